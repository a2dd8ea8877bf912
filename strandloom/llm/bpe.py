"""Byte-level BPE: an encoder that backtracks over longest matches, and a decoder with an offset table.

encode_bytes() gives exactly the merges' result in time linear in the bytes: an Aho-Corasick automaton finds the longest
token at each place, a table of compatible pairs says whether two tokens may stand side by side, and where none may,
the encoder steps back to the next shorter match.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import by_bytes, record_batch, text_or_empty

MOST_CACHED = 600_000
#: Fixed pattern of this vocabulary's words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def byte_chars() -> dict[str, int]:
    """The vocabulary file's character for each byte: printable Latin-1 as itself, the others from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        raw = lambda token: bytes(chars[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (1 + max(*vocab.values(), *self.special.values()))
        for token, i in vocab.items():
            self.tokens[i] = raw(token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.merged[pair] = rank, made
            self.split.setdefault(made, pair)
        self.rank_of = {made: rank for rank, made in reversed(self.merged.values())}
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(raw(token).decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.tokens]
        self.by_bytes = {self.tokens[i]: i for i in vocab.values()}
        #: The longest token that is a proper prefix of a token: where the encoder goes when it steps back.
        self.shorter: dict[int, int] = {}
        for token, i in self.by_bytes.items():
            self.shorter[i] = next((self.by_bytes[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.by_bytes), -1)
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORDS)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.tokens])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.ids_of: dict[str, bytes] = {}
        self.ids_of_word: dict[str, list[int]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave two tokens standing side by side.

        Undoes the merges that made the two, latest first; if the parts that then meet would have merged before, the two
        never stand together. Where both sides' merges have one rank, the one to the left comes first.
        """
        known = self.compatible.get((left, right))
        if known is not None:
            return known
        a, b, before, answer = left, right, len(self.merged) + 1, True
        while answer:
            if self.merged.get((a, b), (before,))[0] < before:
                answer = False
            rank_a, rank_b = self.rank_of.get(a, -1), self.rank_of.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                break
            if rank_a > rank_b:
                before, a = rank_a, self.split[a][1]
            else:
                before, b = rank_b + 1, self.split[b][0]
        if len(self.compatible) > 1_000_000:
            self.compatible.clear()
        self.compatible[left, right] = answer
        return answer

    def encode_bytes(self, word: bytes) -> list[int]:
        whole = self.by_bytes.get(word)
        if whole is not None:
            return [whole]
        size, sizes, shorter, compatible = len(word), self.sizes, self.shorter, self.compatible
        best = [-1] * size  # the longest token from each place
        for end, i in self.automaton.iter(word.decode("latin-1")):
            start = end + 1 - sizes[i]
            if best[start] < 0 or sizes[i] > sizes[best[start]]:
                best[start] = i
        ids: list[int] = []
        dead: set[int] = set()  # places that no encoding can go through
        at, now, last = 0, best[0], -1
        while at < size:
            while now >= 0:
                end = at + sizes[now]
                if end not in dead:
                    if last < 0:
                        break
                    fit = compatible.get((last, now))
                    if self.fits(last, now) if fit is None else fit:
                        break
                now = shorter[now]
            if now >= 0:
                ids.append(now)
                at, last = end, now
                now = best[at] if at < size else -1
            else:
                dead.add(at)
                gone = ids.pop()
                at -= sizes[gone]
                last = ids[-1] if ids else -1
                now = shorter[gone]
        return ids

    def word_ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for word in self.words.findall(text):
            known = self.ids_of_word.get(word)
            if known is None:
                known = self.ids_of_word[word] = self.encode_bytes(word.encode())
            ids += known
        return ids

    def learn(self, pieces: set[str]) -> None:
        """Encodes pieces of text that stand after a blank. A piece that is empty or begins or ends with a blank has no ids of
        its own, as its words depend on what follows; the tables start anew when they are full."""
        if len(self.ids_of) + len(pieces) > MOST_CACHED:
            self.ids_of.clear()
        if len(self.ids_of_word) > MOST_CACHED:
            self.ids_of_word.clear()
        for p in pieces:
            if p and not p[0].isspace() and not p[-1].isspace():
                self.ids_of[p] = array("I", self.word_ids(" " + p)).tobytes()

    def plain(self, text: str) -> list[int]:
        """Ids of text without special tokens' strings."""
        return [i for w in self.words.findall(text) for i in self.encode_bytes(w.encode())]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: each id's bytes lie between its offset and the next; broken UTF-8 becomes U+FFFD."""
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)
        return self.blob[place].tobytes().decode("utf-8", "replace")


@cache
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode_text(coder: Bpe, text: str) -> np.ndarray:
    """Ids of a text; a special token's string in it is that token.

    Words end before a blank that follows no blank. So the pieces between single blanks are looked up, and only new ones encoded.
    """
    if any(s in text for s in coder.special):
        ids: list[int] = []
        for part in coder.apart.split(text):
            ids += [coder.special[part]] if part in coder.special else coder.plain(part)
        return np.array(ids, np.int64)
    first, *rest = text.split(" ")
    try:
        found = b"".join(map(coder.ids_of.get, rest))
    except TypeError:
        new = {p for p in rest if p not in coder.ids_of}
        coder.learn(new)
        try:
            found = b"".join(map(coder.ids_of.get, rest))
        except TypeError:  # blanks side by side
            return np.array(coder.plain(text), np.int64)
    if first[-1:].isspace():
        return np.array(coder.plain(text), np.int64)
    return np.concatenate([np.array(coder.word_ids(first), np.int64), np.frombuffer(found, np.uint32)])


def tokenize(df: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) of each row's whole text.

    Ids are those that merging by rank gives, special tokens' strings included; decoded is the text that the ids spell.
    A null text counts as empty: no ids. Rows stand for themselves; an empty table gives an empty one; other columns
    are left out. A task keeps ids of so many pieces of text at most, which changes no result.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    arrow = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(vocabulary)
        for batch in by_bytes(batches, "__text", 2 << 20):
            found = [encode_text(coder, t) for t in batch.column("__text").to_pylist()]
            columns = {
                "doc_id": batch.column("__id"),
                "n_tokens": [len(ids) for ids in found],
                "ids_sha256": [hashlib.sha256(str(ids.tolist())[1:-1].replace(" ", "").encode()).hexdigest() for ids in found],
                "decoded_sha256": [hashlib.sha256(coder.decode(ids).encode()).hexdigest() for ids in found],
            }
            yield record_batch(columns | ({"ids": found} if with_ids else {}), arrow)

    return df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, ddl)
