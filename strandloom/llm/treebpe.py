"""Byte-level BPE as a tree: the encoding of two halves is joined from theirs.

Token sequences form a monoid. Its element for a string is that string's encoding, and two neighbours are joined by encoding
anew a window around their boundary only. Merging by rank leaves a sequence standing if and only if it leaves each pair of
neighbouring tokens in it standing, so the tokens outside the window are final once the pairs at its two edges stand; until
then the window doubles. Decoding joins the tokens' bytes up a tree in the same way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import by_bytes, record_batch, text_or_empty

#: Words, pieces between blanks and pairs of tokens whose ids a task keeps; full tables start anew.
MOST_KEPT = 500_000
#: Characters of a word or piece that is kept at most.
MOST_LONG = 200
#: Characters of a text that are encoded at once.
PIECE = 1 << 20
#: Parts that a node of the decoder's tree joins.
FAN_IN = 256


class TreeBpe:
    """Encoder and decoder of one file of ranks (a token in base64 and its id on each line) and one pattern of words."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern)
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.leaves: dict[bytes, list[int] | None] = {}
        self.words: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of a window by merging from single bytes: the neighbours of least rank first, of equal ones the leftmost."""
        ranks, size = self.ranks, len(data)
        ends = list(range(1, size + 1))  # where the part that begins here ends; parts merged into others are None
        before = list(range(-1, size - 1))
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if middle is None or middle >= size or ends[middle] != end:
                continue  # one of the two has grown since
            ends[i], ends[middle] = end, None
            if end < size:
                before[end] = i
                if (r := ranks.get(data[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i and (r := ranks.get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        ids, i = [], 0
        while i < size:
            ids.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return ids

    def pair(self, a: int, b: int) -> list[int]:
        """Ids of two tokens' joint bytes: the two themselves if they may stand side by side."""
        if len(self.pairs) > MOST_KEPT:
            self.pairs.clear()
        found = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b])
        return found

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two strings in a row from the encodings of each."""
        if not left or not right:
            return left or right
        window = self.pairs.get((left[-1], right[0])) or self.pair(left[-1], right[0])
        if window[0] == left[-1] and len(window) == 2:
            return left + right
        wide = 1
        while True:
            a, b = max(len(left) - wide, 0), min(wide, len(right))
            if wide > 1:
                window = self.merged(self.decoded(left[a:] + right[:b]))
            if (a == 0 or self.stands(left[a - 1], window[0])) and (b == len(right) or self.stands(window[-1], right[b])):
                return left[:a] + window + right[b:]
            wide *= 2

    def stands(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b)) or self.pair(a, b)
        return len(found) == 2 and found[0] == a

    def leaf(self, data: bytes) -> list[int] | None:
        """The token that data is, if merging from bytes makes it; a file of ranks may hold tokens that merging never makes."""
        try:
            return self.leaves[data]
        except KeyError:
            rank = self.ranks.get(data)
            if rank is None:
                return None
            found = self.leaves[data] = [rank] if self.merged(data) == [rank] else None
            return found

    def encoded(self, data: bytes) -> list[int]:
        """Ids of one word: its halves' encodings, down to tokens, joined."""
        if (whole := self.leaf(data)) is not None:
            return whole
        half = len(data) // 2
        return self.joined(self.encoded(data[:half]), self.encoded(data[half:]))

    def word(self, word: str) -> bytes:
        """The ids of one match of the pattern, packed; a word that is a token is that token."""
        data = word.encode()
        whole = self.ranks.get(data)
        packed = array("I", self.encoded(data) if whole is None else [whole]).tobytes()
        if len(self.words) > MOST_KEPT:
            self.words.clear()
        if len(word) <= MOST_LONG:
            self.words[word] = packed
        return packed

    def matches(self, text: str) -> bytes:
        """Packed ids of all matches in text, each encoded separately."""
        kept = self.words
        return b"".join([kept.get(w) or self.word(w) for w in self.pattern.findall(text)])

    def encode(self, text: str) -> bytes:
        """Packed unsigned 32-bit ids of a text.

        A match ends before a blank that follows no blank, so what stands between single blanks is looked up as a whole and only what is new is matched.
        """
        first, *rest = text.split(" ")
        kept = self.after_blank
        try:
            found = b"".join(map(kept.__getitem__, rest))
        except KeyError:
            new = {p for p in rest if p not in kept}
            if len(kept) + len(new) > MOST_KEPT:
                kept.clear()
                new = set(rest)
            if not all(p and len(p) <= MOST_LONG and not p[0].isspace() and not p[-1].isspace() for p in new):
                return self.matches(text)  # blanks side by side
            for p in new:
                kept[p] = self.matches(" " + p)
            found = b"".join(map(kept.__getitem__, rest))
        return self.matches(text) if first[-1:].isspace() else self.matches(first) + found

    def decoded(self, ids) -> bytes:
        """The bytes of ids: those of neighbours are joined level by level."""
        parts = list(map(self.tokens.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + FAN_IN]) for i in range(0, len(parts), FAN_IN)]
        return parts[0] if parts else b""


@cache
def tree_bpe(path: str, pattern: str) -> TreeBpe:
    return TreeBpe(path, pattern)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cuts text where a blank follows what is none, the first such place beyond each size characters: no match spans it, as
    the pattern allows a blank at a match's beginning or beside other blanks only, and looks at nothing before a match."""
    start = 0
    while len(text) - start > size:
        found = regex.compile(r"\S(?=\s)").search(text, start + size - 1)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


def tree_tokenize(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (the decoded bytes) and, if asked for, ids (array<int>) of each row's whole text.

    A null text counts as empty: no ids, the digest of no bytes. A null id stays null. Rows stand for themselves, repeated
    ones too; an empty table gives an empty one; other columns are left out, whatever their names. Long texts are encoded and decoded piece by piece; a
    task keeps the ids of so many words at most, which changes no result.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    arrow = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if with_ids else fields)
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tree_bpe(vocabulary, pattern)
        for batch in by_bytes(batches, "__text", 2 << 20):
            columns: dict = {name: [] for name, _ in fields[1:]} | ({"ids": []} if with_ids else {})
            for text in batch.column("__text").to_pylist():
                n, of_ids, of_text, kept = 0, hashlib.sha256(), hashlib.sha256(), array("I")
                for piece in pieces(text):
                    packed = coder.encode(piece)
                    ids = array("I", packed)
                    n += len(ids)
                    of_ids.update(packed)
                    of_text.update(coder.decoded(ids))
                    if with_ids:
                        kept += ids
                columns["n_tokens"].append(n)
                columns["ids_sha256"].append(of_ids.hexdigest())
                columns["decoded_sha256"].append(of_text.hexdigest())
                if with_ids:
                    columns["ids"].append(kept.tolist())
            yield record_batch({"doc_id": batch.column("__id")} | columns, arrow)

    return df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, ddl)
