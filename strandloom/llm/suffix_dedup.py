"""Removal of long repeated passages: prefix-free parsing, and suffix arrays of its dictionary and its parse in corpus order.

Parsing: a rolling hash over short grams makes triggers: of the grams in a window of 100 bytes the one with the least hash, the
leftmost of equal ones. It depends on the window's bytes only, so equal windows have equal triggers wherever they stand. The
windows on end that share one trigger make a phrase. Phrases overlap by a window's length less one, so each window lies in
one phrase as a whole, and none is another's beginning that goes on.

The parse's suffix array: as no window reaches beyond its phrase, one phrase is all that the order of the parse's suffixes needs
to tell windows apart. parse_order() is that array cut at this depth: phrases by trigger and kind, equal ones by their place
in the corpus. Every place of a phrase but its first is a repeat as a whole, which settles highly repetitive text.

The dictionary's suffix array: the distinct phrases, each at its first place, are dealt to shards by trigger. A shard ranks
its phrases' suffixes at 100 bytes by prefix doubling, and puts equal ones in order of their places: both arrays combined, in
corpus order. All but the first of equal windows are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.common import by_bytes, free_name, record_batch, text_or_empty, written

SPAN = 100
GRAM = 32
BATCH = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BATCH + (1 << 18))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i that has so many."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, trigger's hash, phrase's hash) of each phrase of some texts on end; ends are the texts' ends.

    First windows count from the text's beginning. A phrase with n windows has n + span - 1 bytes. The data must be shorter than
    16 MiB, as a gram's place takes 24 bits; stretches() cuts longer texts.
    """
    if len(data) >= 1 << 24:
        raise ValueError("texts too long to be parsed at once")
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, none, none
    powers, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])
    grams = _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    keys = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    trigger = (_sliding_min(keys, span - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(len(trigger)), side="right")
    good = np.flatnonzero(np.arange(len(trigger)) + span <= ends[np.minimum(text, len(ends) - 1)])
    if not len(good):
        return none, none, none, none, none
    new = np.ones(len(good), bool)
    new[1:] = (np.diff(good) != 1) | (np.diff(trigger[good]) != 0) | (np.diff(text[good]) != 0)
    at = np.flatnonzero(new)
    first = good[at]
    count = np.diff(np.append(at, len(good)))
    whole = _mixed((sums[first + count + span - 1] - sums[first]) * inverse[first] + count.astype(np.uint64))
    place = first - np.concatenate([[0], ends[:-1]])[text[first]]
    return text[first], place, count, grams[trigger[first]].view(np.int64), (whole ^ (trigger[first] - first).astype(np.uint64)).view(np.int64)


def stretches(texts: list[bytes], most: int = BATCH, span: int = SPAN) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text, start, bytes) to be parsed at once. A text of more than that many windows is cut into stretches that overlap
    by a window's length less one, so that each window stands in one of them."""
    cut = [(i, a, t[a : a + most + span - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - span + 1), most)]
    if sum(len(t) for _, _, t in cut) <= most:
        yield cut
    else:
        yield from ([c] for c in cut)


#: A row's document is known by doc (its id; null is the least long) and own (a hash of its text).
LEAST = -(1 << 63)
MOST_IN_SHARD = 20_000
CHUNK = 1 << 20
COUNT_BITS = 8

_KEYS = [("doc", pa.int64()), ("own", pa.int64())]
_PARSE = pa.schema([("h", pa.int64()), ("x", pa.int64()), *_KEYS, ("at", pa.int64()), ("known", pa.int8())])
_PARSE_DDL = "h long, x long, doc long, own long, at long, known byte"
_FOUND = pa.schema([("h", pa.int64()), *_KEYS, ("at", pa.int64()), ("repeat", pa.bool_())])
_RANGES = pa.schema([*_KEYS, ("start", pa.int64()), ("stop", pa.int64())])


def parse(docs: DataFrame) -> DataFrame:
    """A row for each phrase of __text: trigger h, phrase x, document, and at: the first window's place and the windows' number, packed.

    known is 1 for phrases that the stretches at hand hold earlier; those are dealt out by place from here on, so that copies of one text
    don't meet in one task. Rows repeated as a whole are one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH):
            texts = [t.encode() for t in batch.column("__text").to_pylist()]
            ids, own = batch.column("doc").to_numpy(), batch.column("own").to_numpy()
            for parts in stretches(texts):
                part, place, count, h, x = phrases(np.frombuffer(b"".join(t for _, _, t in parts), np.uint8), np.cumsum([len(t) for _, _, t in parts]))
                text, start = (np.array([p[i] for p in parts], np.int64)[part] for i in (0, 1))
                doc, key, at = ids[text], own[text], (start + place) << COUNT_BITS | count
                order = np.lexsort((at, key, doc, x, h))
                h, x, doc, key, at = h[order], x[order], doc[order], key[order], at[order]
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
                again = np.zeros(len(h), bool)
                again[1:] = same[1:] & (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (at[1:] == at[:-1])
                spread = _mixed((doc ^ key).view(np.uint64) + at.view(np.uint64)).view(np.int64)
                keep = np.flatnonzero(~again)
                back = keep[np.lexsort((at[keep], key[keep], doc[keep]))]  # a document's rows together, which shuffles in fewer bytes
                yield record_batch({"h": np.where(same, spread, h)[back], "x": x[back], "doc": doc[back], "own": key[back], "at": at[back], "known": same[back].astype(np.int8)}, _PARSE)

    return docs.select("doc", "own", "__text").mapInArrow(run, _PARSE_DDL)


def parse_order(parsed: DataFrame) -> DataFrame:
    """The parse's suffixes in order of their first phrase and then of the corpus: later places of a phrase (repeat), and first places of phrases whose trigger has other phrases too.

    Streams through each task's rows in order of trigger, phrase and place; it holds one row back, so a trigger of any
    number of rows takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h", "x", "doc", "own", "at")
        before: tuple | None = None  # the last row
        held: tuple | None = None  # the last first place, and whether its trigger is known to be shared

        def out(h, doc, own, at, repeat) -> pa.RecordBatch:
            return record_batch({"h": h, "doc": doc, "own": own, "at": at, "repeat": np.full(len(h), repeat)}, _FOUND)

        for batch in batches:
            known = batch.column("known").to_numpy().astype(bool)
            c = {n: batch.column(n).to_numpy() for n in names}
            if known.any():
                yield out(c["h"][known], c["doc"][known], c["own"][known], c["at"][known], True)
                c = {n: v[~known] for n, v in c.items()}
            if not len(c["h"]):
                continue
            old = {n: np.concatenate([[before[i] if before else ~v[0]], v[:-1]]) for i, (n, v) in enumerate(c.items())}
            same_x = (c["h"] == old["h"]) & (c["x"] == old["x"])
            again = same_x & (c["doc"] == old["doc"]) & (c["own"] == old["own"]) & (c["at"] == old["at"])
            before = tuple(c[n][-1] for n in names)
            later = same_x & ~again
            yield out(*(c[n][later] for n in ("h", "doc", "own", "at")), True)
            first = [c[n][~same_x] for n in ("h", "doc", "own", "at")]
            shared_before = False
            if held:
                first = [np.concatenate([[a], b]) for a, b in zip(held[0], first)]
                shared_before = held[1]
            if not len(first[0]):
                continue
            shared = np.zeros(len(first[0]), bool)
            equal = first[0][1:] == first[0][:-1]
            shared[1:] |= equal
            shared[:-1] |= equal
            shared[0] |= shared_before
            held = tuple(v[-1] for v in first), bool(shared[-1])
            yield out(*(v[:-1][shared[:-1]] for v in first), False)
        if held and held[1]:
            yield out(*(np.array([v]) for v in held[0]), False)

    rows = parsed.repartition("h").sortWithinPartitions("h", "x", "doc", "own", "at")
    return rows.mapInArrow(run, "h long, doc long, own long, at long, repeat boolean")


def packed(documents: DataFrame) -> DataFrame:
    """doc, own and z, the text in compressed bytes: what joins by document shuffle."""
    schema = pa.schema([*_KEYS, ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in by_bytes(batches, "__text"):
            yield record_batch({"doc": batch.column("doc"), "own": batch.column("own"), "z": [press.compress(t.encode()) for t in batch.column("__text").to_pylist()]}, schema)

    return documents.select("doc", "own", "__text").mapInArrow(run, "doc long, own long, z binary")


def phrase_texts(documents: DataFrame, shared: DataFrame) -> DataFrame:
    """The shared phrases with their bytes: h, doc, own, at, bytes. Each text is opened once for all its phrases; of no phrases come no rows.

    The join shuffles at any size: so no task runs two Python workers, one after the other's rows.
    """
    schema = pa.schema([("h", pa.int64()), *_KEYS, ("at", pa.int64()), ("bytes", pa.binary())])
    asked = shared.groupBy("doc", "own").agg(F.collect_list(F.struct("h", "at")).alias("asked"))
    rows = packed(documents).join(asked.hint("merge"), ["doc", "own"]).select("doc", "own", "z", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, own, z, asked in zip(*(batch.column(n).to_pylist() for n in ("doc", "own", "z", "asked"))):
                text = press.decompress(z)
                at = [a["at"] for a in asked]
                cut = [text[a >> COUNT_BITS : (a >> COUNT_BITS) + (a & ((1 << COUNT_BITS) - 1)) + SPAN - 1] for a in at]
                yield record_batch({"h": [a["h"] for a in asked], "doc": [doc] * len(at), "own": [own] * len(at), "at": at, "bytes": cut}, schema)

    return rows.mapInArrow(run, "h long, doc long, own long, at long, bytes binary")


def dictionary_ranks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rank of the 100 bytes from each start among all of them, by prefix doubling: a suffix array cut at that depth.

    Ranks of 8 bytes give those of 16, 32 and 64; two of 64 that overlap give those of 100. data must reach 100 bytes beyond each start.
    """
    padded = np.concatenate([data, np.zeros(SPAN, np.uint8)])
    words = np.zeros(len(data), np.uint64)
    for i in range(8):
        words = words << np.uint64(8) | padded[i : i + len(data)].astype(np.uint64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    for step in (8, 16, 32):
        onward = np.concatenate([rank[step:], np.zeros(min(step, len(rank)), np.int64)])
        rank = np.unique(rank << 32 | onward, return_inverse=True)[1].astype(np.int64)
    return np.unique(rank[starts] << 32 | rank[starts + SPAN - 64], return_inverse=True)[1]


def shard_repeats(doc: np.ndarray, own: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, own, start, stop) of what the windows of some phrases repeat of earlier ones: the dictionary's ranks combined with the
    phrases' places put the windows in corpus order, and all but the first of equal rank are repeats."""
    count, place = at & ((1 << COUNT_BITS) - 1), at >> COUNT_BITS
    size = count + SPAN - 1
    begin = np.cumsum(size) - size
    phrase = np.repeat(np.arange(len(at)), count)
    inner = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count)
    rank = dictionary_ranks(np.frombuffer(b"".join(texts), np.uint8), begin[phrase] + inner)
    start = place[phrase] + inner
    order = np.lexsort((start, own[phrase], doc[phrase], rank))
    late = np.zeros(len(order), bool)
    late[order[1:]] = rank[order[1:]] == rank[order[:-1]]
    hit = np.flatnonzero(late)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 4
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (np.diff(phrase[hit]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    p = phrase[hit[first]]
    return doc[p], own[p], start[hit[first]], start[hit[last]] + SPAN


def shared_repeats(texts: DataFrame) -> DataFrame:
    """(doc, own, start, stop): repeats between the phrases of each trigger. A task sorts the suffixes of a few triggers' phrases at a time. Nothing in texts is null; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            doc, own, at = (rows.column(n).to_numpy() for n in ("doc", "own", "at"))
            return record_batch(dict(zip(_RANGES.names, shard_repeats(doc, own, at, rows.column("bytes").to_pylist()))), _RANGES)

        size = 0
        for batch in by_bytes(batches, "bytes", CHUNK):
            waiting.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                rows = pa.Table.from_batches(waiting)
                h = rows.column("h").to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last trigger may go on
                if cut:
                    yield out(rows.slice(0, cut))
                    waiting = rows.slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in waiting)
        if waiting:
            yield out(pa.Table.from_batches(waiting))

    return texts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "doc long, own long, start long, stop long")


def hot_repeats(texts: DataFrame) -> DataFrame:
    """The same for triggers with too many phrases for a task: their windows are dealt out by a hash of 128 bits of each window. Nothing in texts is null; an empty table gives an empty one."""
    schema = pa.schema([("w", pa.binary()), *_KEYS, ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "bytes", CHUNK // 8):
            rows: list[tuple] = []
            for doc, own, at, text in zip(*(batch.column(n).to_pylist() for n in ("doc", "own", "at", "bytes"))):
                rows += [(xxhash.xxh3_128_digest(text[i : i + SPAN]), doc, own, (at >> COUNT_BITS) + i) for i in range(at & ((1 << COUNT_BITS) - 1))]
            yield record_batch(dict(zip(schema.names, zip(*rows))), schema)

    windows = texts.mapInArrow(run, "w binary, doc long, own long, start long")
    first = windows.groupBy("w").agg(F.min(F.struct("doc", "own", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    late = windows.join(first, "w").filter(F.struct("doc", "own", "start") != F.col("first"))
    return late.select("doc", "own", "start", (F.col("start") + SPAN).alias("stop"))


def repeated_ranges(documents: DataFrame) -> DataFrame:
    """(doc, own, start, stop): byte ranges, overlapping ones among them, that together are what repeats."""
    found = written(parse_order(parse(documents)), "phrases")
    shared = found.filter("not repeat").select("h", "doc", "own", "at")
    sizes = shared.groupBy("h").count().filter(F.col("count") > MOST_IN_SHARD).select("h")
    hot = written(sizes, "hot")
    texts = written(phrase_texts(documents, shared), "shared")
    place, count = F.shiftright("at", COUNT_BITS), F.col("at").bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    whole = found.filter("repeat").select("doc", "own", place.alias("start"), (place + count + SPAN - 1).alias("stop"))
    ranges = whole.unionByName(shared_repeats(texts.join(hot, "h", "left_anti")))
    return ranges.unionByName(hot_repeats(texts.join(hot, "h", "left_semi"))) if not hot.isEmpty() else ranges


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(r) for r in out]


def _known(doc: Column, text: Column) -> tuple[Column, Column]:
    """A document's id, null as the least long, and a hash of its text."""
    return F.coalesce(doc.cast("long"), F.lit(LEAST)), F.xxhash64(text)


def _prepared(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    text = text_or_empty(f"`{text_col}`")
    doc, own = _known(F.col(f"`{id_col}`"), text)
    return documents.select(doc.alias("doc"), own.alias("own"), text.alias("__text"))


def _ranges_of(documents: DataFrame) -> DataFrame:
    return repeated_ranges(documents).groupBy("doc", "own").agg(F.collect_list(F.struct("start", "stop")).alias("ranges")).hint("merge")


def _cut(documents: DataFrame, ddl: str, schema: pa.Schema, row) -> DataFrame:
    """row(doc, text, merged ranges) for each document."""
    rows = packed(documents).join(_ranges_of(documents), ["doc", "own"], "left").select("doc", "z", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in by_bytes(batches, "z", 1 << 20):
            made = [row(doc, press.decompress(z), _merged(r or [])) for doc, z, r in zip(*(batch.column(n).to_pylist() for n in ("doc", "z", "ranges")))]
            yield record_batch(dict(zip(schema.names, zip(*made))), schema)

    return rows.mapInArrow(run, ddl)


def _rest(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for r in ranges for x in r), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _id(doc: int) -> int | None:
    return None if doc == LEAST else doc


def remove_repeats(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, kept (binary), n_bytes, removed array<struct<start, stop>> in bytes of the text, for every row.

    Each byte goes that a string of SPAN bytes covers which also starts earlier: in a smaller doc_id (null comes first), in
    the same text, or, of rows that share a doc_id, in the text with the smaller hash. Rows that repeat both id and text
    are one document, and have the same result. A null text counts as empty; texts shorter than SPAN stay whole; an empty
    table gives an empty one; other columns are left out. Strings are judged on the texts as they come.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    row = lambda doc, text, ranges: (_id(doc), _rest(text, ranges), len(text), [{"start": a, "stop": b} for a, b in ranges])
    return _cut(_prepared(documents, text_col, id_col), "doc_id long, kept binary, n_bytes long, removed array<struct<start:long,stop:long>>", schema, row)


def suffix_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, as remove_repeats() has it; a null doc_id stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    row = lambda doc, text, ranges: (_id(doc), len(text), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(_rest(text, ranges)).hexdigest())
    return _cut(_prepared(documents), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", schema, row)


def with_repeats_removed(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """documents with the repeats taken out of the text; n_chars, if there is one, counts what is left.

    A null text stays null. What is left of a character that a cut went through goes too. Repeats are as in remove_repeats().
    All other columns stay as they are, whatever their names; an empty table gives an empty one.
    """
    names = [free_name(documents, n) for n in ("__doc", "__own", "__ranges")]
    doc, own = _known(F.col(f"`{id_col}`"), text_or_empty(f"`{text_col}`"))
    text = F.col(f"`{text_col}`")

    @F.pandas_udf("string")
    def rest(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([t if r is None or t is None else _rest(t.encode(), _merged(r)).decode("utf-8", "ignore") for t, r in zip(texts, ranges)], dtype="object")

    of = _ranges_of(_prepared(documents, text_col, id_col)).select(*[F.col(c).alias(n) for c, n in zip(("doc", "own", "ranges"), names)]).hint("merge")
    joined = documents.withColumn(names[0], doc).withColumn(names[1], own).join(of, names[:2], "left").withColumn(text_col, rest(text, F.col(names[2])))
    if "n_chars" in documents.columns:
        joined = joined.withColumn("n_chars", F.length(text).cast("long"))
    return joined.select(*[F.col(f"`{c}`") for c in documents.columns])
