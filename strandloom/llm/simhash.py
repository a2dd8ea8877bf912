"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by shards of BK-trees.

Two fingerprints within radius r agree on at least two of r + 2 blocks of their bits. So each is dealt to a shard for every
pair of blocks and their values: all links lie within shards, no shard sees more than its own fingerprints, and their
number grows with the fingerprints alone. A shard's fingerprints go into a BK-tree one by one, each first finding what
lies within the radius. A large shard is cut into parts, whose pairs are then worked on apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import by_bytes, free_name, record_batch, text_or_empty, written
from strandloom.llm.components import connected_components

SEED = 42
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PART = 2000
FINGERPRINT = "doc_id long, fp long"


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of all words if they are fewer; none for no words."""
    parts = text.encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - words].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; zero if there are none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, words: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text"):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column("__text").to_pylist()], np.uint64)
            yield record_batch({"doc_id": batch.column("__id"), "fp": fps.view(np.int64)}, schema)

    return df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, FINGERPRINT)


class BkTree:
    """Children are keyed by their integer Hamming distance to the parent; a search follows the edges within the radius only."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> Iterator[int]:
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield self.values[node]
            edges = self.children[node]
            if edges:
                todo += [child for edge, child in edges.items() if d - radius <= edge <= d + radius]

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, node = len(self.values) - 1, 0
        while node != new:
            d = (self.values[node] ^ value).bit_count()
            node = self.children[node].setdefault(d, new)


def _tops(values: list[int]) -> dict[int, int]:
    return {v: v for v in values}


def _top(tops: dict[int, int], v: int) -> int:
    while tops[v] != v:
        tops[v] = tops[tops[v]]
        v = tops[v]
    return v


def shard_links(first: list[int], second: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within the radius of each other: a spanning forest of all links inside first (second empty) or
    between the two parts, so that n alike fingerprints give n - 1 links."""
    tree, tops, links = BkTree(), _tops([*first, *second]), []

    def join(v: int) -> None:
        for other in tree.search(v, radius):
            x, y = _top(tops, v), _top(tops, other)
            if x != y:
                tops[max(x, y)] = min(x, y)
                links.append((v, other))

    for v in first:
        if not second:
            join(v)
        tree.add(v)
    for v in second:
        join(v)
    return links


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of so many blocks of the 64 bits."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


WORK = ["pair", "key", "i", "j"]


def _in_parts(dealt: DataFrame, item: str, part: int, part_bytes: int | None = None) -> DataFrame:
    """Of rows (item, pair, key): pair, key, i, j, second and item, with each shard of two items or more cut into parts.

    A row of part p takes part in the works (p, j) as first and (i, p) as second; in (p, p) it meets its own part.
    With part_bytes, a part holds about so many bytes at most, as column bytes gives them.
    """
    parts = F.ceil(F.col("count") / part)
    if part_bytes:
        sizes = dealt.groupBy("pair", "key").agg(F.count("*").alias("count"), F.sum("bytes").alias("sum"))
        parts = F.greatest(parts, F.ceil(F.col("sum") / part_bytes))
    else:
        sizes = dealt.groupBy("pair", "key").count()
    dealt = dealt.join(sizes.filter(F.col("count") > 1), ["pair", "key"]).withColumn("parts", parts.cast("int"))
    dealt = dealt.withColumn("own_part", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("pair", "key", F.least("own_part", "other").alias("i"), F.greatest("own_part", "other").alias("j"), (F.col("own_part") > F.col("other")).alias("second"), item)


def near_links(fps: DataFrame, radius: int, part: int = PART) -> DataFrame:
    """(a, b): links within the radius that join what all such links join, among distinct fingerprints in column fp.

    A shard of more than part fingerprints is dealt into parts by hash, and each pair of parts is a task's work of
    its own, so that no shard is too large for a task.
    """
    blocks = _blocks(radius + 2)
    value = lambda shift, bits: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1))
    keys = [
        F.struct(F.lit(n).alias("pair"), (value(*x) * (1 << y[1]) + value(*y)).alias("key"))
        for n, (x, y) in enumerate(combinations(blocks, 2))
    ]
    dealt = _in_parts(fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.pair", "k.key"), "fp", part)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple[int, int]] = []
        now, first, second = None, [], []
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        for pdf in batches:
            for pair, key, i, j, late, fp in pdf.itertuples(index=False):
                if (pair, key, i, j) != now:
                    if now is not None and (now[2] == now[3] or second):
                        links += shard_links(first, second, radius)
                    now, first, second = (pair, key, i, j), [], []
                (second if late else first).append(int(fp) & 0xFFFFFFFFFFFFFFFF)
            if len(links) > 20_000:
                yield pd.DataFrame([(signed(a), signed(b)) for a, b in links], columns=["a", "b"])
                links = []
        if now is not None and (now[2] == now[3] or second):
            links += shard_links(first, second, radius)
        yield pd.DataFrame([(signed(a), signed(b)) for a, b in links], columns=["a", "b"], dtype="int64")

    return dealt.repartition(*WORK).sortWithinPartitions(*WORK, "second", "fp").mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5, radius: int = 4, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed long) and component_id (the smallest id that links reach, its own included) for every row.

    Texts are lower-cased in ASCII and cut at ASCII blanks; fewer words than a shingle's are one shingle; no words give
    fingerprint zero, linked like any other. A null text counts as empty, a null id takes part as no smallest one (null
    if its component has no other). Equal fingerprints are one from the start, so copies cost no links. An empty table
    gives an empty one; other columns are left out.
    """
    docs = written(fingerprints(df, words, text_col, id_col), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(near_links(distinct.select("fp"), radius)).withColumnRenamed("id", "fp")
    joined = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "component").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", "fp", "component_id")


SKETCH = 128
SHARDS = 12
PART_BYTES = 16 << 20
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SIGNATURE = "doc_id long, own long, fp long, sketch binary, keys array<long>"


def signature(text: str, words: int) -> tuple[int, int, bytes, list[int]]:
    """Hash of the set of shingles, the set's fingerprint, a byte of each of 128 minima of the shingles under different hashes, and shard keys.

    Each key hashes two minima of its own. Texts of similarity s share a given key with probability s^2: of 12, at least one in all
    but 5 of a million pairs at 0.8.
    """
    kinds = np.unique(shingle_hashes(text, words))
    fp = fingerprint(kinds)
    own = xxhash.xxh64_intdigest(kinds.tobytes(), SEED)
    if not len(kinds):
        return own, fp, bytes(SKETCH), [0] * SHARDS
    least = np.array([(kinds * odd).min() for odd in _ODD]) if len(kinds) > 64 else (kinds[:, None] * _ODD[None, :]).min(0)
    keys = [xxhash.xxh64_intdigest(least[2 * i : 2 * i + 2].tobytes(), i) for i in range(SHARDS)]
    mixed = least * np.uint64(0x9E3779B97F4A7C15)
    return own, fp, (mixed >> np.uint64(56)).astype(np.uint8).tobytes(), keys


def signatures(df: DataFrame, words: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("own", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("keys", pa.list_(pa.int64()))])
    signed = lambda v: v - (1 << 64) if v >> 63 else v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text"):
            rows = [signature(t, words) for t in batch.column("__text").to_pylist()]
            yield record_batch(
                {"doc_id": batch.column("__id"), "own": [signed(r[0]) for r in rows], "fp": [signed(r[1]) for r in rows], "sketch": [r[2] for r in rows], "keys": [[signed(k) for k in r[3]] for r in rows]},
                schema,
            )

    return df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, SIGNATURE)


def shingle_sets(df: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """own and kinds, the sorted hashes of the set of shingles as bytes, of each row."""
    schema = pa.schema([("own", pa.int64()), ("kinds", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text"):
            kinds = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column("__text").to_pylist()]
            own = np.array([xxhash.xxh64_intdigest(k, SEED) for k in kinds], np.uint64)
            yield record_batch({"own": own.view(np.int64), "kinds": kinds}, schema)

    return df.select(text_or_empty(text_col).alias("__text")).mapInArrow(run, "own long, kinds binary")


def least_agreeing(similarity: float) -> float:
    """How many bytes of two sketches agree at least, but for some two in ten million pairs of that similarity."""
    p = similarity + (1 - similarity) / 256
    return SKETCH * p - 5.5 * (SKETCH * p * (1 - p)) ** 0.5


def candidate_links(distinct: DataFrame, radius: int, similarity: float, part: int = PART) -> DataFrame:
    """(a, b): links that join what may be alike among column own of distinct signatures.

    Shards are those that share a key. In each, a BK-tree finds what lies within the radius, and the sketches leave out what
    agrees in too few bytes to be as similar.
    """
    dealt = _in_parts(distinct.select("own", F.posexplode("keys").alias("pair", "key")), "own", part)
    dealt = dealt.join(distinct.select("own", "fp", "sketch"), "own").select(*WORK, "second", "own", "fp", "sketch")
    least = least_agreeing(similarity)

    def links_of(first: list[tuple], second: list[tuple]) -> list[tuple[int, int]]:
        """Links that join what is alike among the rows of both parts; a search ends where all earlier rows are joined already."""
        rows = [*first, *second]
        sketches = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), SKETCH)
        tree, tops, links = BkTree(), {i: i for i in range(len(rows))}, []
        at: dict[int, list[int]] = {}
        groups = 0  # of the rows before this one
        for n, (own, fp, _) in enumerate(rows):
            joined = 0
            for value in tree.search(fp, radius):
                for i in at[value]:
                    x, y = _top(tops, i), _top(tops, n)
                    if x != y and np.count_nonzero(sketches[i] == sketches[n]) >= least:
                        tops[max(x, y)] = min(x, y)
                        links.append((rows[i][0], own))
                        joined += 1
                if joined == groups:
                    break
            groups += 1 - joined
            if fp not in at:
                tree.add(fp)
            at.setdefault(fp, []).append(n)
        return links

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple[int, int]] = []
        now, first, second = None, [], []
        for pdf in batches:
            for pair, key, i, j, late, own, fp, sketch in pdf.itertuples(index=False):
                if (pair, key, i, j) != now:
                    if now is not None and (now[2] == now[3] or second):
                        links += links_of(first, second)
                    now, first, second = (pair, key, i, j), [], []
                (second if late else first).append((own, int(fp) & 0xFFFFFFFFFFFFFFFF, sketch))
        if now is not None and (now[2] == now[3] or second):
            links += links_of(first, second)
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.repartition(*WORK).sortWithinPartitions(*WORK, "second", "own").mapInPandas(run, "a long, b long")


def alike_links(sketches: np.ndarray, sets: list[np.ndarray], second: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join what is alike among some sets (the rows from second on against all earlier ones), by exact Jaccard similarity."""
    n = len(sets)
    group, sizes, links, least = np.arange(n), np.array([len(s) for s in sets]), [], least_agreeing(similarity)
    for b in range(max(1, second), n):
        agree = (sketches[:b] == sketches[b]).sum(1)
        small, large = np.minimum(sizes[:b], sizes[b]), np.maximum(sizes[:b], sizes[b])
        todo = np.flatnonzero((agree >= least) & (small >= similarity * large - 1))
        todo = todo[np.argsort(-agree[todo], kind="stable")]
        while len(todo := todo[group[todo] != group[b]]):
            a, todo = int(todo[0]), todo[1:]
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            either = int(sizes[a] + sizes[b]) - both
            if either and both / either >= similarity:
                links.append((a, b))
                group[group == group[b]] = group[a]
    return links


def exact_links(distinct: DataFrame, candidates: DataFrame, sets: DataFrame, similarity: float, part: int = PART, part_bytes: int = PART_BYTES) -> DataFrame:
    """(a, b): links that join all sets (own, kinds) of that Jaccard similarity that lie in one component (id, component) of candidates.

    A small component is one task's work. A large one is dealt to the shards of its members' keys, as a pair of candidates shares one.
    """
    bytes_of = sets.select("own", F.length("kinds").cast("long").alias("bytes"))
    members = written(candidates.withColumnRenamed("id", "own").join(bytes_of, "own"), "members")
    large = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("sum")).filter((F.col("n") > part) | (F.col("sum") > part_bytes)).select("component")
    small = members.join(large, "component", "left_anti").select("own", "bytes", F.lit(-1).alias("pair"), F.col("component").alias("key"))
    keys = distinct.select("own", F.posexplode("keys").alias("pair", "key"))
    wide = members.join(large, "component", "left_semi").join(keys, "own").select("own", "bytes", "pair", F.xxhash64("component", "key").alias("key"))
    dealt = _in_parts(small.unionByName(wide), "own", part, part_bytes)
    dealt = dealt.join(distinct.select("own", "sketch"), "own").join(sets, "own").select(*WORK, "second", "own", "sketch", "kinds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links: list[tuple[int, int]] = []
        now, rows, second = None, [], 0

        def close() -> None:
            if now is None or now[2] != now[3] and second in (0, len(rows)):
                return
            sketches = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), SKETCH)
            found = alike_links(sketches, [np.frombuffer(r[2], np.uint64) for r in rows], second if now[2] != now[3] else 0, similarity)
            links.extend((rows[a][0], rows[b][0]) for a, b in found)

        for pdf in batches:
            for pair, key, i, j, late, own, sketch, kinds in pdf.itertuples(index=False):
                if (pair, key, i, j) != now:
                    close()
                    now, rows, second = (pair, key, i, j), [], 0
                rows.append((own, sketch, kinds))
                second += not late
        close()
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return dealt.repartition(*WORK).sortWithinPartitions(*WORK, "second", "own").mapInPandas(run, "a long, b long")


def keep_one(df: DataFrame, words: int = 5, radius: int = 28, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id is the smallest of their group; groups are what links of similar texts join.

    Two texts are linked if their sets of shingles have that Jaccard similarity or more. Fingerprints and minima only find the
    candidates: at a similarity of 0.8, a pair has fingerprints over 28 bits apart less than once in 100,000. Texts without words are one group, a null text is one. A null id is the smallest. Rows that repeat an id and
    a text stand or fall together. All columns stay, whatever their names; an empty table gives an empty one.
    """
    name = free_name(df, "__key")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    signs = written(signatures(df.withColumn(name, key), words, text_col, name), "signatures")
    distinct = written(signs.groupBy("own").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys")), "distinct")
    candidates = written(connected_components(candidate_links(distinct, radius, similarity)), "candidates")
    least = distinct.join(candidates.select(F.col("id").alias("own")), "own").select(F.col("least").alias(name)).distinct()
    sets = shingle_sets(df.withColumn(name, key).join(least, name, "left_semi"), words, text_col)
    sets = written(sets.join(candidates.select(F.col("id").alias("own")), "own", "left_semi").groupBy("own").agg(F.first("kinds").alias("kinds")), "sets")
    found = connected_components(exact_links(distinct, candidates, sets, similarity)).withColumnRenamed("id", "own")
    joined = distinct.select("own", "least").join(found, "own", "left").withColumn("component", F.coalesce("component", "own"))
    keepers = joined.groupBy("component").agg(F.min("least").alias(name)).select(name).distinct()
    return df.withColumn(name, key).join(keepers, name, "left_semi").drop(name)


def simhash_digest(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row, linked at four bits over shingles of four words.

    A null text counts as empty and has the fingerprint zero, as any text without words; null ids are as in near_duplicates(); an empty table gives an empty one.
    """
    out = near_duplicates(documents, words=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
