"""Importance resampling of documents towards a target: hashed counts of words on both sides weigh each document.

Features are written once as packed streams of uint16 buckets with each document's offset. Counts come from sorting these
streams and run-length encoding them, weights later from gathering the buckets' gains and summing between the offsets.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import by_bytes, record_batch, text_or_empty, written

#: Each byte of a text as it counts in words: A-Z in lower case, digits, a-z and all bytes beyond ASCII as they are, others as blanks.
AS_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Words whose buckets a task keeps; a full table starts anew.
MOST_KEPT = 1_000_000


def features(words: list[bytes], most: int) -> list[bytes]:
    """All runs of 1 to most words in a row, joined by a blank."""
    if most == 1:
        return words
    return [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def bucket_streams(df: DataFrame, text_col: str, id_col: str | None, most: int, buckets: int) -> DataFrame:
    """ids, words (numbers of words), offsets (a document's first feature, and the end of the last one's) and stream (packed uint16): a row
    holds the documents of about 4 MB of text."""
    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("stream", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in by_bytes(batches, "__text"):
            n_words, offsets, parts = [], [0], []
            for text in batch.column("__text").to_pylist():
                words = text.encode().translate(AS_WORD).split()
                found = features(words, most)
                try:
                    part = np.fromiter(map(kept.__getitem__, found), np.uint16, len(found))
                except KeyError:
                    if len(kept) > MOST_KEPT:
                        kept.clear()
                    for f in set(found):
                        kept[f] = zlib.crc32(f) % buckets
                    part = np.fromiter(map(kept.__getitem__, found), np.uint16, len(found))
                n_words.append(len(words))
                offsets.append(offsets[-1] + len(found))
                parts.append(part.astype("<u2").tobytes())
            yield record_batch({"ids": [batch.column("__id").to_pylist()], "words": [n_words], "offsets": [offsets], "stream": [b"".join(parts)]}, arrow)

    own = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return df.select(own.alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, "ids array<long>, words array<long>, offsets array<long>, stream binary")


def sort_counts(streams: DataFrame) -> DataFrame:
    """bucket and n over all streams: each stream is sorted and run-length encoded in its task; the runs' lengths are summed before and after the shuffle by bucket."""
    arrow = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("stream"):
                found = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                first = np.flatnonzero(np.diff(found, prepend=-1)) if len(found) else np.zeros(0, np.int64)
                yield record_batch({"bucket": found[first].astype(np.int32), "n": np.diff(first, append=len(found))}, arrow)

    return streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Each bucket's floor(1000 ln(target's share / source's share)), with one more count in each bucket."""
    s_all, t_all = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    share = lambda b: (target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A Gumbel variate in thousandths, drawn from the document's id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(streams: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_features, weight, score and n_words of each document of the streams."""
    fields = ["doc_id", "n_features", "weight", "score", "n_words"]
    arrow = pa.schema([(f, pa.int64()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, offsets = batch.column("ids")[i].as_py(), batch.column("offsets")[i].values.to_numpy()
                size = np.diff(offsets)
                weight = np.zeros(len(ids), np.int64)
                if offsets[-1]:  # reduceat gives a document of no features its neighbour's first gain, so these are left out
                    some = np.flatnonzero(size)
                    weight[some] = np.add.reduceat(gain[np.frombuffer(batch.column("stream")[i].as_buffer(), "<u2")], offsets[some])
                score = weight + np.array([noise(d, seed) for d in ids], np.int64)
                yield record_batch({"doc_id": ids, "n_features": size, "weight": weight, "score": score, "n_words": batch.column("words")[i].values}, arrow)

    return streams.mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def ranked(rows: DataFrame, percent: int) -> DataFrame:
    """rows with rank: 1, 2, 3... for the floor(percent * rows / 100) highest scores, ties to smaller ids, null for the others.

    Ranges of scores are sorted apart and numbered on from the counts of those before, so no task holds all rows.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "scores")
    counts = parts.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("__part", before.alias("__first"), F.expr(f"sum(count) over () * {int(percent)} div 100").alias("__most"))
    place = F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = parts.join(F.broadcast(firsts), "__part").withColumn("rank", place.cast("long"))
    return out.withColumn("rank", F.when(F.col("rank") <= F.col("__most"), F.col("rank"))).drop("__part", "__first", "__most")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, max_words: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, text_col: str = "text", id_col: str = "doc_id", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) of every row: percent in a hundred of those with min_words words or more are
    drawn without replacement, in proportion to how likely their features are in target rather than in docs.

    Both sides' counts are over all rows. A null or empty text has no features, weight 0, and is drawn only where min_words is
    0. A null id counts as no characters in the draw and stands first among equal scores. Rows stand for themselves, repeated
    ones too; an empty table gives an empty one, an empty target counts 0 everywhere; other columns are left out,
    whatever their names. The driver sees counts of buckets only, 65,536 at most.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets must fit uint16")
    streams = written(bucket_streams(docs, text_col, id_col, max_words, buckets), "streams")
    counted = lambda s: {r["bucket"]: r["n"] for r in sort_counts(s).collect()}
    gain = gains(counted(streams), counted(bucket_streams(target, target_text_col, None, max_words, buckets)), buckets)
    rows = written(weigh(streams, gain, seed), "weights")
    can = F.col("n_words") >= min_words
    drawn = ranked(rows.filter(can), percent).unionByName(rows.filter(~can).withColumn("rank", F.lit(None).cast("long")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
