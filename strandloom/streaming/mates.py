"""Mates matched as they arrive: a stream-stream join within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions.sequences import has_suffix, read_name


def matched_mates(alignments: DataFrame, within: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """read, m1, m2 of suffixed reads whose mates arrive within a span of each other. State older than the watermark is dropped by Spark."""
    rows = alignments.withWatermark(time_col, within).filter(has_suffix(F.col("read")))
    rec = F.struct("contig", "start", "end", "strand")
    first = rows.filter(F.col("read").endswith("/1")).select(read_name(F.col("read")).alias("read"), rec.alias("m1"), F.col(time_col).alias("t1"))
    second = rows.filter(~F.col("read").endswith("/1")).select(read_name(F.col("read")).alias("r2"), rec.alias("m2"), F.col(time_col).alias("t2"))
    near = F.expr(f"read = r2 and t2 between t1 - interval {within} and t1 + interval {within}")
    return first.join(second, near).select("read", "m1", "m2")
