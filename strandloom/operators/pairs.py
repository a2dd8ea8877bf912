"""Alignments to mate pairs, and what the pairs say of the library and of contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.links import end_of_strand, gap_distance, insert_size
from strandloom.functions.sequences import has_suffix, read_name


def mate_pairs(alignments: DataFrame) -> DataFrame:
    """read, m1 and m2 (structs of contig, start, end, strand; null where a mate is missing), one row for each read.

    A name ending in / and a character is a mate's: 1 is the first mate, anything else the second. Of names without it,
    the first line is the first mate, each later one the second. The last line of a mate stands. The window and the
    grouping share one shuffle by name.
    """
    name = read_name(F.col("read"))
    rows = alignments.select(name.alias("name"), has_suffix(F.col("read")).alias("suffixed"), F.substring("read", -1, 1).alias("last"), "line_no", F.struct("contig", "start", "end", "strand").alias("rec"))
    seen = F.row_number().over(Window.partitionBy("name").orderBy("suffixed", "line_no"))
    rows = rows.withColumn("mate", F.when(F.col("suffixed"), F.when(F.col("last") == "1", 1).otherwise(2)).otherwise(F.when(seen == 1, 1).otherwise(2)))
    last = lambda m: F.max_by(F.when(F.col("mate") == m, F.col("rec")), F.when(F.col("mate") == m, F.col("line_no")))
    return rows.groupBy("name").agg(last(1).alias("m1"), last(2).alias("m2")).withColumnRenamed("name", "read")


def both(pairs: DataFrame) -> DataFrame:
    return pairs.filter("m1 is not null and m2 is not null")


def intra_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs on one contig, with their insert size."""
    size = insert_size(F.col("m1.start"), F.col("m1.end"), F.col("m2.start"), F.col("m2.end"))
    return both(pairs).filter("m1.contig = m2.contig").select("read", F.col("m1.contig").alias("contig"), size.cast("long").alias("insert_size"))


def library_stats(pairs: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the insert size (NaN without pairs), and the pairs' number."""
    nan = F.lit(float("nan"))
    return intra_pairs(pairs).agg(F.coalesce(F.avg("insert_size"), nan).alias("mean"), F.coalesce(F.stddev_pop("insert_size"), nan).alias("stdev"), F.count("*").alias("n"))


def coverage(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """coverage = pairs x mean / length, for contigs with a pair of their own; a contig of no known length counts as null."""
    counts = intra_pairs(pairs).groupBy("contig").agg(F.count("*").alias("n"))
    stats = library_stats(pairs).select("mean")
    return counts.join(contigs, "contig", "left").crossJoin(F.broadcast(stats)).select("contig", (F.col("n") * F.col("mean") / F.col("length")).alias("coverage"))


def long_pairs(pairs: DataFrame, contigs: DataFrame, min_length: int) -> DataFrame:
    """Pairs whose contigs are both longer than min_length, with their lengths; a contig of no known length has 0."""
    one = contigs.select(F.col("contig").alias("c1"), F.col("length").alias("length1"))
    two = contigs.select(F.col("contig").alias("c2"), F.col("length").alias("length2"))
    rows = both(pairs).join(one, F.col("m1.contig") == F.col("c1"), "left").join(two, F.col("m2.contig") == F.col("c2"), "left")
    rows = rows.select("read", "m1", "m2", F.coalesce("length1", F.lit(0)).alias("length1"), F.coalesce("length2", F.lit(0)).alias("length2"))
    return rows.filter(F.least("length1", "length2") > min_length)


def links(pairs: DataFrame, contigs: DataFrame, min_length: int = 500) -> DataFrame:
    """read, a, oa, b, ob, mean and stdev of each pair between two contigs; the order of link ids is that of read names."""
    rows = long_pairs(pairs, contigs, min_length).filter("m1.contig != m2.contig").crossJoin(F.broadcast(library_stats(pairs).select(F.col("mean").alias("lib"), F.col("stdev").alias("sigma"))))
    rows = rows.withColumn("oa", end_of_strand(F.col("m1.strand"))).withColumn("ob", end_of_strand(F.col("m2.strand")))
    gap = gap_distance(F.col("lib"), F.col("oa"), F.col("m1.start"), F.col("m1.end"), F.col("length1"), F.col("ob"), F.col("m2.start"), F.col("m2.end"), F.col("length2"))
    return rows.select("read", F.col("m1.contig").alias("a"), "oa", F.col("m2.contig").alias("b"), "ob", gap.alias("mean"), F.col("sigma").alias("stdev"))
