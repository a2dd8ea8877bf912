"""Repeat contigs from coverage, degree, invalidated links, skew and centrality, and the links that stay without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.graph import degrees, neighbours
from strandloom.shared import written


def skew(edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """contig and skew: the share of its distinct neighbours that it covers at least twice as deeply; unknown coverage never counts."""
    own = coverage.select(F.col("contig").alias("node"), F.col("coverage").alias("own"))
    theirs = coverage.select(F.col("contig").alias("neigh"), F.col("coverage").alias("theirs"))
    rows = neighbours(edges).join(own, "node", "left").join(theirs, "neigh", "left")
    hit = F.when(F.col("own") >= 2 * F.col("theirs"), 1.0).otherwise(0.0)
    return rows.groupBy(F.col("node").alias("contig")).agg((F.sum(hit) / F.count("*")).alias("skew"))


def percentile(table: DataFrame, value: str, p: float) -> float | None:
    """The exact percentile, interpolated between neighbours; None of an empty table. Nulls don't count.

    Values are sorted by ranges; the ranges' counts, one for each partition, say in which two the ranks lie, and those alone are
    numbered. No task and no driver holds the values.
    """
    parts = written(table.select(F.col(value).cast("double").alias("x")).filter("x is not null").repartitionByRange("x").withColumn("part", F.spark_partition_id()), "ranges")
    counts = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())
    n = sum(c for _, c in counts)
    if not n:
        return None
    at = p * (n - 1)
    low, found = int(at), {}
    before = 0
    for part, count in counts:
        inside = [k - before for k in {low, min(low + 1, n - 1)} if before <= k < before + count]
        if inside:
            rows = parts.filter(F.col("part") == part).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("x")) - 1)
            found |= {before + r["k"]: r["x"] for r in rows.filter(F.col("k").isin(inside)).collect()}
        before += count
    return found[low] + (at - low) * (found[min(low + 1, n - 1)] - found[low])


def percentile_outliers(table: DataFrame, value: str, p: float = 0.75) -> DataFrame:
    """Rows at or above the percentile, interpolated between neighbours; none of an empty table."""
    table = written(table.select("contig", value), "scores")
    cut = percentile(table, value, p)
    return table.filter(F.lit(False) if cut is None else F.col(value) >= F.lit(cut))


def signal_outliers(edges: DataFrame, coverage: DataFrame, invalidated: DataFrame) -> DataFrame:
    """Contigs above the 75th percentile of coverage, invalidated links and degree, all three."""
    c = percentile_outliers(coverage, "coverage").select("contig")
    i = percentile_outliers(invalidated, "invalidated").select("contig")
    d = percentile_outliers(degrees(edges), "degree").select("contig")
    return c.join(i, "contig", "left_semi").join(d, "contig", "left_semi").distinct()


def negative_distance(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """links with long_a and long_b: whether a negative distance reaches over the whole contig; a contig of no known length never is."""
    one, two = contigs.select(F.col("contig").alias("a"), F.col("length").alias("length_a")), contigs.select(F.col("contig").alias("b"), F.col("length").alias("length_b"))
    over = lambda length: F.coalesce((F.col("mean") < 0) & (F.abs("mean") >= F.col(length)), F.lit(False))
    return links.join(one, "a", "left").join(two, "b", "left").withColumn("long_a", over("length_a")).withColumn("long_b", over("length_b")).drop("length_a", "length_b")


def filter_links(links: DataFrame, contigs: DataFrame, central: DataFrame, others: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links that stay, repeats). central: contig, score; others: contig.

    A link goes if its target is central, or its source is and the scores have mean and deviation other than 0 (an empty
    table's NaN is other than 0); if either end is in others; or if its negative distance spans a contig, which is then
    a repeat too.
    """
    stats = central.agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    both = F.broadcast(stats.select((F.coalesce(F.col("m"), F.lit(float("nan"))) != 0).alias("m"), (F.coalesce(F.col("s"), F.lit(float("nan"))) != 0).alias("s")))
    named = lambda table, side, flag: table.select(F.col("contig").alias(side), F.lit(True).alias(flag)).distinct()
    rows = links
    for side in ("a", "b"):
        rows = rows.join(named(central, side, f"r_{side}"), side, "left").join(named(others, side, f"o_{side}"), side, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.crossJoin(both).filter(~((F.col("m") & F.col("s") & yes("r_a")) | yes("r_b")) & ~(yes("o_a") | yes("o_b")))
    checked = negative_distance(rows.select(*[F.col(c) for c in links.columns]), contigs)
    stay = checked.filter("not long_a and not long_b").select(*links.columns)
    long = checked.filter("long_a").select(F.col("a").alias("contig")).unionByName(checked.filter("long_b").select(F.col("b").alias("contig")))
    repeats = central.select("contig").unionByName(others.select("contig")).unionByName(long).distinct()
    return stay, repeats
