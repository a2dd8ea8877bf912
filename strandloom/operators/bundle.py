"""Links between two contigs' ends, bundled by the largest set of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ["a", "oa", "b", "ob"]


def buckets(links: DataFrame, order: str = "read") -> DataFrame:
    """a, oa, b, ob and links: the links of each ordered pair of contig ends, in link order. Direction matters: (a, b) is not (b, a)."""
    return links.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(order, "mean", "stdev"))).alias("links"))


def merged(links: Column) -> Column:
    """Mean weighted by 1 / stdev^2 and its deviation; a deviation of 0 counts as 1."""
    weight = lambda x: F.lit(1.0) / F.when(x["stdev"] == 0, F.lit(1.0)).otherwise(x["stdev"] * x["stdev"])
    sums = F.aggregate(
        links,
        F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q")),
        lambda a, x: F.struct((a["p"] + x["mean"] * weight(x)).alias("p"), (a["q"] + weight(x)).alias("q")),
    )
    return F.struct((sums["p"] / sums["q"]).alias("mean"), (F.lit(1.0) / F.sqrt(sums["q"])).alias("stdev"))


def bundle_all(links: DataFrame, cutoff: int = 3, order: str = "read") -> DataFrame:
    """All bundles: of buckets above the cutoff the clique, merged; of others the first link alone, with size 1.

    A clique is what covers the point of most overlap with mean +- 3 stdev. Beginnings stand in order of their whole part and then of
    their link; the i-th's depth is i less the ends before it, the last never counts, and the first of the deepest is the
    point. A bucket's links are rows in order of place, with running sums over them: n log n at any size, and they spill.
    All windows and the grouping share one shuffle by the keys.
    """
    own = Window.partitionBy(*KEYS)
    lo, hi = F.col("mean") - 3 * F.col("stdev"), F.col("mean") + 3 * F.col("stdev")
    rows = links.select(*KEYS, F.col(order).alias("place"), "mean", "stdev", lo.alias("lo"), hi.alias("hi"))
    # at one place beginnings stand before ends, which so count as later
    sides = F.array(F.struct(F.col("lo").alias("x"), F.lit(0).alias("end")), F.struct(F.col("hi").alias("x"), F.lit(1).alias("end")))
    rows = rows.withColumn("side", F.explode(sides)).select(*rows.columns, "side.*")
    rows = rows.withColumn("ended", F.sum("end").over(own.orderBy("x", "end").rowsBetween(Window.unboundedPreceding, 0))).filter("end = 0")
    rows = rows.withColumn("i", F.row_number().over(own.orderBy(F.col("lo").cast("int"), "place"))).withColumn("n", F.count("*").over(own))
    deep = F.struct((F.col("i") - F.col("ended")).alias("depth"), (-F.col("i")).alias("early"), F.col("lo").alias("at"))
    rows = rows.withColumn("at", F.max(F.when(F.col("i") < F.col("n"), deep)).over(own)["at"]).withColumn("first", F.min("place").over(own))
    big = F.col("n") > cutoff
    rows = rows.filter((big & F.col("at").between(F.col("lo"), F.col("hi"))) | (~big & (F.col("place") == F.col("first"))))
    weight = F.lit(1.0) / F.when(F.col("stdev") == 0, F.lit(1.0)).otherwise(F.col("stdev") * F.col("stdev"))
    out = rows.groupBy(*KEYS).agg(
        F.sum(F.col("mean") * weight).alias("p"), F.sum(weight).alias("q"), F.count("*").cast("int").alias("size"), F.max("n").alias("n"), F.max(F.struct("mean", "stdev")).alias("one")
    )
    mean, stdev = F.when(big, F.col("p") / F.col("q")).otherwise(F.col("one.mean")), F.when(big, 1 / F.sqrt("q")).otherwise(F.col("one.stdev"))
    return out.select(*KEYS, mean.alias("mean"), stdev.alias("stdev"), F.when(big, F.col("size")).otherwise(1).alias("bsize"))


def first_links(links: DataFrame, order: str = "read") -> DataFrame:
    """a, oa, b, ob and the first link of each bucket in link order, which stands for buckets up to the cutoff."""
    return links.groupBy(*KEYS).agg(F.min(order).alias(order))


def bundled_links(links: DataFrame, cutoff: int = 3, order: str = "read") -> DataFrame:
    return bundle_all(links, cutoff, order).filter(F.col("bsize") >= cutoff)
