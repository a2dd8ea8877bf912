"""Connected components of links between long ids, as rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links of (a, b) lead to, for each id that has a link to another.

    Large-star and small-star rounds (Kiveris et al., 2014): each id's larger neighbours are linked to its smallest, then its
    smaller ones, until nothing changes. The number of links never grows, so a hub costs its own links and no more;
    minima are summed up before they are shuffled, and links are joined with them, which Spark splits where skewed.
    Nulls and links of an id to itself are left out; repeated links count once.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = written(edges, "links")
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b")).distinct()
        following = written(small, "links")
        # the same links again: each id is then linked to its component's smallest id only
        sums = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums(following)) == tuple(sums(edges)):
            break
        edges = following
    tops = edges.select(b.alias("id"), b.alias("component")).distinct()
    return edges.select(a.alias("id"), b.alias("component")).unionByName(tops)
