"""Regions of nearest terminals, and a tree of little weight that joins terminals, as relaxing joins.

Edges are a, b and weight, a whole number of at least zero; direction doesn't count, of parallel edges the lightest stands,
loops and rows with a null are left out, a weight below zero raises ValueError. Terminals are a column contig; repeated ones
are one, and one without edges is a region of its own and adds nothing to a tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators import extras
from strandloom.shared import written


def _arcs(edges: DataFrame) -> DataFrame:
    """Distinct (a, b, weight), both ways."""
    rows = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("long").alias("weight")).dropna().filter("a != b")
    way = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "weight")
    both = rows.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*")
    arcs = written(both.groupBy("a", "b").agg(F.min("weight").alias("weight")), "arcs")
    if not arcs.filter("weight < 0").isEmpty():
        raise ValueError("a weight below zero")
    return arcs


def regions(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """contig, owner, distance, hops and parent: each reached node's nearest terminal and the next node on the way there.

    Ties go to the smaller owner, then to fewer edges, then to the smaller parent, so that a node's parent is always of
    its own region. A round takes only the nodes that came nearer in the one before.
    """
    return _regions(_arcs(edges), terminals)


def _regions(arcs: DataFrame, terminals: DataFrame) -> DataFrame:
    own = written(terminals.select(F.col("contig").cast("string").alias("contig")).dropna().distinct(), "terminals")
    inner = written(arcs.join(own.select(F.col("contig").alias("b")), "b", "left_anti").select("a", "b", "weight"), "inner")
    zero = F.lit(0).cast("long")
    best = written(own.select("contig", F.struct(zero.alias("distance"), F.col("contig").alias("owner"), zero.alias("hops"), F.lit(None).cast("string").alias("parent")).alias("e")), "best")
    front = best
    while True:
        nearer = F.struct((F.col("e.distance") + F.col("weight")).alias("distance"), F.col("e.owner").alias("owner"), (F.col("e.hops") + 1).alias("hops"), F.col("contig").alias("parent"))
        step = front.join(inner, F.col("contig") == F.col("a")).select(F.col("b").alias("contig"), nearer.alias("e")).groupBy("contig").agg(F.min("e").alias("e"))
        old = best.select("contig", F.col("e").alias("old"))
        front = written(step.join(old, "contig", "left").filter(F.col("old").isNull() | (F.col("e") < F.col("old"))).select("contig", "e"), "front")
        if front.isEmpty():
            return best.select("contig", "e.owner", "e.distance", "e.hops", "e.parent")
        best = written(best.join(front.select("contig"), "contig", "left_anti").unionByName(front), "best")


def steiner_tree(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """a, b (the smaller first) and weight of a tree that joins the terminals of each component, at most twice as heavy as the lightest one.

    The shortest way over each border of two regions is an edge between their terminals. A minimum spanning forest of these,
    traced back from the borders along parents, is a tree: within a region parents lead to its terminal alone. Its leaves are terminals.
    """
    arcs = _arcs(edges)
    found = written(_regions(arcs, terminals), "regions")
    end = lambda s: found.select(F.col("contig").alias(s), F.col("owner").alias(f"o{s}"), F.col("distance").alias(f"d{s}"))
    over = arcs.join(end("a"), "a").join(end("b"), "b").filter("oa < ob")
    way = F.struct((F.col("da") + F.col("weight") + F.col("db")).alias("length"), "a", "b", "weight")
    borders = written(over.groupBy("oa", "ob").agg(F.min(way).alias("way")), "borders")
    forest = extras.spanning_forest(borders.select(F.col("oa").alias("a"), F.col("ob").alias("b"), F.col("way.length").alias("weight")))
    taken = written(borders.join(forest.select(F.col("a").alias("oa"), F.col("b").alias("ob")), ["oa", "ob"]).select("way.a", "way.b", "way.weight"), "taken")
    # back from the borders, each node once
    front = written(taken.select(F.explode(F.array("a", "b")).alias("contig")).distinct(), "front")
    seen, steps = front, None
    while not front.isEmpty():
        step = written(front.join(found, "contig").filter("parent is not null").select("contig", "parent"), "step")
        steps = step if steps is None else steps.unionByName(step)
        front = written(step.select(F.col("parent").alias("contig")).distinct().join(seen, "contig", "left_anti"), "front")
        seen = written(seen.unionByName(front), "seen")
    if steps is not None:
        inside = steps.select(F.col("contig").alias("a"), F.col("parent").alias("b")).distinct().join(arcs, ["a", "b"])
        taken = taken.unionByName(inside.select("a", "b", "weight"))
    return taken.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
