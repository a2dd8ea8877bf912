"""Betweenness by level-synchronous joins, and the peeling of its outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.extras import simple
from strandloom.operators.graph import components, neighbours, without_nodes
from strandloom.operators.tour import rooted_forest
from strandloom.shared import written


def betweenness(edges: DataFrame, min_nodes: int = 50, pairs_at_once: int = 1 << 28) -> DataFrame:
    """component, contig, score: exact normalised betweenness of each node of components with min_nodes or more, unweighted and undirected.

    Sources go on in batches, so that a batch has about so many pairs of nodes at most: a level's rows are (source, node, number of
    shortest paths), one join with the edges and one grouped sum lead to the next level, and dependencies come back level by
    level. In an undirected search only this level and the one before can be met again. Nothing is held per component, so a
    giant component spreads over all tasks. Scores are sums over ordered pairs divided by (n - 1)(n - 2). Trees need no pairs: see _between_branches().
    """
    edges = written(edges.select("a", "b").distinct(), "edges")
    parts = components(edges)
    sizes = parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= min_nodes)
    members = written(parts.join(sizes, "component"), "members")
    plain = simple(edges, directed=False).join(members.select(F.col("contig").alias("a"), "component", "n"), "a")
    trees = written(plain.groupBy("component", "n").agg(F.count("*").alias("m")).filter("m = n - 1").select("component"), "trees")
    leaves = written(plain.join(trees, "component", "left_semi").select("component", "a", "b"), "tree edges")
    in_trees = written(_between_branches(leaves, members.join(trees, "component", "left_semi")), "branches")
    everyone, members = members, written(members.join(trees, "component", "left_anti"), "others")
    near = written(neighbours(edges).filter("node != neigh").join(members.select(F.col("contig").alias("node")), "node", "left_semi"), "neighbours")
    every = members.agg(F.sum("n")).first()[0] or 0  # pairs of all sources
    batches = max(1, -(-every // pairs_at_once))
    total = in_trees
    for i in range(batches if every else 0):
        some = members.filter(F.pmod(F.xxhash64("contig"), F.lit(batches)) == i)
        own = written(_dependencies(some, near), "sums")
        total = total.unionByName(own)
    total = total.groupBy("v").agg(F.sum("depends").alias("depends")).withColumnRenamed("v", "contig")
    pairs = (F.col("n") - 1) * (F.col("n") - 2)
    return everyone.join(total, "contig", "left").select("component", "contig", F.when(pairs > 0, F.coalesce("depends", F.lit(0.0)) / pairs).otherwise(0.0).alias("score"))


def _between_branches(edges: DataFrame, members: DataFrame) -> DataFrame:
    """v and depends of the nodes of trees, of their edges (component, a, b) and nodes (component, contig, n): ordered pairs of other nodes that lie in different branches.

    Two nodes of a tree have one path, so a node lies between (n - 1)^2 pairs less the squares of its branches' sizes, which an Euler tour gives.
    """
    forest, _ = rooted_forest(edges, members.select("contig", "component"))
    below = forest.filter("parent is not null").groupBy(F.col("parent").alias("contig")).agg(F.sum(F.col("size") * F.col("size")).alias("squares"))
    rows = forest.select("contig", "size").join(members.select("contig", "n"), "contig").join(below, "contig", "left")
    above = F.col("n") - F.col("size")
    pairs = (F.col("n") - 1) * (F.col("n") - 1) - above * above - F.coalesce("squares", F.lit(0))
    return rows.select(F.col("contig").alias("v"), pairs.cast("double").alias("depends"))


def _dependencies(sources: DataFrame, near: DataFrame) -> DataFrame:
    """v and depends: what the sources' shortest paths give each node, summed up over the sources."""
    level = written(sources.select(F.col("contig").alias("s"), F.col("contig").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels = [level]
    while True:
        reached = level.join(near, F.col("v") == F.col("node")).groupBy("s", F.col("neigh").alias("v")).agg(F.sum("paths").alias("paths"))
        met = levels[-1].select("s", "v") if len(levels) == 1 else levels[-1].select("s", "v").unionByName(levels[-2].select("s", "v"))
        level = written(reached.join(met, ["s", "v"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    below, total = None, None
    for level in reversed(levels):
        rows = level.withColumn("depends", F.lit(0.0))
        if below is not None:
            share = below.select("s", F.col("v").alias("w"), ((1 + F.col("depends")) / F.col("paths")).alias("share"))
            back = share.join(near.select(F.col("node").alias("w"), F.col("neigh").alias("v")), "w").groupBy("s", "v").agg(F.sum("share").alias("share"))
            rows = level.join(back, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("depends"))
        below = written(rows, "depends")
        own = below.filter("s != v").groupBy("v").agg(F.sum("depends").alias("depends"))
        total = own if total is None else total.unionByName(own)
    return total.groupBy("v").agg(F.sum("depends").alias("depends"))


def outliers(scores: DataFrame) -> DataFrame:
    """Nodes at or above their component's mean plus three population deviations."""
    own = Window.partitionBy("component")
    rows = scores.withColumn("mean", F.avg("score").over(own)).withColumn("sigma", F.stddev_pop("score").over(own))
    return rows.filter(F.col("score") >= F.col("mean") + 3 * F.col("sigma")).select("contig", "score")


def high_centrality(edges: DataFrame, rounds: int = 3, min_nodes: int = 50) -> DataFrame:
    """contig, score, round: what is flagged in each round, after what earlier rounds flagged was taken out."""
    spark, found, edges = edges.sparkSession, None, written(edges.select("a", "b").distinct(), "edges")
    for r in range(1, rounds + 1):
        flagged = written(outliers(betweenness(edges, min_nodes)).withColumn("round", F.lit(r)), "flagged")
        found = flagged if found is None else found.unionByName(flagged)
        edges = written(without_nodes(edges, flagged), "peeled")
    return found if found is not None else spark.createDataFrame([], "contig string, score double, round int")
