"""Clusters around seeds: truncated random walks pushed on in rounds of joins, then a sweep by conductance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.graph import neighbours
from strandloom.shared import written


def walk_mass(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, least: float = 1e-4) -> DataFrame:
    """seed, contig, degree and mass: where lazy walks from each seed (column contig) stop, with chance alpha a step, to within least a unit of degree.

    The undirected graph's loops and parallel edges don't count; seeds that are null, repeated or without edges add nothing. A round
    pushes every node on whose waiting mass is at least least times its degree, all seeds together. Nodes with mass have degrees of
    at most 1 / (alpha * least) in sum for a seed, whatever the graph's size.
    """
    return _mass(_near(edges), seeds, alpha, least)


def _near(edges: DataFrame) -> DataFrame:
    """(node, neigh, degree), degree being the node's."""
    near = neighbours(edges.select("a", "b").dropna().filter("a != b"))
    return written(near.join(near.groupBy("node").agg(F.count("*").alias("degree")), "node"), "near")


def _mass(near: DataFrame, seeds: DataFrame, alpha: float, least: float) -> DataFrame:
    degree = written(near.select(F.col("node").alias("contig"), "degree").distinct(), "degrees")
    start = seeds.select("contig").dropna().distinct().join(degree, "contig")
    now = written(start.select(F.col("contig").alias("seed"), "contig", "degree", F.lit(0.0).alias("mass"), F.lit(1.0).alias("waits")), "mass")
    full = F.col("waits") >= least * F.col("degree")
    while not now.filter(full).isEmpty():
        stay = now.select("seed", "contig", F.when(full, F.col("mass") + alpha * F.col("waits")).otherwise(F.col("mass")).alias("mass"), F.when(full, (1 - alpha) / 2 * F.col("waits")).otherwise(F.col("waits")).alias("waits"))
        sent = now.filter(full).select("seed", F.col("contig").alias("node"), ((1 - alpha) / 2 * F.col("waits") / F.col("degree")).alias("waits")).join(near.select("node", "neigh"), "node")
        every = stay.unionByName(sent.select("seed", F.col("neigh").alias("contig"), F.lit(0.0).alias("mass"), "waits"))
        now = written(every.groupBy("seed", "contig").agg(F.sum("mass").alias("mass"), F.sum("waits").alias("waits")).join(degree, "contig"), "mass")
    return now.filter("mass > 0").select("seed", "contig", "degree", "mass")


def clusters(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, least: float = 1e-4) -> DataFrame:
    """seed, contig and conductance: the prefix of least conductance of each seed's nodes in order of mass a unit of degree.

    Conductance is the edges that leave a set over the smaller sum of degrees, inside or outside; the whole graph has none. Masses a degree are
    compared to 12 digits, ties go to the smaller name, and of prefixes of one conductance the shortest is taken. A seed
    whose walk fills a graph of one edge still has its own node.
    """
    near = _near(edges)
    mass = _mass(near, seeds, alpha, least)
    of_seed = Window.partitionBy("seed").orderBy(F.desc(F.round(F.col("mass") / F.col("degree"), 12)), "contig")
    order = written(mass.select("seed", "contig", "degree", F.row_number().over(of_seed).alias("place")), "order")
    other = order.select("seed", F.col("contig").alias("neigh"), F.col("place").alias("before"))
    inner = order.join(near.select(F.col("node").alias("contig"), "neigh"), "contig").join(other, ["seed", "neigh"]).filter("before < place")
    inner = inner.groupBy("seed", "contig").agg(F.count("*").alias("inner"))
    so_far = Window.partitionBy("seed").orderBy("place")
    rows = order.join(inner, ["seed", "contig"], "left").withColumn("volume", F.sum("degree").over(so_far))
    rows = rows.withColumn("cut", F.sum(F.col("degree") - 2 * F.coalesce("inner", F.lit(0))).over(so_far))
    rows = rows.crossJoin(F.broadcast(near.agg(F.count("*").alias("all"))))
    part = F.least("volume", F.col("all") - F.col("volume"))
    rows = written(rows.select("seed", "contig", "place", F.when(part > 0, F.col("cut") / part).alias("conductance")), "sweep")
    best = rows.filter("conductance is not null").groupBy("seed").agg(F.min(F.struct("conductance", "place")).alias("best"))
    return rows.drop("conductance").join(best, "seed").filter("place <= best.place").select("seed", "contig", "best.conductance")
