"""Motifs of the oriented graph: plasmids, tandem and interspersed repeats, bubble classes, cycles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.functions.links import bubble_class
from strandloom.operators.graph import components, in_out_degrees


def plasmids(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """component and size of weak components in which each node has one edge in and one out: single directed rings. parts are components(), if they are there already."""
    rows = (components(edges) if parts is None else parts).join(in_out_degrees(edges), "contig")
    sums = rows.groupBy("component").agg(F.count("*").alias("n"), F.min(F.least("n_in", "n_out")).alias("least"), F.max(F.greatest("n_in", "n_out")).alias("most"))
    return sums.filter("least = 1 and most = 1").select("component", "n")


def tandem_repeats(edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """Nodes with one edge in and one out, covered 1.5 times as deeply as both neighbours."""
    once = edges.select("a", "b").distinct()
    cov = lambda name: coverage.select(F.col("contig").alias(name), F.col("coverage").alias(f"cov_{name}"))
    rows = in_out_degrees(edges).filter("n_in = 1 and n_out = 1").select(F.col("contig").alias("x"))
    rows = rows.join(once.select(F.col("a").alias("before"), F.col("b").alias("x")), "x").join(once.select(F.col("a").alias("x"), F.col("b").alias("after")), "x")
    rows = rows.join(cov("x"), "x").join(cov("before"), "before").join(cov("after"), "after")
    return rows.filter("cov_x >= 1.5 * cov_before and cov_x >= 1.5 * cov_after").select(F.col("x").alias("contig"))


def interspersed_repeats(edges: DataFrame, coverage: DataFrame, least: int = 5, fold: float = 5.0) -> DataFrame:
    """Nodes with so many edges in or out, covered so many times the mean."""
    mean = F.broadcast(coverage.agg(F.avg("coverage").alias("mean")))
    rows = in_out_degrees(edges).filter((F.col("n_in") >= least) | (F.col("n_out") >= least)).join(coverage, "contig").crossJoin(mean)
    return rows.filter(F.col("coverage") >= fold * F.col("mean")).select("contig")


def bubble_classes(bubbles: DataFrame) -> DataFrame:
    return bubbles.select("source", "sink", F.size("members").alias("n"), bubble_class(F.col("members")).alias("kind")).filter("kind is not null")


def cycle_basis(edges: DataFrame) -> DataFrame:
    """component and cycle: a basis of the undirected graph's cycles, from a spanning tree of each component in order of names.

    Each edge outside the tree closes one cycle. A component is one task's work.
    """
    once = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = once.join(components(once).withColumnRenamed("contig", "a"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        root = min(near)
        parent, depth, queue = {root: root}, {root: 0}, [root]
        for u in queue:
            for v in sorted(near[u]):
                if v not in parent:
                    parent[v], depth[v] = u, depth[u] + 1
                    queue.append(v)
        out = []
        for a, b in sorted(zip(pdf["a"], pdf["b"])):
            if parent[a] == b or parent[b] == a:
                continue
            left, right = [a], [b]
            while left[-1] != right[-1]:
                side = left if depth[left[-1]] >= depth[right[-1]] else right
                side.append(parent[side[-1]])
            out.append((pdf["component"].iloc[0], left + right[-2::-1]))
        return pd.DataFrame(out, columns=["component", "cycle"])

    return rows.groupBy("component").applyInPandas(run, "component string, cycle array<string>")
