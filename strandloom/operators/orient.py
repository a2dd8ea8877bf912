"""Orientation of contigs, and the links that it leaves valid."""

from __future__ import annotations

import heapq
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.links import congruent
from strandloom.operators.graph import components, degrees
from strandloom.shared import written

#: What a link of these ends says of its unoriented end, given the other end's orientation: +1 forward, -1 reverse.
VOTE_OF_TARGET = {("FOW", "EB"): 1, ("FOW", "BB"): -1, ("REV", "EE"): 1, ("REV", "BE"): -1}
VOTE_OF_SOURCE = {("FOW", "EB"): 1, ("FOW", "EE"): -1, ("REV", "BB"): 1, ("REV", "BE"): -1}
FITTING = {("FOW", "FOW"): "EB", ("REV", "REV"): "BE", ("FOW", "REV"): "EE", ("REV", "FOW"): "BB"}
ORIENTED = "component string, contig string, orient string, invalidated long"


class _Walk:
    """The greedy walk over one component: seeds in turn, each vote as the neighbours stand at that time."""

    def __init__(self, links: pd.DataFrame, strategy: str) -> None:
        self.out: dict[str, list] = {}
        self.back: dict[str, list] = {}
        self.rank = {}
        for row in links.itertuples():
            self.out.setdefault(row.a, []).append(row)
            self.back.setdefault(row.b, []).append(row)
            self.rank[row.a], self.rank[row.b] = (row.len_a, row.deg_a), (row.len_b, row.deg_b)
        self.strategy, self.orient, self.counts = strategy, {}, {}

    def vote(self, v: str) -> str:
        score = sum(VOTE_OF_TARGET.get((self.orient.get(x.b), x.oa + x.ob), 0) * x.bsize for x in self.out.get(v, ()))
        score += sum(VOTE_OF_SOURCE.get((self.orient.get(x.a), x.oa + x.ob), 0) * x.bsize for x in self.back.get(v, ()))
        return "FOW" if score >= 0 else "REV"

    def count(self, v: str) -> None:
        """The weight of links to oriented neighbours that don't fit; a later visit's count stands."""
        bad = lambda x: x.a in self.orient and x.b in self.orient and FITTING[self.orient[x.a], self.orient[x.b]] != x.oa + x.ob
        self.counts[v] = sum(x.bsize for x in [*self.out.get(v, ()), *self.back.get(v, ())] if bad(x))

    def order(self, u: str) -> list:
        links = self.out.get(u, [])
        if self.strategy == "bsize":
            return sorted(links, key=lambda x: (-x.bsize, x.link_id))
        which = 0 if self.strategy == "length" else 1
        return sorted(links, key=lambda x: (-self.rank[x.b][which], x.link_id))

    def visit(self, start: str) -> None:
        ranked = self.strategy in ("length", "degree")
        which = 0 if self.strategy == "length" else 1
        queue: list | deque = [(self.rank[start][which], start)] if ranked else deque([start])
        while queue:
            u = heapq.heappop(queue)[1] if ranked else queue.popleft()
            for x in self.order(u):
                if x.b not in self.orient:
                    self.orient[x.b] = self.vote(x.b)
                    if ranked:
                        heapq.heappush(queue, (self.rank[x.b][which], x.b))
                    else:
                        queue.append(x.b)
                self.count(x.b)


def longest(contigs: DataFrame) -> DataFrame:
    """contig and length of the longest one; ties go to the smaller name."""
    return contigs.orderBy(F.desc("length"), "contig").limit(1)


def most_links_out(links: DataFrame) -> DataFrame:
    """contig and n_out of the one that most links lead out of; ties go to the smaller name."""
    return links.groupBy(F.col("a").alias("contig")).agg(F.count("*").alias("n_out")).orderBy(F.desc("n_out"), "contig").limit(1)


def orient_contigs(links: DataFrame, contigs: DataFrame, strategy: str = "bsize") -> DataFrame:
    """component, contig, orient and invalidated (the last count written for it; null if none was), one row for each contig of a link.

    The walk votes in an order of its own, so a weak component is one task's work; components never touch each other's
    state. The longest contig of all (ties: the smaller name) is counted before its walk, and so gets a row of its own if
    it has no links. Within a component seeds are taken by length, then name; all are FOW.
    """
    links, length = written(links, "links"), written(contigs.groupBy("contig").agg(F.max("length").alias("length")), "lengths")
    top = longest(length).select(F.col("contig").alias("top"))
    deg = degrees(links)
    named = lambda side: length.select(F.col("contig").alias(side), F.col("length").alias(f"len_{side}")).join(deg.select(F.col("contig").alias(side), F.col("degree").alias(f"deg_{side}")), side, "right")
    parts = components(links).withColumnRenamed("contig", "a")
    rows = links.join(named("a"), "a").join(named("b"), "b").join(parts, "a").crossJoin(F.broadcast(top))
    rows = rows.select("component", "link_id", "a", "oa", "b", "ob", "bsize", F.coalesce("len_a", F.lit(0)).alias("len_a"), F.coalesce("len_b", F.lit(0)).alias("len_b"), "deg_a", "deg_b", "top")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        w, top = _Walk(pdf, strategy), pdf["top"].iloc[0]
        seeds = sorted(w.rank, key=lambda c: (-w.rank[c][0 if strategy != "degree" else 1], c))
        if top in w.rank:
            w.orient[top] = "FOW"
            w.count(top)
            w.visit(top)
        for s in seeds:
            if s not in w.orient:
                w.orient[s] = "FOW"
                w.visit(s)
        rows = [(pdf["component"].iloc[0], c, o, w.counts.get(c)) for c, o in sorted(w.orient.items())]
        out = pd.DataFrame(rows, columns=["component", "contig", "orient", "invalidated"])
        return out.astype({"invalidated": "Int64"})

    done = rows.groupBy("component").applyInPandas(walk, ORIENTED)
    alone = top.join(deg.select(F.col("contig").alias("top")), "top", "left_anti")
    return done.unionByName(alone.select(F.col("top").alias("component"), F.col("top").alias("contig"), F.lit("FOW").alias("orient"), F.lit(0).cast("long").alias("invalidated")))


def valid_links(links: DataFrame, orientation: DataFrame) -> DataFrame:
    """Links whose ends fit both contigs' orientations."""
    side = lambda s: orientation.select(F.col("contig").alias(s), F.col("orient").alias(f"orient_{s}"))
    rows = links.join(side("a"), "a").join(side("b"), "b")
    return rows.filter(congruent(F.col("orient_a"), F.col("orient_b"), F.concat("oa", "ob"))).select(*links.columns)


def with_link_ids(links: DataFrame, first: int = 0) -> DataFrame:
    """link_id in order of the keys, numbered range by range."""
    order = ["a", "oa", "b", "ob"]
    parts = written(links.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(firsts), "part").withColumn("link_id", (F.col("before") + rank - 1 + first).cast("long")).drop("part", "before")
