"""Blocks of an undirected graph, and the nodes that cut them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.operators import graph, tour
from strandloom.operators.graph import component_edges
from strandloom.schemas import BLOCKS
from strandloom.shared import written


def biconnected(adjacency: dict[str, list[str]]) -> list[set[str]]:
    """Node sets of the blocks with an edge."""
    return [{v for e in own for v in e} for own in edge_blocks(adjacency)]


def edge_blocks(adjacency: dict[str, list[str]]) -> list[list[tuple[str, str]]]:
    """Edges, each once, of each block: depth-first search with an edge stack, without recursion."""
    low, order, blocks, edges = {}, {}, [], []
    for root in sorted(adjacency):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        trail = [(root, None, iter(sorted(adjacency[root])))]
        while trail:
            u, parent, rest = trail[-1]
            for v in rest:
                if v == parent:
                    continue
                if v not in order:
                    edges.append((u, v))
                    order[v] = low[v] = len(order)
                    trail.append((v, u, iter(sorted(adjacency[v]))))
                    break
                if order[v] < order[u]:
                    edges.append((u, v))
                    low[u] = min(low[u], order[v])
            else:
                trail.pop()
                if trail:
                    up = trail[-1][0]
                    low[up] = min(low[up], low[u])
                    if low[u] >= order[up]:
                        block = [edges.pop()]
                        while block[-1] != (up, u):
                            block.append(edges.pop())
                        blocks.append(block)
    return blocks


def cuts(adjacency: dict[str, list[str]], without: str) -> set[str]:
    """Nodes that part what is left when one node is gone."""
    rest = {u: [v for v in vs if v != without] for u, vs in adjacency.items() if u != without}
    seen: dict[str, int] = {}
    for block in biconnected(rest):
        for v in block:
            seen[v] = seen.get(v, 0) + 1
    return {v for v, n in seen.items() if n > 1}


def _adjacency(rows: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, set[str]] = {}
    for a, b in rows:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return {u: sorted(vs) for u, vs in out.items()}


#: Edges of a component that one task searches at most; the blocks of larger ones come from an Euler tour, in many tasks.
MOST_IN_TASK = 100_000


def blocks(edges: DataFrame, most: int | None = None) -> DataFrame:
    """component, block (numbered by smallest members) and its members; single nodes are no block.

    Components of most edges or fewer are searched depth-first in a task each. Larger ones go through tour.block_members(),
    whose rounds are joins: the result is the same, but no task holds a component.
    """
    small, large = parted(edges, most)
    found = by_component(small, lambda component, a, b: [(component, i, m) for i, (m, _) in enumerate(blocks_of(a, b))], BLOCKS)
    return found if large is None else found.unionByName(large_blocks(large))


def large_blocks(parts: DataFrame) -> DataFrame:
    """The same of edges (component, a, b) of components of any size.

    Tours of components of at most graph.AT_ONCE edges are gone through in lots, in one pass; those of larger ones take rounds of joins.
    """
    counts = parts.groupBy("component").agg(F.count("*").alias("n"))
    beyond = written(counts.filter(F.col("n") > graph.AT_ONCE).select("component"), "beyond")
    if beyond.isEmpty():
        return tour.blocks_in_lots(parts)
    return tour.blocks_in_lots(parts.join(beyond, "component", "left_anti")).unionByName(_blocks_in_rounds(parts.join(beyond, "component", "left_semi")))


def _blocks_in_rounds(parts: DataFrame) -> DataFrame:
    found = tour.block_members(parts.filter("a != b"))
    found = found.groupBy("component", "key").agg(F.sort_array(F.collect_list("node")).alias("members")).drop("key")
    order = written(tour.numbered(found, ["component", "members"], "place"), "order")
    first = order.groupBy("component").agg(F.min("place").alias("first"))
    return order.join(first, "component").select("component", (F.col("place") - F.col("first")).cast("int").alias("block"), "members")


def parted(edges: DataFrame, most: int | None = None, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """(component, a, b), and what else they carry, of edges of the components that a task may hold, and of those of more than most edges, or None if there are none."""
    parts, counts = component_edges(edges, carried)
    most = MOST_IN_TASK if most is None else most
    counts = written(counts, "counts")
    large = counts.filter(F.col("n") > most).select("component")
    if large.isEmpty():
        return parts, None
    if counts.filter(F.col("n") <= most).isEmpty():
        return parts.filter(F.lit(False)), parts
    return parts.join(large, "component", "left_anti"), written(parts.join(large, "component", "left_semi"), "large")


def blocks_of(a: list[str], b: list[str]) -> list[tuple[list[str], list[tuple[str, str]]]]:
    """Members and edges of each block of a component's edges, in order of members."""
    return sorted((sorted({v for e in own for v in e}), own) for own in edge_blocks(_adjacency(zip(a, b))))


def by_component(parts: DataFrame, found: Callable[[str, list[str], list[str]], list[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of each component's edges (component, a, b). Components are many and small: a task goes through its own one by one."""
    return by_key(parts, ["component"], ["a", "b"], lambda key, a, b: found(key[0], a, b), schema)


def by_key(rows: DataFrame, keys: list[str], values: list[str], found: Callable[..., list[tuple]], schema: str, order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows that a function makes of each key and its columns of values, as lists in the order given or in any; a task holds one key's rows at a time, beside a batch."""
    columns = [c.split()[0] for c in schema.split(", ")]
    small = {c.split()[0]: "Int32" if c.endswith(" int") else "Int64" for c in schema.split(", ") if c.endswith((" int", " long"))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, own in runs(batches, keys, values):
            out += found(key, *own)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns).astype(small)
                out = []
        yield pd.DataFrame(out, columns=columns).astype(small)

    # A hash of the keys deals them out, as Spark may leave out a repartition by the very columns of the join before it and then read that join's shuffle where it lies.
    dealt = rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*keys, *values)
    return dealt.mapInPandas(run, schema)


def runs(batches: Iterator[pd.DataFrame], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Each key of a sorted stream, and its values column by column."""
    now, held = None, []
    for pdf in batches:
        if not len(pdf):
            continue
        own = [pdf[k].to_numpy() for k in keys]
        new = np.zeros(len(pdf), dtype=bool)
        for k in own:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        columns = [pdf[v].tolist() for v in values]
        for i, j in zip(cuts, cuts[1:]):
            key, rows = tuple(k[i] for k in own), [c[i:j] for c in columns]
            if key == now:
                for h, r in zip(held, rows):
                    h.extend(r)
                continue
            if now is not None:
                yield now, held
            now, held = key, rows
    if now is not None:
        yield now, held


def block_edges(edges: DataFrame, of: DataFrame) -> DataFrame:
    """Each edge with its block: blocks part the edges of a component."""
    member = of.select("component", "block", F.explode("members").alias("node"))
    one = member.select("component", "block", F.col("node").alias("a"))
    two = member.select("component", "block", F.col("node").alias("b"))
    return edges.join(one, "a").join(two, ["component", "block", "b"])
