"""Edges as tables: degrees, neighbours, subgraphs, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strandloom import shared
from strandloom.shared import spread as written

#: Edges that a task contracts at once; links of contracted parts are settled in one task once they are so few.
AT_ONCE = 500_000
#: Stars that meet others, of which a table may be sent to all tasks; where there are more, edges and stars are merged.
FEW_STARS = 100_000


def endpoints(edges: DataFrame) -> DataFrame:
    """contig: both ends of each edge, in one pass over the edges."""
    return edges.select(F.explode(F.array("a", "b")).alias("contig"))


def nodes(edges: DataFrame) -> DataFrame:
    return endpoints(edges).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """contig and degree: rows that touch it, parallel ones counted."""
    return endpoints(edges).groupBy("contig").agg(F.count("*").alias("degree"))


def in_out_degrees(edges: DataFrame) -> DataFrame:
    """contig, n_in, n_out over distinct edges; each edge is counted once at each end, in one shuffle."""
    end = lambda side, i, o: F.struct(F.col(side).alias("contig"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    rows = edges.select("a", "b").distinct().select(F.explode(F.array(end("a", 0, 1), end("b", 1, 0))).alias("e")).select("e.*")
    return rows.groupBy("contig").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (node, neigh), both ways; a loop makes a node its own neighbour."""
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("neigh"))
    return edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.*").distinct()


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.col("contig").alias("a")), "a", "left_anti").join(gone.select(F.col("contig").alias("b")), "b", "left_anti")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    return edges.join(kept.select(F.col("contig").alias("a")), "a", "left_semi").join(kept.select(F.col("contig").alias("b")), "b", "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """contig and component (its smallest member) of each node; direction doesn't count, an edge to itself makes a component of one. A null is no node.

    Tasks contract their edges first, so many at once, to stars of numbers; what then is left to be joined over tasks are the links between stars that
    share a node, a small part of the edges wherever edges that belong together lie together.
    """
    _, meet, part = _stars(edges, with_edges=False)
    if part is None:
        return meet.select(F.col("node").alias("contig"), F.col("name").alias("component"))
    return meet.filter("star = at").drop("star").join(part.withColumnRenamed("star", "at"), "at", "left").select(F.col("node").alias("contig"), F.coalesce("component", "name").alias("component"))


def component_edges(edges: DataFrame, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(component, a, b) of the edges (a, b) with the columns they carry, loops and repeated ones too, and (component, n): how many each component has. No edge is joined by name.

    Where few stars meet others, as when edges that belong together lie together, no edge is shuffled.
    """
    stars, _, part = _stars(edges, with_edges=True, carried=carried)
    rows = stars.filter("other is not null")
    ends = [F.col("node").alias("a"), F.col("other").alias("b"), *carried]
    sizes = rows.groupBy("star", "name").agg(F.count("*").alias("n"))
    if part is None:
        return rows.select(F.col("name").alias("component"), *ends), sizes.select(F.col("name").alias("component"), "n")
    named = F.coalesce("component", "name").alias("component")
    counts = sizes.join(part, "star", "left").select(named, "n").groupBy("component").agg(F.sum("n").alias("n"))
    return rows.join(part, "star", "left").select(named, *ends), counts


def _stars(edges: DataFrame, with_edges: bool, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Stars, where stars meet, and (star, component) of stars that meet others, or None if none do.

    A row of stars is (node, star, name of its smallest node, null) for each node of a star, and with edges (a, star, name, b) for each edge, with what it carries. A node is once in a
    star, so it has a row for each lot of edges that a task contracted at most, however many edges it has.
    """
    kind, most = edges.schema["a"].dataType.simpleString(), AT_ONCE

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for lot in _lots(batches, most):
            a, b, names = _coded(lot)
            root = _roots(len(names), a, b)
            top = root == np.arange(len(names))
            star = first + (np.cumsum(top) - 1)[root]
            first += int(top.sum())
            name = names.take(pa.array(root))
            columns = ["node", "star", "name", "other", *carried]
            none = [pa.nulls(len(names), lot[c].type) for c in carried]
            yield from pa.table([names, pa.array(star), name, pa.nulls(len(names), names.type), *none], columns).to_batches(max_chunksize=20_000)
            if with_edges:
                whole = lot.filter(pc.and_(pc.is_valid(lot["a"]), pc.is_valid(lot["b"])))
                at = a[_valid(lot)]
                yield from pa.table([whole["a"], pa.array(star[at]), name.take(pa.array(at)), whole["b"], *[whole[c] for c in carried]], columns).to_batches(max_chunksize=20_000)

    types = "".join(f", {c} {edges.schema[c].dataType.simpleString()}" for c in carried)
    stars = written(edges.select("a", F.col("b").cast(kind).alias("b"), *carried).mapInArrow(contract, f"node {kind}, star long, name {kind}, other {kind}{types}"), "stars")
    own = stars.filter("other is null").drop("other", *carried)
    # edges have their stars already, so that only links are asked of their nodes
    meet = (own.drop("name") if with_edges else own).withColumn("at", F.min("star").over(Window.partitionBy("node")))
    meet = meet if with_edges else written(meet, "meet")
    settled = written(_settled(written(meet.filter("star != at").select(F.col("star").alias("a"), F.col("at").alias("b")).distinct(), "links")), "settled")
    if settled.isEmpty():
        return stars, meet, None
    named = written(settled.join(own.filter("node = name").select("star", "name"), "star"), "named")
    part = named.select("star", "root").join(named.groupBy("root").agg(F.min("name").alias("component")), "root").select("star", "component")
    part = shared.written(part, "parts")
    return stars, meet, F.broadcast(part) if part.count() <= FEW_STARS else part.hint("merge")


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together to most rows or a little more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _valid(lot: pa.Table) -> np.ndarray:
    """Of the edges with an end, which have both."""
    one, two = (lot[c].is_valid().to_numpy() for c in "ab")
    return (one & two)[one | two]


def _coded(lot: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Edges between numbers in order of name, and the names; an edge with one end is a loop, one with none is no edge."""
    ends = pa.chunked_array([*lot["a"].chunks, *lot["b"].chunks]).combine_chunks()
    ends = (ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends).dictionary_encode()
    order = pc.sort_indices(ends.dictionary)
    place = np.empty(len(order) + 1, dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place[-1] = -1
    codes = place[pc.fill_null(ends.indices, -1).to_numpy(zero_copy_only=False)]
    a, b = codes[: lot.num_rows], codes[lot.num_rows :]
    a, b = np.where(a < 0, b, a), np.where(b < 0, a, b)
    return a[a >= 0], b[a >= 0], ends.dictionary.take(order)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each number's component, of edges between numbers below n."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _settled(links: DataFrame) -> DataFrame:
    """star and root, the same number for all stars of a component, of distinct links (a, b) between stars that meet others.

    While there are too many links for a task, each number becomes the least one near it in an order that is new in each round, and links between equal
    numbers go: numbers shrink by a constant factor a round. The order is that of a hash which is one to one on longs, so hashes serve as numbers
    themselves; a number that has lost its last link is hashed on like the others.
    """
    ways: list[DataFrame] = []
    turned = lambda c, k: F.xxhash64(c, F.lit(k))
    while links.count() > AT_ONCE:
        k = len(ways)
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy("a").agg(F.least(turned(F.col("a"), k), F.min(turned(F.col("b"), k))).alias("to")), "ways")
        rows = links.join(to.withColumnRenamed("to", "x"), "a").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        links = written(rows.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        ways.append(to)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            a, b, names = _coded(pa.Table.from_batches(held))
            yield from pa.table([names, names.take(pa.array(_roots(len(names), a, b)))], ["star", "root"]).to_batches(max_chunksize=20_000)

    done = links.coalesce(1).mapInArrow(settle, "star long, root long")
    for k in range(len(ways) - 1, -1, -1):
        alone = F.col("to")
        for j in range(k + 1, len(ways)):
            alone = turned(alone, j)
        done = written(ways[k].join(written(done, "done").withColumnRenamed("star", "to"), "to", "left").select(F.col("a").alias("star"), F.coalesce("root", alone).alias("root")), "done")
    return done


def node_ids(names: DataFrame) -> DataFrame:
    """contig and id: 1 for the first in order of name, without one task that sorts all: ranges are sorted apart and numbered on."""
    parts = written(names.select("contig").distinct().repartitionByRange("contig").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("contig"))
    return parts.join(F.broadcast(firsts), "part").select("contig", (F.col("first") + rank).alias("id"))
