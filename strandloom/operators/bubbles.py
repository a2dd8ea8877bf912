"""Bubbles: blocks that lead from one source to one sink, and the graph with each put into one node."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.operators.blocks import by_component, by_key, large_blocks, parted
from strandloom.operators.splits import pairs_by_block, split_pairs
from strandloom.schemas import BUBBLES
from strandloom.shared import written


def is_bubble(source: str, sink: str, members: set[str], out: dict[str, list[str]], back: dict[str, list[str]]) -> bool:
    """Whether edges lead from source to sink through all members: a node is passed once all edges into it are seen, and the sink leads nowhere inside."""
    if any(v in members for v in out.get(sink, ())):
        return False
    seen = {(source, v) for v in out.get(source, ())}
    queue, reached = deque(sorted(seen)), {source}
    while queue:
        _, v = queue.popleft()
        reached.add(v)
        if v == sink:
            continue
        if all((u, v) in seen for u in back.get(v, ())):
            for w in out.get(v, ()):
                if (v, w) not in seen:
                    seen.add((v, w))
                    queue.append((v, w))
    return sink in reached and reached == members


def find_bubbles(edges: DataFrame, pairs: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """component, source, sink, members: pairs are tried in order of component, block and pair, each way round; the first that holds claims its block's members, and what touches claimed members is passed over.

    Without pairs, components of at most most edges go from edges to bubbles in one pass of a task.
    """
    if pairs is not None:
        return _claimed(edges, pairs.groupBy("component", "block").agg(F.sort_array(F.collect_list(F.struct("pair", "u", "v"))).alias("pairs"), F.first("members").alias("members")))
    small, large = parted(edges, most)
    found = by_component(small, _bubbles_within, BUBBLES)
    return found if large is None else found.unionByName(large_bubbles(large))


def large_bubbles(parts: DataFrame) -> DataFrame:
    """The same of edges (component, a, b) of components of any size."""
    of = written(large_blocks(parts), "blocks")
    own = split_pairs(parts, of).groupBy("component", "block").agg(F.sort_array(F.collect_list(F.struct("pair", "u", "v"))).alias("pairs")).join(of, ["component", "block"])
    return _claimed(parts, own)


def by_bubbles(parts: DataFrame, carried: tuple[str, ...], found: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of each component's bubbles (component, source, sink, members) and of its edges, column by column: nothing is joined to edges again."""
    return by_key(parts, ["component"], ["a", "b", *carried], lambda key, a, b, *more: found(_bubbles_within(key[0], a, b), a, b, *more), schema)


def _bubbles_within(component: str, a: list[str], b: list[str]) -> list[tuple]:
    """find_bubbles() of one component."""
    rows, claimed, arcs = [], set(), set(zip(a, b))
    for _, names, own, pairs in pairs_by_block(a, b):
        members = set(names)
        if members & claimed:
            continue
        out: dict[str, list[str]] = {}
        back: dict[str, list[str]] = {}
        for u, v in [*own, *((v, u) for u, v in own), *((v, v) for v in names)]:
            if (u, v) in arcs:
                out.setdefault(u, []).append(v)
                back.setdefault(v, []).append(u)
        ways = (way for u, v in pairs for way in ((u, v), (v, u)))
        found = next(((s, t) for s, t in ways if is_bubble(s, t, members, out, back)), None)
        if found:
            rows.append((component, *found, names))
            claimed |= members
    return rows


def _claimed(edges: DataFrame, own: DataFrame) -> DataFrame:
    """Bubbles of blocks (component, block, pairs, members)."""
    own = written(own, "pairs")
    # a block's members stand once beside all its pairs
    parts = own.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("block", "members", "pairs"))).alias("blocks"))
    member = own.select("component", F.explode("members").alias("a")).distinct()
    inner = edges.select("a", "b").distinct().join(member, "a").groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("edges"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, claimed = [], set()
        ahead: dict[str, list[str]] = {}
        for e in pdf["edges"].iloc[0]:
            ahead.setdefault(e["a"], []).append(e["b"])
        for block in pdf["blocks"].iloc[0]:
            members = set(block["members"])
            if members & claimed:
                continue
            out: dict[str, list[str]] = {}
            back: dict[str, list[str]] = {}
            for a, b in ((a, b) for a in sorted(members) for b in ahead.get(a, ()) if b in members):
                out.setdefault(a, []).append(b)
                back.setdefault(b, []).append(a)
            ways = ((s, t) for p in block["pairs"] for s, t in ((p["u"], p["v"]), (p["v"], p["u"])))
            found = next(((s, t) for s, t in ways if is_bubble(s, t, members, out, back)), None)
            if found:
                rows.append((pdf["component"].iloc[0], *found, sorted(members)))
                claimed |= members
        return pd.DataFrame(rows, columns=["component", "source", "sink", "members"])

    return parts.join(inner, "component").groupBy("component").applyInPandas(run, BUBBLES)


def collapse(edges: DataFrame, bubbles: DataFrame) -> DataFrame:
    """a, b, ends, bsize of the graph in which each bubble is one node.

    A node is a struct <bubble boolean, name>, a bubble's name being its source: no contig's name can clash with it. An edge
    that enters a source enters it at B, one that leaves a sink leaves at E; between bubbles, source to sink is BE and
    sink to source EB. Of edges that then run between the same nodes the later kind stands, and within a kind the one
    between later names.
    """
    # bubbles share no member, so a node has one row at most
    member = bubbles.select("source", "sink", F.explode("members").alias("node"))
    member = member.select("node", F.struct(F.lit(True).alias("bubble"), F.col("source").alias("name")).alias("into"), (F.col("node") == F.col("source")).alias("source"), (F.col("node") == F.col("sink")).alias("sink"))
    rows = edges.select("a", "b", F.concat("oa", "ob").alias("ends"), "bsize")
    for side in ("a", "b"):
        rows = rows.join(member.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("into", "source", "sink")]), side, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rim = lambda s: yes(f"source_{s}") | yes(f"sink_{s}")
    apart = F.coalesce(F.col("into_a") != F.col("into_b"), F.lit(False))
    first, second = F.col("ends").substr(1, 1), F.col("ends").substr(2, 1)
    second = F.when(~rim("a") & yes("source_b"), "B").otherwise(second)
    first = F.when(yes("sink_a") & ~rim("b"), "E").otherwise(first)
    ends = F.when(yes("source_a") & yes("sink_b") & apart, "BE").when(yes("sink_a") & yes("source_b") & apart, "EB").otherwise(F.concat(first, second))
    rows = rows.withColumn("ends", ends)
    plain = lambda s: F.struct(F.lit(False).alias("bubble"), F.col(s).alias("name"))
    node = lambda s: F.coalesce(F.col(f"into_{s}"), plain(s))
    order = F.struct(F.col("kind"), F.col("a"), F.col("b"))
    kinds = [
        rows.filter("into_a is null or into_b is null").select("a", "b", node("a").alias("x"), node("b").alias("y"), "ends", "bsize", F.lit(0).alias("kind")),
        rows.filter(~rim("a") & yes("source_b")).select("a", "b", plain("a").alias("x"), F.col("into_b").alias("y"), "ends", "bsize", F.lit(1).alias("kind")),
        rows.filter(yes("sink_a") & ~rim("b")).select("a", "b", F.col("into_a").alias("x"), plain("b").alias("y"), "ends", "bsize", F.lit(1).alias("kind")),
        rows.filter(apart & ((yes("source_a") & yes("sink_b")) | (yes("sink_a") & yes("source_b")))).select("a", "b", F.col("into_a").alias("x"), F.col("into_b").alias("y"), "ends", "bsize", F.lit(2).alias("kind")),
    ]
    every = kinds[0]
    for k in kinds[1:]:
        every = every.unionByName(k)
    every = every.withColumn("order", order)
    return every.groupBy("x", "y").agg(F.max_by(F.struct("ends", "bsize"), "order").alias("d")).select(F.col("x").alias("a"), F.col("y").alias("b"), "d.ends", "d.bsize")


def collapsed(edges: DataFrame, most: int | None = None) -> DataFrame:
    """collapse() of the graph with its own bubbles, an edge without both ends being none. Components of at most most edges go from edges to collapsed ones in one pass of a task.

    Of edges that stand several times between the same nodes with the same ends the largest is taken.
    """
    small, large = parted(edges, most, carried=("oa", "ob", "bsize"))
    size = "long" if (kind := edges.schema["bsize"].dataType.simpleString()) == "bigint" else kind
    rows = by_bubbles(small, ("oa", "ob", "bsize"), lambda *found: [(*x, *y, ends, n) for x, y, ends, n in collapsed_within(*found)], f"x boolean, a string, y boolean, b string, ends string, bsize {size}")
    node = lambda bubble, name: F.struct(F.col(bubble).alias("bubble"), F.col(name).alias("name")).alias(name)
    rows = rows.select(node("x", "a"), node("y", "b"), "ends", "bsize")
    return rows if large is None else rows.unionByName(collapse(large, written(large_bubbles(large), "bubbles")))


def collapsed_within(found: list[tuple], a: list[str], b: list[str], oa: list[str], ob: list[str], bsize: list) -> list[tuple]:
    """((bubble, name), (bubble, name), ends, bsize) of one component's edges and bubbles, as in collapse()."""
    of = {v: ((True, source), v == source, v == sink) for _, source, sink, members in found for v in members}
    best: dict[tuple, tuple] = {}
    for u, v, one, two, size in zip(a, b, oa, ob, bsize):
        size = None if size != size else size
        into_u, source_u, sink_u = of.get(u, (None, False, False))
        into_v, source_v, sink_v = of.get(v, (None, False, False))
        apart = into_u is not None and into_v is not None and into_u != into_v
        enters, leaves = source_v and not (source_u or sink_u), sink_u and not (source_v or sink_v)
        if apart and (source_u and sink_v or sink_u and source_v):
            ends = "BE" if source_u and sink_v else "EB"
        elif one is None or two is None:
            ends = None
        else:
            ends = ("E" if leaves else (one + two)[:1]) + ("B" if enters else (one + two)[1:2])
        ways = []
        if into_u is None or into_v is None:
            ways.append((into_u or (False, u), into_v or (False, v), 0))
        if enters:
            ways.append(((False, u), into_v, 1))
        if leaves:
            ways.append((into_u, (False, v), 1))
        if apart and (source_u and sink_v or sink_u and source_v):
            ways.append((into_u, into_v, 2))
        for x, y, kind in ways:
            rank = kind, u, v, ends or "", size is not None, size or 0
            if (x, y) not in best or rank > best[x, y][0]:
                best[x, y] = rank, ends, size
    return [(x, y, ends, size) for (x, y), (_, ends, size) in best.items()]
