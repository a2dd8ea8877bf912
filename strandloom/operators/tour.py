"""Rooted spanning forests by Euler tours, and what follows from them: subtrees' minima, blocks, lowest common ancestors.

No task holds a component beyond a lot: tasks go through lots of bounded size, dealt out by component, and what runs on beyond a lot is left to rounds of joins. Tours are
ranked by pointer doubling, nodes are numbered range by range, and minima over subtrees come from tables of ranges whose length doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators import graph
from strandloom.operators.extras import simple
from strandloom.operators.graph import components, nodes
from strandloom.schemas import BLOCKS
from strandloom.shared import spread as written

#: Places that lie in one block, whose extremes a task tables at once.
BLOCK = 1 << 16


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """A gapless number from 0 in the order of some columns, counted range by range."""
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(firsts), "__part").withColumn(name, (F.col("__first") + rank - 1).cast("long")).drop("__part", "__first")


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows sorted by part in lots of about most; a part of at most most rows is never cut."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < most:
            continue
        lot = pa.Table.from_batches(held)
        same = pc.equal(lot["part"], lot["part"][-1]).to_numpy()
        cut = int(np.argmax(same)) or n
        yield lot.slice(0, cut)
        held, n = lot.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.xxhash64("part")).sortWithinPartitions("part")


def ranked(links: DataFrame) -> DataFrame:
    """id and steps to the end of its list, of (id, to, part) where to is null at an end and part says which lists may lie together.

    Pointers double, first within lots of each part and then, where lists run on beyond a lot, by a join a round.
    """
    most = graph.AT_ONCE

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, most):
            own, to = lot["id"].to_numpy(), pc.fill_null(lot["to"], -1).to_numpy()
            order = np.argsort(own)
            at = np.minimum(np.searchsorted(own[order], to), len(own) - 1)
            here = own[order][at] == to
            # a row whose next one lies elsewhere points to itself
            hop = np.where(here, order[at], np.arange(len(own)))
            steps = here.astype(np.int64)
            while (hop[hop] != hop).any():
                steps, hop = steps + steps[hop], hop[hop]
            last = to[hop]
            steps += last >= 0
            yield from pa.table([pa.array(own), pa.array(last, mask=last < 0), pa.array(steps)], ["id", "to", "steps"]).to_batches(max_chunksize=100_000)

    now = written(_dealt(links.select("id", "to", "part")).mapInArrow(within, "id long, to long, steps long"), "ranks")
    while not now.filter("to is not null").isEmpty():
        on = now.select(F.col("id").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        step = now.join(on, "to", "left").select("id", F.col("beyond").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        now = written(step, "ranks")
    return now.select("id", "steps")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges between numbers below n make a spanning forest: each round each part takes its first edge out."""
    root, taken, left = np.arange(n), np.zeros(len(a), dtype=bool), np.arange(len(a))
    while True:
        left = left[root[a[left]] != root[b[left]]]
        if not len(left):
            return taken
        best = np.full(n, len(a))
        for side in (a, b):
            np.minimum.at(best, root[side[left]], left)
        won = np.unique(best[best < len(a)])
        taken[won] = True
        root = graph._roots(n, root[a[won]], root[b[won]])[root]


def forest_and_parts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, a, b) of a spanning forest of simple undirected edges, and (contig, component) of their nodes, component being its smallest node.

    Tasks take lots of edges, dealt out by component, and keep a forest of each lot. Where a component has more edges than a lot, each round each of its parts
    takes its least edge out, and parts so joined become one.
    """
    rows, counts = graph.component_edges(edges)
    kind, most = edges.schema["a"].dataType.simpleString(), graph.AT_ONCE

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, most):
            a, b, names = graph._coded(lot)
            yield from lot.filter(pa.array(_forest(len(names), a, b))).to_batches(max_chunksize=20_000)

    kept = written(_dealt(rows.withColumnRenamed("component", "part")).mapInArrow(within, f"part {kind}, a {kind}, b {kind}").withColumnRenamed("part", "component"), "kept")
    label = kept.select("component", F.explode(F.array("a", "b")).alias("contig")).distinct()
    large = written(counts.filter(F.col("n") > most).select("component"), "large")
    if large.isEmpty():
        return kept, label
    left = written(kept.join(large, "component", "left_semi").select("component", "a", "b", F.col("a").alias("pa"), F.col("b").alias("pb")), "left")
    taken = [kept.join(large, "component", "left_anti")]
    while not left.isEmpty():
        rank = F.struct("a", "b", "component", "pa", "pb")
        sides = left.select(F.explode(F.array(F.struct(F.col("pa").alias("part"), rank.alias("e")), F.struct(F.col("pb").alias("part"), rank.alias("e")))).alias("s")).select("s.*")
        won = written(sides.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct(), "won")
        taken.append(won.select("component", "a", "b"))
        part = written(components(won.select(F.col("pa").alias("a"), F.col("pb").alias("b"))), "parts")
        new = lambda side: part.select(F.col("contig").alias(side), F.col("component").alias(f"new_{side}"))
        left = left.join(new("pa"), "pa").join(new("pb"), "pb").filter("new_pa != new_pb")
        left = written(left.select("component", "a", "b", F.col("new_pa").alias("pa"), F.col("new_pb").alias("pb")), "left")
    return reduce(DataFrame.unionByName, taken), label


def rooted_forest(edges: DataFrame, parts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(contig, root, parent, pre, size) of a spanning forest of the undirected graph, and its edges (a, b).

    Each component's smallest node is its root, whose parent is null. pre counts all nodes from 0, component by component, each subtree without a gap: that of a node
    are the size numbers from its own. The tour of a tree goes on from an arc into a node along that node's next
    arc out, in order of name; it is cut at the root and ranked. With parts, the components of all nodes (contig, component), edges are a forest already.
    """
    plain = written(simple(edges, directed=False), "plain")
    if parts is None:
        tree, linked = forest_and_parts(plain)
    else:
        tree, linked = plain.join(parts.select(F.col("contig").alias("a"), "component"), "a"), parts
    alone = nodes(edges).join(linked, "contig", "left_anti").withColumn("component", F.col("contig"))
    parts = written(linked.unionByName(alone), "parts")
    way = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = tree.select(F.xxhash64("component").alias("part"), F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("part", "e.*")
    arcs = written(both.withColumn("id", F.monotonically_increasing_id()), "arcs")
    around = Window.partitionBy("x").orderBy("y")
    roots = parts.filter("contig = component").select(F.col("contig").alias("x"), F.lit(True).alias("at_root"))
    turn = arcs.select("x", "y", F.lead("id").over(around).alias("next"), F.first("id").over(around).alias("begin")).join(roots, "x", "left")
    turn = turn.select(F.col("y").alias("x"), F.col("x").alias("y"), F.coalesce("next", F.when(F.col("at_root").isNull(), F.col("begin"))).alias("to"))
    steps = written(arcs.join(ranked(arcs.join(turn, ["x", "y"]).select("id", "to", "part")), "id").select("x", "y", "steps"), "steps")
    back = steps.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("steps").alias("after"))
    down = steps.join(back, ["x", "y"]).filter("steps > after").select(F.col("y").alias("contig"), F.col("x").alias("parent"), "steps", F.expr("(steps - after + 1) div 2").alias("size"))
    sizes = parts.groupBy("component").agg(F.count("*").alias("all"))
    rows = parts.join(down, "contig", "left").join(sizes, "component")
    rows = rows.select("contig", F.col("component").alias("root"), "parent", F.coalesce("size", "all").alias("size"), F.coalesce(-F.col("steps"), F.lit(-(1 << 62))).alias("at"))
    return written(numbered(rows, ["root", "at"], "pre").drop("at"), "forest"), tree.select("a", "b")


def range_extremes(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges (contig, pre, size) with low and high: the least low and greatest high of values (pre, low, high) whose pre lies in the size numbers from pre.

    A task tables one block of BLOCK values at a time. A range over several blocks is cut into its part of the first and of the last one, and the whole blocks between
    them, whose extremes are few and come from a table over many tasks.
    """
    width, last = F.lit(BLOCK), F.col("pre") + F.col("size") - 1
    of = lambda c: F.floor(c / width).cast("long")
    asked = written(ranges.filter("size > 0").withColumn("one", of(F.col("pre"))).withColumn("two", of(last)), "asked")
    names = ranges.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranges.schema)
    piece = lambda block, begin, end: F.struct(block.alias("part"), begin.cast("long").alias("begin"), end.cast("long").alias("end"))
    begin, end = F.pmod("pre", width), F.pmod(last, width)
    cut = F.when(F.col("one") == F.col("two"), F.array(piece(F.col("one"), begin, end))).otherwise(F.array(piece(F.col("one"), begin, width - 1), piece(F.col("two"), F.lit(0), end)))
    pieces = asked.select(*names, F.explode(cut).alias("p")).select(*names, "p.*", F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    own = values.select(of(F.col("pre")).alias("part"), F.pmod("pre", width).cast("long").alias("begin"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))
    rows = own.unionByName(pieces, allowMissingColumns=True).select("part", "begin", "end", "low", "high", *names)
    most = BLOCK

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = None, None
        for batch in batches:
            part = batch["part"].to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                run = batch.slice(i, j - i)
                if part[i] != now:
                    now, big = part[i], np.iinfo(np.int64)
                    low, high, table = np.full(most, big.max), np.full(most, big.min), None
                value = run["end"].is_null()
                given = run.filter(value)
                if given.num_rows:
                    at = given["begin"].to_numpy()
                    low[at], high[at] = given["low"].to_numpy(), given["high"].to_numpy()
                want = run.filter(pc.invert(value))
                if not want.num_rows:
                    continue
                table = table or _table(low, high)
                begin, end = want["begin"].to_numpy(), want["end"].to_numpy()
                level = np.frexp((end - begin + 1).astype(float))[1] - 1
                lows, highs = np.empty(len(begin), np.int64), np.empty(len(begin), np.int64)
                for k in np.unique(level):
                    on = level == k
                    x, y = begin[on], end[on] - (1 << int(k)) + 1
                    lows[on] = np.minimum(table[k][0][x], table[k][0][y])
                    highs[on] = np.maximum(table[k][1][x], table[k][1][y])
                yield pa.RecordBatch.from_arrays([*[want[c] for c in names], pa.array(lows), pa.array(highs)], [*names, "low", "high"])

    # a block's values stand before what is asked of it
    dealt = rows.repartition(F.xxhash64("part")).sortWithinPartitions("part", F.col("end").asc_nulls_first())
    found = written(dealt.mapInArrow(within, f"{types}, low long, high long"), "pieces")
    far = asked.filter("one < two")
    between = written(far.filter("two - one > 1").select(*names, F.col("one").alias("__one"), F.col("two").alias("__two")), "between")
    if not between.isEmpty():
        blocks = own.groupBy(F.col("part").alias("pre")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        asking = between.select((F.col("__one") + 1).alias("pre"), (F.col("__two") - F.col("__one") - 1).alias("size")).distinct()
        inner = _doubled_extremes(blocks, asking).withColumnRenamed("pre", "from").withColumnRenamed("size", "n")
        inner = between.join(inner, (F.col("__one") + 1 == F.col("from")) & (F.col("__two") - F.col("__one") - 1 == F.col("n"))).select(*names, "low", "high")
        found = found.unionByName(inner)
    return found.groupBy(*names).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _table(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The extremes of 1, 2, 4 and more values from each place on, as far as there are so many."""
    table, width = [(low, high)], 1
    while len(low) > width:
        low, high = np.minimum(low[:-width], low[width:]), np.maximum(high[:-width], high[width:])
        table.append((low, high))
        width *= 2
    return table


def _doubled_extremes(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """range_extremes() by a join for each doubling, however many ranges are asked for and however long they are."""
    asked = written(ranges.withColumn("level", F.floor(F.log2("size")).cast("int")), "asked")
    asked = asked.withColumn("level", F.col("level") - (F.expr("shiftleft(1L, level)") > F.col("size")).cast("int") + (F.expr("shiftleft(2L, level)") <= F.col("size")).cast("int"))
    most = asked.agg(F.max("level")).first()[0]
    table, found = written(values, "extremes"), []
    for level in range((most if most is not None else -1) + 1):
        width = 1 << level
        one = table.select("pre", F.col("low").alias("low1"), F.col("high").alias("high1"))
        two = table.select(F.col("pre").alias("last"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        rows = asked.filter(F.col("level") == level).withColumn("last", F.col("pre") + F.col("size") - width)
        found.append(rows.join(one, "pre").join(two, "last").select(*ranges.columns, F.least("low1", "low2").alias("low"), F.greatest("high1", "high2").alias("high")))
        beyond = table.select((F.col("pre") - width).alias("pre"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        if level < most:
            table = written(table.join(beyond, "pre").select("pre", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")), "extremes")
    return reduce(DataFrame.unionByName, found) if found else ranges.join(values.drop("pre"), how="cross")


def block_members(edges: DataFrame) -> DataFrame:
    """component, key and node: the nodes of each block of the undirected graph, key being one of its nodes, by the method of Tarjan and Vishkin.

    Two tree edges, each named by its lower node, are in one block if an edge joins nodes of which neither is above the other, or if from below the lower one
    an edge leads out of the upper one's subtree. Blocks are the components of that relation. Loops and parallel edges
    don't count; nodes without other edges are in no block; an empty table gives an empty one.
    """
    forest, tree = rooted_forest(edges)
    other = simple(edges, directed=False).join(tree, ["a", "b"], "left_anti")
    at = lambda side: forest.select(F.col("contig").alias(side), F.col("pre").alias(f"pre_{side}"), F.col("size").alias(f"size_{side}"))
    other = written(other.join(at("a"), "a").join(at("b"), "b"), "other")
    reach = other.select(F.col("pre_a").alias("pre"), F.col("pre_b").alias("to")).unionByName(other.select(F.col("pre_b").alias("pre"), F.col("pre_a").alias("to")))
    own = forest.select("pre", F.col("pre").alias("to"))
    values = reach.unionByName(own).groupBy("pre").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    lower = forest.filter("parent is not null")
    span = range_extremes(values, lower.select("contig", "parent", "pre", "size"))
    upper = lower.select(F.col("contig").alias("parent"), F.col("pre").alias("pre_up"), F.col("size").alias("size_up"))
    out = span.join(upper, "parent").filter("low < pre_up or high >= pre_up + size_up").select(F.col("contig").alias("a"), F.col("parent").alias("b"))
    aside = other.filter("least(pre_a + size_a, pre_b + size_b) <= greatest(pre_a, pre_b) and (pre_a + size_a <= pre_b or pre_b + size_b <= pre_a)").select("a", "b")
    joined = components(written(out.unionByName(aside), "relation"))
    block = lower.join(joined, "contig", "left").select("root", F.coalesce("component", "contig").alias("key"), "contig", "parent")
    member = block.select(F.col("root").alias("component"), "key", F.explode(F.array("contig", "parent")).alias("node"))
    return member.distinct()


def blocks_in_lots(parts: DataFrame) -> DataFrame:
    """component, block (numbered by smallest members) and members of edges (component, a, b) of components of at most graph.AT_ONCE edges.

    The method is that of block_members(); a task goes through lots of whole components, whose forests, tours and extremes are columns of numbers.
    """
    most = graph.AT_ONCE

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, most):
            yield from _blocks_of_lot(lot).to_batches(max_chunksize=20_000)

    return written(_dealt(parts.select(F.col("component").alias("part"), "a", "b")).mapInArrow(within, BLOCKS), "ranks")


def _blocks_of_lot(lot: pa.Table) -> pa.Table:
    """The blocks of a lot of whole components, whose nodes are numbers in order of name."""
    a, b, names = graph._coded(lot)
    n = len(names)
    plain = np.unique((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
    a, b = plain // n, plain % n
    root = graph._roots(n, a, b)
    taken = _forest(n, a, b)
    parent, pre, size = _toured(root, a[taken], b[taken])
    a, b = a[~taken], b[~taken]
    low, high = np.arange(n), np.arange(n)
    for x, y in ((pre[a], pre[b]), (pre[b], pre[a])):
        np.minimum.at(low, x, y)
        np.maximum.at(high, x, y)
    lower = np.flatnonzero(parent >= 0)
    up = parent[lower]
    least, greatest = _extremes_below(low, high, pre[lower], size[lower])
    out = (least < pre[up]) | (greatest >= pre[up] + size[up])
    aside = (pre[a] + size[a] <= pre[b]) | (pre[b] + size[b] <= pre[a])
    key = graph._roots(n, np.concatenate([lower[out], a[aside]]), np.concatenate([up[out], b[aside]]))
    member = np.unique(np.concatenate([key[lower] * n + lower, key[lower] * n + up]))
    key, node = member // n, member % n
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.diff(begin, append=len(key))
    # blocks of a component share one node at most, so their first two members give their order
    own = root[node[begin]]
    order = np.lexsort((node[begin + 1], node[begin], own))
    begin, count, own = begin[order], count[order], own[order]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    number = np.arange(len(own)) - np.repeat(first, np.diff(first, append=len(own)))
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(len(node)) + np.repeat(begin - offsets[:-1], count)
    members = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.take(pa.array(node[at])))
    return pa.table([names.take(pa.array(own)), pa.array(number, pa.int32()), members], ["component", "block", "members"])


def _toured(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """parent (-1 for roots), pre and size as in rooted_forest(), of the edges of a spanning forest."""
    n, x, y = len(root), np.concatenate([a, b]), np.concatenate([b, a])
    way = np.sort(x * n + y)
    x, y = way // n, way % n
    back = np.searchsorted(way, y * n + x)
    # a tour goes on from an arc along the next arc out of its end
    on = back + 1
    around = x[np.minimum(on, len(x) - 1)] != y if len(x) else on > 0
    around |= on == len(x)
    final = around & (root[y] == y)
    hop = np.where(final, np.arange(len(x)), np.where(around, np.searchsorted(x, y), on))
    steps = (~final).astype(np.int64)
    while (hop[hop] != hop).any():
        steps, hop = steps + steps[hop], hop[hop]
    down = np.flatnonzero(steps > steps[back])
    parent, size, at = np.full(n, -1), np.bincount(root, minlength=n), np.full(n, np.iinfo(np.int64).min)
    parent[y[down]], at[y[down]], size[y[down]] = x[down], -steps[down], (steps[down] - steps[back[down]] + 1) // 2
    pre = np.empty(n, dtype=np.int64)
    pre[np.lexsort((at, root))] = np.arange(n)
    return parent, pre, size


def _extremes_below(low: np.ndarray, high: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least low and the greatest high of the count values from each begin on, one width of the doubling tables at a time."""
    level = np.frexp(count.astype(float))[1] - 1
    least, greatest, width = np.empty_like(begin), np.empty_like(begin), 1
    for k in range(int(level.max(initial=-1)) + 1):
        on = level == k
        x, y = begin[on], begin[on] + count[on] - width
        least[on], greatest[on] = np.minimum(low[x], low[y]), np.maximum(high[x], high[y])
        low, high = np.minimum(low[:-width], low[width:]), np.maximum(high[:-width], high[width:])
        width *= 2
    return least, greatest


def cut_nodes(members: DataFrame) -> DataFrame:
    """contig: nodes of more than one block."""
    return members.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias("contig"))


def is_biconnected(edges: DataFrame) -> bool:
    """Whether the undirected graph has an edge, is connected and has no cut node: one block holds every node."""
    members = written(block_members(edges), "members")
    return members.select("key").distinct().count() == 1 and members.count() == nodes(edges).count()


def ancestors(parents: DataFrame) -> DataFrame:
    """contig, level and above: the node 2^level steps above, of (contig, parent) in a forest. Each round doubles the steps; a ring raises ValueError."""
    first = written(parents.filter("parent is not null").select("contig", F.lit(0).alias("level"), F.col("parent").alias("above")), "above")
    every, now, level = first, first, 0
    most = first.count()
    while not now.isEmpty():
        if 1 << level > most:
            raise ValueError("the parents run in a ring")
        level += 1
        on = now.select(F.col("contig").alias("above"), F.col("above").alias("beyond"))
        now = written(now.join(on, "above").select("contig", F.lit(level).alias("level"), F.col("beyond").alias("above")), "above")
        every = every.unionByName(now)
    return every


def depths(table: DataFrame, contigs: DataFrame) -> DataFrame:
    """contig and depth (0 for roots), from the table of ancestors: the steps that are left from the ancestor at the highest level, added up."""
    top = written(table.groupBy("contig").agg(F.max(F.struct("level", "above")).alias("top")), "top")
    now = contigs.select("contig", F.col("contig").alias("at"), F.lit(0).cast("long").alias("depth"))
    while True:
        on = top.select(F.col("contig").alias("at"), F.col("top.level").alias("level"), F.col("top.above").alias("above"))
        step = written(now.join(on, "at", "left").select("contig", F.coalesce("above", "at").alias("at"), (F.col("depth") + F.coalesce(F.expr("shiftleft(1L, level)"), F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "depths")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now.select("contig", "depth")


def climbs(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ancestors() and depths() of a forest of (contig, parent), as tables."""
    contigs = parents.select(F.col("contig")).unionByName(parents.filter("parent is not null").select(F.col("parent").alias("contig"))).distinct()
    table = written(ancestors(parents), "ancestors")
    return table, written(depths(table, contigs), "depths")


def lowest_common_ancestors(parents: DataFrame, pairs: DataFrame, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """x, y and ancestor of each row of pairs (x, y), in the forest of (contig, parent): the lowest node that is above both or one of them; null in different trees, or where a node is none of the forest's.

    The deeper one climbs to the other's depth, then both climb as long as their ancestors differ, from the longest steps to the shortest: a join
    for each doubling, over all pairs together. A node without a parent is a root, whether it has a row or not. known is
    what climbs() gives, if it is there already.
    """
    table, depth = known or climbs(parents)
    most = table.agg(F.max("level")).first()[0]
    side = lambda s: depth.select(F.col("contig").alias(s), F.col("depth").alias(f"depth_{s}"))
    rows = pairs.select("x", "y").distinct().join(side("x"), "x").join(side("y"), "y")
    rows = rows.select("x", "y", F.when(F.col("depth_x") >= F.col("depth_y"), F.col("x")).otherwise(F.col("y")).alias("u"), F.when(F.col("depth_x") >= F.col("depth_y"), F.col("y")).otherwise(F.col("x")).alias("v"), F.abs(F.col("depth_x") - F.col("depth_y")).alias("climb"))
    rows = written(rows, "pairs")
    levels = range(most if most is not None else -1, -1, -1)
    step = lambda s, level: table.filter(F.col("level") == level).select(F.col("contig").alias(s), F.col("above").alias(f"above_{s}"))
    for level in levels:
        up = rows.join(step("u", level), "u", "left")
        rows = written(up.select("x", "y", F.when(F.col("climb").bitwiseAND(F.lit(1 << level)) != 0, F.col("above_u")).otherwise(F.col("u")).alias("u"), "v", "climb"), "pairs")
    for level in levels:
        up = rows.join(step("u", level), "u", "left").join(step("v", level), "v", "left")
        apart = F.col("above_u") != F.col("above_v")
        rows = written(up.select("x", "y", F.when(apart, F.col("above_u")).otherwise(F.col("u")).alias("u"), F.when(apart, F.col("above_v")).otherwise(F.col("v")).alias("v"), "climb"), "pairs")
    one = parents.filter("parent is not null").select(F.col("contig").alias("u"), F.col("parent").alias("up_u"))
    two = parents.filter("parent is not null").select(F.col("contig").alias("v"), F.col("parent").alias("up_v"))
    met = rows.join(one, "u", "left").join(two, "v", "left")
    found = F.when(F.col("u") == F.col("v"), F.col("u")).when(F.col("up_u") == F.col("up_v"), F.col("up_u"))
    return pairs.select("x", "y").join(met.select("x", "y", found.alias("ancestor")), ["x", "y"], "left")


def fundamental_cycles(edges: DataFrame) -> DataFrame:
    """component, a, b, place and contig: a basis of the undirected graph's cycles, a row for each node of each cycle in order, from a at place 0 to b.

    Each edge (a, b) outside a spanning forest closes one cycle with the forest's way from a up to the lowest common ancestor and
    down to b. A way is a node and a number of steps; it is cut at its longest power of two, the rest going on from the ancestor
    there, until single nodes are left: a join for each doubling, however long the ways are. Loops and parallel edges close none.
    """
    forest, tree = rooted_forest(edges)
    other = written(simple(edges, directed=False).join(tree, ["a", "b"], "left_anti"), "other")
    parents = forest.select("contig", "parent")
    table, depth = climbs(parents)
    met = lowest_common_ancestors(parents, other.select(F.col("a").alias("x"), F.col("b").alias("y")), (table, depth)).select(F.col("x").alias("a"), F.col("y").alias("b"), "ancestor")
    at = lambda s: depth.select(F.col("contig").alias(s), F.col("depth").alias(f"depth_{s}"))
    up, down = F.col("depth_a") - F.col("depth_ancestor"), F.col("depth_b") - F.col("depth_ancestor")
    way = lambda v, n, place, turn: F.struct(F.col(v).alias("v"), n.alias("n"), place.cast("long").alias("place"), F.lit(turn).alias("turn"))
    ways = met.join(at("a"), "a").join(at("b"), "b").join(at("ancestor"), "ancestor")
    ways = ways.select("a", "b", F.explode(F.array(way("a", up + 1, F.lit(0), 1), way("b", down, up + down, -1))).alias("w")).select("a", "b", "w.*").filter("n > 0")
    ways = written(ways, "ways")
    longest = ways.agg(F.max("n")).first()[0] or 1
    for level in range((longest - 1).bit_length() - 1, -1, -1):
        width = 1 << level
        above = table.filter(F.col("level") == level).select(F.col("contig").alias("v"), "above")
        rest = ways.filter(F.col("n") > width).join(above, "v").select("a", "b", F.col("above").alias("v"), (F.col("n") - width).alias("n"), (F.col("place") + width * F.col("turn")).alias("place"), "turn")
        ways = written(ways.withColumn("n", F.least("n", F.lit(width))).unionByName(rest), "ways")
    root = forest.select(F.col("contig").alias("a"), F.col("root").alias("component"))
    return ways.join(root, "a").select("component", "a", "b", "place", F.col("v").alias("contig"))
