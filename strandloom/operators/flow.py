"""Maximum flow and minimum cut of a graph of arcs (a, b, capacity) by pushes down exact levels.

Capacities are whole numbers. Parallel arcs count as one with their sum; loops, and arcs whose end is null or whose
capacity is null or not above zero, carry nothing. Source and sink that are one node, or that no arc joins, have a flow of zero.

Flow that has entered a node and not left it is held there. A phase finds each node's number of steps to the sink over arcs
with room left, and to the source for nodes from which the sink is out of reach. Then levels are swept once from the
farthest on: all that a level's nodes hold or receive moves one level nearer, as far as there is room. What is stuck has no
arc with room to a nearer node, so its level rises in the next phase, and levels never fall; when nothing is held, the flow is
one, and no way with room leads from source to sink. A level is one job over that level's arcs and a phase changes the
table of arcs once; the driver sees levels' numbers only.

Before that, nodes that a single arc leads to and that lead to the sink alone are folded into that arc's beginning, which then leads to the sink with as much
more room, as long as there are such nodes. Phases go over what is left, and its flow to the sink is dealt out to folded nodes again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.shared import written

#: A node's arcs are dealt out to so many keys, so that no task sorts all arcs of a hub.
SALTS = 64
#: Levels after which the table of nodes already seen is written as one, so that plans stay short.
MERGED_AFTER = 16


def max_flow(net: DataFrame) -> DataFrame:
    """a, b, capacity and flow (long) of each arc that can carry something, of residual()'s rows: a flow of the largest value.

    Of two arcs against each other one carries the net flow and the other zero.
    """
    return net.filter("capacity > 0").select("a", "b", "capacity", F.greatest(F.lit(0).cast("long"), F.col("capacity") - F.col("room")).alias("flow"))


def flow_value(flow: DataFrame, source: str) -> DataFrame:
    """One row with value: what leaves the source less what enters it, of max_flow()'s rows."""
    part = F.when(F.col("a") == source, F.col("flow")).when(F.col("b") == source, -F.col("flow"))
    return flow.agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("value"))


def min_cut(net: DataFrame, source: str, sink: str) -> DataFrame:
    """a, b, capacity of the arcs of the smallest cut nearest to the source, of residual()'s rows: from nodes that room still leads to from there, to others.

    These nodes are the same for every maximum flow. The capacities add up to the flow's value.
    """
    net = written(net, "net")
    open_arcs = net.filter("room > 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = written(_levels(open_arcs, source).select("contig"), "near")
    rows = net.filter("capacity > 0").select("a", "b", "capacity")
    if source == sink:
        return rows.limit(0)
    return rows.join(near.select(F.col("contig").alias("a")), "a", "left_semi").join(near.select(F.col("contig").alias("b")), "b", "left_anti").select("a", "b", "capacity")


def residual(arcs: DataFrame, source: str, sink: str) -> DataFrame:
    """a, b, capacity and room of each arc and of its reverse (capacity 0 where there is none), once the largest flow is there."""
    rows = arcs.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("capacity").cast("long").alias("capacity"))
    rows = rows.filter("a != b and capacity > 0")
    if source == sink:
        return _phases(rows, source, sink)
    inner, room, own, folds = _folded(rows, source, sink)
    if not folds:
        return _phases(rows, source, sink)
    net = _phases(inner.unionByName(room.select(F.col("contig").alias("a"), F.lit(sink).alias("b"), F.col("n").alias("capacity"))), source, sink)
    to_sink = (F.col("b") == sink) & (F.col("capacity") > 0)
    held = net.filter(to_sink).select(F.col("a").alias("contig"), (F.col("capacity") - F.col("room")).alias("n"))
    found = [net.filter((F.col("a") != sink) & (F.col("b") != sink))]
    for i, parts in enumerate(reversed(folds)):
        held, rows = _unfolded(parts, held)
        if i < len(folds) - 1:
            held = written(held, "held")
        found += [rows.select("a", "b", "capacity", (F.col("capacity") - F.col("n")).alias("room")), rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).cast("long").alias("capacity"), F.col("n").alias("room"))]
    # what a node itself leads to the sink, beside arcs that come from there
    back = inner.filter(F.col("a") == sink).groupBy(F.col("b").alias("contig")).agg(F.sum("capacity").alias("from_sink"))
    rims = own.withColumnRenamed("n", "to_sink").join(back, "contig", "full").join(held, "contig", "left").na.fill(0)
    found += [
        rims.select(F.col("contig").alias("a"), F.lit(sink).alias("b"), F.col("to_sink").alias("capacity"), (F.col("to_sink") - F.col("n")).alias("room")),
        rims.select(F.lit(sink).alias("a"), F.col("contig").alias("b"), F.col("from_sink").alias("capacity"), (F.col("from_sink") + F.col("n")).alias("room")),
    ]
    return reduce(DataFrame.unionByName, found)


def _folded(rows: DataFrame, source: str, sink: str) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Arcs (a, b, capacity) that are left without the sink's, each left node's room to the sink (contig, n), the same as given for all nodes, and each round's folded arcs.

    A folded arc is (a, b, capacity, room): b is the folded node, room what it can lead to the sink. A round goes over the arcs twice, whatever their shape.
    """
    zero = F.lit(0).cast("long")
    # parallel arcs are one
    inner, folds = written(rows.filter(F.col("b") != sink).groupBy("a", "b").agg(F.sum("capacity").alias("capacity")), "inner"), []
    own = room = written(rows.filter(F.col("b") == sink).groupBy(F.col("a").alias("contig")).agg(F.sum("capacity").alias("n")), "room")
    while True:
        end = lambda c, i, o: F.struct(F.col(c).alias("contig"), F.lit(i).cast("long").alias("i"), F.lit(o).cast("long").alias("o"), zero.alias("n"))
        ends = inner.select(F.explode(F.array(end("a", 0, 1), end("b", 1, 0))).alias("e")).select("e.*").unionByName(room.select("contig", zero.alias("i"), zero.alias("o"), "n"))
        nodes = ends.groupBy("contig").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("n").alias("n"))
        leaf = (F.col("i") == 1) & (F.col("o") == 0) & (F.col("n") > 0) & (F.col("contig") != source)
        leaves = written(nodes.filter(leaf).select(F.col("contig").alias("b"), "n"), "leaves")
        if leaves.isEmpty():
            return inner, room, own, folds
        marked = written(inner.join(leaves, "b", "left").withColumn("n", F.when(F.col("a") != sink, F.col("n"))), "arcs")
        folded = marked.filter("n is not null").select("a", "b", "capacity", F.least("capacity", "n").alias("room"))
        if folded.isEmpty():
            return inner, room, own, folds
        folds.append(folded)
        inner = marked.filter("n is null").select("a", "b", "capacity")
        left = room.join(folded.select(F.col("b").alias("contig")), "contig", "left_anti")
        room = written(left.unionByName(folded.select(F.col("a").alias("contig"), F.col("room").alias("n"))).groupBy("contig").agg(F.sum("n").alias("n")), "room")


def _unfolded(parts: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each node leads to the sink (contig, n) with the folded ones, and folded arcs (a, b, capacity, n) with the flow n that each got of its beginning's."""
    rows = parts.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    have = held.select(F.col("contig").alias("a"), F.greatest(F.lit(0).cast("long"), F.col("n")).alias("n_held"))
    share = _dealt(rows.groupBy("a", "salt").agg(F.sum("room").alias("room")).join(have, "a"), ["a"], "salt").select("a", "salt", F.col("n").alias("n_held"))
    before = F.coalesce(F.sum("room").over(Window.partitionBy("a", "salt").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = F.greatest(F.lit(0).cast("long"), F.least(F.col("room"), F.coalesce("n_held", F.lit(0)) - before))
    rows = rows.join(share, ["a", "salt"], "left").withColumn("n", got).select("a", "b", "capacity", "n")
    change = share.select(F.col("a").alias("contig"), (-F.col("n_held")).alias("n"))
    held = held.unionByName(change).groupBy("contig").agg(F.sum("n").alias("n")).unionByName(rows.select(F.col("b").alias("contig"), "n"))
    return held, rows


def _phases(rows: DataFrame, source: str, sink: str) -> DataFrame:
    """residual() of arcs that can carry something, by phases."""
    ways = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).cast("long").alias("capacity")))
    net = ways.groupBy("a", "b").agg(F.sum("capacity").alias("capacity"))
    net = written(net.withColumn("room", F.col("capacity")), "net")
    if source == sink:
        return net
    moves = written(net.filter((F.col("a") == source) & (F.col("room") > 0)).select("a", "b", F.col("room").alias("n")), "moves")
    held = net.limit(0).select(F.col("a").alias("contig"), F.col("room").alias("n"))
    while True:
        net = written(_moved(net, moves), "net")
        change = moves.select(F.explode(F.array(F.struct(F.col("b").alias("contig"), F.col("n").alias("n")), F.struct(F.col("a").alias("contig"), (-F.col("n")).alias("n")))).alias("e")).select("e.*")
        held = held.unionByName(change.filter(~F.col("contig").isin(source, sink))).groupBy("contig").agg(F.sum("n").alias("n")).filter("n > 0")
        held = written(held, "held")
        if held.isEmpty():
            return net
        moves = _sweep(net, held, source, sink)


def _moved(net: DataFrame, moves: DataFrame) -> DataFrame:
    change = moves.select("a", "b", (-F.col("n")).alias("n")).unionByName(moves.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    change = change.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return net.join(change, ["a", "b"], "left").select("a", "b", "capacity", (F.col("room") + F.coalesce("n", F.lit(0))).alias("room"))


def _levels(arcs: DataFrame, goal: str) -> DataFrame:
    """contig and level: the steps that each node is from the goal along arcs (a, b), 0 for the goal itself; a level is one join."""
    spark = arcs.sparkSession
    front = written(spark.createDataFrame([(goal, 0)], "contig string, level int"), "front")
    seen, level = front, 0
    while True:
        level += 1
        then = arcs.join(front.select(F.col("contig").alias("b")), "b").select(F.col("a").alias("contig")).distinct()
        front = written(then.join(seen, "contig", "left_anti").withColumn("level", F.lit(level)), "front")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if level % MERGED_AFTER == 0:
            seen = written(seen, "seen")


def _sweep(net: DataFrame, held: DataFrame, source: str, sink: str) -> DataFrame:
    """(a, b, n) of one phase's moves: each level once, farthest first, towards the sink and, where that is out of reach, the source."""
    room = written(net.filter("room > 0").select("a", "b", "room"), "room")
    ahead = written(_levels(room, sink).withColumn("ahead", F.lit(True)), "levels")
    levels = ahead
    if not held.join(ahead, "contig", "left_anti").isEmpty():
        apart = room.join(ahead.select(F.col("contig").alias("a")), "a", "left_anti").join(ahead.select(F.col("contig").alias("b")), "b", "left_anti")
        levels = written(ahead.unionByName(_levels(written(apart, "apart"), source).withColumn("ahead", F.lit(False))), "levels")
    end = lambda s: levels.select(F.col("contig").alias(s), F.struct("ahead", "level").alias(f"at_{s}"))
    steps = room.join(end("a"), "a").join(end("b"), "b").filter("at_a.ahead = at_b.ahead and at_a.level = at_b.level + 1")
    steps = steps.select("a", "b", "room", F.col("at_a.level").alias("level"), F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    steps = written(steps.sortWithinPartitions("level"), "steps")
    held = written(held.join(levels, "contig").select("contig", "n", "level"), "held")
    top = held.agg(F.max("level")).first()[0] or 0
    moves, come = None, None
    for level in range(top, 0, -1):
        here = held.filter(F.col("level") == level).select("contig", "n")
        if come is not None:
            here = here.unionByName(come).groupBy("contig").agg(F.sum("n").alias("n"))
        # each key's part of what the node holds, then each arc's part of its key's
        part = _dealt(steps.filter(F.col("level") == level).groupBy("a", "salt").agg(F.sum("room").alias("room")).join(here.withColumnRenamed("contig", "a").withColumnRenamed("n", "n_held"), "a"), ["a"], "salt")
        part = part.select("a", "salt", F.col("n").alias("n_held"))
        move = _dealt(steps.filter(F.col("level") == level).join(part, ["a", "salt"]), ["a", "salt"], "b").select("a", "b", "n")
        move = written(move, "moves")
        come = move.groupBy(F.col("b").alias("contig")).agg(F.sum("n").alias("n"))
        moves = move if moves is None else moves.unionByName(move)
        if (top - level) % MERGED_AFTER == MERGED_AFTER - 1:
            moves = written(moves, "moves")
    return moves if moves is not None else net.limit(0).select("a", "b", F.col("room").alias("n"))


def _dealt(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows that get some of their key's n_held, as n: in that order, each as much as it has room for, until nothing is left."""
    before = F.coalesce(F.sum("room").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("n", F.least(F.col("room"), F.col("n_held") - before)).filter("n > 0")
