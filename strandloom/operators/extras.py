"""Further graph analytics over edge tables (a, b and, where said, a weight), as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.graph import components, neighbours, nodes
from strandloom.shared import written

#: Rounds of page_rank() whose plans are put together to one job.
ROUNDS_AT_ONCE = 5


def loops(edges: DataFrame) -> DataFrame:
    return edges.filter("a = b")


def parallel_edges(edges: DataFrame, directed: bool = True) -> DataFrame:
    """a, b and n of edges that stand more than once; undirected ones with the smaller node first."""
    a, b = (F.col("a"), F.col("b")) if directed else (F.least("a", "b"), F.greatest("a", "b"))
    return edges.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n")).filter("n > 1")


def simple(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Without loops, each edge once."""
    rows = edges.filter("a != b")
    return (rows.select("a", "b") if directed else rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def bfs_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, contig, distance in undirected steps, for all sources (column contig) together; a level is one join."""
    near = written(neighbours(edges), "neighbours")
    level = written(sources.select(F.col("contig").alias("source"), "contig", F.lit(0).alias("distance")), "level")
    every, step = level, 0
    while True:
        step += 1
        then = level.join(near, F.col("contig") == F.col("node")).select("source", F.col("neigh").alias("contig")).distinct()
        level = written(then.join(every.select("source", "contig"), ["source", "contig"], "left_anti").withColumn("distance", F.lit(step)), "level")
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def shortest_paths(edges: DataFrame, sources: DataFrame, directed: bool = False) -> DataFrame:
    """source, contig, distance by column weight: relaxed until nothing gets nearer. A ring of negative weight raises ValueError."""
    arcs = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    if not directed:
        arcs = arcs.unionByName(arcs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    arcs = written(arcs.groupBy("a", "b").agg(F.min("weight").alias("weight")), "arcs")
    now = written(sources.select(F.col("contig").alias("source"), "contig", F.lit(0.0).alias("distance")), "near")
    for _ in range(nodes(edges).unionByName(sources.select("contig")).distinct().count() + 1):
        step = now.join(arcs, F.col("contig") == F.col("a")).select("source", F.col("b").alias("contig"), (F.col("distance") + F.col("weight")).alias("distance"))
        then = written(now.unionByName(step).groupBy("source", "contig").agg(F.min("distance").alias("distance")), "near")
        state = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("source", "contig", "distance").cast("decimal(38,0)"))).first())
        if state(then) == state(now):
            return then
        now = then
    raise ValueError("a ring of negative weight")


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 1000, threshold: float = 1e-9) -> DataFrame:
    """contig and rank: weight goes both ways along an edge in equal shares, (1 - d) / n is added before d multiplies, and the result is scaled to 0 to 1.

    Rounds go on until no rank moves by more than the threshold, or there were so many; that is seen once in ROUNDS_AT_ONCE rounds, which are one job.
    """
    edges = written(edges.select("a", "b"), "edges")
    near = neighbours(edges)
    share = near.groupBy("node").agg(F.count("*").alias("n_near"))
    own = written(nodes(edges), "own")
    n = max(1, own.count())
    # a node's own row brings its rank before the round
    arcs = near.join(share, "node").unionByName(own.select(F.col("contig").alias("node"), F.col("contig").alias("neigh"), F.lit(None).cast("long").alias("n_near")))
    arcs = written(arcs, "arcs")
    rank = own.select("contig", F.lit(1.0 / n).alias("rank"))
    done, sent = 0, F.coalesce(F.sum(F.col("rank") / F.col("n_near")), F.lit(0.0))
    while done < rounds:
        for _ in range(min(ROUNDS_AT_ONCE, rounds - done)):
            rows = arcs.join(rank.select(F.col("contig").alias("node"), "rank"), "node").groupBy(F.col("neigh").alias("contig"))
            rank = rows.agg((damping * ((1 - damping) / n + sent)).alias("rank"), F.max(F.when(F.col("n_near").isNull(), F.col("rank"))).alias("before"))
            done += 1
        then = written(rank, "rank")
        rank = then.select("contig", "rank")
        moved = then.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
        if moved is None or moved <= threshold:
            break
    ends = F.broadcast(rank.agg(F.min("rank").alias("low"), F.max("rank").alias("high")))
    return rank.crossJoin(ends).select("contig", F.when(F.col("high") > F.col("low"), (F.col("rank") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0)).alias("rank"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, weight of a minimum spanning forest: each round, each part takes its least edge (ties by ends), and parts merge."""
    left = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    left = written(left.groupBy("a", "b").agg(F.min("weight").alias("weight")).select("a", "b", "weight", F.col("a").alias("pa"), F.col("b").alias("pb")), "left")
    taken = None
    while not left.isEmpty():
        rank = F.struct("weight", "a", "b")
        sides = left.select(F.col("pa").alias("part"), rank.alias("e")).unionByName(left.select(F.col("pb").alias("part"), rank.alias("e")))
        won = written(sides.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct().select("a", "b", "weight"), "won")
        taken = won if taken is None else taken.unionByName(won)
        joined = left.join(won.select("a", "b"), ["a", "b"]).select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        part = components(joined)
        for side in ("pa", "pb"):
            left = left.join(part.select(F.col("contig").alias(side), F.col("component").alias(f"new_{side}")), side, "left").withColumn(side, F.coalesce(f"new_{side}", side)).drop(f"new_{side}")
        left = written(left.filter("pa != pb"), "left")
    return taken if taken is not None else left.select("a", "b", "weight")


def topological_levels(edges: DataFrame) -> DataFrame:
    """contig and level (0 for nodes without edges in): peeled round by round; nodes on rings, and what only they lead to, have none."""
    arcs = written(edges.select("a", "b").distinct(), "arcs")
    end = lambda side, n: F.struct(F.col(side).alias("contig"), F.lit(n).cast("long").alias("n"))
    # a loop is an edge in that never goes
    left = arcs.select(F.explode(F.array(end("a", 0), end("b", 1))).alias("e")).select("e.*").groupBy("contig").agg(F.sum("n").alias("n"))
    left, level, found = written(left, "waiting"), 0, None
    while True:
        free = left.filter("n = 0").select("contig", F.lit(level).alias("level"))
        if free.isEmpty():
            return found if found is not None else free
        found = free if found is None else found.unionByName(free)
        seen = arcs.join(free.select(F.col("contig").alias("a")), "a").groupBy(F.col("b").alias("contig")).agg(F.count("*").alias("seen"))
        left = written(left.filter("n > 0").join(seen, "contig", "left").select("contig", (F.col("n") - F.coalesce("seen", F.lit(0))).alias("n")), "waiting")
        level += 1


def is_acyclic(edges: DataFrame) -> bool:
    return topological_levels(edges).count() == nodes(edges).count()


def strong_components(edges: DataFrame) -> DataFrame:
    """contig and component (its smallest member) of strongly connected components.

    Nodes without arcs in, or out, stand alone and leave first, round by round. Then each round spreads the smallest names forward; what also reaches back to its name's node within the same name is that
    node's component and leaves. Rounds go on until no node is left.
    """
    arcs, left, found = written(simple(edges), "arcs"), written(nodes(edges), "nodes"), None
    while not left.isEmpty():
        while True:
            inner = arcs.select(F.col("a").alias("contig")).intersect(arcs.select(F.col("b").alias("contig")))
            alone = written(left.join(inner, "contig", "left_anti").withColumn("component", F.col("contig")), "alone")
            if alone.isEmpty():
                break
            found = alone if found is None else found.unionByName(alone)
            left = written(left.join(alone, "contig", "left_anti"), "nodes")
            gone = alone.select("contig")
            arcs = written(arcs.join(gone.withColumnRenamed("contig", "a"), "a", "left_anti").join(gone.withColumnRenamed("contig", "b"), "b", "left_anti"), "arcs")
        if left.isEmpty():
            break
        color = written(left.withColumn("color", F.col("contig")), "color")
        while True:
            step = arcs.join(color.withColumnRenamed("contig", "a"), "a").select(F.col("b").alias("contig"), "color")
            then = written(color.unionByName(step).groupBy("contig").agg(F.min("color").alias("color")), "color")
            changed = not then.join(color, ["contig", "color"], "left_anti").isEmpty()
            color = then
            if not changed:
                break
        one, two = color.select(F.col("contig").alias("a"), F.col("color").alias("ca")), color.select(F.col("contig").alias("b"), F.col("color").alias("cb"))
        inner = written(arcs.join(one, "a").join(two, "b").filter("ca = cb").select("a", "b"), "inner")
        back = written(color.filter("contig = color"), "back")
        front = back
        while True:
            front = inner.join(front.withColumnRenamed("contig", "b"), "b").select(F.col("a").alias("contig"), "color").distinct()
            front = written(front.join(back, ["contig", "color"], "left_anti"), "front")
            if front.isEmpty():
                break
            back = written(back.unionByName(front), "back")
        done = back.select("contig", F.col("color").alias("component"))
        found = done if found is None else found.unionByName(done)
        left = written(left.join(done, "contig", "left_anti"), "nodes")
        gone = done.select("contig")
        arcs = written(arcs.join(gone.withColumnRenamed("contig", "a"), "a", "left_anti").join(gone.withColumnRenamed("contig", "b"), "b", "left_anti"), "arcs")
    return found if found is not None else left.select("contig", F.col("contig").alias("component"))


def path_counts(edges: DataFrame, source: str) -> DataFrame:
    """contig and n: the number of ways from a node of an acyclic graph, summed level by level."""
    arcs = written(simple(edges), "arcs")
    levels = written(topological_levels(arcs), "levels")
    now = levels.filter(F.col("contig") == source).select("contig", F.lit(1).cast("long").alias("n"))
    most = levels.agg(F.max("level")).first()[0] or 0
    total, front = now, now
    for _ in range(int(most)):
        front = written(arcs.join(front.withColumnRenamed("contig", "a"), "a").groupBy(F.col("b").alias("contig")).agg(F.sum("n").alias("n")), "front")
        total = total.unionByName(front)
    return total.groupBy("contig").agg(F.sum("n").alias("n"))


def sources(edges: DataFrame) -> DataFrame:
    """contig: nodes that no edge leads into."""
    return _never_at(edges, "b")


def sinks(edges: DataFrame) -> DataFrame:
    """contig: nodes that no edge leads out of."""
    return _never_at(edges, "a")


def _never_at(edges: DataFrame, side: str) -> DataFrame:
    """contig: nodes that never stand at one side, in one grouping without a join."""
    end = lambda c: F.struct(F.col(c).alias("contig"), (F.lit(c == side) & F.col(c).isNotNull()).alias("at"))
    rows = edges.select(F.explode(F.array(end("a"), end("b"))).alias("e")).select("e.*")
    return rows.groupBy("contig").agg(F.max("at").alias("at")).filter("not at").select("contig")


def is_forest(edges: DataFrame) -> bool:
    """Whether the undirected graph has no cycle: as many distinct edges as nodes less components, no loop and no parallel edge."""
    plain = written(edges.select("a", "b"), "edges")
    parts = components(plain).agg(F.count("*").alias("n"), F.countDistinct("component").alias("c")).first()
    return plain.count() == parts["n"] - parts["c"]


def arcs_to_reverse(edges: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """(a, b): arcs whose reversal, with loops left out, makes the graph acyclic. parts are its strong components, if they are known.

    Within a strong component nodes stand in order of their arcs out less those in, largest first (ties by name); what runs
    against that order is reversed. All other arcs follow the order of components, so whatever the order within, no
    ring is left. Repeated arcs count once; of two arcs against each other one is reversed.
    """
    arcs = written(simple(edges), "arcs")
    part = written(strong_components(edges) if parts is None else parts, "strong")
    side = lambda s: part.select(F.col("contig").alias(s), F.col("component").alias(f"part_{s}"))
    inner = written(arcs.join(side("a"), "a").join(side("b"), "b").filter("part_a = part_b").select("a", "b"), "inner")
    end = inner.select(F.explode(F.array(F.struct(F.col("a").alias("contig"), F.lit(1).alias("n")), F.struct(F.col("b").alias("contig"), F.lit(-1).alias("n")))).alias("e")).select("e.*")
    lead = written(end.groupBy("contig").agg(F.sum("n").alias("lead")), "lead")
    place = lambda s: lead.select(F.col("contig").alias(s), F.struct((-F.col("lead")).alias("less"), F.col("contig").alias("name")).alias(f"at_{s}"))
    return inner.join(place("a"), "a").join(place("b"), "b").filter("at_a > at_b").select("a", "b")


def made_acyclic(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) of the graph with arcs_to_reverse() turned round and loops left out."""
    turned = written(arcs_to_reverse(edges), "turned")
    kept = simple(edges).join(turned, ["a", "b"], "left_anti")
    return kept.unionByName(turned.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
