"""Scaffolds: contig ends matched greedily, paths traced through them, bubbles filled in, sequences and coordinates written out."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.sequences import gap_join, reverse_complement
from strandloom.operators.blocks import by_key, parted
from strandloom.operators.bubbles import by_bubbles, collapse, collapsed_within, large_bubbles
from strandloom.shared import written

NODE = "struct<bubble:boolean,name:string>"
PATHS = "path string, end string, place long, node string, entry string, exit string"
WAYS = "source string, heaviest array<string>, others array<array<string>>"


def end_edges(collapsed: DataFrame) -> DataFrame:
    """Edges between contig ends: p and q are structs <node, end>."""
    end = lambda n, i: F.struct(F.col(n).alias("node"), F.col("ends").substr(i, 1).alias("end"))
    return collapsed.select(end("a", 1).alias("p"), end("b", 2).alias("q"), "bsize")


def scaffold_paths(edges: DataFrame, most: int | None = None) -> DataFrame:
    """trace_paths() of match_ends() of edges between contig ends. A node without a name is no node.

    Components of at most most edges are matched by a scan and traced in one pass of a task, which goes through its components as a stream sorted by
    component and size; larger ones take rounds of joins.
    """
    name = lambda c: F.concat(F.col(f"{c}.node.bubble").cast("int").cast("string"), F.col(f"{c}.node.name"))
    named = edges.select(name("p").alias("a"), F.col("p.end").alias("x"), name("q").alias("b"), F.col("q.end").alias("y"), "bsize")
    small, large = parted(named, most, carried=("x", "y", "bsize"))
    found = _with_nodes(by_key(small, ["component"], ["a", "x", "b", "y"], _paths_within, PATHS, [F.desc_nulls_first("bsize"), "a", "x", "b", "y"]))
    if large is None:
        return found
    end = lambda c, e: F.struct(_node(c).alias("node"), F.col(e).alias("end"))
    return found.unionByName(trace_paths(match_ends(large.select(end("a", "x").alias("p"), end("b", "y").alias("q"), "bsize"))))


def _node(c: str) -> Column:
    return F.struct((F.col(c).substr(1, 1) == "1").alias("bubble"), F.expr(f"substr({c}, 2)").alias("name"))


def _with_nodes(found: DataFrame) -> DataFrame:
    return found.select(F.struct(_node("path").alias("node"), "end").alias("path"), "place", _node("node").alias("node"), "entry", "exit")


def bubble_scaffolds(edges: DataFrame, most: int | None = None) -> DataFrame:
    """scaffold_paths() of a graph's own edges with its bubbles collapsed. Components of at most most edges go from edges to paths in one pass of a task."""
    small, large = parted(edges, most, carried=("oa", "ob", "bsize"))
    found = _with_nodes(by_bubbles(small, ("oa", "ob", "bsize"), _scaffolds_within, PATHS))
    return found if large is None else found.unionByName(scaffold_paths(end_edges(collapse(large, written(large_bubbles(large), "bubbles")))))


def _scaffolds_within(*found: list) -> list[tuple]:
    """bubble_scaffolds() of one component."""
    rows = []
    for (x, p), (y, q), ends, size in collapsed_within(*found):
        one, two = (None, None) if ends is None else (ends[:1], ends[1:2])
        rows.append((size is not None, -(size or 0), f"{x:d}{p}", one or "", f"{y:d}{q}", two or "", one, two))
    rows.sort(key=lambda r: r[:6])
    return _paths_within((), [r[2] for r in rows], [r[6] for r in rows], [r[4] for r in rows], [r[7] for r in rows])


def _paths_within(_: tuple, *columns: list[str]) -> list[tuple]:
    """scaffold_paths() of one component's edges, largest first."""
    mate: dict[tuple[str, str], tuple[str, str]] = {}
    for a, x, b, y in zip(*columns):
        if (a, x) not in mate and (b, y) not in mate:
            mate[a, x], mate[b, y] = (b, y), (a, x)
    other = {"B": "E", "E": "B"}
    rows = []
    for node, end in mate:
        begin = at = (node, other[end])
        if begin in mate:
            continue
        trail = []
        while True:
            trail.append((at[0], at[1], other[at[1]]))
            final = trail[-1][0], trail[-1][2]
            if final not in mate:
                break
            at = mate[final]
        if begin < final:
            rows += [(*begin, place, *step) for place, step in enumerate(trail)]
    return rows


def match_ends(edges: DataFrame) -> DataFrame:
    """p, q, bsize: the edges that a scan by size takes, each if neither of its ends is taken (ties: smaller p, then q). Of parallel and repeated edges only the first can be.

    In each round every end points along the first edge left at it. An edge that is first at both its ends is taken. An end whose first edge
    is the second one at the other end, its upper one, is taken with it just if the upper one loses its own first edge, so along
    such chains taken and lost take turns: pointers to a chain's top double, and the whole chain is settled in the round. The top
    of a chain is an end of a taken edge, or has lost its first edge to the chain that runs through the other end; otherwise it waits.
    What touches a taken edge goes, and so does a top's lost edge. A chain of any order of sizes so takes one round with log2(n) joins.
    """
    pair = edges.select(F.struct((-F.col("bsize")).alias("s"), "p", "q").alias("rank"), F.least("p", "q").alias("one"), F.greatest("p", "q").alias("two"))
    left = written(pair.groupBy("one", "two").agg(F.min("rank").alias("rank")).select("rank"), "ends")
    way = lambda x, y: F.struct(F.col(f"rank.{x}").alias("end"), F.col(f"rank.{y}").alias("other"), "rank")
    taken = None
    while not left.isEmpty():
        sides = F.when(F.col("rank.p") == F.col("rank.q"), F.array(way("p", "q"))).otherwise(F.array(way("p", "q"), way("q", "p")))
        at = left.select(F.explode(sides).alias("e")).select("e.*").withColumn("n", F.row_number().over(Window.partitionBy("end").orderBy("rank"))).filter("n <= 2")
        best = written(at.groupBy("end").agg(F.min_by("other", "n").alias("up"), F.min("rank").alias("first"), F.when(F.count("*") > 1, F.max("rank")).alias("second")), "best")
        upper = best.select(F.col("end").alias("up"), F.col("first").alias("up_first"), F.col("second").alias("up_second"))
        kind = F.when(F.col("first").eqNullSafe(F.col("up_first")), "root").when(F.col("first").eqNullSafe(F.col("up_second")), "on").otherwise("top")
        state = written(best.join(upper, "up").select("end", "up", "first", kind.alias("kind")), "states")
        # a chain through the other end takes that end whichever way it turns out
        passed = state.filter("kind = 'on'").select("up")
        lost = state.filter("kind = 'top'").join(passed, "up", "left_semi").select("end", "first")
        heads = state.filter("kind = 'root'").select("end", F.lit(0).alias("turn")).unionByName(lost.select("end", F.lit(1).alias("turn")))
        hop = state.filter("kind = 'on'").select("end", "first", "up", F.lit(1).alias("turn"))
        while True:
            on = hop.select(F.col("end").alias("up"), F.col("up").alias("beyond"), F.col("turn").alias("more"))
            hop = written(hop.join(on, "up", "left").select("end", "first", F.coalesce("beyond", "up").alias("up"), ((F.col("turn") + F.coalesce("more", F.lit(0))) % 2).alias("turn"), F.col("beyond").isNotNull().alias("moved")), "hops")
            if hop.filter("moved").isEmpty():
                break
            hop = hop.drop("moved")
        settled = hop.join(heads.select(F.col("end").alias("up"), F.col("turn").alias("start")), "up").filter((F.col("turn") + F.col("start")) % 2 == 0)
        roots = state.filter("kind = 'root'").filter(F.col("end") == F.col("first.p"))
        won = written(settled.select("first").unionByName(roots.select("first")).select("first.p", "first.q", (-F.col("first.s")).alias("bsize")), "won")
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.col("p").alias("end")).unionByName(won.select(F.col("q").alias("end"))).distinct()
        rest = left.withColumn("p", F.col("rank.p")).withColumn("q", F.col("rank.q"))
        rest = rest.join(used.withColumnRenamed("end", "p"), "p", "left_anti").join(used.withColumnRenamed("end", "q"), "q", "left_anti").select("rank")
        left = written(rest.join(lost.select(F.col("first").alias("rank")), "rank", "left_anti"), "ends")
    return taken if taken is not None else edges.select("p", "q", "bsize")


def trace_paths(matched: DataFrame) -> DataFrame:
    """path (its first end), place (from 0), node, entry and exit of each node of a path; rings have no ends and no path.

    Matched ends and each node's own two ends make paths and rings. A state is a node entered at one end; pointers to the
    state some steps on double each round, so a path of n nodes takes log2(n) rounds. A path begins at the smaller of its ends.
    """
    # an end matched with itself stands once, as repeated states would multiply in each round
    both = matched.select("p", "q").unionByName(matched.filter("p != q").select(F.col("q").alias("p"), F.col("p").alias("q")))
    nodes = both.select(F.col("p.node").alias("node")).distinct()
    states = nodes.select("node", F.explode(F.array(F.lit("B"), F.lit("E"))).alias("entry"))
    leaves = F.struct(F.col("node"), F.when(F.col("entry") == "B", "E").otherwise("B").alias("end"))
    state = F.struct("node", "entry")
    # a state whose exit is free points to itself, 0 steps on
    hop = states.withColumn("p", leaves).join(both, "p", "left")
    hop = hop.select(state.alias("state"), F.when(F.col("q").isNull(), state).otherwise(F.struct(F.col("q.node").alias("node"), F.col("q.end").alias("entry"))).alias("to"), F.when(F.col("q").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    hop = written(hop, "hops")
    reach, most = 1, hop.count()
    while reach < 2 * most:
        on = hop.select(F.col("state").alias("to"), F.col("to").alias("beyond"), F.col("steps").alias("more"))
        then = written(hop.join(on, "to").select("state", F.col("beyond").alias("to"), (F.col("steps") + F.col("more")).alias("steps")), "hops")
        if then.agg(F.sum("steps")).first()[0] == hop.agg(F.sum("steps")).first()[0]:
            break
        hop, reach = then, reach * 2
    free = written(states.withColumn("p", leaves).join(both.select("p"), "p", "left_anti").select(state.alias("to")), "free")
    done = hop.join(free, "to")
    turned = lambda s: F.struct(s["node"].alias("node"), F.when(s["entry"] == "B", "E").otherwise("B").alias("entry"))
    ends = done.select("state", F.struct(F.col("to.node").alias("node"), turned(F.col("to"))["entry"].alias("end")).alias("final"), "steps")
    other = ends.select(turned(F.col("state")).alias("state"), F.col("final").alias("begin"), F.col("steps").alias("place"))
    rows = ends.join(other, "state").filter("begin < final")
    return rows.select(F.col("begin").alias("path"), "place", F.col("state.node").alias("node"), F.col("state.entry").alias("entry"), turned(F.col("state"))["entry"].alias("exit"))


def heaviest_path(edges: list[tuple[str, str, int]], source: str, sink: str) -> list[str] | None:
    """The path with the least sum of 1 / size (10 for size 0); of equal ones the first in order of names."""
    out: dict[str, list[tuple[str, float]]] = {}
    for a, b, size in edges:
        out.setdefault(a, []).append((b, 10.0 if size == 0 else 1.0 / size))
    heap, done = [(0.0, [source])], set()
    while heap:
        cost, path = heapq.heappop(heap)
        u = path[-1]
        if u == sink:
            return path
        if u not in done:
            done.add(u)
            for v, c in out.get(u, ()):
                if v not in done:
                    heapq.heappush(heap, (cost + c, [*path, v]))
    return None


def other_paths(edges: list[tuple[str, str, int]], members: list[str], path: list[str]) -> list[list[str]]:
    """Ways beside a path: the parts that are left without it, if one node, or if one node leads in and one out and a way joins them."""
    on_path = set(path)
    left = [m for m in members if m not in on_path]
    beside = set(left)
    inner = [(a, b) for a, b, _ in edges if a in beside and b in beside]
    out, into = dict.fromkeys(left, 0), dict.fromkeys(left, 0)
    for a, b in inner:
        out[a] += 1
        into[b] += 1
    top = {m: m for m in left}

    def find(m: str) -> str:
        while top[m] != m:
            m = top[m]
        return m

    for a, b in inner:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    parts: dict[str, list[str]] = {}
    for m in left:
        parts.setdefault(find(m), []).append(m)
    found = []
    for part in (sorted(p) for _, p in sorted(parts.items())):
        if len(part) == 1:
            found.append(part)
            continue
        ends = [m for m in part if out[m] == 1 and into[m] == 0], [m for m in part if out[m] == 0 and into[m] == 1]
        if len(ends[0]) + len(ends[1]) == 2 and len(ends[0]) == 1:
            way = heaviest_path([(a, b, 1) for a, b in inner], ends[0][0], ends[1][0])
            if way:
                found.append(way)
    return found


def bubble_paths(edges: DataFrame, bubbles: DataFrame) -> DataFrame:
    """source, heaviest array<string>, others array<array<string>> of each bubble. Bubbles are many and small: a task goes through its own one by one."""
    member = bubbles.select("source", "sink", F.explode("members").alias("a"))
    # a member without an edge out has a row too, and b is null beyond the bubble
    rows = member.join(edges.select("a", "b", "bsize"), "a", "left")
    rows = rows.join(member.select("source", F.col("a").alias("b"), F.lit(True).alias("inside")), ["source", "b"], "left")
    rows = rows.select("source", "sink", "a", F.when(F.col("inside"), F.col("b")).alias("b"), F.coalesce("bsize", F.lit(0)).alias("bsize"))

    def found(key: tuple, sink: list[str], a: list[str], b: list[str | None], bsize: list[int]) -> list[tuple]:
        most: dict[tuple[str, str], int] = {}
        for u, v, size in zip(a, b, bsize):
            if v is not None:
                most[u, v] = max(size, most.get((u, v), size))
        inside = [(u, v, size) for (u, v), size in most.items()]
        best = heaviest_path(inside, key[0], sink[0])
        return [(*key, best, other_paths(inside, sorted(set(a)), best))] if best else []

    return by_key(rows, ["source"], ["sink", "a", "b", "bsize"], found, WAYS)


def own_bubble_paths(edges: DataFrame, most: int | None = None) -> DataFrame:
    """bubble_paths() of a graph's own bubbles. Components of at most most edges go from edges to paths in one pass of a task."""
    small, large = parted(edges, most, carried=("bsize",))
    found = by_bubbles(small, ("bsize",), _ways_within, WAYS)
    return found if large is None else found.unionByName(bubble_paths(large, written(large_bubbles(large), "bubbles")))


def _ways_within(found: list[tuple], a: list[str], b: list[str], bsize: list) -> list[tuple]:
    """bubble_paths() of one component's edges and bubbles."""
    of = {v: source for _, source, _, members in found for v in members}
    inside: dict[str, dict[tuple[str, str], int]] = {source: {} for _, source, _, _ in found}
    for u, v, size in zip(a, b, bsize):
        if u in of and of[u] == of.get(v):
            own, size = inside[of[u]], 0 if size is None or size != size else size
            own[u, v] = max(size, own.get((u, v), size))
    rows = []
    for _, source, sink, members in found:
        edges = [(u, v, size) for (u, v), size in inside[source].items()]
        best = heaviest_path(edges, source, sink)
        if best:
            rows.append((source, best, other_paths(edges, members, best)))
    return rows


def scaffold_parts(edges: DataFrame, orientation: DataFrame, bubbles: DataFrame, paths: DataFrame) -> DataFrame:
    """kind (0 primary, 1 variant), path, part (from 0), contig, strand.

    A bubble stands for its heaviest path's contigs, backwards if it is entered at E; each keeps the strand of its own
    orientation. The ways beside that path are variants.
    """
    inside = bubble_paths(edges, bubbles)
    orient = orientation.select("contig", F.when(F.col("orient") == "FOW", "+").when(F.col("orient") == "REV", "-").alias("own"))
    rows = paths.join(inside.select(F.col("source").alias("s"), "heaviest"), F.col("node.bubble") & (F.col("node.name") == F.col("s")), "left")
    way = F.when(F.col("entry") == "E", F.reverse("heaviest")).otherwise(F.col("heaviest"))
    rows = rows.filter("not node.bubble or heaviest is not null").withColumn("way", F.when(F.col("node.bubble"), way).otherwise(F.array("node.name")))
    rows = rows.select("path", "place", F.col("node.bubble").alias("inside"), "entry", F.posexplode("way").alias("step", "contig")).join(orient, "contig", "left")
    strand = F.when(F.col("inside"), F.col("own")).otherwise(F.when(F.col("entry") == "B", "+").otherwise("-"))
    part = F.row_number().over(Window.partitionBy("path").orderBy("place", "step")) - 1
    name = F.concat(F.col("path.node.name"), F.lit(":"), F.col("path.end"))
    primary = rows.select(F.lit(0).alias("kind"), name.alias("path"), part.alias("part"), "contig", strand.alias("strand"))
    used = paths.filter("node.bubble").select(F.col("node.name").alias("source")).distinct()
    ways = inside.join(used, "source").select("source", F.posexplode("others").alias("n", "way")).select("source", "n", F.posexplode("way").alias("part", "contig")).join(orient, "contig", "left")
    variant = ways.select(F.lit(1).alias("kind"), F.concat(F.col("source"), F.lit(":"), F.col("n").cast("string")).alias("path"), "part", "contig", F.col("own").alias("strand"))
    return primary.unionByName(variant)


def scaffold_names(keys: DataFrame) -> DataFrame:
    """kind, path and scaffold: numbers from 1 over primaries, then variants, then singles, each in order of path, counted range by range."""
    parts = written(keys.select("kind", "path").distinct().repartitionByRange("kind", "path").withColumn("range", F.spark_partition_id()), "scaffolds")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("kind", "path"))
    number = (F.col("first") + rank).cast("string")
    return parts.join(F.broadcast(firsts), "range").select("kind", "path", F.concat(F.lit("scaffold_"), number, F.when(F.col("kind") == 1, "_variant").otherwise("")).alias("scaffold"))


def agp(parts: DataFrame, contigs: DataFrame) -> DataFrame:
    """scaffold, begin, end, part, contig, length, strand of all parts, and of the contigs that are in none as scaffolds of their own.

    Parts count from 0 and gaps don't count in the coordinates; a single contig's row begins at 0 and has part 1.
    """
    rows = parts.join(contigs, "contig")
    single = contigs.join(parts.select("contig").distinct(), "contig", "left_anti").select(F.lit(2).alias("kind"), F.col("contig").alias("path"), F.lit(1).alias("part"), "contig", F.lit("+").alias("strand"), "length")
    upto = Window.partitionBy("kind", "path").orderBy("part")
    end = F.sum("length").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("kind", "path", "part", "contig", "strand", "length", (end - F.col("length") + 1).alias("begin"), end.alias("end"))
    single = single.select("kind", "path", "part", "contig", "strand", "length", F.lit(0).cast("long").alias("begin"), F.col("length").cast("long").alias("end"))
    every = rows.unionByName(single)
    return every.join(scaffold_names(every), ["kind", "path"]).select("scaffold", "begin", "end", "part", "contig", "length", "strand")


def scaffold_sequences(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """scaffold and seq: the parts' sequences in order, turned where the strand is not +, with 100 N between."""
    turned = F.when(F.col("strand") == "+", F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    parts = rows.join(sequences, "contig").groupBy("scaffold").agg(F.sort_array(F.collect_list(F.struct("part", turned.alias("seq")))).alias("parts"))
    return parts.select("scaffold", gap_join(F.transform("parts", lambda p: p["seq"])).alias("seq"))


def path_weight(links: Column) -> Column:
    return F.aggregate(links, F.lit(0).cast("long"), lambda a, x: a + x["bsize"])
