"""Blocks taken apart at their separation pairs: rings, bonds and rigid rests, as rows for each class, and the pairs that follow."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.operators.blocks import MOST_IN_TASK, _adjacency, block_edges, blocks_of, by_component, cuts, large_blocks, parted
from strandloom.shared import written

KEY = ["component", "block"]
CLASSES = "component string, block int, class int, kind string, place long, node string, virtual boolean, sides int"
CLASS_LISTS = "component string, block int, class int, kind string, nodes array<string>, virtual array<boolean>, sides int"


def _spliced(one: deque, two: deque, x: str) -> deque:
    """Two ways that end at x as one way through it: the shorter one is put to the longer one."""
    if len(one) < len(two):
        one, two = two, one
    rest = iter(two) if two[0] == x else reversed(two)
    next(rest)
    (one.extend if one[-1] == x else one.extendleft)(rest)
    return one


def reduced(edges: Iterable[tuple[str, str, int | None]]) -> list[tuple[str, list, int | None]]:
    """(kind, items, sides) of a block's classes, of its edges (a, b, chain), chain being the number of a chain of nodes that stands for an edge, or None.

    A node with two neighbours is taken out and its edges become a way; ways and edges between the same nodes become a bond. What
    can't be made smaller is a rest, in which each node has three neighbours or more. Work grows with the edges, but for log factors. A ring's items are (node,
    edge to the next one) in turn, an edge being "real", "virtual" or a chain's number; a bond has its two nodes and the number of its sides, the edge itself among
    them; a rest has its nodes, and the pairs that cut it are given as classes of kind pair: ends of virtual edges, and those that a search of the rest finds.
    """
    near: dict[str, dict[str, object]] = {}
    ready: deque[str] = deque()

    def put(a: str, b: str, content: object) -> None:
        old = near.setdefault(a, {}).get(b)
        if b in near[a]:
            content = ("bond", [*(old[1] if isinstance(old, tuple) else [old]), content])
        near[a][b] = content
        near.setdefault(b, {})[a] = content
        ready.extend(x for x in (a, b) if len(near[x]) == 2)

    def way(a: str, content: object, b: str) -> deque:
        return content if isinstance(content, deque) else deque([a, content, b])

    for a, b, chain in edges:
        put(a, b, None if chain is None else deque([a, chain, b]))
    while ready:
        x = ready.popleft()
        if len(near.get(x, ())) != 2:
            continue
        (a, one), (b, two) = near.pop(x).items()
        del near[a][x], near[b][x]
        put(a, b, _spliced(way(a, one, x), way(x, two, b), x))

    out: list[tuple[str, list, int | None]] = []
    name = lambda c: "real" if c is None else c if isinstance(c, int) else "virtual"
    open_ = []

    def ring(items: list, last: object) -> None:
        out.append(("ring", [(items[i], name(items[i + 1])) for i in range(0, len(items) - 1, 2)] + ([(items[-1], last)] if last else []), None))
        open_.extend((items[i], items[i + 1], items[i + 2]) for i in range(0, len(items) - 2, 2) if isinstance(items[i + 1], tuple))

    if len(near) == 2:
        (a, rest), (b, _) = near.items()
        content = rest[b]
        if isinstance(content, tuple) and len(content[1]) == 2:
            # two ways that meet at both ends are one ring
            one, two = sorted((list(way(a, c, b)) for c in content[1]), key=len, reverse=True)
            ring(one + (two if two[0] == one[-1] else two[::-1])[1:], None)
        elif content is not None:
            open_.append((a, content, b))
    else:
        real = sorted((a, b) for a, rest in near.items() for b in rest if a < b)
        open_ += [(a, near[a][b], b) for a, b in real if near[a][b] is not None]
        inside = _adjacency(real)
        if inside:
            out.append(("rest", [(v, None) for v in sorted(inside)], None))
            found = {(a, b) for a, b in real if near[a][b] is not None} | {(u, v) for u in inside for v in cuts(inside, u) if u < v}
            out += [("pair", [(u, None), (v, None)], None) for u, v in sorted(found)]
    top = len(near) == 2
    while open_:
        a, content, b = open_.pop()
        if isinstance(content, tuple):
            # beyond its own ways, a bond inside has the side that it was found on
            out.append(("bond", [(v, None) for v in sorted((a, b))], len(content[1]) + (0 if top and not out else 1)))
            open_ += [(a, c, b) for c in content[1] if c is not None]
        elif isinstance(content, deque):
            ring(list(content), "virtual")
    return out


def pairs_within(classes: list[tuple[str, list, int | None]]) -> set[tuple[str, str]]:
    """The pairs whose removal parts a block, of its classes (without chains): ends of virtual edges, nodes of a ring that don't stand side by side, and pairs of rests."""
    pairs: set[tuple[str, str]] = set()
    for kind, items, _ in classes:
        if kind in ("bond", "pair"):
            pairs.add((items[0][0], items[1][0]))
        elif kind == "ring":
            n = len(items)
            for i in range(n):
                for j in range(i + 1, n):
                    beside = items[i][1] if j == i + 1 else items[j][1] if i == 0 and j == n - 1 else "virtual"
                    if beside == "virtual":
                        pairs.add(tuple(sorted((items[i][0], items[j][0]))))
    return pairs


def _chains(edges: DataFrame) -> DataFrame:
    """component, block, chain, place, x, y, start, end, n: each edge of large blocks in its chain, a way through nodes of degree two.

    Each edge is followed both ways at once by pointers that double. A block that is one ring is cut open at its smallest node.
    """
    both = edges.select(*KEY, F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select(*KEY, "e.*")
    degree = written(both.groupBy(*KEY, "x").agg(F.count("*").alias("n")), "degrees")
    plain = degree.groupBy(*KEY).agg(F.max("n").alias("most"), F.min("x").alias("x")).filter("most = 2").select(*KEY, "x")
    inner = written(degree.filter("n = 2").join(plain, [*KEY, "x"], "left_anti").select(*KEY, F.col("x").alias("y")), "inner")
    darts = written(both.withColumn("id", F.monotonically_increasing_id()), "darts")
    on = darts.select(*KEY, F.col("x").alias("y"), F.col("y").alias("z"), F.col("id").alias("next"))
    step = darts.join(inner, [*KEY, "y"], "left_semi").join(on, [*KEY, "y"]).filter("x != z").select("id", "next")
    now = written(darts.select("id").join(step, "id", "left").select("id", F.coalesce("next", "id").alias("at"), F.col("next").isNotNull().cast("long").alias("steps")), "hops")
    while True:
        beyond = now.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"))
        now = written(now.join(beyond, "at").select("id", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")), "hops")
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    ends = darts.select(F.col("id").alias("at"), F.col("y").alias("end"))
    rows = written(darts.join(now, "id").join(ends, "at").select(*KEY, "x", "y", "at", "end", "steps"), "followed")
    back = rows.select(*KEY, F.col("x").alias("y"), F.col("y").alias("x"), F.col("at").alias("back"), F.col("end").alias("start"), F.col("steps").alias("place"))
    return rows.join(back, [*KEY, "x", "y"]).filter("at < back").select(*KEY, F.col("at").alias("chain"), "place", "x", "y", "start", "end", (F.col("steps") + F.col("place") + 1).alias("n"))


def split_classes(edges: DataFrame, of: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """component, block, class, kind, place, node, virtual, sides of blocks (component, block, members; all, if not given) of more than two edges.

    A ring has its nodes in order, from the smallest one on towards its smaller neighbour; virtual tells whether the edge to the next node (from the last to the first)
    stands for more of the block. A bond has two nodes, and sides of it meet there; a rest has nodes with three neighbours or more, whose pairs have kind pair.
    In blocks of more than most edges, chains of nodes with two neighbours are followed in many tasks first, so that a task
    holds the nodes of three neighbours or more of one block; a ring of any length is never held. The rest of a block is searched
    for pairs by one task. Loops and parallel edges don't count; a bridge has no class.
    """
    if of is None:
        small, large = parted(edges, most)
        found = by_component(small, _classes_within, CLASSES)
        return found if large is None else found.unionByName(split_classes(large, written(large_blocks(large), "blocks"), most))
    most = MOST_IN_TASK if most is None else most
    # an edge and its reverse are one
    simple = edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = written(block_edges(simple, of).select(*KEY, "a", "b"), "edges")
    count = written(rows.groupBy(*KEY).count().filter("count > 2"), "counts")
    small = rows.join(count.filter(F.col("count") <= most), KEY, "left_semi").withColumn("chain", F.lit(None).cast("long"))
    large = rows.join(count.filter(F.col("count") > most), KEY, "left_semi")
    chains = None
    if not count.filter(F.col("count") > most).isEmpty():
        chains = written(_chains(large), "chains")
        short = chains.filter("place = 0 and start != end")
        small = small.unionByName(short.select(*KEY, F.col("start").alias("a"), F.col("end").alias("b"), F.when(F.col("n") > 1, F.col("chain")).alias("chain")))

    def of_block(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
        for number, (kind, items, sides) in enumerate(reduced(sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2])))):
            for place, (node, then) in enumerate(items):
                chain = then if isinstance(then, int) else None
                yield (*key, number, kind, place, node, None if then is None else then == "virtual", sides, chain)

    columns = ["component", "block", "class", "kind", "place", "node", "virtual", "sides", "chain"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own = None, []
        out: list[tuple] = []
        for pdf in batches:
            for component, block, a, b, chain in zip(pdf["component"], pdf["block"], pdf["a"], pdf["b"], pdf["chain"]):
                if (component, block) != key:
                    out += of_block(key, own) if own else []
                    key, own = (component, block), []
                own.append((a, b, None if pd.isna(chain) else int(chain)))
            yield pd.DataFrame(out, columns=columns).astype({"sides": "Int32", "chain": "Int64"})
            out = []
        yield pd.DataFrame(list(of_block(key, own)) if own else [], columns=columns).astype({"sides": "Int32", "chain": "Int64"})

    # chains' numbers go to the task as text: pandas would make doubles of a column with nulls
    dealt = small.withColumn("chain", F.col("chain").cast("string")).repartition(F.xxhash64(*KEY)).sortWithinPartitions(*KEY)
    found = written(dealt.mapInPandas(run, CLASSES + ", chain long"), "classes")
    if chains is not None:
        found = written(_with_chains(found, chains), "classes")
    return _turned(found.drop("chain"))


def split_class_lists(edges: DataFrame, most: int | None = None) -> DataFrame:
    """component, block, class, kind, nodes, virtual, sides: split_classes() with a row for each class, whose nodes and flags are lists in order of place.

    Classes of components of at most most edges come whole from the task that finds them.
    """
    small, large = parted(edges, most)
    found = by_component(small, _class_lists_within, CLASS_LISTS)
    if large is None:
        return found
    rows = split_classes(large, written(large_blocks(large), "blocks"), most).groupBy(*KEY, "class", "kind", "sides").agg(F.sort_array(F.collect_list(F.struct("place", "node", "virtual"))).alias("r"))
    return found.unionByName(rows.select(*KEY, "class", "kind", F.col("r.node").alias("nodes"), F.col("r.virtual").alias("virtual"), "sides"))


def _classes_within(component: str, a: list[str], b: list[str]) -> list[tuple]:
    """split_classes() of one component."""
    return [(*own, place, node, virtual, sides) for *own, nodes, flags, sides in _class_lists_within(component, a, b) for place, (node, virtual) in enumerate(zip(nodes, flags))]


def _class_lists_within(component: str, a: list[str], b: list[str]) -> list[tuple]:
    """split_class_lists() of one component, its rings turned as _turned() does."""
    out = []
    for block, (_, own) in enumerate(blocks_of(a, b)):
        if len(own) < 3:
            continue
        for number, (kind, items, sides) in enumerate(reduced((*e, None) for e in sorted((min(e), max(e)) for e in own))):
            if kind == "ring":
                n, first = len(items), min(range(len(items)), key=lambda i: items[i][0])
                way = 1 if items[(first + 1) % n][0] < items[first - 1][0] else -1
                at = [(first + way * i) % n for i in range(n)]
                # an edge belongs to that of its two nodes which now comes first
                items = [(items[i][0], items[i if way == 1 else i - 1][1]) for i in at]
            out.append((component, block, number, kind, [node for node, _ in items], [None if then is None else then == "virtual" for _, then in items], sides))
    return out


def _with_chains(found: DataFrame, chains: DataFrame) -> DataFrame:
    """Classes with their chains' inner nodes put in, and the rings that are a block by themselves."""
    inner = chains.filter("place < n - 1").select(*KEY, "chain", F.col("place").alias("step"), F.col("y").alias("inside"), "start", "n")
    more = found.filter("chain is not null").join(inner, [*KEY, "chain"])
    step = F.when(F.col("node") == F.col("start"), F.col("step")).otherwise(F.col("n") - 2 - F.col("step"))
    rows = found.withColumn("step", F.lit(-1).cast("long")).unionByName(more.select(*[c for c in found.columns if c != "node"], F.col("inside").alias("node"), step.alias("step")))
    order = Window.partitionBy(*KEY, "class").orderBy("place", "step")
    rows = rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("step")
    whole = chains.filter("start = end").select(*KEY, F.lit(0).alias("class"), F.lit("ring").alias("kind"), "place", F.col("x").alias("node"), F.lit(False).alias("virtual"), F.lit(None).cast("int").alias("sides"), F.lit(None).cast("long").alias("chain"))
    return rows.unionByName(whole)


def _turned(found: DataFrame) -> DataFrame:
    """Rings turned so that each begins at its smallest node and goes on to its smaller neighbour."""
    own = [*KEY, "class"]
    rings = written(found.filter("kind = 'ring'"), "rings")
    first = written(rings.groupBy(*own).agg(F.min_by("place", "node").alias("first"), F.count("*").alias("n")), "first")
    beside = first.select(*own, F.explode(F.array(F.struct(F.lit(1).alias("way"), ((F.col("first") + 1) % F.col("n")).alias("place")), F.struct(F.lit(-1).alias("way"), ((F.col("first") - 1 + F.col("n")) % F.col("n")).alias("place")))).alias("e")).select(*own, "e.*")
    way = beside.join(rings.select(*own, "place", "node"), [*own, "place"]).groupBy(*own).agg(F.min_by("way", "node").alias("way"))
    turn = first.join(way, own)
    placed = rings.join(turn, own)
    at = lambda shift: F.pmod((F.col("place") + shift - F.col("first")) * F.col("way"), F.col("n")).cast("long")
    nodes = placed.select(*own, "kind", at(0).alias("place"), "node", "sides")
    # an edge belongs to that of its two nodes which now comes first
    flags = placed.select(*own, at(F.when(F.col("way") == 1, 0).otherwise(1)).alias("place"), "virtual")
    return nodes.join(flags, [*own, "place"]).select(*found.columns).unionByName(found.filter("kind != 'ring'"))


def split_pairs(edges: DataFrame, of: DataFrame) -> DataFrame:
    """component, block, pair, u, v of the blocks given: for each block its two cut nodes, if it has exactly two, and then in order of name each
    pair whose removal parts a block of more than two edges. One task searches a block, so that a component of many blocks is many tasks' work."""
    member = written(of.select("component", "block", F.explode("members").alias("node")), "members")
    cut = member.groupBy("component", "node").agg(F.count("*").alias("n")).filter("n > 1").select("component", "node", F.lit(True).alias("cut"))
    own = member.join(cut, ["component", "node"]).groupBy("component", "block").agg(F.sort_array(F.collect_list("node")).alias("cuts"))
    rows = block_edges(edges.select("a", "b").filter("a != b").distinct(), of).join(own, ["component", "block"], "left")

    def found(key: tuple, rows: list[tuple], both) -> list[tuple]:
        return [(*key, j, u, v) for j, (u, v) in enumerate(_pairs_of(rows, both))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, both, out = None, [], None, []
        for pdf in batches:
            for component, block, a, b, cut in zip(pdf["component"], pdf["block"], pdf["a"], pdf["b"], pdf["cuts"]):
                if (component, block) != key:
                    out += found(key, own, both) if len(own) > 2 else []
                    key, own, both = (component, block), [], cut
                own.append((a, b))
            yield pd.DataFrame(out, columns=["component", "block", "pair", "u", "v"])
            out = []
        yield pd.DataFrame(found(key, own, both) if len(own) > 2 else [], columns=["component", "block", "pair", "u", "v"])

    # Blocks are many and small: a task goes through its own one by one. A hash of the key deals them out, as Spark may leave out a
    # repartition by the very columns of the join before it and then read that join's shuffle where it lies.
    dealt = rows.select("component", "block", "a", "b", "cuts").repartition(F.xxhash64("component", "block")).sortWithinPartitions("component", "block")
    return dealt.mapInPandas(run, "component string, block int, pair int, u string, v string")


def _pairs_of(rows: list[tuple[str, str]], both) -> list[tuple[str, str]]:
    """A block's pairs in their order, of its edges and cut nodes."""
    inside, pairs = _adjacency(rows), []
    if both is not None and len(both) == 2:
        pairs.append(tuple(both))
    pairs += sorted(pairs_within(reduced((a, b, None) for a in sorted(inside) for b in inside[a] if a < b)))
    return list(dict.fromkeys(pairs))


def pairs_by_block(a: list[str], b: list[str]) -> Iterator[tuple[int, list[str], list[tuple[str, str]], list[tuple[str, str]]]]:
    """Number, members, edges and pairs of each block of more than two edges of a component."""
    found = blocks_of(a, b)
    seen: dict[str, int] = {}
    for members, _ in found:
        for v in members:
            seen[v] = seen.get(v, 0) + 1
    for i, (members, own) in enumerate(found):
        if len(own) > 2:
            yield i, members, own, _pairs_of(own, [v for v in members if seen[v] > 1])


def separation_pairs(edges: DataFrame, of: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """split_pairs() of some blocks, or of all, with members, the whole block's nodes, beside each pair. A component of at most most edges is searched in one pass of a task."""
    if of is None:
        small, large = parted(edges, most)

        def found(component: str, a: list[str], b: list[str]) -> list[tuple]:
            return [(component, i, j, u, v, members) for i, members, _, pairs in pairs_by_block(a, b) for j, (u, v) in enumerate(pairs)]

        rows = by_component(small, found, "component string, block int, pair int, u string, v string, members array<string>")
        return rows if large is None else rows.unionByName(separation_pairs(large, written(large_blocks(large), "blocks")))
    return split_pairs(edges, of).join(of, ["component", "block"]).select("component", "block", "pair", "u", "v", "members")
