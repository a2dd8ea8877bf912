"""Rings, bonds and rests of blocks against a search of all pairs."""

import random

from strandloom.operators import blocks, splits


def brute(edges):
    out = set()
    for block in blocks.biconnected(blocks._adjacency(edges)):
        inside = blocks._adjacency([(a, b) for a, b in edges if a in block and b in block])
        if len(block) > 2:
            out |= {(u, v) for u in block for v in blocks.cuts(inside, u) if u < v}
    return out


def sample(rng, g):
    """Random graphs, and such as grow by edges that become ways or double."""
    name = lambda i: f"g{g:03}n{i:02}"
    if rng.random() < 0.4:
        n = rng.randint(3, 9)
        return [(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(rng.randint(3, 20))]
    edges, n = [(0, 1), (1, 2), (0, 2)], 3
    for _ in range(rng.randint(0, 12)):
        a, b = rng.choice(edges)
        if rng.random() < 0.4:
            edges.remove((a, b))
        k = rng.randint(1, 3)
        way = [a, *range(n, n + k), b]
        edges += zip(way, way[1:])
        n += k
    return [(name(a), name(b)) for a, b in edges]


def classes_of(rows):
    found = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        found.setdefault((r["component"], r["block"], r["class"]), []).append(r)
    return [(v[0]["kind"], [(r["node"], None if r["virtual"] is None else "virtual" if r["virtual"] else "real") for r in v], v[0]["sides"]) for v in found.values()]


def test_pairs_within_blocks_agree_with_brute_force():
    rng = random.Random(3)
    for g in range(1500):
        edges = sample(rng, g)
        got = set()
        for block in blocks.biconnected(blocks._adjacency(edges)):
            inside = sorted({tuple(sorted(e)) for e in edges if set(e) <= block and e[0] != e[1]})
            if len(inside) > 2:
                got |= splits.pairs_within(splits.reduced((a, b, None) for a, b in inside))
        assert got == brute(edges), edges


def test_classes_in_tasks_and_over_chains(spark):
    rng = random.Random(6)
    edges = [e for g in range(150) for e in sample(rng, g)]
    edges += edges[:5] + [(b, a) for a, b in edges[5:9]] + [("loop", "loop")]
    graph = spark.createDataFrame(edges, "a string, b string")
    of = blocks.written(blocks.blocks(graph), "blocks")
    one = sorted(classes_of(splits.split_classes(graph, of).collect()), key=repr)
    two = sorted(classes_of(splits.split_classes(graph, of, most=4).collect()), key=repr)
    assert one == two
    assert splits.pairs_within(one) == brute(edges)
    assert {kind for kind, _, _ in one} == {"ring", "bond", "rest", "pair"}
    for kind, items, sides in one:
        if kind == "ring":
            assert len(items) > 2 and items[0] == min(items) and items[1][0] < items[-1][0]
        assert (sides is not None and sides > 2) == (kind == "bond")


def test_three_ways_and_nothing(spark):
    edges = [("s", "a"), ("a", "t"), ("s", "b"), ("b", "t"), ("s", "t"), ("t", "end")]
    graph = spark.createDataFrame(edges, "a string, b string")
    of = blocks.written(blocks.blocks(graph), "blocks")
    got = sorted(classes_of(splits.split_classes(graph, of).collect()), key=repr)
    ring = lambda x: ("ring", [(x, "real"), ("s", "virtual"), ("t", "real")], None)
    assert got == [("bond", [("s", None), ("t", None)], 3), ring("a"), ring("b")]
    assert splits.split_classes(graph.filter("a = 'x'"), of).count() == 0


def test_a_long_ring_is_one_class(spark):
    n = 100_000
    graph = spark.range(n).selectExpr("concat('n', lpad(cast(id * 7 % 100000 as string), 6, '0')) as a", "concat('n', lpad(cast((id + 1) % 100000 * 7 % 100000 as string), 6, '0')) as b")
    of = graph.selectExpr("'n000000' as component", "0 as block", "a as node").groupBy("component", "block").agg({"node": "collect_list"}).toDF("component", "block", "members")
    rows = splits.split_classes(graph, of, most=1000)
    row = rows.selectExpr("count(*)", "count(distinct class)", "count_if(virtual)", "min(place)", "max(place)", "min_by(node, place)").first()
    assert tuple(row) == (n, 1, 0, 0, n - 1, "n000000")
