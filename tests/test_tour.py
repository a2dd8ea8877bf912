"""Euler tours, blocks without a task for a component, lowest common ancestors, and graphs made acyclic, against brute force."""

import random

import pytest

from strandloom.operators import blocks, extras, tour


def graph(spark, edges):
    return spark.createDataFrame(edges, "a string, b string")


def adjacency(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return {u: sorted(vs) for u, vs in out.items()}


@pytest.fixture(scope="module")
def random_edges():
    rng = random.Random(4)
    edges = [(f"g{g:02}n{rng.randrange(n)}", f"g{g:02}n{rng.randrange(n)}") for g in range(40) for n in [rng.randint(2, 14)] for _ in range(rng.randint(1, 22))]
    return edges + edges[:5] + [(b, a) for a, b in edges[5:9]] + [("loop", "loop")]


def test_blocks_of_random_graphs(spark, random_edges):
    both = blocks.blocks(graph(spark, random_edges), most=4).collect()  # some components in a task, others by tour
    assert sorted(r["members"] for r in both) == sorted(sorted(b) for b in blocks.biconnected(adjacency(random_edges)))
    alone = blocks.blocks(graph(spark, random_edges)).collect()
    key = lambda rows: sorted((r["component"], r["block"], r["members"]) for r in rows)
    assert key(both) == key(alone)


def test_forest_of_random_graphs(spark, random_edges):
    forest, tree = tour.rooted_forest(graph(spark, random_edges))
    rows = {r["contig"]: r for r in forest.collect()}
    assert sorted(rows) == sorted({x for e in random_edges for x in e})
    assert sorted(r["pre"] for r in rows.values()) == list(range(len(rows)))
    links = {frozenset(r) for r in tree.collect()}
    below = {x: {x} for x in rows}
    for x, r in rows.items():
        assert (r["parent"] is None) == (r["root"] == x)
        if r["parent"]:
            assert frozenset((x, r["parent"])) in links and rows[r["parent"]]["pre"] < r["pre"]
        up = r["parent"]
        while up:
            below[up].add(x)
            up = rows[up]["parent"]
    assert all({rows[y]["pre"] for y in below[x]} == set(range(r["pre"], r["pre"] + r["size"])) for x, r in rows.items())
    assert len(links) == len(rows) - len({r["root"] for r in rows.values()})


def test_biconnectivity(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)]
    assert tour.is_biconnected(graph(spark, ring))
    assert not tour.is_biconnected(graph(spark, [*ring, ("x", "y")]))
    members = tour.block_members(graph(spark, [*ring, ("n3", "x")]))
    assert [r["contig"] for r in tour.cut_nodes(members).collect()] == ["n3"]
    assert tour.block_members(graph(spark, [("loop", "loop")])).collect() == []


def test_range_extremes(spark):
    rng = random.Random(9)
    low, high = [rng.randrange(99) for _ in range(70)], [rng.randrange(99) for _ in range(70)]
    asked = [(f"q{i}", a := rng.randrange(70), rng.randint(1, 70 - a)) for i in range(60)] + [("all", 0, 70), ("wide", 3, 64)]
    values = spark.createDataFrame(list(zip(range(70), low, high)), "pre long, low long, high long")
    got = {r["contig"]: (r["low"], r["high"]) for r in tour.range_extremes(values, spark.createDataFrame(asked, "contig string, pre long, size long")).collect()}
    assert got == {q: (min(low[a : a + n]), max(high[a : a + n])) for q, a, n in asked}


def test_lowest_common_ancestors(spark):
    rng = random.Random(3)
    parent = {f"t{i:02}": (f"t{rng.randrange(max(0, i - 4), i):02}" if i else None) for i in range(60)} | {"u0": None, "u1": "u0", "u2": "u1"}
    names = [*parent, "stranger"]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(150)] + [("t05", "t05"), ("u0", "u2")]

    def ups(x):
        out = []
        while x is not None and x in parent:
            out.append(x)
            x = parent[x]
        return out

    want = {(x, y): next((u for u in ups(x) if u in ups(y)), None) for x, y in pairs}
    forest = spark.createDataFrame(list(parent.items()), "contig string, parent string")
    got = tour.lowest_common_ancestors(forest, spark.createDataFrame(pairs, "x string, y string"))
    assert got.count() == len(pairs)
    assert {(r["x"], r["y"]): r["ancestor"] for r in got.collect()} == want
    assert tour.lowest_common_ancestors(forest.filter("1 = 0"), spark.createDataFrame(pairs[:2], "x string, y string")).filter("ancestor is not null").count() == 0
    with pytest.raises(ValueError, match="ring"):
        tour.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "contig string, parent string"))


def test_made_acyclic(spark, random_edges):
    edges = graph(spark, random_edges)
    assert not extras.is_acyclic(edges)
    turned = {tuple(r) for r in extras.arcs_to_reverse(edges).collect()}
    out = extras.made_acyclic(edges)
    assert extras.is_acyclic(out)
    plain = {e for e in random_edges if e[0] != e[1]}
    assert turned < plain
    assert {tuple(r) for r in out.collect()} == {(b, a) if (a, b) in turned else (a, b) for a, b in plain}


def test_small_lots(spark, random_edges, monkeypatch):
    monkeypatch.setattr(tour.graph, "AT_ONCE", 5)
    monkeypatch.setattr(tour, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        chain = [(f"p{i:02}", f"p{i + 1:02}") for i in range(40)] + [("p07", "p31")]
        edges = graph(spark, [*random_edges, *chain])
        found = blocks.blocks(edges, most=0).collect()
        assert sorted(r["members"] for r in found) == sorted(sorted(b) for b in blocks.biconnected(adjacency([*random_edges, *chain])))
        test_forest_of_random_graphs(spark, [*random_edges, *chain])
        test_range_extremes(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_chain_takes_no_rounds(spark, monkeypatch):
    labels, plain = [], tour.written
    monkeypatch.setattr(tour, "written", lambda df, label: labels.append(label) or plain(df, label))
    found = blocks.blocks(graph(spark, [(f"p{i:03}", f"p{i + 1:03}") for i in range(300)]), most=0)
    assert found.count() == 300
    assert [labels.count(c) for c in ("ranks", "won", "extremes")] == [1, 0, 0]
