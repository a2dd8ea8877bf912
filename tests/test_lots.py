"""Components contracted in small lots, and what is found in one pass over a component against the same by rounds of joins."""

import random

import pytest

from strandloom.operators import blocks, bubbles, graph, hyper, layout, splits


@pytest.fixture(scope="module")
def tangle(spark):
    """Bubbles of several shapes, rings and chains, joined at random; some loops and repeated edges."""
    rng, rows = random.Random(5), []
    for i in range(40):
        rows += [(f"s{i}", f"{m}{i}") for m in "abc"[: 2 + i % 2]] + [(f"{m}{i}", f"t{i}") for m in "abc"[: 2 + i % 2]]
        if i % 5 == 0:
            rows += [(f"t{i}", f"s{i}")]
        if i % 3:
            rows += [(f"t{i}", f"s{i + 1}")]
    rows += [(f"s{i}", f"s{i}") for i in (3, 9)] + rows[:7]
    rows += [(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}") for _ in range(18)]
    return spark.createDataFrame([(a, "E", b, "B", rng.randrange(1, 30)) for a, b in rows], "a string, oa string, b string, ob string, bsize int")


def rows_of(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("n, m", [(30, 20), (300, 280), (60, 200)])
def test_components_in_small_lots(spark, monkeypatch, n, m):
    rng = random.Random(n)
    pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)] + [(f"p{i}", f"p{i + 1}") for i in range(50)]
    least = {v: v for e in pairs for v in e}
    for _ in least:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    monkeypatch.setattr(graph, "AT_ONCE", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        edges = spark.createDataFrame([*pairs, ("alone", None), (None, None)], "a string, b string").repartition(3)
        assert {r["contig"]: r["component"] for r in graph.components(edges).collect()} == least | {"alone": "alone"}
        parts, counts = graph.component_edges(edges)
        assert sorted((r["component"], r["a"], r["b"]) for r in parts.collect()) == sorted((least[a], a, b) for a, b in pairs)
        assert sum(r["n"] for r in counts.collect()) == len(pairs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_pairs_and_classes(tangle):
    assert rows_of(blocks.blocks(tangle)) == rows_of(blocks.blocks(tangle, most=2))
    assert rows_of(splits.separation_pairs(tangle)) == rows_of(splits.separation_pairs(tangle, most=2)) == rows_of(splits.separation_pairs(tangle, blocks.blocks(tangle)))
    assert rows_of(splits.split_classes(tangle).drop("class")) == rows_of(splits.split_classes(tangle, blocks.blocks(tangle)).drop("class"))


def test_bubbles_and_their_paths(tangle):
    found = bubbles.find_bubbles(tangle)
    assert found.count() > 20
    assert rows_of(found) == rows_of(bubbles.find_bubbles(tangle, most=2)) == rows_of(bubbles.find_bubbles(tangle, splits.separation_pairs(tangle)))
    paths = {r["source"]: r for r in layout.bubble_paths(tangle, found).collect()}
    assert set(paths) == {r["source"] for r in found.collect()}
    for r in found.collect():
        own = paths[r["source"]]
        assert sorted([*own["heaviest"], *(v for way in own["others"] for v in way)]) == sorted(r["members"])


def test_hyper_components_of_repeated_rows(spark):
    rows = spark.createDataFrame([("1", "x"), ("1", "y"), ("1", "x"), ("2", "y"), ("3", "z"), (None, "q"), ("3", None)], "e string, n string")
    want = {("edge", "1", "x"), ("edge", "2", "x"), ("edge", "3", "z"), ("node", "x", "x"), ("node", "y", "x"), ("node", "z", "z")}
    got = hyper.components(hyper.incidence(rows, "e", "n", repeated=True))
    assert sorted((r["kind"], r["name"], r["component"]) for r in got.collect()) == sorted(want)
