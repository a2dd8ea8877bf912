"""How few tables and shuffles the passes over components take, and that their results stay those of the plain steps."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import blocks, bubbles, graph, layout, splits, tour
from strandloom.plans import derived


def test_a_customers_edges_lie_together(spark, sf):
    rows = derived.order_flow(spark, sf).withColumn("part", F.spark_partition_id())
    found = rows.join(graph.components(rows.select("a", "b")).withColumnRenamed("contig", "a"), "a")
    assert found.groupBy("component").agg(F.countDistinct("part").alias("n")).filter("n > 1").isEmpty()


def test_tours_within_lots_write_one_table(spark, sf, monkeypatch):
    made, plain = [], tour.written
    monkeypatch.setattr(tour, "written", lambda df, label: made.append(label) or plain(df, label))
    flow = derived.order_flow(spark, sf).filter("a < 'o000000300'")
    by_tour, by_search = blocks.blocks(flow, most=0), blocks.blocks(flow)
    assert sorted(by_tour.collect()) == sorted(by_search.collect())
    assert len(made) == 1


@pytest.fixture(scope="module")
def tangle(spark):
    """Bubbles of several shapes, rings and chains, joined at random, with loops and a size that is null."""
    rng, rows = random.Random(8), {}
    for i in range(40):
        for m in "abc"[: 2 + i % 2]:
            rows[f"s{i}", f"{m}{i}"] = rows[f"{m}{i}", f"t{i}"] = rng.randrange(1, 30)
        if i % 5 == 0:
            rows[f"t{i}", f"s{i}"] = 4
        if i % 7 == 0:
            rows[f"a{i}", f"s{i}"] = 3
        if i % 3:
            rows[f"t{i}", f"s{i + 1}"] = None if i == 7 else rng.randrange(1, 30)
        if i % 4 == 1:
            rows[f"s{i}", f"t{i + 2}"] = 6
    rows |= {(f"x{rng.randrange(12)}", f"x{rng.randrange(12)}"): rng.randrange(9) for _ in range(18)} | {("s3", "s3"): 2, ("s4", "out"): 5, ("in", "t4"): 8}
    return spark.createDataFrame([(a, rng.choice("BE"), b, rng.choice("BE"), n) for (a, b), n in rows.items()], "a string, oa string, b string, ob string, bsize int")


def rows_of(df):
    return sorted(repr(r) for r in df.select(*sorted(df.columns)).collect())


def test_class_lists(tangle):
    rows = splits.split_classes(tangle)
    lists = rows.groupBy("component", "block", "class", "kind", "sides").agg(F.sort_array(F.collect_list(F.struct("place", "node", "virtual"))).alias("r"))
    want = rows_of(lists.select("component", "block", "class", "kind", F.col("r.node").alias("nodes"), F.col("r.virtual").alias("virtual"), "sides"))
    assert rows_of(splits.split_class_lists(tangle)) == want
    assert rows_of(splits.split_class_lists(tangle, most=2).drop("class")) == rows_of(splits.split_class_lists(tangle).drop("class"))


def test_collapsed_in_one_pass(tangle):
    found = bubbles.find_bubbles(tangle)
    assert found.count() > 15
    want = rows_of(bubbles.collapse(tangle, found))
    assert rows_of(bubbles.collapsed(tangle)) == want == rows_of(bubbles.collapsed(tangle, most=2))


def test_scaffolds_in_one_pass(tangle):
    want = rows_of(layout.scaffold_paths(layout.end_edges(bubbles.collapse(tangle, bubbles.find_bubbles(tangle)))))
    assert len(want) > 20
    assert rows_of(layout.bubble_scaffolds(tangle)) == want == rows_of(layout.bubble_scaffolds(tangle, most=2))


def test_bubble_paths_in_one_pass(tangle):
    want = rows_of(layout.bubble_paths(tangle, bubbles.find_bubbles(tangle)))
    assert rows_of(layout.own_bubble_paths(tangle)) == want == rows_of(layout.own_bubble_paths(tangle, most=2))
