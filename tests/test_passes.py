"""How often queries go over their tables."""

from strandloom.operators import extras, graph
from strandloom.plans import derived, registry


def test_alignments_are_paired_once(spark, sf, monkeypatch):
    calls, plain = [], derived.alignments
    monkeypatch.setattr(derived, "alignments", lambda *a: calls.append(a) or plain(*a))
    registry.QUERIES["p14_filtered_links"](spark, sf)
    assert len(calls) == 1


def test_page_rank_writes_once_in_several_rounds(spark, monkeypatch):
    labels, plain = [], extras.written
    monkeypatch.setattr(extras, "written", lambda df, label: labels.append(label) or plain(df, label))
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c")], "a string, b string")
    assert extras.page_rank(edges, rounds=12, threshold=0.0).count() == 4
    assert labels.count("rank") == 3


def test_sources_and_sinks_need_no_join(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "d")], "a string, b string")
    assert [r["contig"] for r in extras.sources(edges).collect()] == ["a"]
    assert [r["contig"] for r in extras.sinks(edges).collect()] == ["c"]
    assert "Join" not in extras.sources(edges)._jdf.queryExecution().toString()


def test_plasmids_take_components_once(spark, sf, monkeypatch):
    calls, plain = [], graph._stars
    monkeypatch.setattr(graph, "_stars", lambda *a, **k: calls.append(a) or plain(*a, **k))
    assert registry.QUERIES["k17_plasmid_rows"](spark, sf).columns == ["value"]
    assert len(calls) == 1
