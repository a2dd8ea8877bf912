"""Betweenness of trees by their branches against the search from every node."""

import random

from strandloom.operators import centrality


def test_trees_need_no_search(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"a{i}", f"a{rng.randrange(i)}") for i in range(1, 40)] + [(f"b{i}", f"b{i + 1}") for i in range(12)] + [("b3", "b2"), ("b5", "b5")]
    ring = [(f"c{i}", f"c{(i + 1) % 6}") for i in range(6)]
    searched = []
    plain = centrality._dependencies
    monkeypatch.setattr(centrality, "_dependencies", lambda sources, near: searched.append(sources.count()) or plain(sources, near))
    got = {r["contig"]: r["score"] for r in centrality.betweenness(spark.createDataFrame(rows + ring, "a string, b string"), min_nodes=3).collect()}
    assert searched == [6]
    near = {}
    for a, b in rows + ring:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert set(got) == set(near)

    def reach(v, without):
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen - {without}:
                seen.add(w)
                todo.append(w)
        return len(seen)

    for v in near:
        if v[0] != "c":
            sizes = [reach(w, v) for w in near[v]]
            n = sum(sizes) + 1
            assert got[v] == ((n - 1) ** 2 - sum(s * s for s in sizes)) / ((n - 1) * (n - 2))
