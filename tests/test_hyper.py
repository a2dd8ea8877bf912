"""Hypergraphs against brute force."""

import random

from strandloom.operators import hyper


def test_random_hypergraphs(spark):
    rng = random.Random(2)
    rows = [(f"{g}:{rng.randrange(6)}", f"{g}:{rng.randrange(12)}") for g in range(30) for _ in range(rng.randint(1, 14))]
    rows += rows[:5]
    inside = hyper.incidence(spark.createDataFrame([*rows, (None, "x"), ("y", None)], "h string, v string"), "h", "v")
    held, holds = {}, {}
    for h, v in rows:
        held.setdefault(h, set()).add(v)
        holds.setdefault(v, set()).add(h)
    assert {r["node"]: r["degree"] for r in hyper.node_degrees(inside).collect()} == {v: len(hs) for v, hs in holds.items()}
    assert {r["edge"]: (r["size"], r["meetings"]) for r in hyper.edge_sizes(inside).collect()} == {h: (len(vs), sum(len(holds[v]) - 1 for v in vs)) for h, vs in held.items()}
    want = {}
    for v in holds:
        seen, todo = {v}, [v]
        while todo:
            for w in {w for h in holds[todo.pop()] for w in held[h]} - seen:
                seen.add(w)
                todo.append(w)
        want["node", v] = min(seen)
    want |= {("edge", h): want["node", min(vs)] for h, vs in held.items()}
    assert {(r["kind"], r["name"]): r["component"] for r in hyper.components(inside).collect()} == want


def test_empty(spark):
    inside = hyper.incidence(spark.createDataFrame([], "h string, v string"), "h", "v")
    assert hyper.components(inside).count() == hyper.edge_sizes(inside).count() == 0
