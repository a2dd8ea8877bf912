"""Bases of cycles against what linear algebra says of them."""

import random

from strandloom import shared
from strandloom.operators import tour


def test_random_graphs(spark):
    rng = random.Random(9)
    rows = []
    for g in range(20):
        names = [f"{g:02}{c}" for c in "abcdefghi"]
        rows += [tuple(rng.sample(names, 2)) for _ in range(rng.randint(3, 18))]
    rows += [(f"r{i:03}", f"r{(i + 1) % 75:03}") for i in range(75)]
    rows += [("00a", "00a"), *rows[:4]]
    found = {}
    for r in tour.fundamental_cycles(spark.createDataFrame(rows, "a string, b string")).collect():
        found.setdefault((r["component"], r["a"], r["b"]), []).append((r["place"], r["contig"]))
    plain = {(min(e), max(e)) for e in rows if e[0] != e[1]}
    near = {}
    for a, b in plain:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    part = {}
    for v in sorted(near):
        todo = [v] if v not in part else []
        while todo:
            u = todo.pop()
            if u not in part:
                part[u] = v
                todo += near[u]
    spaces = {}
    for (component, a, b), nodes in found.items():
        nodes = [v for place, v in sorted(nodes)]
        assert sorted(p for p, _ in found[component, a, b]) == list(range(len(nodes)))
        assert nodes[0] == a and nodes[-1] == b and len(set(nodes)) == len(nodes) >= 3 and part[a] == component
        ring = {(min(u, v), max(u, v)) for u, v in zip(nodes, nodes[1:] + nodes[:1])}
        assert ring <= plain
        # a basis has no sum of others: each new ring leaves something
        space = spaces.setdefault(component, {})
        while ring and min(ring) in space:
            ring = ring ^ space[min(ring)]
        assert ring
        space[min(ring)] = ring
    assert sum(len(s) for s in spaces.values()) == len(plain) - len(near) + len(set(part.values()))
    assert len(found["r000", *next((a, b) for c, a, b in found if c == "r000")]) == 75


def test_no_cycle(spark):
    assert tour.fundamental_cycles(spark.createDataFrame([], "a string, b string")).count() == 0
    assert tour.fundamental_cycles(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("c", "b")], "a string, b string")).count() == 0


def test_no_table_is_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c")], "a string, b string")
    plans, plain = [], shared.written
    monkeypatch.setattr(shared, "written", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or plain(df, label))
    plans.append(tour.fundamental_cycles(edges)._jdf.queryExecution().toString())
    joins = [line for p in plans for line in p.split("== Physical Plan ==")[1].splitlines() if "Join" in line]
    # but the counts of ranges
    assert joins and not [j for j in joins if "BroadcastHashJoin" in j and "__part" not in j]
