"""Greedy matching of contig ends against one scan over all edges."""

import random

from strandloom.operators import layout

SCHEMA = "p struct<node:struct<bubble:boolean,name:string>,end:string>, q struct<node:struct<bubble:boolean,name:string>,end:string>, bsize int"


def end(name):
    return ((False, name[:-1]), name[-1])


def edges_of(spark, rows):
    return spark.createDataFrame([(end(p), end(q), n) for p, q, n in rows], SCHEMA)


def found(spark, rows):
    got = layout.match_ends(edges_of(spark, rows)).collect()
    return sorted((r["p"]["node"]["name"] + r["p"]["end"], r["q"]["node"]["name"] + r["q"]["end"], r["bsize"]) for r in got)


def scanned(rows):
    used, out = set(), []
    for n, p, q in sorted((-n, p, q) for p, q, n in rows):
        if p not in used and q not in used:
            out.append((p, q, -n))
            used |= {p, q}
    return sorted(out)


def test_random_graphs(spark):
    rng = random.Random(8)
    rows = []
    for g in range(120):
        n, sizes = rng.randint(2, 12), rng.choice([1, 3, 40])
        name = lambda: f"g{g:03}n{rng.randrange(n):02}{rng.choice('BE')}"  # noqa: B023, E731
        rows += [(name(), name(), rng.randint(1, sizes)) for _ in range(rng.randint(1, 30))]
    rows += [(f"path{k}n{i:03}B", f"path{k}n{i + 1:03}B", rng.randint(1, 9)) for k in range(6) for i in range(60)]
    rows += rows[:9] + [(q, p, n) for p, q, n in rows[9:20]]
    assert found(spark, rows) == scanned(rows)


def test_rising_and_falling_chains(spark, monkeypatch):
    rounds = []
    plain = layout.written
    monkeypatch.setattr(layout, "written", lambda df, label: (rounds.append(label), plain(df, label))[1])
    rows = [(f"n{i:05}B", f"n{i + 1:05}B", i) for i in range(10_000)] + [(f"m{i:05}B", f"m{i + 1:05}B", 600 - i) for i in range(501)]
    assert found(spark, rows) == scanned(rows)
    assert rounds.count("won") == 1


def test_no_edges(spark):
    assert found(spark, []) == []


def traced(rows):
    return sorted((r["path"]["node"]["name"], r["path"]["end"], r["place"], r["node"]["name"], r["entry"], r["exit"]) for r in rows.collect())


def test_small_components_take_one_pass(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"g{g:02}n{rng.randrange(9)}{rng.choice('BE')}", f"g{g:02}n{rng.randrange(9)}{rng.choice('BE')}", rng.randint(1, 5)) for g in range(60) for _ in range(11)]
    rows += [(f"p{i:02}E", f"p{i + 1:02}B", i % 7) for i in range(40)] + [(f"r{i}E", f"r{(i + 1) % 5}B", 3) for i in range(5)]
    edges = edges_of(spark, rows)
    want = traced(layout.trace_paths(layout.match_ends(edges)))
    assert len(want) > 100 and traced(layout.scaffold_paths(edges, most=10)) == want
    rounds, plain = [], layout.written
    monkeypatch.setattr(layout, "written", lambda df, label: (rounds.append(label), plain(df, label))[1])
    assert traced(layout.scaffold_paths(edges)) == want
    assert not rounds
    assert traced(layout.scaffold_paths(edges_of(spark, []))) == []
