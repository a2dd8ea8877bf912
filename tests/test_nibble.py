"""Clusters of seeds against the same walk and sweep, done plainly."""

import random

from strandloom.operators import nibble


def plain(edges, seed, alpha, least):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    mass, waits = {}, {seed: 1.0}
    while full := {v: w for v, w in waits.items() if w >= least * len(near[v])}:
        for v, w in full.items():
            mass[v] = mass.get(v, 0) + alpha * w
            waits[v] -= w - (1 - alpha) / 2 * w
        for v, w in full.items():
            for u in near[v]:
                waits[u] = waits.get(u, 0) + (1 - alpha) / 2 * w / len(near[v])
    order = sorted(mass, key=lambda v: (-round(mass[v] / len(near[v]), 12), v))
    total, best = sum(map(len, near.values())), None
    for k in range(1, len(order) + 1):
        inside = set(order[:k])
        part = min(sum(len(near[v]) for v in inside), total - sum(len(near[v]) for v in inside))
        if part > 0:
            size = sum(u not in inside for v in inside for u in near[v]) / part
            if best is None or size < best[0]:
                best = size, inside
    return best


def test_planted_groups(spark):
    rng = random.Random(3)
    edges = [tuple(rng.sample([f"{g}{i:02}" for i in range(12)], 2)) for g in "abc" for _ in range(45)]
    edges += [("a00", "b00"), ("b01", "c01"), ("c02", "a02"), ("a00", "a00"), ("x", "y")]
    seeds = ["a05", "b07", "c00", "a05", "nowhere"]
    table = spark.createDataFrame([*edges, (None, "a00")], "a string, b string")
    rows = nibble.clusters(table, spark.createDataFrame([(s,) for s in [*seeds, None]], "contig string"), 0.25, 0.002).collect()
    found = {}
    for r in rows:
        found.setdefault(r["seed"], (r["conductance"], set()))[1].add(r["contig"])
    assert found == {s: plain(edges, s, 0.25, 0.002) for s in ("a05", "b07", "c00")}
    assert all({v[0] for v in inside} == {s[0]} for s, (_, inside) in found.items())


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert nibble.clusters(none, spark.createDataFrame([("a",)], "contig string")).count() == 0
