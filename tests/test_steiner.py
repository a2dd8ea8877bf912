"""Regions and trees of terminals against brute force."""

import itertools
import random

import pytest

from strandloom.operators import steiner


def spanning(nodes, weights):
    """Weight of the lightest tree over exactly these nodes, or None."""
    parent = {v: v for v in nodes}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    total, left = 0, len(nodes) - 1
    for w, a, b in sorted((w, a, b) for (a, b), w in weights.items() if a in parent and b in parent):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total, left = total + w, left - 1
    return total if left == 0 else None


def test_random_graphs(spark):
    rng = random.Random(5)
    rows, ends, graphs = [], [], {}
    for g in range(16):
        names = [f"{g:02}{c}" for c in "abcdefgh"]
        line = [(names[i], names[i + 1], rng.randint(0 if g % 2 else 1, 9)) for i in range(7)]
        own = line + [(*rng.sample(names, 2), rng.randint(1, 6)) for _ in range(7)]
        chosen = rng.sample(names, rng.randint(2, 5))
        rows += own
        ends += chosen
        graphs[f"{g:02}"] = own, chosen, names
    rows += [("00a", "00a", 1), (None, "00a", 1), ("00a", "00b", None)]
    edges = spark.createDataFrame(rows, "a string, b string, weight long")
    terminals = spark.createDataFrame([(v,) for v in [*ends, ends[0], "alone"]], "contig string")
    tree = [tuple(r) for r in steiner.steiner_tree(edges, terminals).select("a", "b", "weight").collect()]
    regions = {r["contig"]: r for r in steiner.regions(edges, terminals).collect()}
    assert regions["alone"]["owner"] == "alone"
    for g, (own, chosen, names) in graphs.items():
        weights = {}
        for a, b, w in own:
            key = min(a, b), max(a, b)
            weights[key] = min(w, weights.get(key, w))
        mine = [(a, b, w) for a, b, w in tree if a.startswith(g)]
        assert all(weights[a, b] == w for a, b, w in mine)
        inside = {v for a, b, _ in mine for v in (a, b)} | set(chosen)
        assert len(mine) == len(set(mine)) == len(inside) - 1
        assert spanning(inside, {(a, b): w for a, b, w in mine}) is not None
        degree = [v for a, b, _ in mine for v in (a, b)]
        assert {v for v in inside if degree.count(v) == 1} <= set(chosen)
        others = [v for v in names if v not in chosen]
        least = min(t for k in range(len(others) + 1) for more in itertools.combinations(others, k) if (t := spanning({*chosen, *more}, weights)) is not None)
        assert least <= sum(w for _, _, w in mine) <= 2 * least
        far = {(a, b): 0 if a == b else 10**6 for a in names for b in names}
        for (a, b), w in weights.items():
            far[a, b] = far[b, a] = min(w, far[a, b])
        for m, a, b in itertools.product(names, repeat=3):
            far[a, b] = min(far[a, b], far[a, m] + far[m, b])
        for v in names:
            near = min((far[t, v], t) for t in chosen)
            # where weights are zero a terminal in between may stand in for a smaller one behind it
            assert regions[v]["distance"] == near[0]
            assert far[regions[v]["owner"], v] == near[0]
            if regions[v]["parent"] is not None:
                assert regions[regions[v]["parent"]]["owner"] == regions[v]["owner"]


def test_edges_of_no_use(spark):
    none = spark.createDataFrame([], "a string, b string, weight long")
    terminals = spark.createDataFrame([("a",), (None,)], "contig string")
    assert steiner.steiner_tree(none, terminals).count() == 0
    some = spark.createDataFrame([("a", "b", 1)], "a string, b string, weight long")
    assert steiner.steiner_tree(some, terminals).count() == 0
    with pytest.raises(ValueError):
        steiner.regions(spark.createDataFrame([("a", "b", -1)], "a string, b string, weight long"), terminals)
