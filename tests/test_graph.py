"""Graph operators on small graphs whose results are known."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from strandloom.operators import blocks, bubbles, centrality, graph, layout, motifs, orient, splits


def edges(spark, pairs, ends="EB", size=5):
    rows = [(i, p[0], (p[2] if len(p) > 2 else ends)[0], p[1], (p[2] if len(p) > 2 else ends)[1], p[3] if len(p) > 3 else size) for i, p in enumerate(pairs)]
    return spark.createDataFrame(rows, "link_id long, a string, oa string, b string, ob string, bsize int")


def contigs(spark, names, length=1000):
    return spark.createDataFrame([(n, length) for n in names], "contig string, length int")


DIAMOND = [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")]


def test_star_is_flagged(spark):
    star = [("hub", f"leaf{i:02d}") for i in range(50)]
    scores = {r["contig"]: r["score"] for r in centrality.betweenness(edges(spark, star)).collect()}
    assert scores["hub"] == pytest.approx(1.0)
    assert all(v == 0 for k, v in scores.items() if k != "hub")
    assert [r["contig"] for r in centrality.outliers(centrality.betweenness(edges(spark, star))).collect()] == ["hub"]
    assert centrality.betweenness(edges(spark, star[:48])).count() == 0


def brandes(nodes, near):
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, back, paths, dist = [], {n: [] for n in nodes}, dict.fromkeys(nodes, 0), {s: 0}
        paths[s], queue = 1, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    back[w].append(v)
        depends = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in back[w]:
                depends[v] += paths[v] / paths[w] * (1 + depends[w])
            if w != s:
                score[w] += depends[w]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in score.items()}


def test_betweenness_agrees_with_brandes(spark):
    rng = random.Random(3)
    names = [f"n{i:02d}" for i in range(25)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(40)} | {(a, b) for a, b in zip(names, names[1:])}
    pairs = [p for p in pairs if p[0] != p[1]]
    near = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in names}
    got = {r["contig"]: r["score"] for r in centrality.betweenness(edges(spark, pairs), 10).collect()}
    want = brandes(names, near)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_blocks_and_pairs_of_a_diamond(spark):
    e = edges(spark, DIAMOND)
    assert [r["members"] for r in blocks.blocks(e).collect()] == [["a", "b", "s", "t"]]
    assert {(r["u"], r["v"]) for r in splits.separation_pairs(e).collect()} == {("s", "t"), ("a", "b")}
    found = bubbles.find_bubbles(e).collect()
    assert [(r["source"], r["sink"], r["members"]) for r in found] == [("s", "t", ["a", "b", "s", "t"])]
    assert [r["kind"] for r in motifs.bubble_classes(bubbles.find_bubbles(e)).collect()] == ["four"]


def test_triangles(spark):
    alone = edges(spark, [("s", "a"), ("a", "t"), ("s", "t")])
    assert splits.separation_pairs(alone).count() == 0
    between = edges(spark, [("x", "s"), ("s", "a"), ("a", "t"), ("s", "t"), ("t", "y")])
    found = bubbles.find_bubbles(between).collect()
    assert [(r["source"], r["sink"]) for r in found] == [("s", "t")]
    assert bubbles.find_bubbles(edges(spark, [*DIAMOND, ("t", "a")])).filter("source = 's' and sink = 't'").count() == 0


def cut_by_force(pairs, members):
    def parts(gone):
        left = [m for m in members if m not in gone]
        if not left:
            return 0
        seen, todo = {left[0]}, [left[0]]
        while todo:
            u = todo.pop()
            for a, b in pairs:
                for x, y in ((a, b), (b, a)):
                    if x == u and y in left and y not in seen:
                        seen.add(y)
                        todo.append(y)
        return 2 if len(seen) < len(left) else 1

    return {(u, v) for u in members for v in members if u < v and parts({u, v}) == 2}


def test_separation_pairs_agree_with_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        names = list("abcdefg"[: rng.randint(4, 7)])
        pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(rng.randint(4, 12))}
        near = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in {x for p in pairs for x in p}}
        for block in blocks.biconnected(near):
            inside = {u: [v for v in near[u] if v in block] for u in block}
            got = {(u, v) for u in block for v in blocks.cuts(inside, u) if u < v}
            assert got == cut_by_force([(a, b) for a, b in pairs if a in block and b in block], sorted(block))


def test_ring_is_a_plasmid_and_no_path(spark):
    ring = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert [tuple(r) for r in motifs.plasmids(ring).collect()] == [("a", 3)]
    assert motifs.cycle_basis(ring).count() == 1
    none = bubbles.find_bubbles(ring)
    assert layout.trace_paths(layout.match_ends(layout.end_edges(bubbles.collapse(ring, none)))).count() == 0


def scaffold(spark, e, names):
    found = bubbles.find_bubbles(e)
    o = orient.orient_contigs(e, contigs(spark, names))
    paths = layout.trace_paths(layout.match_ends(layout.end_edges(bubbles.collapse(e, found))))
    parts = layout.scaffold_parts(e, o, found, paths)
    return o, layout.agp(parts, contigs(spark, names))


def test_chain_is_one_scaffold(spark):
    _, rows = scaffold(spark, edges(spark, [("a", "b"), ("b", "c")]), "abcd")
    got = [tuple(r) for r in rows.orderBy("scaffold", "part").select("scaffold", "begin", "end", "part", "contig", "strand").collect()]
    assert got == [("scaffold_1", 1, 1000, 0, "a", "+"), ("scaffold_1", 1001, 2000, 1, "b", "+"), ("scaffold_1", 2001, 3000, 2, "c", "+"), ("scaffold_2", 0, 1000, 1, "d", "+")]


def test_matching_takes_the_largest(spark):
    m = layout.match_ends(layout.end_edges(bubbles.collapse(edges(spark, [("a", "b", "EB", 9), ("a", "c", "EB", 5)]), bubbles.find_bubbles(edges(spark, [("a", "b")])))))
    assert [(r["p"]["node"]["name"], r["q"]["node"]["name"]) for r in m.collect()] == [("a", "b")]


def test_matching_agrees_with_one_scan(spark):
    rng = random.Random(11)
    names = [f"n{i}" for i in range(12)]
    pairs = list({(a, b): (a, b, rng.choice(["EB", "BB", "EE", "BE"]), rng.randint(1, 4)) for a, b in (rng.sample(names, 2) for _ in range(60))}.values())
    e = layout.end_edges(bubbles.collapse(edges(spark, pairs), bubbles.find_bubbles(edges(spark, [("q", "r")]))))
    used, want = set(), set()
    for a, b, o, s in sorted(pairs, key=lambda x: (-x[3], (x[0], x[2][0]), (x[1], x[2][1]))):
        p, q = (a, o[0]), (b, o[1])
        if p not in used and q not in used:
            used |= {p, q}
            want.add((p, q))
    got = {((r["p"]["node"]["name"], r["p"]["end"]), (r["q"]["node"]["name"], r["q"]["end"])) for r in layout.match_ends(e).collect()}
    assert got == want


def test_bubble_goes_into_a_scaffold(spark):
    e = edges(spark, [("x", "s"), *DIAMOND, ("t", "y")])
    _, rows = scaffold(spark, e, ["x", "s", "a", "b", "t", "y"])
    by = {}
    for r in rows.orderBy("scaffold", "part").collect():
        by.setdefault(r["scaffold"], []).append(r["contig"])
    assert sorted(map(tuple, by.values())) == [("b",), ("x", "s", "a", "t", "y")]
    assert any(k.endswith("_variant") for k in by)


def test_orientation_votes_and_counts(spark):
    tie = edges(spark, [("a", "c", "EB", 3), ("b", "c", "EE", 3), ("a", "b", "EB", 1)])
    got = {r["contig"]: r["orient"] for r in orient.orient_contigs(tie, contigs(spark, "abc")).collect()}
    assert got["a"] == "FOW" and got["c"] == "FOW"
    lone = spark.createDataFrame([("z", 9000), ("a", 10), ("b", 10)], "contig string, length int")
    rows = {r["contig"]: (r["orient"], r["invalidated"]) for r in orient.orient_contigs(edges(spark, [("a", "b")]), lone).collect()}
    assert rows["z"] == ("FOW", 0)


def test_valid_links_keep_four_of_sixteen(spark):
    from strandloom.functions.links import congruent

    rows = [(x, y, o) for x in ("FOW", "REV") for y in ("FOW", "REV") for o in ("EB", "BE", "EE", "BB")]
    df = spark.createDataFrame(rows, "x string, y string, o string").filter(congruent(F.col("x"), F.col("y"), F.col("o")))
    assert {tuple(r) for r in df.collect()} == {("FOW", "FOW", "EB"), ("REV", "REV", "BE"), ("FOW", "REV", "EE"), ("REV", "FOW", "BB")}


def test_empty_graph(spark):
    e = edges(spark, [])
    assert graph.components(e).count() == 0
    assert blocks.blocks(e).count() == 0
    assert centrality.high_centrality(e, 1).count() == 0
    assert orient.orient_contigs(e, contigs(spark, "ab")).count() == 1


def test_long_path_is_traced(spark):
    n = 40
    names = [f"n{i:02d}" for i in range(n)]
    random.Random(2).shuffle(names)
    e = edges(spark, list(zip(names, names[1:])))
    rows = layout.trace_paths(layout.match_ends(layout.end_edges(bubbles.collapse(e, bubbles.find_bubbles(edges(spark, [("q", "r")])))))).orderBy("place").collect()
    got = [r["node"]["name"] for r in rows]
    assert got in (names, names[::-1]) and [r["place"] for r in rows] == list(range(n))
