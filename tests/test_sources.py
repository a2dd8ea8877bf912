"""Readers, writers, mates and bundles on hand-made files."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandloom.config import Config
from strandloom.functions import links as fl, sequences as fs
from strandloom.operators import bundle, pairs, repeats
from strandloom.plans import scaffold
from strandloom.sources import readers, writers
from strandloom.streaming.mates import matched_mates


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_mates(spark, tmp_path):
    bed = "c1 0 9 r/1 60 +\nc2\t5\t9\tr/2\t60\t-\textra\nc3 1 2 r/3 0 +\nc1 0 1 q 0 +\nc2 0 1 q 0 -\nc3 0 1 q 0 +\nc1 0 1 a 0 +\n"
    rows = {r["read"]: r for r in pairs.mate_pairs(readers.read_bed(spark, put(tmp_path, "a.bed", bed))).collect()}
    assert (rows["r"]["m1"]["contig"], rows["r"]["m2"]["contig"]) == ("c1", "c3")
    assert (rows["q"]["m1"]["contig"], rows["q"]["m2"]["contig"]) == ("c1", "c3")
    assert rows["a"]["m2"] is None


def test_distances_and_sizes(spark):
    row = spark.createDataFrame([(300.0, 900, 950, 1000, 50, 100, 800)], "m double, s1 int, e1 int, l1 int, s2 int, e2 int, l2 int")
    c = F.col
    got = [row.select(fl.gap_distance(c("m"), F.lit(a), c("s1"), c("e1"), c("l1"), F.lit(b), c("s2"), c("e2"), c("l2"))).first()[0] for a, b in ("EB", "BB", "EE", "BE")]
    assert got == [100, -750, -550, -1400]
    sizes = spark.sql("select 10 a, 60 b, 100 c, 150 d")
    assert sizes.select(fl.insert_size(c("a"), c("b"), c("c"), c("d")), fl.insert_size(c("c"), c("d"), c("a"), c("b"))).first()[:] == (141, 141)


def test_bundles(spark):
    rows = [("r%d" % i, "A", "E", "B", "B", 10.0, 0.0) for i in range(4)] + [("s%d" % i, "B", "E", "A", "B", 10.0, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "read string, a string, oa string, b string, ob string, mean double, stdev double")
    assert [tuple(r) for r in bundle.bundled_links(df).collect()] == [("A", "E", "B", "B", 10.0, 0.5, 4)]
    two = spark.createDataFrame([("a", "A", "E", "B", "B", 0.5, 1 / 6), ("b", "A", "E", "B", "B", 10.5, 1 / 6)], df.schema)
    assert [(r["mean"], r["bsize"]) for r in bundle.bundled_links(two, 1).collect()] == [(pytest.approx(0.5), 1)]
    assert bundle.bundle_all(two.limit(1), 0).count() == 0


def sweep(links):
    """Opens and closes the intervals in order, the last one never, and keeps the point of most that are open."""
    spans = sorted((int(m - 3 * s), i, m - 3 * s, m + 3 * s) for i, (m, s) in enumerate(links))
    best, point = 0, None
    for place, (_, _, lo, _) in enumerate(spans[:-1]):
        depth = place + 1 - sum(hi < lo for _, _, _, hi in spans)
        if depth > best:
            best, point = depth, lo
    return sum(m - 3 * s <= point <= m + 3 * s for m, s in links) if point is not None else 0


def test_clique_agrees_with_a_sweep(spark):
    rng = random.Random(4)
    groups = {f"k{g}": [(rng.uniform(-50, 50), 5.0) for _ in range(rng.randint(4, 12))] for g in range(60)}
    rows = [(f"{i:03d}", g, "E", "B", "B", m, s) for g, links in groups.items() for i, (m, s) in enumerate(links)]
    df = spark.createDataFrame(rows, "read string, a string, oa string, b string, ob string, mean double, stdev double")
    got = {r["a"]: r["bsize"] for r in bundle.bundle_all(df, 3).collect()}
    assert got == {g: sweep(links) for g, links in groups.items()}


def test_length_filter_comes_after_statistics(spark):
    mate = lambda c, s: (c, s, s + 10, "+")
    rows = [("a", mate("x", 0), mate("x", 90)), ("b", mate("x", 0), mate("y", 0)), ("c", mate("y", 0), mate("z", 0))]
    kind = "struct<contig:string,start:int,end:int,strand:string>"
    df = spark.createDataFrame(rows, f"read string, m1 {kind}, m2 {kind}")
    contigs = spark.createDataFrame([("x", 500), ("y", 900)], "contig string, length int")
    assert pairs.library_stats(df).first()[:] == (101.0, 0.0, 1)
    assert pairs.links(df, contigs).count() == 0
    assert pairs.coverage(df, contigs).first()["coverage"] == pytest.approx(101 / 500)
    assert pairs.library_stats(df.filter("read = 'b'")).first()["mean"] != pairs.library_stats(df.filter("read = 'b'")).first()["mean"]


def test_percentile(spark):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([1, 2, 5, 9.5, 11, 7.25])], "contig string, coverage double")
    assert {r["coverage"] for r in repeats.percentile_outliers(df, "coverage").collect()} == {9.5, 11.0}


def test_repeat_filter_precedence(spark):
    links = spark.createDataFrame([(0, "r", "E", "x", "B", 1.0, 1.0, 4), (1, "x", "E", "r", "B", 1.0, 1.0, 4), (2, "x", "E", "y", "B", -900.0, 1.0, 4)], "link_id long, a string, oa string, b string, ob string, mean double, stdev double, bsize int")
    contigs = spark.createDataFrame([("x", 800), ("y", 1000), ("r", 1000)], "contig string, length int")
    flat = spark.createDataFrame([("r", 1.0)], "contig string, score double")
    none = spark.createDataFrame([], "contig string")
    stay, gone = repeats.filter_links(links, contigs, flat, none)
    assert [r["link_id"] for r in stay.collect()] == [0]
    assert {r["contig"] for r in gone.collect()} == {"r", "x"}


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">a one\nACG\nTNR\n>b\n" + "A" * 160 + "\n>a two\nGG\n")
    seqs = readers.read_fasta(spark, path)
    assert {r["contig"]: r["seq"] for r in seqs.collect()} == {"a": "GG", "b": "A" * 160}
    assert {r["contig"]: r["length"] for r in readers.fasta_lengths(seqs).collect()} == {"a": 2, "b": 160}
    line = spark.createDataFrame([("ACGTNRacgtn",)], "s string").select(fs.reverse_complement(F.col("s"))).first()[0]
    assert line == "nacgtNNACGT"
    for n, want in ((79, 1), (80, 1), (81, 2), (160, 2)):
        assert spark.range(1).select(fs.wrapped(F.lit("A" * n))).first()[0].count("\n") + 1 == want


def test_links_stop_at_a_bad_line(spark, tmp_path):
    path = put(tmp_path, "l", "a E b B 1.5 2 4\nc E d B 1 2 5\nbroken E\ne E f B 1 2 6\n")
    assert [(r["link_id"], r["a"]) for r in readers.read_links(spark, path, bundled=True).orderBy("link_id").collect()] == [(0, "a"), (1, "c")]
    assert [r["link_id"] for r in readers.read_links(spark, path).orderBy("link_id").collect()] == [1, 2]


def test_gml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a", "FOW", 10), (2, "b", "REV", 20)], "id long, label string, orientation string, length int")
    edges = spark.createDataFrame([(1, 2, "EE", 1.5, 0.25, 4)], "source long, target long, orientation string, mean double, stdev double, bsize int")
    writers.save(writers.gml_rows(nodes, edges), str(tmp_path / "g"), one_file=True)
    n, e = readers.read_gml(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert [tuple(r) for r in e.collect()] == [("a", "b", "EE", 1.5, 0.25, 4)]


def test_bam(spark, tmp_path):
    name = b"q1\0"
    body = struct.pack("<iiBBHHHiiii", 0, 7, len(name), 30, 0, 2, 16 | 64, 4, -1, -1, 0) + name + struct.pack("<2I", 4 << 4 | 0, 3 << 4 | 1) + b"\x11\x11" + b"\0" * 4
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99)
    (tmp_path / "x.bam").write_bytes(gzip.compress(head + struct.pack("<i", len(body)) + body))
    assert [tuple(r)[:6] for r in readers.read_bam(spark, str(tmp_path / "x.bam")).collect()] == [("c1", 7, 11, "q1/1", 30, "-")]


def test_pairs_and_bubbles_files(spark, tmp_path):
    path = put(tmp_path, "p", "b a x y\na b x z\n")
    assert [(r["u"], r["v"], r["members"]) for r in readers.read_pairs(spark, path).collect()] == [("a", "b", ["x", "z"])] * 2
    rows = spark.createDataFrame([("c", "s", "t", ["s", "t", "a"])], "component string, source string, sink string, members array<string>")
    assert writers.bubble_rows(rows).first()[0] == "s\tt\ts\tt\ta\t"


def test_whole_run(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    names = ["c1", "c2", "c3", "c4"]
    fasta = "".join(f">{n}\n{''.join(rng.choice('ACGT') for _ in range(1000))}\n" for n in names)
    bed = []
    for i in range(20):
        bed += [f"c1 {i} {i + 100} in{i}/1 60 +", f"c1 {i + 200} {i + 300} in{i}/2 60 -"]
    for k, (a, b) in enumerate([("c1", "c2"), ("c2", "c3")]):
        for i in range(5):
            bed += [f"{a} {880 + i} {980 + i} x{k}{i}/1 60 +", f"{b} {10 + i} {110 + i} x{k}{i}/2 60 -"]
    inputs = readers.read_bed(spark, put(tmp_path, "m.bed", "\n".join(bed) + "\n")), readers.read_fasta(spark, put(tmp_path, "a.fa", fasta))
    config = Config(tables=str(tmp_path / "tables"))
    out = scaffold.run(*inputs, config)
    agp = [tuple(r) for r in out["agp"].orderBy("scaffold", "part").select("scaffold", "part", "contig").collect()]
    assert agp == [("scaffold_1", 0, "c1"), ("scaffold_1", 1, "c2"), ("scaffold_1", 2, "c3"), ("scaffold_2", 1, "c4")]
    assert {r["scaffold"]: len(r["seq"]) for r in out["scaffolds"].collect()} == {"scaffold_1": 3200, "scaffold_2": 1000}
    files = {name: [r["value"] for r in rows.collect()] for name, rows in scaffold.kept_files(out, config).items()}
    assert files["seppairs"] == files["repeats"] == files["high_centrality"] == []
    assert files["invalidated_counts"] == ["c1\t0", "c2\t0", "c3\t0"]
    assert [len(files[n]) for n in ("bundled_graph.gml", "oriented.gml")] == [7, 7]
    writers.save(scaffold.writers.oriented_gml(out["orientation"], out["contigs"], out["oriented"]), str(tmp_path / "o"), one_file=True)
    nodes, edges = readers.read_gml(spark, str(tmp_path / "o"))
    assert sorted((r["label"], r["length"]) for r in nodes.collect()) == [("c1", 1000), ("c2", 1000), ("c3", 1000)]
    assert [tuple(r)[-1] for r in edges.collect()] == [5, 5]
    # a second run goes on after the stages that are whole
    (tmp_path / "tables" / "agp" / "_SUCCESS").unlink()
    monkeypatch.setattr(scaffold.orient, "orient_contigs", None)
    assert scaffold.run(*inputs, config)["agp"].count() == 4


def test_motif_and_centrality_files(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x'", "y"), ("y", "z")], "a string, b string")
    found = spark.createDataFrame([("c", "s", "t", ["s", "t", "a"]), ("c", "u", "v", list("uvabc"))], "component string, source string, sink string, members array<string>")
    files = {name: [r["value"] for r in rows.collect()] for name, rows in writers.motif_files(edges, found).items()}
    assert files == {"plasmids": ["['a', 'b', 'c']"], "three_bubbles": ["s\tt\ts\tt\ta\t"], "four_bubbles": [], "complex_bubbles": ["u\tv\tu\tv\ta\tb\tc\t"], "cycles": files["cycles"]}
    assert len(files["cycles"]) == 1 and sorted(files["cycles"][0]) == sorted("['a', 'b', 'c']")
    assert spark.range(1).select(writers.listed(F.array(F.lit("x'"), F.lit("\\")))).first()[0] == r"['x\'', '\\']"
    central = spark.createDataFrame([("k", 0.5, 1), ("j", 0.25, 2)], "contig string, score double, round int")
    assert [r["value"] for r in writers.central_rows(central).collect()] == ["k\t0.5", "k\t0.5", "j\t0.25", "k\t0.5", "j\t0.25"]


def test_mates_in_a_stream(spark, tmp_path):
    ddl = "contig string, start int, end int, read string, strand string, ts timestamp"
    rows = spark.sql("select 'c1' contig, 1 start, 2 `end`, 'r/1' read, '+' strand, timestamp '2024-01-01 00:00:00' ts union all select 'c2', 1, 2, 'r/2', '-', timestamp '2024-01-01 00:01:00' union all select 'c2', 1, 2, 'late/2', '-', timestamp '2024-01-01 09:01:00'")
    rows.write.parquet(str(tmp_path / "in"))
    q = matched_mates(spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("mates").start()
    try:
        q.processAllAvailable()
        assert [r["read"] for r in spark.sql("select * from mates").collect()] == ["r"]
    finally:
        q.stop()
