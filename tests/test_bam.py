"""BAM files read by many tasks, and the order of lines over several files."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandloom.sources import bam, readers, writers
from strandloom.sources.ordered import ordered_text


def record(rng, i, n_refs, long=False):
    name = f"q{i}".encode() + b"\0"
    cigar = [(rng.randint(1, 50) << 4) | rng.choice([0, 1, 2, 3, 4, 7, 8]) for _ in range(rng.randint(0, 4))]
    n = rng.randint(0, 40) if not long else 60_000
    flag = rng.choice([0, 4, 16, 64, 128, 80, 144])
    ref = rng.randrange(-1, n_refs)
    body = struct.pack("<iiBBHHHiiii", ref, rng.randint(0, 9999), len(name), rng.randint(0, 60), 0, len(cigar), flag, n, -1, -1, 0) + name
    body += struct.pack(f"<{len(cigar)}I", *cigar) + bytes(rng.randrange(256) for _ in range((n + 1) // 2)) + bytes([40]) * n
    return struct.pack("<i", len(body)) + body


def bgzf(data, size):
    out = b""
    for i in range(0, len(data), size):
        d = data[i : i + size]
        c = zlib.compressobj(1, zlib.DEFLATED, -15)
        z = c.compress(d) + c.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC\2\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(d), len(d))
    return out


def sample(seed, n, n_refs=3, long=()):
    rng = random.Random(seed)
    names = [f"contig{i}".encode() + b"\0" for i in range(n_refs)]
    head = b"BAM\1" + struct.pack("<i", 5) + b"@HD\t\n" + struct.pack("<i", n_refs) + b"".join(struct.pack("<i", len(x)) + x + struct.pack("<i", 999) for x in names)
    return head + b"".join(record(rng, i, n_refs, i in long) for i in range(n))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "2000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


COLUMNS = ["contig", "start", "end", "read", "mapq", "strand"]


def rows_of(df):
    return [tuple(r) for r in df.orderBy("line_no").select(COLUMNS).collect()]


def expected(data):
    return [(contig, start, end, read, mapq, strand) for contig, _, start, end, read, mapq, strand in bam.whole_rows(gzip.compress(data))]


@pytest.mark.parametrize(("block", "n_refs"), [(700, 3), (60_000, 3), (3_000, 9_000)])
def test_one_file_in_many_tasks(spark, small_splits, tmp_path, block, n_refs):
    data = sample(1, 3000, n_refs)
    (tmp_path / "a.bam").write_bytes(bgzf(data, block) + bgzf(b"", 1))
    assert ordered_text(spark, str(tmp_path), encoding="ISO-8859-1", lineSep=bam.MAGIC).select("offset").distinct().count() > 3
    assert rows_of(readers.read_bam(spark, str(tmp_path))) == expected(data)


def test_records_over_several_splits_and_files(spark, small_splits, tmp_path):
    """Records of 90 KB outgrow a split; the second file holds no record, the third is one gzip member without blocks."""
    one, two, three = sample(2, 400, long=(7, 8, 200, 399)), sample(3, 0), sample(4, 50)
    (tmp_path / "a.bam").write_bytes(bgzf(one, 5000))
    (tmp_path / "b.bam").write_bytes(bgzf(two, 5000))
    (tmp_path / "c.bam").write_bytes(gzip.compress(three))
    got = rows_of(readers.read_bam(spark, str(tmp_path)).filter("line_no >= 0"))
    assert sorted(got) == sorted(expected(one) + expected(two) + expected(three))


def test_wrongly_guessed_records_are_read_again(spark, small_splits, tmp_path, monkeypatch):
    data = sample(5, 450)
    (tmp_path / "a.bam").write_bytes(bgzf(data, 4000))
    blocks = ordered_text(spark, str(tmp_path), encoding="ISO-8859-1", lineSep=bam.MAGIC).withColumn("value", F.col("value").cast("binary"))
    names, headers = bam._headers(blocks)
    rims = [r.asDict() for r in bam._read(blocks, headers, {}).filter("kind = 1").orderBy("line_no").collect()]
    assert len(rims) > 2
    wrong = dict(rims[1], first=0, front=bytes(rims[1]["front"])[:4])
    last = list(bam.stitched([rims[0], wrong]))[-1]
    assert last[0] == 2 and last[-1] == rims[1]["first"] > 0
    monkeypatch.setattr(bam, "FOLLOW", 0)  # any place passes for a record's beginning
    assert rows_of(readers.read_bam(spark, str(tmp_path))) == expected(data)


def test_magic_bytes_within_a_block():
    rng = random.Random(6)
    stored = bytes(rng.randrange(256) for _ in range(500)) + b"\x1f\x8b\x08\x04" + bytes(rng.randrange(256) for _ in range(500))
    c = zlib.compressobj(0, zlib.DEFLATED, -15)
    z = c.compress(stored) + c.flush()
    raw = bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC\2\0" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(stored), len(stored))
    parts = bam.Blocks()
    assert b"".join(parts.add(f) for f in raw.split(b"\x1f\x8b\x08\x04")) == stored and not parts.broken and not parts.lead
    head, tail = raw.split(b"\x1f\x8b\x08\x04")  # a split of the file begins between the two
    first, second = bam.Blocks(), bam.Blocks()
    assert first.add(head) == b"" and second.add(tail) == b"" and bam.inflated(first.broken + second.lead) == stored


def test_damage_is_told(spark, tmp_path):
    data = sample(8, 30)
    (tmp_path / "a.bam").write_bytes(bgzf(data[:-5], 4000))
    with pytest.raises(Exception, match="ends within a record"):
        readers.read_bam(spark, str(tmp_path)).collect()


def test_lines_in_the_order_of_files(spark, small_splits, tmp_path):
    """The larger file is the last by name, so Spark would read it first; links are numbered by file and line nonetheless."""
    text = [["a E b B 1.0 2.0", "a E c B 2.0 2.0"], [f"x{i} E y{i} B {i}.0 1.0" for i in range(3000)], ["z E z B 5 5", "stop here"], ["after E b B 1.0 1.0"]]
    for i, part in enumerate(text):
        (tmp_path / f"part-{i}").write_text("\n".join(part) + "\n")
    got = readers.read_links(spark, str(tmp_path)).orderBy("link_id").collect()
    want = [line.split()[:2] for part in text[:2] for line in part] + [["z", "E"]]
    assert [[r["a"], r["oa"]] for r in got] == want
    assert [r["link_id"] for r in got] == list(range(1, len(want) + 1))


def test_the_last_line_of_all_files_stands(spark, tmp_path):
    for i, part in enumerate(["c 1\nd 5\n", "c 2\n" + "e 1\n" * 500, "c 3\n"]):
        (tmp_path / f"part-{i}").write_text(part)
    got = {r["contig"]: r["length"] for r in readers.read_lengths(spark, str(tmp_path)).collect()}
    assert got == {"c": 3, "d": 5, "e": 1}


def test_what_the_writer_saved_is_read_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("c"), "id").alias("a"), F.lit("E").alias("oa"), F.lit("b").alias("b"), F.lit("B").alias("ob"), F.lit(1.0).alias("mean"), F.lit(1.0).alias("stdev"))
    writers.save(writers.link_rows(rows.repartitionByRange(5, "a").sortWithinPartitions("a")), str(tmp_path / "links"))
    got = [r["a"] for r in readers.read_links(spark, str(tmp_path / "links")).orderBy("link_id").collect()]
    assert got == sorted(f"c{i}" for i in range(5000))
