"""BAM files as alignments, read by many tasks.

A BAM file is a row of gzip members (blocks) of at most 64 KiB, which records cross at will. The text reader cuts a file at the blocks' magic
bytes, so Spark splits it as it splits any text. A task follows the records of its split from the first one that it can make out, and
leaves the bytes before it and the unfinished end of its last record as the split's rims. The rims of neighbours then
form the records between them; where they don't fit, the first record was not made out rightly, and the split is read
again from the place where its forerunner's records end.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.shared import written
from strandloom.sources.ordered import ROW_BITS, ordered_text, slot

MAGIC = "\x1f\x8b\x08\x04"
#: Bytes of a split that are looked through for its first record, and records that must then follow each other.
LOOK, FOLLOW = 1 << 18, 20
FIELDS = [("kind", pa.int32()), ("file", pa.string()), ("line_no", pa.int64()), ("ref", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("read", pa.string()), ("mapq", pa.int32()), ("strand", pa.string())]
RIMS = [("size", pa.int64()), ("first", pa.int64()), ("skip", pa.int64()), ("front", pa.binary()), ("tail", pa.binary()), ("lead", pa.binary()), ("broken", pa.binary())]
RECORD = "kind int, file string, line_no long, ref int, start int, end int, read string, mapq int, strand string"
DDL = RECORD + ", size long, first long, skip long, front binary, tail binary, lead binary, broken binary"


def alignment(block: bytes) -> tuple | None:
    """ref, start, end, read, mapq, strand of a record; None for an unmapped one. end is start plus the bases that the CIGAR spends on the reference."""
    ref, pos, name_len, mapq, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", block)
    if flag & 4 or ref < 0:
        return None
    name = block[32 : 32 + name_len - 1].decode()
    cigar = struct.unpack_from(f"<{n_cigar}I", block, 32 + name_len)
    span = sum(c >> 4 for c in cigar if c & 15 in (0, 2, 3, 7, 8))
    return ref, pos, pos + span, name + ("/1" if flag & 64 else "/2" if flag & 128 else ""), mapq, "-" if flag & 16 else "+"


def header(data: bytes) -> tuple[int, list[str]] | None:
    """The length of a BAM header and the names of its references; None if data ends before the header does."""
    if data[:4] != b"BAM\1"[: len(data)]:
        raise ValueError("not a BAM file")
    try:
        at = 8 + struct.unpack_from("<i", data, 4)[0]
        (n,) = struct.unpack_from("<i", data, at)
        at, names = at + 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<i", data, at)
            if at + 8 + size > len(data):
                return None
            names.append(data[at + 4 : at + 3 + size].decode())
            at += 8 + size
    except struct.error:
        return None
    return at, names


def block_size(data: bytes) -> int | None:
    """The size of the block that begins with the magic bytes and then data; None if no block begins so."""
    if len(data) < 8:
        return None
    at, end = 8, 8 + struct.unpack_from("<H", data, 6)[0]
    while at + 4 <= min(end, len(data)):
        (size,) = struct.unpack_from("<H", data, at + 2)
        if data[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(data):
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + size
    return None


def inflated(raw: bytes) -> bytes:
    """The content of a whole block without its magic bytes."""
    size = block_size(raw) - 4
    data = zlib.decompress(raw[8 + struct.unpack_from("<H", raw, 6)[0] : size - 8], -15)
    if zlib.crc32(data) != struct.unpack_from("<I", raw, size - 8)[0]:
        raise ValueError("a block's checksum is wrong")
    return data


class Blocks:
    """Puts blocks together again where the magic bytes stood in the midst of one by chance."""

    def __init__(self) -> None:
        self.raw, self.need, self.lead = b"", 0, b""

    def add(self, data: bytes) -> bytes:
        if self.need:
            self.raw += MAGIC.encode("latin-1") + data
        else:
            size = block_size(data)
            if size is None:
                self.lead += MAGIC.encode("latin-1") + data
                return b""
            self.raw, self.need = data, size - 4
        if len(self.raw) < self.need:
            return b""
        self.need = 0
        return inflated(self.raw)

    @property
    def broken(self) -> bytes:
        return self.raw if self.need else b""


def plausible(data: bytes, at: int, n_refs: int) -> int:
    """Where the record at that place ends if it can be one, else -1. Its bytes may end after the fixed fields."""
    size, ref, pos, name_len, _, _, n_cigar, _, n_bases, next_ref, next_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not (-1 <= ref < n_refs and -1 <= next_ref < n_refs and pos >= -1 and next_pos >= -1 and name_len > 0 and n_bases >= 0):
        return -1
    if size < 32 + name_len + 4 * n_cigar + (n_bases + 1) // 2 + n_bases:
        return -1
    name = data[at + 36 : at + 36 + name_len]
    if len(name) == name_len and (name[-1] or any(c < 33 or c > 126 for c in name[:-1])):
        return -1
    return at + 4 + size


def first_record(data: bytes, n_refs: int) -> int | None:
    """The first place from which records follow each other, as many as FOLLOW or up to the end of data."""
    for at in range(len(data) - 35):
        end, n = at, 0
        while 0 <= end <= len(data) - 36 and n < FOLLOW:
            end, n = plausible(data, end, n_refs), n + 1
        if end >= 0:
            return at
    return None


class Split:
    """One split's records and rims; first is where its first record begins, if that is known."""

    def __init__(self, file: str, place: int, n_refs: int, first: int | None) -> None:
        self.file, self.place, self.n_refs, self.first = file, place, n_refs, first
        self.blocks, self.data, self.size, self.front, self.n, self.at = Blocks(), b"", 0, b"", 0, None
        self.rows: list[tuple] = []

    def add(self, fragment: bytes) -> None:
        found = self.blocks.add(fragment)
        self.data += found
        self.size += len(found)
        if self.at is None and (self.first is not None and self.size >= self.first + 4 or self.first is None and self.size >= LOOK):
            self.begin()
        if self.at is not None:
            self.follow()

    def begin(self) -> None:
        if self.first is None:
            found = first_record(self.data, self.n_refs)
            self.first = self.size if found is None else found
        self.at = min(self.first, self.size)
        self.front = self.data[: self.at + 4]

    def follow(self) -> None:
        at, data = self.at, self.data
        while at + 4 <= len(data):
            (size,) = struct.unpack_from("<i", data, at)
            if at + 4 + size > len(data):
                break
            if found := alignment(data[at + 4 : at + 4 + size]):
                self.rows.append((0, self.file, (self.place << ROW_BITS) + self.n, *found, *[None] * 7))
            at, self.n = at + 4 + size, self.n + 1
        self.data, self.at = data[at:], 0

    def end(self) -> None:
        """The last row: the rims. A split in which no record begins is all front."""
        if self.at is None:
            self.begin()
            self.follow()
        skip = max(self.first - self.size, 0)
        self.rows.append((1, self.file, (self.place << ROW_BITS) + self.n, *[None] * 6, self.size, min(self.first, self.size), skip, self.front, self.data, self.blocks.lead, self.blocks.broken))


def stitched(rims: list[dict]) -> Iterator[tuple]:
    """Of a file's rims in order: the records between splits (kind 0), or last a row of kind 2 that says where a split's first record begins."""
    row = lambda kind, rim, at, found, first=None: (kind, rim["file"], at, *(found or [None] * 6), first)
    pending, skip, order, broken = b"", 0, 0, b""
    for i, rim in enumerate(rims):
        size, first = rim["size"], rim["first"]
        between = inflated(broken + rim["lead"]) if broken else b""
        if i == 0:
            pending, skip = rim["tail"], rim["skip"]
        elif skip > len(between):  # the header goes on
            skip -= len(between)
            if first != min(skip, size):
                yield row(2, rim, rim["line_no"], None, min(skip, size))
                return
            pending, skip = rim["tail"], skip - first
        else:
            pending, skip = pending + between[skip:], 0
            target, at = len(pending) + first, 0
            pending += rim["front"]
            while at < target and at + 4 <= len(pending) and (end := at + 4 + struct.unpack_from("<i", pending, at)[0]) <= target:
                if found := alignment(pending[at + 4 : end]):
                    yield row(0, rim, order, found)
                at, order = end, order + 1
            if at == target:
                pending = rim["tail"]
            elif first == size:  # no record begins here
                pending = pending[at:]
            else:
                yield row(2, rim, rim["line_no"], None, min(first + end - target, size) if at + 4 <= len(pending) else size)
                return
        order, broken = rim["line_no"] if rim["tail"] or first < size else order, rim["broken"]
    if pending or skip or broken:
        raise ValueError("the BAM file ends within a record")


def _headers(blocks: DataFrame) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """(file, ref, contig), and for each file the length of its header and the number of its references, or (-2, 0) for one without blocks.

    A header is read by one task, from so many of its file's first splits as it takes.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = pdf.sort_values("line_no"), Blocks()
        data = b"".join(parts.add(bytes(v)) for v in pdf["value"].iloc[1:])
        file, found = pdf["file"].iloc[0], header(data)
        if found is None:
            return pd.DataFrame([(file, -1, None, -2 if parts.lead or len(pdf) == 1 else -1)], columns=["file", "ref", "contig", "length"])
        return pd.DataFrame([(file, i - 1, n, found[0]) for i, n in enumerate([None, *found[1]])], columns=["file", "ref", "contig", "length"])

    names, known, limit = [], {}, 1
    while True:
        rows = blocks.filter(F.col("offset") < limit)
        for file in known:
            rows = rows.filter(F.col("file") != file)
        found = written(rows.groupBy("file").applyInPandas(run, "file string, ref int, contig string, length long"), "headers")
        names.append(found.filter("ref >= 0").select("file", "ref", "contig"))
        ends = found.groupBy("file").agg(F.first("length").alias("length"), F.max("ref").alias("last")).collect()
        known |= {r["file"]: (r["length"], r["last"] + 1) for r in ends if r["length"] != -1}
        if all(r["length"] != -1 for r in ends):
            break
        limit = max(limit * 4, 1 << 20)
    out = names[0]
    for n in names[1:]:
        out = out.unionByName(n)
    return out, known


def _read(blocks: DataFrame, headers: dict[str, tuple[int, int]], firsts: dict[tuple[str, int], int]) -> DataFrame:
    """Records (kind 0) and rims (kind 1) of all splits; firsts says where the first record of some splits begins."""
    schema = pa.schema(FIELDS + RIMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, rows = None, None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(schema, zip(*rows) if rows else [[]] * len(schema))], schema=schema)
            rows.clear()
            return made

        for batch in batches:
            for file, offset, line_no, value in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "line_no", "value"))):
                if headers[file][0] < 0:
                    continue
                if (file, line_no >> ROW_BITS) != own:
                    if now:
                        now.end()
                        rows += now.rows
                    own = file, line_no >> ROW_BITS
                    now = Split(*own, headers[file][1], headers[file][0] if offset == 0 else firsts.get(own))
                    if offset == 0:
                        continue  # nothing stands before a file's first block
                now.add(value)
                if len(now.rows) > 10_000:
                    rows += now.rows
                    now.rows = []
                    yield out()
        if now:
            now.end()
            rows += now.rows
        yield out()

    return blocks.select("file", "offset", "line_no", "value").mapInArrow(run, DDL)


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Records of all files with blocks (file, line_no, ref, start, end, read, mapq, strand), names of references (file, ref, contig), and the files without blocks."""
    blocks = ordered_text(spark, path, encoding="ISO-8859-1", lineSep=MAGIC).withColumn("value", F.col("value").cast("binary"))
    names, headers = _headers(blocks)
    firsts: dict[tuple[str, int], int] = {}

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        rims = [{k: bytes(v) if k in ("front", "tail", "lead", "broken") else v for k, v in r.items()} for r in pdf.sort_values("line_no").to_dict("records")]
        return pd.DataFrame(list(stitched(rims)), columns=[f for f, _ in FIELDS] + ["first"]).astype({c: "Int64" for c in ("ref", "start", "end", "mapq", "first")})

    while True:
        found = written(_read(blocks, headers, firsts), "splits")
        rims = found.filter("kind = 1").select("file", "line_no", *[n for n, _ in RIMS])
        between = written(rims.groupBy("file").applyInPandas(stitch, RECORD + ", first long"), "between")
        wrong = between.filter("kind = 2").select("file", slot(F.col("line_no")).alias("place"), "first").collect()
        if not wrong:
            break
        firsts |= {(r["file"], r["place"]): r["first"] for r in wrong}
    columns = [n for n, _ in FIELDS[1:]]
    rows = found.filter("kind = 0").select(columns).unionByName(between.filter("kind = 0").select(columns))
    return rows, names, [f for f, (length, _) in headers.items() if length == -2]


def _whole(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Alignments of files that were not written in blocks, which no place but the first can be read from: one file a task."""
    schema = pa.schema([("contig", pa.string()), *FIELDS[2:3], *FIELDS[4:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows: list[tuple] = []
                for row in whole_rows(content):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(schema, zip(*rows))], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for f, c in zip(schema, zip(*rows))], schema=schema)

    content = spark.read.format("binaryFile").load(path).filter(F.col("_metadata.file_path").isin(files)).select("content")
    return content.mapInArrow(run, "contig string, line_no long, start int, end int, read string, mapq int, strand string")


def whole_rows(content: bytes) -> Iterator[tuple]:
    f = gzip.GzipFile(fileobj=io.BytesIO(content))
    take = lambda fmt: struct.unpack("<" + fmt, f.read(struct.calcsize("<" + fmt)))
    if f.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    f.read(take("i")[0])
    names = []
    for _ in range(take("i")[0]):
        names.append(f.read(take("i")[0])[:-1].decode())
        f.read(4)
    n = 0
    while head := f.read(4):
        if found := alignment(f.read(struct.unpack("<i", head)[0])):
            yield names[found[0]], n, *found[1:]
        n += 1


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, read, mapq, strand and line_no of BAM files, as BED rows: start counts from 0, unmapped reads are left out,
    a mate's number becomes the name's suffix /1 or /2. line_no grows in the order of files and of records within each."""
    rows, names, plain = read_splits(spark, path)
    columns = ["contig", "start", "end", "read", "mapq", "strand", "line_no"]
    out = rows.join(names, ["file", "ref"]).select(columns)
    return out.unionByName(_whole(spark, path, plain).select(columns)) if plain else out
