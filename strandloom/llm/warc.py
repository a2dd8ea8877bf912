"""WARC archives of pages: records written and read back, and one global order of captures merged from sorted runs.

Archives are kept as a table in the shared folder, a row for each segment of gzip members: any store that Spark writes to
will do, no task needs a local file, and a lost executor's segments are written anew.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from strandloom.llm.common import by_bytes, record_batch, text_or_empty, written

SEGMENT = 4 << 20
#: Captures that one range of the merged order holds about: what a task keeps, whatever the number of captures.
IN_RANGE = 250_000
#: Captures of a run that a merge has decoded at once.
HEADS = 256
#: Bytes of an archive handed to the decompressor at a time.
PIECE = 16 << 10
FIRST = datetime(2024, 1, 1, tzinfo=UTC)
#: Fixed value: the profile that the format names for a revisit with an equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = pa.struct([("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
ARCHIVE = pa.schema([("archive", pa.string()), ("segment", pa.int64()), ("data", pa.binary()), ("run", pa.list_(ENTRY))])
ARCHIVE_DDL = "archive string, segment long, data binary, run array<struct<urlkey:string,captured:string,page_id:long,offset:long,length:long>>"
RECORD_DDL = "archive string, segment long, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def url_key(url: str) -> str:
    """A sortable key: host labels from the top down, then path and sorted query, in lower case, without scheme, port, www or fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + query if query else "")).lower()


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    when = (FIRST + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Date: {when}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _named(lines: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines.decode().split("\r\n")[1:] if ":" in x)}


def _page(urn: str) -> int | None:
    value = urn.rpartition(":")[2].rstrip(">")
    return None if value == "None" else int(value)


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers_to, payload or None) of one record; a damaged payload raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _named(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_named(http)["content-length"])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['warc-record-id']}: the payload doesn't match its digest")
    return _page(fields["warc-record-id"]), size, digest, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None, payload if kind == "response" else None


def decide_revisits(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of at least revisit_from bytes, all but the largest page_id refer to that one.

    Equal means equal SHA-1. Null urls and htmls count as empty. Rows that repeat the largest page_id all stay responses;
    a null page_id is the smallest. The largest id of each payload is summed up before the shuffle, so that a payload
    of a third of all pages costs a row a task there; the join back is one that Spark splits where it is skewed.
    """
    rows = pages.select(F.col("page_id").cast("long"), text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    last = rows.filter(F.octet_length("html") >= revisit_from).groupBy("sha").agg(F.max("page_id").alias("last"))
    joined = rows.join(last, "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_archives(decided: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows of archive, segment, data (gzip members, one a record) and run: the segment's captures, sorted by URL key and time.

    Takes the columns of decide_revisits(), urls and htmls not null; a null page_id is written as such. No rows, no segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0
        for batch in by_bytes(batches, "html", segment):
            data, entries = bytearray(), []
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                member = gzip.compress(build_record(page, url, html.encode(), refers, refers is not None), 4, mtime=0)
                when = (FIRST + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
                entries.append({"urlkey": url_key(url), "captured": when, "page_id": page, "offset": len(data), "length": len(member)})
                data += member
            entries.sort(key=capture_order)
            yield record_batch({"archive": [name], "segment": [number], "data": [bytes(data)], "run": [entries]}, ARCHIVE)
            number += 1

    return decided.mapInArrow(run, ARCHIVE_DDL)


def capture_order(e: dict) -> tuple:
    return e["urlkey"], e["captured"], -1 if e["page_id"] is None else e["page_id"]


def members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; a member that is cut short raises ValueError."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, content, read = zlib.decompressobj(31), [], at
        while not member.eof:
            if read >= len(view):
                raise ValueError(f"the member at {at} is cut short")
            content.append(member.decompress(view[read : read + PIECE]))
            read = min(read + PIECE, len(view))
        yield at, b"".join(content)
        at = read - len(member.unused_data)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives, as the record says it; payload is null for revisits, or if not asked for.

    A segment is read member by member, in pieces, so that its cost is in proportion to its bytes. A segment without data
    has no records, and no segments give no rows. A damaged member or payload fails the task with the reason.
    """
    schema = pa.schema([("archive", pa.string()), ("segment", pa.int64()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, segment, data in zip(*(batch.column(c).to_pylist() for c in ("archive", "segment", "data"))):
                rows = []
                for at, raw in members(data or b""):
                    page, size, digest, kind, refers, payload = parse_record(raw)
                    rows.append((archive, segment, at, page, size, digest, kind, refers, payload if with_payload else None))
                if rows:
                    yield record_batch(dict(zip(schema.names, zip(*rows))), schema)

    return archives.select("archive", "segment", "data").mapInArrow(run, RECORD_DDL)


class LoserTree:
    """k sorted runs merged into one: each inner node keeps the loser of its match, so the next item costs log2(k) matches.

    Runs are read as iterators, one item ahead; of equal items that of the earlier run comes first.
    """

    def __init__(self, runs: list, key) -> None:
        self.runs, self.key = [iter(run) for run in runs], key
        self.k = max(1, len(runs))
        self.items: list = [None] * len(runs)
        self.heads = [self._head(i) for i in range(len(runs))]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _head(self, i: int):
        for item in self.runs[i]:
            self.items[i] = item
            return 0, self.key(item), i
        return (1,)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.winner >= 0 and self.heads[self.winner][0] == 0:
            i = self.winner
            yield self.items[i]
            self.heads[i] = self._head(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self.heads[self.losers[node]] < self.heads[i]:
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _rows_of(batches: list[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of one run, decoded a few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, HEADS):
            yield from batch.slice(start, HEADS).to_pylist()


def merge_index(archives: DataFrame, in_range: int = IN_RANGE) -> DataFrame:
    """All captures in one order by URL key, time and page_id: archive, segment, offset, length, urlkey, captured, page_id, position (from 0).

    Each segment brings a sorted run. The captures are dealt out by ranges of the whole order, about in_range to a range, so
    that what a task holds doesn't grow with the captures, and one URL with a third of them spreads over tasks. Spark's own
    sort, which spills, brings a range's part of each run together in the run's order; these parts stay Arrow batches, of
    which a loser tree reads a few rows ahead. The counts of the ranges before it give a range its first position. Ties
    stand by archive, segment and offset; a null page_id is the smallest. No segments give no rows.
    """
    entries = archives.select("archive", "segment", F.explode("run").alias("e")).select("archive", "segment", "e.*")
    captures = archives.agg(F.sum(F.size("run"))).first()[0] or 0
    ranges = max(-(-captures // in_range), archives.sparkSession.sparkContext.defaultParallelism)
    capture = [F.col("urlkey"), F.col("captured"), F.coalesce("page_id", F.lit(-1))]
    dealt = entries.repartitionByRange(ranges, *capture, F.col("archive"), F.col("segment"), F.col("offset"))
    dealt = dealt.sortWithinPartitions("archive", "segment", *capture, "offset")
    names = ["archive", "segment", "urlkey", "captured", "page_id", "offset", "length"]
    schema = pa.schema([("archive", pa.string()), ("segment", pa.int64()), ("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("part", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[pa.RecordBatch]] = []
        last = None
        for batch in batches:
            of = list(zip(batch.column("archive").to_pylist(), batch.column("segment").to_pylist()))
            starts = [i for i in range(len(of)) if i == 0 or of[i] != of[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(of)]):
                if of[start] != last:
                    runs.append([])
                    last = of[start]
                runs[-1].append(batch.slice(start, end - start))
        merged, part, count = [], TaskContext.get().partitionId(), 0
        for e in LoserTree([_rows_of(r) for r in runs], lambda e: (*capture_order(e), e["archive"], e["segment"], e["offset"])):
            merged.append(e | {"part": part, "at": count})
            count += 1
            if len(merged) == 10_000:
                yield pa.RecordBatch.from_pylist(merged, schema)
                merged = []
        if merged:
            yield pa.RecordBatch.from_pylist(merged, schema)

    merged = written(dealt.select(*names).mapInArrow(run, "archive string, segment long, urlkey string, captured string, page_id long, offset long, length long, part long, at long"), "captures")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = merged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return merged.join(firsts, "part").select(*names, (F.col("first") + F.col("at")).alias("position"))


def warc_digest(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Writes all pages as records, reads the archives back, and gives each record its place among all captures.

    Nulls, ties and repeated ids are as decide_revisits() says; repeated rows have a record each; an empty table gives none.
    """
    archives = written(write_archives(decide_revisits(pages, revisit_from)), "archives")
    order = merge_index(archives).select("archive", "segment", "offset", "urlkey", "captured", "position")
    records = read_archives(archives, with_payload=False).drop("payload")
    return records.join(order, ["archive", "segment", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", F.col("position").alias("capture_position"))
