"""FLAC media columns: text bytes stored losslessly as 8-bit samples in FLAC streams, and streams decoded with every frame checked.

Frames of many streams are coded side by side: numpy steps through sample i of all frames at once, so the bit-serial Rice
code costs a few vector operations a sample instead of a Python step.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import by_bytes, record_batch, text_or_empty, written

BLOCK = 1024
RATE = 8000
MOST_RICE = 14

#: Fixed coefficients of the format's polynomial predictors, nearest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_many(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte ranges, in step: ranges in order of length, so that those still running are a prefix."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].astype(np.int64), lengths[order]
    crc = np.zeros(len(order), np.int64)
    running = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for i, n in enumerate(running):
        c = crc[:n]
        crc[:n] = ((c & 0xFF) << 8) ^ CRC16[(c >> 8) ^ flat[at[:n] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's UTF-8 like coding, up to 31 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = next(k for k in range(2, 7) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size) & 0xFF | n, *tail[::-1]])


def _head(number: int, size: int) -> bytes:
    """A frame's header: fixed blocking, one channel of 8 bits, the block size in 16 bits."""
    head = b"\xff\xf8" + bytes([0x70, 0x02]) + _number(number) + (size - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


def _stream_info(samples: int, md5: bytes, least: int, most: int, block: int) -> bytes:
    packed = RATE << 44 | 0 << 41 | 7 << 36 | samples
    body = block.to_bytes(2, "big") * 2 + least.to_bytes(3, "big") + most.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    return b"fLaC" + bytes([0x80]) + len(body).to_bytes(3, "big") + body


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (values >> (width - 1 - j)) & 1


def encode(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload, byte b as the sample b - 128; each payload has 16 bytes at least (the format's smallest block).

    Each frame takes the polynomial predictor with the least residual and the best Rice parameter, or is a constant or
    verbatim frame where that is smaller.
    """
    owner, number, begin, size = [], [], [], []
    total = 0
    for i, p in enumerate(payloads):
        cuts = list(range(0, len(p), block)) or [0]
        if len(cuts) > 1 and len(p) - cuts[-1] < 16:
            cuts.pop()
        ends = [*cuts[1:], len(p)]
        owner += [i] * len(cuts)
        number += range(len(cuts))
        begin += [total + c for c in cuts]
        size += [e - c for c, e in zip(cuts, ends)]
        total += len(p)
    samples = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32) - 128
    begin, size = np.array(begin, np.int64), np.array(size, np.int64)
    frames: list[bytes] = [b""] * len(owner)
    for n in np.unique(size):  # frames of one size are a matrix
        rows = np.flatnonzero(size == n)
        for part in np.array_split(rows, max(1, len(rows) * int(n) // 1_000_000)):
            if len(part):
                for k, body in zip(part, _subframes(samples[begin[part][:, None] + np.arange(n)])):
                    frames[k] = _head(number[k], int(n)) + body
    flat = np.frombuffer(b"".join(frames), np.uint8)
    lengths = np.array([len(f) for f in frames], np.int64)
    crcs = crc16_many(flat, np.cumsum(lengths) - lengths, lengths)
    of: list[list[bytes]] = [[] for _ in payloads]
    for i, f, c in zip(owner, frames, crcs):
        of[i].append(f + int(c).to_bytes(2, "big"))
    out = []
    for p, fs in zip(payloads, of):
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 128).tobytes()).digest()
        lens = [len(f) for f in fs]
        out.append(_stream_info(len(p), md5, min(lens), max(lens), block) + b"".join(fs))
    return out


def _subframes(x: np.ndarray) -> list[bytes]:
    """The subframe of each row of samples, padded to whole bytes."""
    rows, n = x.shape
    residual, orders = x, [x]
    for _ in range(4):
        residual = np.diff(residual, axis=1)
        orders.append(residual)
    zig = [np.where(r < 0, -2 * r - 1, 2 * r) for r in orders]
    sums = np.stack([z.sum(1) for z in zig])
    best_order = sums.argmin(0)
    best_bits, best_k = np.full(rows, 8 * n), np.full(rows, -1)
    for order in range(5):
        part = np.flatnonzero(best_order == order)
        if not len(part):
            continue
        z, mean = zig[order][part], sums[order][part] // (n - order)
        near = np.log2(np.maximum(mean, 1)).astype(np.int64)
        for k in (near - 1, near, near + 1):
            k = k.clip(0, 7)
            need = 10 + 8 * order + (n - order) * (k + 1) + (z >> k[:, None]).sum(1)
            better = need < best_bits[part]
            best_bits[part], best_k[part] = np.where(better, need, best_bits[part]), np.where(better, k, best_k[part])
    best_order = np.where(best_k < 0, -1, best_order)
    out: list[bytes] = [b""] * rows
    constant = (x == x[:, :1]).all(1)
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, int(x[i, 0]) & 0xFF])
    for i in np.flatnonzero(~constant & (best_order < 0)):
        out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
    for order in range(5):
        for k in range(8):
            part = np.flatnonzero(~constant & (best_order == order) & (best_k == k))
            if not len(part):
                continue
            z = zig[order][part]
            quotient = z >> k
            width = quotient + k + 1
            start = 8 + 8 * order + 10
            used = start + width.sum(1)
            bytes_each = (used + 7) // 8
            base = (np.cumsum(bytes_each) - bytes_each) * 8
            bits = np.zeros(int(bytes_each.sum()) * 8, np.uint8)
            _put(bits, base, np.full(len(part), (8 + order) << 1), 8)
            for j in range(order):
                _put(bits, base + 8 + 8 * j, x[part, j] & 0xFF, 8)
            _put(bits, base + start - 4, np.full(len(part), k), 4)  # method 0 and partition order 0 stay zero bits
            at = (base + start)[:, None] + np.cumsum(width, 1) - width + quotient
            _put(bits, at.ravel(), (z & ((1 << k) - 1) | 1 << k).ravel(), k + 1)
            packed = np.packbits(bits).tobytes()
            first = base // 8
            for i, b, e in zip(part, first, first + bytes_each):
                out[i] = packed[b:e]
    return out


def _headers(streams: list[bytes]) -> tuple[np.ndarray, list[int], list[int]]:
    flat = np.frombuffer(b"".join(streams), np.uint8)
    starts, totals, at = [], [], 0
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        p, info = 4, b""
        while True:
            last, kind, size = s[p] >> 7, s[p] & 0x7F, int.from_bytes(s[p + 1 : p + 4], "big")
            if kind == 0:
                info = s[p + 4 : p + 4 + size]
            p += 4 + size
            if last:
                break
        packed = int.from_bytes(info[10:18], "big")
        if packed >> 41 & 7 or (packed >> 36 & 31) + 1 != 8:
            raise ValueError("only streams of one channel of 8 bits are read")
        starts.append(at + p)
        totals.append(packed & (1 << 36) - 1)
        at += len(s)
    return flat, starts, totals


def _header(raw: bytes) -> tuple[int, int, int] | None:
    """Bytes of the frame header that raw begins with, the frame's size in samples and its number; None if it is none or damaged."""
    if len(raw) < 6 or raw[0] != 0xFF or raw[1] & 0xFE != 0xF8:
        return None
    lead = raw[4]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    if more > 6 or lead & 0xC0 == 0x80:
        return None
    number = lead if not more else lead & (0x3F >> more)
    for b in raw[5 : 5 + more]:
        number = number << 6 | b & 0x3F
    q, code = 5 + more, raw[2] >> 4
    if code == 7:
        size, q = int.from_bytes(raw[q : q + 2], "big") + 1, q + 2
    elif code == 6 and q < len(raw):
        size, q = raw[q] + 1, q + 1
    else:
        size = 192 if code == 1 else 576 << (code - 2) if 1 < code < 6 else 256 << (code - 8) if code >= 8 else 0
    if not size or q >= len(raw) or crc8(raw[:q]) != raw[q]:
        return None
    return q + 1, size, number


def _scan(stream: bytes, at: int, total: int) -> list[tuple[int, int, int]] | None:
    """(place, place of the subframe, samples) of each frame as sync codes and header checksums show them; None if they don't add up."""
    found, samples, sync = [], 0, stream[at : at + 2]
    while samples < total:
        at = stream.find(sync, at)
        if at < 0:
            return None
        head = _header(stream[at : at + 16])
        if head is not None and head[2] == len(found):
            found.append((at, at + head[0], head[1]))
            samples += head[1]
            at += head[0]
        at += 1
    return found if samples == total else None


def _window(flat: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 32 bits from each bit place, of which at least 25 hold when read from 4 bytes."""
    at = bit >> 3
    w = flat[at].astype(np.int64) << 32 | flat[at + 1].astype(np.int64) << 24 | flat[at + 2].astype(np.int64) << 16 | flat[at + 3].astype(np.int64) << 8 | flat[at + 4]
    return w >> (8 - (bit & 7)) & 0xFFFFFFFF


_LEADING = np.array([16 - int(v).bit_length() for v in range(1 << 16)], np.int64)


def decode(streams: list[bytes]) -> tuple[list[bytes], list[list[tuple[int, int]]]]:
    """The payload of each stream, and its seek points (first sample, byte offset) by frame.

    Rice residuals are read and predictors undone for all streams' current frames in step. Every frame's two checksums
    and each stream's MD5 are verified; a wrong one raises ValueError.
    """
    flat, starts, totals = _headers(streams)
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    ends = np.cumsum([len(s) for s in streams])
    begins = ends - [len(s) for s in streams]
    out: list[list[np.ndarray]] = [[] for _ in streams]
    seek: list[list[tuple[int, int]]] = [[] for _ in streams]
    checks: list[tuple[int, int]] = []
    todo, single = [], []  # frames whose places are known, and streams to be read frame by frame
    for i, s in enumerate(streams):
        found = _scan(s, int(starts[i] - begins[i]), totals[i])
        if found is None:
            single.append(i)
        else:
            todo += [(i, int(begins[i]) + p, int(begins[i]) + body, size) for p, body, size in found]
    if todo:
        values, stops = _bodies(padded, np.array([t[2] for t in todo], np.int64), np.array([t[3] for t in todo], np.int64))
        wrong = set()
        for j, (i, p, _, _) in enumerate(todo):
            following = todo[j + 1][1] if j + 1 < len(todo) and todo[j + 1][0] == i else int(ends[i])
            if stops[j] + 2 != following:  # what looked like a header lay in a frame
                wrong.add(i)
        done = [0] * len(streams)
        for (i, p, _, size), v, stop in zip(todo, values, stops):
            if i not in wrong:
                seek[i].append((done[i], int(p - begins[i])))
                done[i] += size
                out[i].append(v)
                checks.append((p, int(stop)))
        single += wrong
    for i in single:
        at, done_i = int(starts[i]), 0
        while done_i < totals[i]:
            head = _header(padded[at : at + 16].tobytes())
            if head is None:
                raise ValueError("a frame header is damaged")
            used, size, _ = head
            v, stop = _bodies(padded, np.array([at + used], np.int64), np.array([size], np.int64))
            seek[i].append((done_i, int(at - begins[i])))
            out[i].append(v[0])
            checks.append((at, int(stop[0])))
            done_i, at = done_i + size, int(stop[0]) + 2
    if checks:
        start, stop = np.array(checks, np.int64).T
        said = padded[stop].astype(np.int64) << 8 | padded[stop + 1]
        if (crc16_many(padded, start, stop - start) != said).any():
            raise ValueError("a frame's checksum is wrong")
    payloads = []
    for s, parts in zip(streams, out):
        x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        signed = x.astype(np.int8).tobytes()
        if hashlib.md5(signed).digest() != s[26:42]:
            raise ValueError("a stream's MD5 is wrong")
        payloads.append((x + 128).astype(np.uint8).tobytes())
    return payloads, seek


def _bodies(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples of each frame whose subframe begins at a byte, and the byte after its padding."""
    n = len(at)
    values: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    stops = np.zeros(n, np.int64)
    kind = flat[at].astype(np.int64) >> 1 & 0x3F
    for i in np.flatnonzero(kind == 0):
        values[i], stops[i] = np.full(sizes[i], np.int64(flat[at[i] + 1].astype(np.int8))), at[i] + 2
    for i in np.flatnonzero(kind == 1):
        values[i], stops[i] = flat[at[i] + 1 : at[i] + 1 + sizes[i]].astype(np.int8).astype(np.int64), at[i] + 1 + sizes[i]
    for code in np.unique(kind[kind > 1]):
        part = np.flatnonzero(kind == code)
        part = part[np.argsort(-sizes[part], kind="stable")]
        order = int(code) - 8 if code < 13 else int(code) - 31
        bit = (at[part] + 1) * 8
        size = sizes[part]
        x = np.zeros((len(part), int(size[0])), np.int64)
        take = lambda width: _window(flat, bit) >> (32 - width)  # noqa: E731, B023
        for j in range(order):
            x[:, j] = take(8).astype(np.uint8).astype(np.int8)
            bit = bit + 8
        shift, weights = np.zeros(len(part), np.int64), None
        if code >= 32:
            precision = take(4) + 1
            bit = bit + 4
            shift = take(5)
            bit = bit + 5
            weights = np.zeros((len(part), order), np.int64)
            for j in range(order):
                w = _window(flat, bit) >> (32 - precision)
                weights[:, j] = np.where(w >> (precision - 1) & 1, w - (1 << precision), w)
                bit = bit + precision
        if take(6).any():
            raise ValueError("only residuals in one partition with 4-bit parameters are read")
        bit = bit + 6
        k = take(4)
        bit = bit + 4
        running = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for j in range(order, int(size[0])):
            m = running[j]
            b = bit[:m]
            w = _window(flat, b)
            zeros = _LEADING[w >> 16]
            if (zeros == 16).any():  # a long run of zeros: count on, lane by lane
                for lane in np.flatnonzero(zeros == 16):
                    run, p = 0, int(b[lane])
                    while not flat[p >> 3] >> (7 - (p & 7)) & 1:
                        run, p = run + 1, p + 1
                    zeros[lane] = run
                w = _window(flat, b + zeros)
                rest = w >> (31 - k[:m]) & ((1 << k[:m]) - 1)
            else:
                # quotient, stop bit and remainder lie in 16 + 1 + 14 bits at most
                rest = w >> (31 - zeros - k[:m]) & ((1 << k[:m]) - 1)
            z = zeros << k[:m] | rest
            x[:m, j] = z >> 1 ^ -(z & 1)
            bit[:m] = b + zeros + 1 + k[:m]
        if weights is not None:
            for j in range(order, int(size[0])):
                m = running[j]
                x[:m, j] += (weights[:m] * x[:m, j - order : j][:, ::-1]).sum(1) >> shift[:m]
        else:
            # undoing a difference is a running sum; its first term is the warm-up's own difference
            for d in range(order, 0, -1):
                seed = np.diff(x[:, :order], n=d - 1, axis=1)[:, -1] if order else 0
                x[:, order:] = seed[:, None] + np.cumsum(x[:, order:], 1)
        for i, row, n_i, b in zip(part, x, size, bit):
            values[i], stops[i] = row[:n_i], (int(b) + 7) // 8
    return values, stops


def payload(text: str) -> bytes:
    """UTF-8, and bytes 0 up to a positive multiple of 64."""
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def encode_media(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and n_bytes (long), media (binary: the FLAC stream of the padded text).

    A null text counts as empty: 64 bytes 0. Equal texts have equal streams; long texts are many frames; an empty table
    gives an empty one. Columns not in keep are left out, and so can't clash with the new ones.
    """
    named = df.select(*keep, text_or_empty(text_col).alias("__text"))
    schema = T.StructType([*named.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    arrow = pa.schema([*[pa.field(f.name, pa.int64()) for f in named.schema.fields[:-1]], ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", 2 << 20):
            raw = [t.encode() for t in batch.column("__text").to_pylist()]
            media = encode([r + bytes(-len(r) % 64 or (0 if r else 64)) for r in raw])
            yield record_batch({**{c: batch.column(c) for c in keep}, "n_bytes": [len(r) for r in raw], "media": media}, arrow)

    return named.mapInArrow(run, schema)


def decode_media(df: DataFrame) -> DataFrame:
    """Of doc_id, n_bytes and media: digests of the payload read back and of the stream, the seek table, and a feature.

    The feature is the mean level, the share of zero crossings and the loudest of the blocks, of the decoded samples.
    A damaged stream fails the task with the reason.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek array<struct<sample:long,offset:long>>"
    arrow = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
         ("seek", pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media", 2 << 20):
            media = batch.column("media").to_pylist()
            payloads, seek = decode(media)
            yield record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": batch.column("n_bytes"),
                    "payload_bytes": [len(p) for p in payloads],
                    "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                    "tail_crc32": [zlib.crc32(p[-64:]) for p in payloads],
                    "media_bytes": [len(m) for m in media],
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                    "feature": [feature(p) for p in payloads],
                    "seek": [[{"sample": s, "offset": o} for s, o in points] for points in seek],
                },
                arrow,
            )

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def pcm_blocks(df: DataFrame) -> DataFrame:
    """Of doc_id and media: a row for each PCM block, which is a frame: doc_id, block (from 0), first_sample, samples, frame_offset, pcm.

    pcm holds the frame's samples as unsigned bytes, and so stands at byte first_sample of the whole payload; frame_offset is the
    byte of the stream at which a reader that seeks first_sample begins. Frames' checksums and the stream's MD5 are verified.
    Each row stands for itself, so repeated rows give repeated blocks; an empty table gives none.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("first_sample", pa.int64()), ("samples", pa.int32()), ("frame_offset", pa.int64()), ("pcm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "media", 2 << 20):
            payloads, seek = decode(batch.column("media").to_pylist())
            rows: list[tuple] = []
            for doc, data, points in zip(batch.column("doc_id").to_pylist(), payloads, seek):
                ends = [*(p[0] for p in points[1:]), len(data)]
                rows += [(doc, i, sample, end - sample, offset, data[sample:end]) for i, ((sample, offset), end) in enumerate(zip(points, ends))]
            if rows:
                yield record_batch(dict(zip(arrow.names, zip(*rows))), arrow)

    return df.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, block int, first_sample long, samples int, frame_offset long, pcm binary")


def feature(data: bytes) -> str:
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    loudest = int(np.abs(x).reshape(-1, 64).sum(1).argmax())
    return f"{int(x.sum())}/{len(x)}:{crossings}:{loudest}"


def media_digest(documents: DataFrame) -> DataFrame:
    """Stores each text as a FLAC stream in a table, reads the stored bytes back and describes them; ids are cast to long.

    Beside the digests stand n_blocks and seek: each PCM block's first sample and the byte of the stream where its frame begins.
    A null text counts as empty; repeated rows have rows each; an empty table gives an empty one.
    """
    stored = written(encode_media(documents.select(F.col("doc_id").cast("long"), "text")), "media", "zstd")
    return decode_media(stored).withColumn("n_blocks", F.size("seek").cast("long"))
