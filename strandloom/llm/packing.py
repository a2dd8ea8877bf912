"""Best-fit decreasing packing of token sequences, for a whole table at once.

Pieces of one length are alike, so best-fit decreasing needs their number only: the lengths' histogram, of a row for each
length at most, is packed with a segment tree over remaining capacities, whole groups of alike bins at a time. The result is a
list of moves, each "items r to r+n of this length go into these bins at this offset", whose size is bounded by the capacity
and not by the table. Every piece then looks up its own move by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from strandloom.llm.bpe import byte_chars
from strandloom.llm.common import by_bytes, record_batch, text_or_empty, written

CAPACITY = 2048
END_ID = 0
MOST_CACHED = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, rank_in_chunk long"


class OpenBins:
    """A segment tree over remaining capacities: which have an open bin, and the tightest of at least so much in logarithmic time."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, remaining: int, is_open: bool) -> None:
        node = self.size + remaining
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, least: int) -> int:
        """The smallest remaining capacity >= least that has an open bin; -1 if none has."""
        node = self.size + least
        if self.open[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return -1


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, first rank, first bin, bins, items a bin, offset) that pack counts[length] items of each length.

    The bins of a move are numbered on end; rank r of the move's items lies in bin first + (r - first rank) // items a bin.
    This is what best-fit decreasing gives one item at a time: after an item went into the tightest bin, that bin is tighter
    still, so it takes the next ones of that length until none fits; and bins of one remaining capacity take turns.
    """
    tree, groups, moves, bins = OpenBins(capacity), defaultdict(list), [], 0
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                each = min(capacity // length, left)
                many = left // each if each == capacity // length else 1
                first, bins, room = bins, bins + many, capacity
            else:
                first, many = groups[room].pop()
                each = min(room // length, left)
                use = min(many, left // each)
                if use < many:
                    groups[room].append((first + use, many - use))
                    many = use
                if not groups[room]:
                    tree.set(room, False)
            moves.append((length, rank, first, many, each, capacity - room))
            rank, left = rank + many * each, left - many * each
            rest = room - each * length
            if rest:
                groups[rest].append((first, many))
                tree.set(rest, True)
    return moves


class Pieces:
    """Ids of the pieces of texts between blanks, as little-endian unsigned 32-bit numbers.

    This vocabulary's words never hold white space, so pieces have their ids for themselves. A piece of Latin letters and marks after
    them is a word and a run of marks, which the library's BPE model encodes straight away: normalising such a piece is lower-casing it.
    Whatever else there is goes through the whole tokenizer.
    """

    MARKS = ".,!?;:"

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.shown = {b: c for c, b in byte_chars().items()}

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
            ids = self.words[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes() if word else b""
        return ids

    def learn(self, pieces: list[str]) -> None:
        other = []
        for p in pieces:
            small = p.lower()
            word = small.rstrip(self.MARKS)
            if (word.isalpha() or not word) and (p.isascii() or max(p) < "\u0100"):
                self.known[p] = self.word(word) + self.word(small[len(word) :])
            else:
                other.append(p)
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self.known[p] = array("I", e.ids).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        new = {p for pieces in cut for p in pieces if p not in self.known}
        if len(self.known) + len(new) > MOST_CACHED:
            self.forget()
            new = {p for pieces in cut for p in pieces}
        self.learn([*new])
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]

    def forget(self) -> None:
        self.known.clear()
        self.words.clear()


@cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def token_pieces(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each piece of at most capacity ids: doc_id, piece, start, length, ids_crc32, and the piece's rank among those of its length in its task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("rank_in_chunk", pa.int64())])
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen, coder = TaskContext.get().partitionId(), [0] * (capacity + 1), pieces_of(vocabulary)
        for batch in by_bytes(batches, "__text", 2 << 20):
            rows = []
            for doc, ids in zip(batch.column("__id").to_pylist(), coder.of(batch.column("__text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(part), chunk, seen[n]))
                    seen[n] += 1
            yield record_batch(dict(zip(schema.names, zip(*rows))), schema)
        coder.forget()  # an idle worker holds no memory that the next stage needs

    return df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, PIECES)


def pack(df: DataFrame, vocabulary: str, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Each row is a document of its own, whose ids end with id 0; a null text counts as empty, which leaves just that id.
    Longer ones are cut into pieces of capacity ids. Repeated rows are packed each; an empty table gives an empty one;
    other columns are left out. What reaches the driver is a count for each length, at most capacity of them.
    """
    spark = df.sparkSession
    pieces = written(token_pieces(df, vocabulary, capacity, text_col, id_col), "pieces")
    local = pieces.groupBy("length", "chunk").count()
    counts = {r["length"]: r["n"] for r in local.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    moves = spark.createDataFrame(best_fit_decreasing(counts, capacity) or [(0,) * 6], "length long, first_rank long, first_bin long, bins long, each long, at long")
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = local.select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(firsts, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("rank_in_chunk"))
    mine = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("bins") * F.col("each"))
    packed = ranked.join(F.broadcast(moves.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & mine)
    place = F.col("rank") - F.col("first_rank")
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + place % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
