"""Spelling variants: words at edit distance one, found by a self-join of the vocabulary's trie with active-node sets.

The trie is cut into subtrees by prefix, so that it is joined in many tasks. Two words at distance one, the shorter of n
characters, share their first n // 2 characters or their last n // 2: one of both halves is free of the edit. So each word goes to the
subtree of its first half and, in the trie of the words read backwards, to that of its last half, and each pair meets in one subtree.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import by_bytes, record_batch, text_or_empty, written

#: Each Latin-1 byte as it counts in words: A-Z in lower case, a-z and U+00C0 to U+00FF as they are, others as blanks.
AS_LETTER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
#: Words of a subtree that one task joins at once; a larger subtree is cut at the next character.
MOST_IN_SUBTREE = 20_000
#: Different words that a task counts before it passes their counts on.
MOST_COUNTED = 200_000


def vocabulary(df: DataFrame, min_length: int, min_count: int, drop_one_in: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word and n: the letters' runs in lower case (A-Z only), one in drop_one_in of a document's runs without one character."""
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(counts: Counter) -> pa.RecordBatch:
        return record_batch({"word": [w.decode("latin-1") for w in counts], "n": list(counts.values())}, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in by_bytes(batches, "__text"):
            for doc, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist()):
                # one byte for each character; those beyond Latin-1 become question marks, which part words as they do
                own = Counter(text.encode("latin-1", "replace").translate(AS_LETTER).split())
                begun = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if drop_one_in and h % drop_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        counts[word] += n
                if len(counts) > MOST_COUNTED:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    rows = df.select(F.col(id_col).cast("long").alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Node:
    """A node of a trie: children by character, and the word that ends here."""

    __slots__ = ("children", "word")

    def __init__(self) -> None:
        self.children: dict[str, Node] = {}
        self.word: int = -1


def descend(active: dict[Node, int], letter: str, child: Node) -> dict[Node, int]:
    """The active nodes of a child from its parent's: all nodes whose strings are within one edit of the child's, with that distance.

    From an active node one comes by the same letter (distance as it is), by another one or none of its own (one more), and beyond
    a node at distance 0 by one letter that the child's string lacks.
    """
    found: dict[Node, int] = {}

    def add(node: Node, distance: int) -> None:
        if found.get(node, 2) > distance:
            found[node] = distance

    for node, distance in active.items():
        if (same := node.children.get(letter)) is not None:
            add(same, distance)
            if distance == 0:
                for beyond in same.children.values():
                    add(beyond, 1)
        if distance == 0:
            add(node, 1)
            for other in node.children.values():
                add(other, 1)
    return found


def near_in_subtree(words: list[str]) -> list[tuple[int, int]]:
    """Pairs i < j of distinct words at distance one, by active-node sets that go down the words' trie."""
    root = Node()
    for i, word in enumerate(words):
        node = root
        for letter in word:
            node = node.children.setdefault(letter, Node())
        node.word = i
    pairs = []
    trail = [(root, {root: 0} | {c: 1 for c in root.children.values()})]
    while trail:
        node, active = trail.pop()
        if node.word >= 0:
            pairs += [(node.word, other.word) for other, distance in active.items() if distance == 1 and other.word > node.word]
        for letter, child in node.children.items():
            trail.append((child, descend(active, letter, child)))
    return pairs


def subtrees(words: DataFrame, min_length: int) -> DataFrame:
    """key (way, shorter length, half), head (the first half read that way), rest, way, short, word and n: a word stands in the subtrees of its own length and of the next shorter one, of each way."""
    short = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= min_length))
    rows = words.select("word", "n", short.alias("short")).withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    read = F.when(F.col("way") == 0, F.col("word")).otherwise(F.reverse("word"))
    half = F.expr("short div 2").cast("int")
    rows = rows.withColumn("read", read).select("word", "n", "short", "way", F.substring(F.col("read"), 1, half).alias("head"), F.col("read").substr(half + 1, F.length("read")).alias("rest"))
    return rows.withColumn("key", F.concat_ws(":", F.col("way").cast("string"), F.col("short").cast("string"), F.col("head")))


def _met(one: str, two: str, way: int, short: int) -> bool:
    """Whether a pair of a subtree belongs to it: the shorter one has short characters, and a pair that also shares its first half is left to the trie read forwards."""
    return min(len(one), len(two)) == short and not (way and one[: short // 2] == two[: short // 2])


def joined_subtrees(rows: DataFrame) -> DataFrame:
    """word, n, near, n_near_word of the pairs of each subtree, both ways: a task goes through its subtrees one by one."""
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])

    def pairs(group: list[tuple[str, str, int]], way: int, short: int) -> Iterator[tuple]:
        for i, j in near_in_subtree([rest for rest, _, _ in group]):
            (_, a, n), (_, b, m) = group[i], group[j]
            if _met(a, b, way, short):
                yield a, n, b, m
                yield b, m, a, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, at, found = None, [], (0, 0), []

        def out() -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * 4
            found.clear()
            return record_batch(dict(zip(arrow.names, map(list, columns))), arrow)

        for batch in batches:
            for k, way, short, rest, word, n in zip(*(batch.column(c).to_pylist() for c in ("key", "way", "short", "rest", "word", "n"))):
                if k != key:
                    if len(group) > 1:
                        found += pairs(group, *at)
                    key, group, at = k, [], (way, short)
                    if len(found) > 20_000:
                        yield out()
                group.append((rest, word, n))
        if len(group) > 1:
            found += pairs(group, *at)
        yield out()

    # by a hash of the key: Spark may leave out a repartition by the very column of the join before it, and then read that join's shuffle where it lies
    dealt = rows.select("key", "way", "short", "rest", "word", "n").repartition(F.xxhash64("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def edits_at_root(rows: DataFrame) -> DataFrame:
    """The pairs of large subtrees whose edit is at the subtree's root: beyond it an active node at distance one goes on by equal letters only, so the rests are equal."""
    side = lambda x, rest: rows.select("key", "way", "short", rest.alias("beyond"), F.col("rest").substr(1, 1).alias(f"first{x}"), F.col("word").alias(f"word{x}"), F.col("n").alias(f"n{x}"))
    after = F.col("rest").substr(F.lit(2), F.length("rest"))
    some = F.length("rest") > 0
    replaced = side(1, F.when(some, after)).join(side(2, F.when(some, after)), ["key", "way", "short", "beyond"]).filter("first1 < first2")
    added = side(1, F.when(some, after)).join(side(2, F.col("rest")), ["key", "way", "short", "beyond"]).filter("first1 != first2")
    both = replaced.unionByName(added).withColumn("half", F.expr("short div 2").cast("int"))
    same_half = F.col("word1").substr(F.lit(1), F.col("half")) == F.col("word2").substr(F.lit(1), F.col("half"))
    met = (F.least(F.length("word1"), F.length("word2")) == F.col("short")) & ~((F.col("way") == 1) & same_half)
    ends = lambda a, b: F.struct(F.col(f"word{a}").alias("word"), F.col(f"n{a}").alias("n"), F.col(f"word{b}").alias("near"), F.col(f"n{b}").alias("near_n"))
    return both.filter(met).select(F.explode(F.array(ends(1, 2), ends(2, 1))).alias("p")).select("p.*")


def near_words(words: DataFrame, min_length: int, most: int | None = None) -> DataFrame:
    """word, n, near, near_n: all pairs of distinct words (word, n) that differ by one inserted, deleted or replaced character, both ways.

    Subtrees of more than most words are cut at their next character, round by round, until none is left; the pairs whose
    edit is that character are joined by what follows. No pair is lost, and a task holds so many words of a subtree at most.
    """
    most = MOST_IN_SUBTREE if most is None else most
    left = written(subtrees(words, min_length), "subtrees")
    found = []
    while True:
        large = written(left.groupBy("key").count().filter(F.col("count") > most).select("key"), "large")
        if large.isEmpty():
            break
        found.append(joined_subtrees(left.join(large, "key", "left_anti")))
        hot = written(left.join(large, "key", "left_semi"), "subtrees")
        found.append(edits_at_root(hot))
        deeper = hot.filter(F.length("rest") > 0).withColumn("key", F.concat("key", F.col("rest").substr(1, 1)))
        left = written(deeper.withColumn("rest", F.col("rest").substr(F.lit(2), F.length("rest"))), "subtrees")
    found.append(joined_subtrees(left))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms are followed to the last by doubling. A form is commoner than its word, so there are no rings."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(df: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_one_in: int = 199, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, form, root (string), n, n_near, form_n (long) of all words of min_length characters or more that occur min_count times or more.

    A word's form is its near word (one edit away) of largest n, ties to the first in code-point order, if that n is ratio times its own or more;
    its root is where forms lead in the end, or itself. One in drop_one_in runs of a document loses a character first (0: none does).
    A null text has no words; a null id counts as no characters. Rows stand for themselves, repeated ones too; an empty
    table gives an empty one; other columns are left out, whatever their names.
    """
    if min_length < 2:
        raise ValueError("halves need words of two characters at least")
    words = written(vocabulary(df, min_length, min_count, drop_one_in, text_col, id_col), "words")
    near = near_words(words, min_length)
    best = near.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    best = written(best.select("word", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    out = words.join(best, "word", "left").join(roots(best.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
