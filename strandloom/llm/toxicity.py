"""Toxicity by weak supervision: many small voters, a generative model of how far to trust them, and a linear classifier.

Voters are words and word beginnings: a fixed lexicon, and patterns mined from labelled rows. The label model estimates each
voter's accuracy and which voters repeat each other by EM over their votes; a given label is one voter more, of a given
accuracy. A linear classifier over the voters and shares of votes then learns from the posterior labels alone, and is cut
where it agrees with them best. It scores whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import by_bytes, free_name, record_batch, text_or_empty, written

#: Insults that need no mining.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "crap", "cretin", "damn", "disgusting", "dumb", "filth", "fool", "fuck", "garbage", "hate",
    "idiot", "imbecile", "jerk", "kill", "loser", "moron", "pathetic", "pig", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless",
)
PREFIXES = (4, 5, 6)
WORD = re.compile(r"\w+")
ROWS_FOR_FIT = 20_000
MOST_VOTERS = 400
BLOCK = 2000
#: How often a given label is held to be right: its weight among the voters of the label model.
LABEL_TRUST = 0.9
FLUSH = 100_000


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: voters (a word, or a beginning with * after it), the label model's trust in each, and the classifier's weights."""

    voters: tuple[str, ...]
    strengths: tuple[float, ...]
    weights: tuple[float, ...]
    share_weight: float
    bias: float


def patterns_of(text: str) -> set[str]:
    """All words of a text in lower case, and the words' beginnings of 4 to 6 letters, with * after them."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if len(w) >= n}


def mine_voters(labelled: DataFrame, most: int = MOST_VOTERS, least_docs: int = 8) -> list[tuple[str, float]]:
    """(pattern, log odds) of patterns that stand in toxic rows far more often than in others, strongest first.

    Counted over all labelled rows: tasks sum up their patterns before the shuffle, in tables of bounded size. What comes back is at
    most that many patterns; ties go to the smaller pattern. Without toxic or without other rows there are none.
    """
    schema = pa.schema([("p", pa.string()), ("t", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: tuple[dict[str, int], dict[str, int]] = {}, {}

        def out() -> pa.RecordBatch:
            every = [*dict.fromkeys([*of[0], *of[1]])]
            toxic = [of[1].get(p, 0) for p in every]
            rows = record_batch({"p": every, "t": toxic, "n": [of[0].get(p, 0) + t for p, t in zip(every, toxic)]}, schema)
            of[0].clear()
            of[1].clear()
            return rows

        for batch in by_bytes(batches, "text"):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                counts = of[int(toxic > 0)]
                for p in patterns_of(text):
                    counts[p] = counts.get(p, 0) + 1
                counts[""] = counts.get("", 0) + 1  # the rows themselves
                if len(of[0]) + len(of[1]) > FLUSH:
                    yield out()
        yield out()

    rows = labelled.select("toxic", "text").mapInArrow(run, "p string, t long, n long")
    counts = written(rows.groupBy("p").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).filter("t > 2 or p = ''"), "patterns")
    total = counts.filter("p = ''").first()
    bad, good = (int(total["t"]), int(total["n"] - total["t"])) if total else (0, 0)
    if not bad or not good:
        return []
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1))
    sure = counts.filter((F.col("p") != "") & (F.col("t") >= min(least_docs, max(3, bad // 20))) & (odds > 2.0)).withColumn("odds", odds)
    return [(r["p"], float(r["odds"])) for r in sure.orderBy(F.desc(F.col("t") * F.col("odds")), "p").limit(most).select("p", "odds").collect()]


@lru_cache(maxsize=8)
def _finder(voters: tuple[str, ...]) -> tuple[dict[str, int], dict[str, int], tuple[int, ...]]:
    whole = {v: i for i, v in enumerate(voters) if not v.endswith("*")}
    starts = {v[:-1]: i for i, v in enumerate(voters) if v.endswith("*")}
    return whole, starts, tuple(sorted({len(s) for s in starts}))


def votes(text: str, voters: tuple[str, ...]) -> tuple[dict[int, int], int]:
    """How often each voter votes in a text, and the number of words."""
    whole, starts, lengths = _finder(voters)
    words = WORD.findall(text.lower())
    found: dict[int, int] = {}
    for n in lengths:
        for i in filter(None.__ne__, map(starts.get, [w[:n] for w in words])):
            found[i] = found.get(i, 0) + 1
    for i in filter(None.__ne__, map(whole.get, words)):
        found[i] = found.get(i, 0) + 1
    return found, len(words)


def label_model(matrix: np.ndarray, labels: np.ndarray, prior: float, trust: float = LABEL_TRUST, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior P(toxic) of each row, and each voter's log odds, of a rows x voters matrix of votes (1) and abstentions (0).

    A generative model: given the true label, a voter votes with a rate of its own, for toxic rows and for others; EM estimates
    both. Voters that go together more than the label explains share one vote: what each says, by voting or abstaining, counts
    1 / (1 + the sum of its correlations). The given labels (0 or 1) are one voter more, right with probability trust.
    """
    n, m = matrix.shape
    given = np.where(labels > 0, 1.0, -1.0) * np.log(trust / (1 - trust))
    posterior = np.where(labels > 0, trust, 1 - trust)
    weight, vote = np.ones(m), np.zeros(m)
    for r in range(rounds):
        toxic = posterior.sum()
        rate_t = np.clip((posterior.astype(np.float32) @ matrix + 0.5) / (toxic + 1), 1e-6, 1 - 1e-6)
        rate_o = np.clip(((1 - posterior).astype(np.float32) @ matrix + 0.05) / (n - toxic + 1), 1e-6, 1 - 1e-6)
        vote, abstain = np.log(rate_t / rate_o), np.log((1 - rate_t) / (1 - rate_o))
        if r % 10 == 5:  # what the label leaves unexplained
            together = np.zeros((m, m))
            for at in range(0, n, BLOCK):
                p = posterior[at : at + BLOCK, None]
                left = matrix[at : at + BLOCK] - p * rate_t - (1 - p) * rate_o
                together += left.T @ left
            scale = np.sqrt(np.diag(together)) + 1e-9
            together = np.clip(together / np.outer(scale, scale), 0, 1)
            np.fill_diagonal(together, 0)
            weight = 1 / (1 + np.where(together > 0.2, together, 0).sum(1))
        z = np.log(prior / (1 - prior)) + given + matrix @ (weight * (vote - abstain)).astype(np.float32) + (weight * abstain).sum()
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return posterior, weight * vote


def linear_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression on soft labels, the intercept last (not shrunk), by Newton's method."""
    w, shrink = np.zeros(x.shape[1] + 1), np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        curve, slope = np.diag(shrink), -shrink * w
        for at in range(0, len(x), BLOCK):
            part = np.hstack([x[at : at + BLOCK], np.ones((len(x[at : at + BLOCK]), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve = curve + (part * (p * (1 - p))[:, None]).T @ part
            slope = slope + part.T @ (y[at : at + BLOCK] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(z: np.ndarray, truth: np.ndarray) -> float:
    """The cut of z with the highest true rate less false rate, in the middle between the two values that it lies between.

    truth holds 0 and 1; where all are alike, the cut is 0.
    """
    if truth.min(initial=1) == truth.max(initial=0):
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, truth = z[order], truth[order]
    gain = np.cumsum(truth) / truth.sum() - np.cumsum(1 - truth) / (1 - truth).sum()
    gain[:-1][z[:-1] == z[1:]] = -1
    at = int(gain.argmax())
    return float((z[at] + z[at + 1]) / 2) if at + 1 < len(z) else float(z[at] - 1)


def features(found: dict[int, int], words: int, strengths: np.ndarray) -> np.ndarray:
    row = np.zeros(len(strengths) + 1)
    row[list(found)] = 1.0
    row[-1] = min(3.0, sum(c * strengths[i] for i, c in found.items()) / max(1.0, strengths.max(initial=1.0)) / np.sqrt(words + 1.0)) if found else 0.0
    return row


def fit(labelled: DataFrame, sample: DataFrame, most_voters: int = MOST_VOTERS) -> ToxicityModel:
    """A model from all labelled rows (text, toxic 0 or 1) and the bounded sample of them that labelled_rows() gives.

    The lexicon and most_voters mined patterns at most, the strongest, vote: the number of a model's weights is so a choice of the caller.
    Voters are mined over all rows; the label model and the classifier are fitted on the sample. Labels choose the voters, give the
    prior and are one voter of the label model; the classifier sees posteriors only. Without toxic or without other rows (an
    empty table is such a case) the lexicon alone votes, each word with the same weight.
    """
    mined = mine_voters(labelled, most_voters)
    voters = tuple(dict.fromkeys([*LEXICON, *(p for p, _ in mined)]))
    schema = pa.schema([("toxic", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            found = [votes(t, voters) for t in batch.column("text").to_pylist()]
            yield record_batch({"toxic": batch.column("toxic"), "ids": [list(f) for f, _ in found], "counts": [list(f.values()) for f, _ in found], "words": [w for _, w in found]}, schema)

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic int, ids array<int>, counts array<int>, words long").collect()
    truth = np.array([r["toxic"] for r in rows], float)
    if not len(truth) or truth.min() == truth.max():
        return ToxicityModel(LEXICON, (1.0,) * len(LEXICON), (2.0,) * len(LEXICON), 1.0, -2.5)
    matrix = np.zeros((len(rows), len(voters)), np.float32)
    for i, r in enumerate(rows):
        matrix[i, r["ids"]] = 1.0
    posterior, strengths = label_model(matrix, truth, float(truth.mean()))
    strengths = np.clip(strengths, 0, None)
    del matrix
    x = np.zeros((len(rows), len(voters) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i] = features(dict(zip(r["ids"], r["counts"])), r["words"], strengths)
    w = linear_fit(x, posterior)
    w[-1] -= best_cut(x @ w[:-1] + w[-1], (posterior >= 0.5).astype(float))
    return ToxicityModel(voters, tuple(strengths.tolist()), tuple(w[:-2].tolist()), float(w[-2]), float(w[-1]))


def _score(text: str, model: ToxicityModel, weights: np.ndarray, strengths: np.ndarray) -> float:
    found, words = votes(text, model.voters)
    z = model.bias
    if found:
        row = features(found, words, strengths)
        z += float(row[:-1] @ weights + row[-1] * model.share_weight)
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score (0 to 1) of each row's whole text; a null text counts as empty, rows stand for themselves.

    Repeated rows are scored each; an empty table gives an empty one; columns not in keep are left out.
    """
    schema_in = df.select(*keep).schema
    arrow = pa.schema([*[pa.field(c, pa.int64()) for c in keep], ("score", pa.float64())])
    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in schema_in] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, strong = np.array(model.weights), np.array(model.strengths)
        for batch in by_bytes(batches, "__text"):
            scores = [_score(t, model, weights, strong) for t in batch.column("__text").to_pylist()]
            yield record_batch({**{c: batch.column(c) for c in keep}, "score": scores}, arrow)

    return df.select(*keep, text_or_empty(text_col).alias("__text")).mapInArrow(run, ddl)


def with_score(df: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "__score") -> DataFrame:
    """All columns of df, and the score in the column that into names, which replaces an own one of that name; a null text counts as empty, an empty table gives an empty one."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, strong = np.array(model.weights), np.array(model.strengths)
        return pd.Series([_score(t or "", model, weights, strong) for t in texts], dtype="float64")

    return df.withColumn(into, score(F.col(f"`{text_col}`").cast("string")))


def without_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of df whose text scores below that, with all their columns as they are, whatever their names."""
    name = free_name(df, "__score")
    return with_score(df, model, text_col, name).filter(F.col(name) < below).drop(name)


def labelled_rows(documents: DataFrame, labels: DataFrame, held_out: bool = True, rows_for_fit: int = ROWS_FOR_FIT) -> tuple[DataFrame, DataFrame]:
    """text and toxic of the labelled rows to learn from, and of a sample: with held_out, none whose crc32 of the id leaves 0 modulo 5.

    The sample is bounded: the rows_for_fit labelled ids with the smallest hashes, which is small enough to send to every
    task. All rows are a sort-merge join at any size, so that what is shuffled grows with the input: a text with a label
    once. A document with several labels counts as toxic if one says so; null labels and null ids are left out, and so are
    labels without a document. Documents that share an id are rows each.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("key"), F.col("toxic").cast("int").alias("toxic")).filter("key is not null and toxic is not null")
    if held_out:
        own = own.filter(F.crc32(F.col("key").cast("string")) % 5 != 0)
    own = own.groupBy("key").agg(F.max("toxic").alias("toxic"))
    sample = own.orderBy(F.xxhash64("key"), "key").limit(rows_for_fit)
    texts = documents.select(F.col("doc_id").cast("long").alias("key"), text_or_empty("text").alias("text")).filter("key is not null")
    rows = texts.join(own.hint("merge"), "key").select("text", "toxic")
    return rows, written(texts.join(F.broadcast(sample), "key").select("text", "toxic"), "labelled")


def toxicity_digest(documents: DataFrame, labels: DataFrame, most_voters: int = MOST_VOTERS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id is not held out, a null text is scored as an empty one. most_voters is as in fit()."""
    model = fit(*labelled_rows(documents, labels), most_voters)
    scored = score_toxicity(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
