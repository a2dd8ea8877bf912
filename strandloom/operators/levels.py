"""Levels of acyclic graphs, found in one pass over lots of whole components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.operators import graph
from strandloom.operators.extras import topological_levels
from strandloom.operators.tour import _dealt, _lots
from strandloom.shared import written


def component_levels(edges: DataFrame) -> DataFrame:
    """topological_levels() of any graph, an edge without both ends being none: tasks go through lots of whole components, peeled together round by round.

    Components of more than graph.AT_ONCE edges take rounds of joins.
    """
    parts, counts = graph.component_edges(edges)
    most = graph.AT_ONCE
    beyond = written(counts.filter(F.col("n") > most).select("component"), "beyond")
    if beyond.isEmpty():
        return _levels_in_lots(parts, most)
    return _levels_in_lots(parts.join(beyond, "component", "left_anti"), most).unionByName(topological_levels(parts.join(beyond, "component", "left_semi")))


def _levels_in_lots(parts: DataFrame, most: int) -> DataFrame:
    kind = parts.schema["a"].dataType.simpleString()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches, most):
            a, b, names = graph._coded(lot)
            level = _peeled(len(names), a, b)
            free = np.flatnonzero(level >= 0)
            yield from pa.table([names.take(pa.array(free)), pa.array(level[free], pa.int32())], ["contig", "level"]).to_batches(max_chunksize=20_000)

    return _dealt(parts.select(F.col("component").alias("part"), "a", "b")).mapInArrow(within, f"contig {kind}, level int")


def _peeled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The level of each number below n, or -1; a round's work grows with its own nodes and edges."""
    plain = np.unique(a * n + b)
    a, b = plain // n, plain % n
    begin, end = np.searchsorted(a, np.arange(n)), np.searchsorted(a, np.arange(n), "right")
    # a loop is an edge in that never goes
    waiting, level, now = np.bincount(b, minlength=n), np.full(n, -1), 0
    front = np.flatnonzero(waiting == 0)
    while len(front):
        level[front] = now
        count = end[front] - begin[front]
        met = b[np.repeat(begin[front] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        np.subtract.at(waiting, met, 1)
        front, now = np.unique(met), now + 1
        front = front[waiting[front] == 0]
    return level
