"""Column functions over mates, links and orientations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def insert_size(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    return F.when(start1 <= start2, end2 - start1 + 1).otherwise(end1 - start2 + 1)


def end_of_strand(strand: Column) -> Column:
    """A mate on the forward strand points at its contig's end E, one on the reverse strand at its beginning B."""
    return F.when(strand == "+", "E").otherwise("B")


def gap_distance(mean: Column, oa: Column, start1: Column, end1: Column, length1: Column, ob: Column, start2: Column, end2: Column, length2: Column) -> Column:
    """The library's mean less what both mates leave on their contigs. The second offset depends on the second end alone."""
    first = F.when(oa == "E", length1 - start1).otherwise(end1)
    second = F.when(ob == "B", end2).otherwise(length2 - start2)
    return (mean - first - second).cast("double")


def congruent(orient_a: Column, orient_b: Column, ends: Column) -> Column:
    """Whether a link's ends are those that its contigs' orientations ask for."""
    return F.coalesce(F.concat(F.when(orient_a == "FOW", "E").otherwise("B"), F.when(orient_b == "FOW", "B").otherwise("E")) == ends, F.lit(False)) & orient_a.isNotNull() & orient_b.isNotNull()


def gfa_signs(ends: Column) -> tuple[Column, Column]:
    """Signs of a link's two segments.

    Fixed values: BB -+, BE --, EB ++, EE +-.
    """
    return F.when(ends.substr(1, 1) == "E", "+").otherwise("-"), F.when(ends.substr(2, 1) == "B", "+").otherwise("-")


def edge_cost(bsize: Column) -> Column:
    return F.when(bsize == 0, F.lit(10.0)).otherwise(F.lit(1.0) / bsize)


def bubble_class(members: Column) -> Column:
    n = F.size(members)
    return F.when(n == 3, "three").when(n == 4, "four").when(n > 4, "complex")


def six_digits(x: Column) -> Column:
    """x as it comes back from a text of six significant digits."""
    return F.format_string("%.5e", x).cast("double")
