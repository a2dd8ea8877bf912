"""Column functions over names and sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Each base's complement; ambiguous ones become N, a blank goes.
BASES, COMPLEMENTS = "ACGTNRMYSWKacgtn ", "TGCANNNNNNNtgcan"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def known_bases(seq: Column) -> Column:
    return seq.rlike(f"^[{BASES}]*$")


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of so many characters, without a line end after the last."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def gap_join(parts: Column, gap: int = 100) -> Column:
    return F.array_join(parts, "N" * gap)


def first_token(header: Column) -> Column:
    return F.split(F.ltrim(header), r"\s+")[0]


def tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def read_name(read: Column) -> Column:
    """A read's name without the mate's suffix /1 or /2 (or any /x)."""
    return F.when(has_suffix(read), F.expr("substring(read, 1, length(read) - 2)")).otherwise(read)


def has_suffix(read: Column) -> Column:
    return (F.length(read) >= 2) & (read.substr(-2, 1) == "/")
