"""Scans of text whose rows know their order over any number of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bits of an order that count rows within a partition, as monotonically_increasing_id() has them.
ROW_BITS = 33
#: Files that are sent to every task at most; the places of more are joined by a shuffle.
MOST_FILES = 100_000


def slot(order: Column) -> Column:
    """The part of an order that is common to the rows of one split of a file."""
    return F.shiftright(order, ROW_BITS)


def ordered_text(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """value, file, offset (where the row's split begins) and line_no, which grows in the order of the files' names and of the rows within them; it has gaps.

    Spark deals splits out by size and small files many to a task, so a row's number in its task says nothing across splits. Splits of a file
    begin at least as far apart as Spark's least split; each file has room for so many, in order of name, and the row's number
    in its task is counted on within. Only names and sizes of files are listed for that: no text is read twice.
    """
    least = max(1, min(_bytes(spark.conf.get(f"spark.sql.files.{x}")) for x in ("maxPartitionBytes", "openCostInBytes")))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    room = F.sum(F.expr(f"size div {least}") + 1).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    places = files.select("file", F.coalesce(room, F.lit(0)).alias("first"))
    reader = spark.read
    for name, value in options.items():
        reader = reader.option(name, value)
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("row"))
    few = len(rows.inputFiles()) <= MOST_FILES
    order = F.shiftleft(F.col("first") + F.expr(f"offset div {least}"), ROW_BITS) + F.col("row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.join(F.broadcast(places) if few else places, "file").select("value", "file", "offset", order.alias("line_no"))


def _bytes(setting: str) -> int:
    """A size setting in bytes: digits with or without a unit."""
    text = setting.strip().lower().removesuffix("b")
    unit = text[-1:] if text[-1:] in "kmgt" else ""
    return int(text.removesuffix(unit)) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
