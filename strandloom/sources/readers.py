"""Typed scans of the positional text formats. Nothing is inferred; fields are parted by any white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandloom.functions.sequences import first_token, tokens
from strandloom.shared import written
from strandloom.sources.bam import read_bam  # noqa: F401
from strandloom.sources.ordered import ordered_text


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (in the order of the files' names and their lines) and f, the fields."""
    rows = ordered_text(spark, path)
    return rows.select("line_no", tokens(F.col("value")).alias("f")).filter("f[0] != ''")


def _field(i: int, kind: str) -> Column:
    return F.expr(f"try_cast(get(f, {i}) as {kind})")


def _last(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of repeated keys the last line stands."""
    return rows.groupBy(key).agg(F.max_by(value, "line_no").alias(value))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, read, mapq, strand and line_no; fields beyond the sixth are left out."""
    return lines(spark, path).select(
        _field(0, "string").alias("contig"), _field(1, "int").alias("start"), _field(2, "int").alias("end"), _field(3, "string").alias("read"), _field(4, "int").alias("mapq"), F.substring(_field(5, "string"), 1, 1).alias("strand"), "line_no"
    )


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return _last(lines(spark, path).select(_field(0, "string").alias("contig"), _field(1, "int").alias("length"), "line_no"), "contig", "length")


def lengths_of_nodes(contigs: DataFrame, nodes: DataFrame) -> DataFrame:
    return contigs.join(nodes.select("contig"), "contig", "left_semi")


def read_values(spark: SparkSession, path: str, name: str, kind: str) -> DataFrame:
    """contig and a value: coverage, invalidated counts, centrality scores."""
    return _last(lines(spark, path).select(_field(0, "string").alias("contig"), _field(1, kind).alias(name), "line_no"), "contig", name)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    return read_values(spark, path, "coverage", "double")


def read_links(spark: SparkSession, path: str, bundled: bool = False) -> DataFrame:
    """Links, up to the first line that doesn't parse; link_id counts from 1, for bundled links from 0."""
    n = 7 if bundled else 6
    rows = lines(spark, path).select(
        "line_no", _field(0, "string").alias("a"), _field(1, "string").alias("oa"), _field(2, "string").alias("b"), _field(3, "string").alias("ob"), _field(4, "double").alias("mean"), _field(5, "double").alias("stdev"), *([_field(6, "int").alias("bsize")] if bundled else [])
    )
    bad = " or ".join(f"{c} is null" for c in rows.columns[1 : n + 1])
    stop = F.broadcast(rows.filter(bad).agg(F.min("line_no").alias("stop")))
    rows = rows.crossJoin(stop).filter("stop is null or line_no < stop").drop("stop")
    return numbered(rows, "line_no", "link_id", 0 if bundled else 1).drop("line_no")


def numbered(rows: DataFrame, order: str, name: str, first: int) -> DataFrame:
    """A gapless number in the order of a column, counted range by range."""
    parts = written(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return parts.join(F.broadcast(firsts), "__part").withColumn(name, (F.col("__first") + rank - 1 + first).cast("long")).drop("__part", "__first")


def undirected_simple(links: DataFrame) -> DataFrame:
    """One edge for each pair of nodes, with the attributes of its last link."""
    rows = links.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b"))
    return rows.groupBy("u", "v").agg(F.max_by(F.struct("mean", "stdev", "bsize", "oa", "ob"), "link_id").alias("attrs")).select("u", "v", "attrs.*")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig and seq. A record is what stands between two > that begin a line; of repeated names the last record stands."""
    rows = ordered_text(spark, path, lineSep="\n>").filter("trim(value) != ''")
    body = F.regexp_replace(F.col("value"), "^>", "")
    header = F.split(body, "\r?\n", 2)
    rows = rows.select("line_no", first_token(header[0]).alias("contig"), F.regexp_replace(F.coalesce(F.get(header, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))
    return _last(rows, "contig", "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """read and seq: records of four lines, the name up to the first blank."""
    rows = spark.read.option("lineSep", "\n@").text(path).filter("trim(value) != ''")
    parts = F.split(F.regexp_replace("value", "^@", ""), "\r?\n")
    return rows.select(first_token(parts[0]).alias("read"), F.get(parts, F.lit(1)).alias("seq"))


def fasta_lengths(sequences: DataFrame) -> DataFrame:
    return sequences.select("contig", F.length("seq").alias("length"))


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, orientation, length) and edges (source, target, orientation, mean, stdev, bsize), named by label.

    A file is cut at its node and edge blocks by the reader, so that no task holds it whole.
    """
    rows = spark.read.option("lineSep", "]").text(path)
    value = lambda key: F.nullif(F.regexp_extract("value", rf'\b{key}\s+"?([^"\n]+?)"?\s*(?:\n|$)', 1), F.lit(""))
    node = rows.filter(F.col("value").rlike(r"\bnode\s*\[")).select(value("id").cast("long").alias("id"), value("label").alias("label"), value("orientation").alias("orientation"), value("length").cast("int").alias("length"))
    edge = rows.filter(F.col("value").rlike(r"\bedge\s*\[")).select(
        value("source").cast("long").alias("s"), value("target").cast("long").alias("t"), value("orientation").alias("orientation"), value("mean").cast("double").alias("mean"), value("stdev").cast("double").alias("stdev"), value("bsize").cast("int").alias("bsize")
    )
    name = lambda i, n: node.select(F.col("id").alias(i), F.col("label").alias(n))
    edges = edge.join(name("s", "source"), "s").join(name("t", "target"), "t").select("source", "target", "orientation", "mean", "stdev", "bsize")
    return node, edges


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """line_no, u, v (the smaller first) and members; of lines with one pair, all have the last one's members."""
    rows = lines(spark, path).select("line_no", F.least(F.col("f")[0], F.col("f")[1]).alias("u"), F.greatest(F.col("f")[0], F.col("f")[1]).alias("v"), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("members"))
    last = rows.groupBy("u", "v").agg(F.max_by("members", "line_no").alias("members"))
    return rows.drop("members").join(last, ["u", "v"])


def read_bubbles(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("f")[0].alias("source"), F.col("f")[1].alias("sink"), F.slice("f", 3, F.greatest(F.size("f") - 2, F.lit(0))).alias("members"))
