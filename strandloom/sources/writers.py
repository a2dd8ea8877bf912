"""Rows of the text formats, as a column named value; save() writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.links import bubble_class, gfa_signs
from strandloom.functions.sequences import wrapped
from strandloom.operators import motifs
from strandloom.operators.graph import components, node_ids
from strandloom.shared import written


def number(x: Column) -> Column:
    """A double in six significant digits, as plain text."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def tsv(df: DataFrame, *columns: str, digits: bool = False) -> DataFrame:
    kinds = dict(df.dtypes)
    cells = [number(F.col(c)) if digits and kinds[c] == "double" else F.col(c).cast("string") for c in columns]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def coverage_rows(coverage: DataFrame) -> DataFrame:
    return tsv(coverage, "contig", "coverage", digits=True)


def link_rows(links: DataFrame) -> DataFrame:
    extra = ["bsize"] if "bsize" in links.columns else []
    return tsv(links, "a", "oa", "b", "ob", "mean", "stdev", *extra, digits=True)


def pair_rows(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("component", "block", "pair").select(F.concat_ws("\t", "u", "v", F.array_join("members", "\t")).alias("value"))


def bubble_rows(bubbles: DataFrame) -> DataFrame:
    """source, sink and members, with a tab after the last."""
    return bubbles.orderBy("source").select(F.concat("source", F.lit("\t"), "sink", F.lit("\t"), F.array_join("members", "\t"), F.lit("\t")).alias("value"))


def gml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id, label, orientation, length; edges: source, target (ids), orientation, mean, stdev, bsize. Lengths and means stand in quotes."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col
    node = nodes.select(F.lit(1).alias("k"), c("id").alias("i"), F.lit(0).cast("long").alias("j"), text('node [\n id ', c("id"), '\n label "', c("label"), '"\n orientation "', F.when(c("orientation") == "FOW", "FOW").otherwise("REV"), '"\n length "', c("length"), '"\n]').alias("value"))
    edge = edges.select(F.lit(2).alias("k"), c("source").alias("i"), c("target").alias("j"), text("edge [\n source ", c("source"), "\n target ", c("target"), '\n orientation "', c("orientation"), '"\n mean "', number(c("mean")), '"\n stdev ', number(c("stdev")), "\n bsize ", c("bsize"), "\n]").alias("value"))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, 0, 0, "graph [\n directed 1"), (3, 0, 0, "]")], "k int, i long, j long, value string")
    return frame.unionByName(node).unionByName(edge).orderBy("k", "i", "j").select("value")


def bundled_gml(bundles: DataFrame, ids: DataFrame, cutoff: int) -> DataFrame:
    """All contigs of any bundle as nodes (contig, id), edges of bundles of cutoff links or more."""
    nodes = ids.select(F.col("id").cast("long"), F.col("contig").alias("label"), F.lit("FOW").alias("orientation"), F.lit(0).alias("length"))
    return gml_rows(nodes, _edges(bundles.filter(F.col("bsize") >= cutoff), ids))


def oriented_gml(orientation: DataFrame, contigs: DataFrame, links: DataFrame) -> DataFrame:
    """Oriented contigs as nodes, numbered from 1 in order of name, valid links as edges; a contig of no known length has 0."""
    ids = written(node_ids(orientation), "ids")
    length = contigs.groupBy("contig").agg(F.max("length").alias("length"))
    nodes = ids.join(orientation.select("contig", F.col("orient").alias("orientation")), "contig").join(length, "contig", "left")
    nodes = nodes.select(F.col("id").cast("long"), F.col("contig").alias("label"), "orientation", F.coalesce("length", F.lit(0)).alias("length"))
    return gml_rows(nodes, _edges(links, ids))


def _edges(links: DataFrame, ids: DataFrame) -> DataFrame:
    name = lambda side, out: ids.select(F.col("contig").alias(side), F.col("id").cast("long").alias(out))
    return links.join(name("a", "source"), "a").join(name("b", "target"), "b").select("source", "target", F.concat("oa", "ob").alias("orientation"), "mean", "stdev", "bsize")


def invalidated_rows(orientation: DataFrame) -> DataFrame:
    """contig and the last count of links that its orientation left invalid, for contigs that were counted."""
    return tsv(orientation.filter("invalidated is not null").orderBy("contig"), "contig", "invalidated")


def central_rows(found: DataFrame, rounds: int = 3) -> DataFrame:
    """contig and score as high_centrality() gives them; each round repeats what earlier rounds found."""
    again = found.select("contig", "score", "round", F.explode(F.sequence(F.col("round"), F.lit(rounds))).alias("again"))
    return tsv(again.orderBy("again", "round", "contig"), "contig", "score")


def listed(names: Column) -> Column:
    """Names as a list in brackets and quotes; a quote or backslash within a name has a backslash before it."""
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), F.regexp_replace(n, r"([\\'])", r"\\$1"), F.lit("'"))), ", "), F.lit("]"))


def plasmid_rows(edges: DataFrame) -> DataFrame:
    """value: the names of each single directed ring as a list, in order of component."""
    parts = components(edges)
    rings = parts.join(motifs.plasmids(edges, parts).select("component"), "component", "left_semi")
    rings = rings.groupBy("component").agg(F.sort_array(F.collect_list("contig")).alias("names")).orderBy("component")
    return rings.select(listed(F.col("names")).alias("value"))


def motif_files(edges: DataFrame, bubbles: DataFrame) -> dict[str, DataFrame]:
    """The rows of each motif file by its name: plasmids, bubbles of three, of four and of more members, and cycles."""
    kinds = bubbles.withColumn("kind", bubble_class(F.col("members")))
    files = {f"{kind}_bubbles": bubble_rows(kinds.filter(F.col("kind") == kind)) for kind in ("three", "four", "complex")}
    return {"plasmids": plasmid_rows(edges), **files, "cycles": motifs.cycle_basis(edges).select(listed(F.col("cycle")).alias("value"))}


def gfa_rows(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """Header, segments with their lengths, links with the bundle's size as overlap."""
    x, y = gfa_signs(F.concat("oa", "ob"))
    head = contigs.sparkSession.createDataFrame([(0, "", "H\tVN:Z:1.0")], "k int, o string, value string")
    s = contigs.select(F.lit(1).alias("k"), F.col("contig").alias("o"), F.concat_ws("\t", F.lit("S"), "contig", F.lit("*"), F.concat(F.lit("LN:i:"), F.col("length").cast("string"))).alias("value"))
    e = links.select(F.lit(2).alias("k"), F.concat_ws("\t", "a", "b").alias("o"), F.concat_ws("\t", F.lit("L"), "a", x, "b", y, F.col("bsize").cast("string")).alias("value"))
    return head.unionByName(s).unionByName(e).orderBy("k", "o", "value").select("value")


def agp_rows(rows: DataFrame) -> DataFrame:
    return rows.orderBy("scaffold", "part").select(F.concat_ws("\t", "scaffold", F.col("begin").cast("string"), F.col("end").cast("string"), F.col("part").cast("string"), F.lit("W"), "contig", F.lit("1"), F.col("length").cast("string"), "strand").alias("value"))


def fasta_rows(sequences: DataFrame, name: str = "scaffold") -> DataFrame:
    return sequences.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped(F.col("seq"))).alias("value"))


def repeat_rows(repeats: DataFrame) -> DataFrame:
    return repeats.orderBy("contig").select(F.col("contig").alias("value"))


def save(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Writes value as text, in as many files as the rows have partitions; one_file is for readers that need a single one."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").text(path)
