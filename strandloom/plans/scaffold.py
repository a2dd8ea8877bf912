"""The whole run: alignments and sequences to scaffolds, each stage a table that the next one reads."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.config import Config
from strandloom.functions.links import six_digits
from strandloom.operators import bubbles, bundle, centrality, graph, layout, orient, pairs, repeats, splits
from strandloom.shared import stage, written
from strandloom.sources import readers, writers


def _compat(df: DataFrame, config: Config) -> DataFrame:
    """With text_compat, doubles as they come back from text of six digits."""
    return df.select(*[six_digits(F.col(c)).alias(c) if config.text_compat and t == "double" else F.col(c) for c, t in df.dtypes])


def _keeper(spark: SparkSession, config: Config):
    return lambda name, make: stage(spark, config.tables, name, make)


def bundle_stage(alignments: DataFrame, contigs: DataFrame, config: Config) -> dict[str, DataFrame]:
    keep = _keeper(contigs.sparkSession, config)
    found = keep("mates", lambda: pairs.mate_pairs(alignments))
    links = keep("links", lambda: _compat(pairs.links(found, contigs, config.min_length), config))
    every = keep("bundles", lambda: bundle.bundle_all(links))
    bundled = keep("bundled", lambda: _compat(orient.with_link_ids(bundle.bundled_links(links, config.min_bundle)), config))
    return {"mates": found, "links": links, "bundles": every, "bundled": bundled, "coverage": keep("coverage", lambda: _compat(pairs.coverage(found, contigs), config))}


def repeat_stage(bundled: DataFrame, coverage: DataFrame, contigs: DataFrame, config: Config) -> dict[str, DataFrame]:
    """filtered (links that stay), repeats and central."""
    spark = bundled.sparkSession
    keep = _keeper(spark, config)
    if not config.repeats:
        return {"filtered": bundled, "repeats": spark.createDataFrame([], "contig string"), "central": spark.createDataFrame([], "contig string, score double, round int")}
    invalidated = keep("invalidated", lambda: orient.orient_contigs(bundled, contigs, config.strategy).filter("invalidated is not null").select("contig", "invalidated"))
    central = keep("central", lambda: centrality.high_centrality(bundled, config.centrality_rounds, config.centrality_min))
    both = lambda: repeats.filter_links(bundled, contigs, central.select("contig", "score"), repeats.signal_outliers(bundled, coverage, invalidated))
    return {"filtered": keep("filtered", lambda: both()[0]), "repeats": keep("repeats", lambda: both()[1]), "central": central}


def scaffold_stage(links: DataFrame, contigs: DataFrame, config: Config) -> dict[str, DataFrame]:
    keep = _keeper(contigs.sparkSession, config)
    orientation = keep("orientation", lambda: orient.orient_contigs(links, contigs, config.strategy))
    valid = keep("oriented", lambda: orient.valid_links(links, orientation))
    found_pairs = keep("pairs", lambda: splits.separation_pairs(valid))
    found = keep("bubbles", lambda: bubbles.find_bubbles(valid, found_pairs))
    paths = keep("paths", lambda: layout.scaffold_paths(layout.end_edges(bubbles.collapse(valid, found))))
    parts = keep("parts", lambda: layout.scaffold_parts(valid, orientation, found, paths))
    return {"orientation": orientation, "oriented": valid, "pairs": found_pairs, "bubbles": found, "parts": parts, "agp": keep("agp", lambda: layout.agp(parts, contigs))}


def run(alignments: DataFrame, sequences: DataFrame, config: Config = Config()) -> dict[str, DataFrame]:
    """All stages' tables by name. alignments as read_bed() gives them, sequences as contig and seq.

    With config.tables, stages whose tables are whole there are not run again; the inputs and options must then be the same.
    """
    contigs = _keeper(sequences.sparkSession, config)("contigs", lambda: readers.fasta_lengths(sequences))
    out = bundle_stage(alignments, contigs, config)
    out |= repeat_stage(out["bundled"], out["coverage"], contigs, config)
    out |= scaffold_stage(out["filtered"], contigs, config)
    return out | {"contigs": contigs, "scaffolds": layout.scaffold_sequences(out["agp"], sequences)}


def kept_files(out: dict[str, DataFrame], config: Config) -> dict[str, DataFrame]:
    """The rows of the stages' files by name."""
    ids = written(graph.node_ids(graph.nodes(out["bundles"])), "ids")
    files = {name: writers.link_rows(out[name]) for name in ("links", "bundled", "filtered", "oriented")}
    return files | {
        "contig_coverage": writers.coverage_rows(out["coverage"]),
        "bundled_graph.gml": writers.bundled_gml(out["bundles"], ids, config.min_bundle),
        "oriented.gml": writers.oriented_gml(out["orientation"], out["contigs"], out["oriented"]),
        "invalidated_counts": writers.invalidated_rows(out["orientation"]),
        "high_centrality": writers.central_rows(out["central"], config.centrality_rounds),
        "repeats": writers.repeat_rows(out["repeats"]),
        "seppairs": writers.pair_rows(out["pairs"]),
    }


def main() -> None:
    p = argparse.ArgumentParser(description="Scaffolds contigs from a BED file of read pairs.")
    p.add_argument("-a", "--assembly", required=True, help="FASTA of the contigs")
    p.add_argument("-m", "--mapping", required=True, help="BED, or BAM by its name's ending")
    p.add_argument("-d", "--dir", required=True, help="folder for results")
    p.add_argument("-r", "--repeats", default="true")
    p.add_argument("-k", "--keep", default="false", help="true: write the stages' tables too")
    p.add_argument("-l", "--length", type=int, default=500)
    p.add_argument("-b", "--bsize", type=int, default=3)
    p.add_argument("--strategy", default="bsize", choices=["bsize", "length", "degree"], help="what the walk of orientation takes first")
    p.add_argument("--motifs", default="false", help="true: write the motif files too")
    p.add_argument("--tables", help="folder that keeps the stages' tables, so that a run goes on where one ended")
    a = p.parse_args()
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    config = Config(min_length=a.length, min_bundle=a.bsize, repeats=a.repeats.lower() == "true", keep=a.keep.lower() == "true", strategy=a.strategy, tables=a.tables)
    alignments = readers.read_bam(spark, a.mapping) if a.mapping.endswith(".bam") else readers.read_bed(spark, a.mapping)
    out = run(alignments, readers.read_fasta(spark, a.assembly), config)
    writers.save(writers.fasta_rows(out["scaffolds"]), f"{a.dir}/scaffolds.fa")
    writers.save(writers.agp_rows(out["agp"]), f"{a.dir}/scaffolds.agp")
    writers.save(writers.gfa_rows(out["contigs"], out["oriented"]), f"{a.dir}/scaffold_graph.gfa")
    writers.save(writers.bubble_rows(out["bubbles"]), f"{a.dir}/bubbles.txt")
    files = kept_files(out, config) if config.keep else {}
    if a.motifs.lower() == "true":
        files |= writers.motif_files(out["oriented"], out["bubbles"])
    for name, rows in files.items():
        writers.save(rows, f"{a.dir}/{name}", one_file=name.endswith(".gml"))


if __name__ == "__main__":
    main()
