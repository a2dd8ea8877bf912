"""Hypergraphs as tables of incidences: edge and node, a row for each node of an edge. No edge is ever expanded into pairs of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators import graph


def incidence(rows: DataFrame, edge: str, node: str, repeated: bool = False) -> DataFrame:
    """edge and node, as text, of two columns: repeated rows are one, unless they may stay, and rows with a null in either are none."""
    rows = rows.select(F.col(edge).cast("string").alias("edge"), F.col(node).cast("string").alias("node")).dropna()
    return rows if repeated else rows.distinct()


def edge_sizes(inside: DataFrame) -> DataFrame:
    """edge, its size (nodes) and its meetings: the sum, over its nodes, of the other edges that hold them too.

    Edges that share several nodes meet at each of them. Meetings come from the nodes' degrees, so a node of many edges costs a row an edge, not a row a pair.
    """
    return inside.join(node_degrees(inside), "node").groupBy("edge").agg(F.count("*").alias("size"), F.sum(F.col("degree") - 1).alias("meetings"))


def node_degrees(inside: DataFrame) -> DataFrame:
    """node and degree: the edges that hold it."""
    return inside.groupBy("node").agg(F.count("*").alias("degree"))


def components(inside: DataFrame) -> DataFrame:
    """kind (edge or node), name and component (its smallest node): edges that share a node are together.

    Edges and nodes are the two sides of a graph whose links are the incidences, whose number stays as it is. Repeated rows do no harm, and where
    an edge's rows lie together, that edge is contracted where it lies.
    """
    # a mark before each name keeps the sides apart, and a node is always the smallest member
    links = inside.select(F.concat(F.lit("0"), "node").alias("a"), F.concat(F.lit("1"), "edge").alias("b"))
    kind = F.when(F.col("contig").startswith("0"), "node").otherwise("edge")
    return graph.components(links).select(kind.alias("kind"), F.expr("substr(contig, 2)").alias("name"), F.expr("substr(component, 2)").alias("component"))
