"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import new_tag, table


def connected_components(edges: DataFrame, tag: str | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of type long); root is the component's smallest node.

    Every step is a grouped minimum and an equi-join, so a node with very many
    neighbours is pre-aggregated or split, never gathered. Loops and repeated
    edges are allowed, nulls are ignored; an empty table gives an empty table.
    """
    tag = tag or new_tag("components")
    now = table(_tidy(edges.select("a", "b")), tag)
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
        now = table(_tidy(_small_star(_tidy(_large_star(now)))), tag)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _tidy(edges: DataFrame) -> DataFrame:
    """Each edge once, larger end first, no loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))
