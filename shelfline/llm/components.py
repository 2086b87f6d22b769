"""Connected components of a graph of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.session import materialize


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Point every neighbour `v` of `u` at the least of u's neighbours."""
    return pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _round(links: DataFrame, large: bool) -> DataFrame:
    """One star operation on links (u, v), u > v."""
    if large:       # larger neighbours move to the least neighbour or itself
        pairs = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return _star(pairs.where("v > u"), least)
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    least = materialize(least, "least")
    return _star(links, least).union(least.select("u", F.col("m").alias("v")))


def _tidy(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (`u`, `v`, long ids in any direction) the (`node`, `root`)
    of every linked node, root being the least id of its component.

    Alternating large and small stars (a logarithmic number of rounds) until
    the links form stars.  The least neighbour is a partial aggregate and each
    round's links are a written table, so a node with many links is split like
    any skewed join and a lost executor costs one round.
    """
    links = materialize(_tidy(links), "links")
    while True:
        links = materialize(_tidy(_round(links, True)), "links")
        links = materialize(_tidy(_round(links, False)), "links")
        # Stars: a node has one link up, or only links from below.
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
        if not ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where(
                "ups > 1 or (ups = 1 and least = 0)").head(1):
            roots = links.select("v").distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
