"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """One star round over links (u > v). large: neighbours above a node go to its least neighbour; small: those below."""
    both = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # A written table: the skew join splits a node with very many links only if both sides come straight from a shuffle.
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    joined = both.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link; root is the least node of its component.

    links has two long columns, a and b, in any order, with repeats and self-links allowed. The rounds stop when the
    link table no longer changes, after about log(n) of them. Sums meet in partial aggregates and each round's join has
    one row per node on one side, so a node with very many links is split by the skew join like any hot key."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links, before = materialize(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select("v", F.col("v").alias("root")).distinct().toDF("node", "root"))
        before = now
        links = materialize(_stars(_stars(links, False), True), "links")
