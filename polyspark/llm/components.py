"""Connected components of a link table by alternating large-star and small-star contraction.

Every step is a grouped minimum (with map-side combining) and an equi-join, so a vertex with a huge number of links is
split by adaptive skew handling instead of landing in one task. No link list is ever gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import Stash


def _oriented(edges: DataFrame) -> DataFrame:
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, stash: Stash) -> DataFrame:
    """``edges``: longs u, v (nulls and self links are ignored; order and repetition do not matter).

    Returns (u, v): every vertex that has a link and is not its component's smallest, with that smallest vertex. Vertices
    that do not appear are their own component. An empty table gives an empty table.
    """
    now = stash.put(_oriented(edges.select("u", "v").dropna()))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _oriented(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash.put(_oriented(small.unionByName(low.select("u", F.col("m").alias("v")))))
        stash.drop(now)
        # Done when no vertex has a smaller one and is the smaller one of another: every component is a star.
        if after.join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            return after
        now = after
