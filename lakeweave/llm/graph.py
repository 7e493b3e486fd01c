"""Connected components by joins, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the links ``a, b``.

    Alternates between linking larger neighbours to a node's smallest and smaller ones likewise, until
    nothing changes. Each step is an aggregation and a join on nodes; its result is written to the shared
    folder. Nulls and self links are ignored.
    """
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(pairs, "links")
    while True:
        # Large star: all neighbours, in both directions, that are larger go to the smallest one.
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "links")
        # Small star: smaller neighbours, and the node itself, go to the smallest one.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        fresh = materialize(small.distinct(), "links")
        same = fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        before = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        state = fresh
        if same == before:
            break
    tops = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
