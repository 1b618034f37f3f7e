"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id that is reachable from each id of ``links``.

    Alternating large-star and small-star rounds, each an aggregation and a join of links that only
    ever move, so that no vertex gathers its neighbours in one row; the rounds needed grow with the
    logarithm of the longest path.  Each round's links are written to the shared folder.  Links that
    are null at either end are ignored; loops give a component of one; an empty table stays empty.
    """
    ok = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = materialize(
        ok.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )  # u >= v
    loops = edges.where("u = v").select(F.col("u").alias("id"), F.col("v").alias("component"))
    edges = edges.where("u > v")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = materialize(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots).unionByName(loops).groupBy("id").agg(F.min("component").alias("component"))
