"""The latest delivery of each record, for tables in which rows are delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans import materialize


def latest(df: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """Rows of ``df`` that are not superseded by a later row of the same ``key``.

    Only (key, time, hash of the content) is grouped.  The keys delivered more than once are
    written as a table; the planner broadcasts it if its known size allows, and joins by shuffle
    otherwise, so the wide rows normally do not move.  Rows equal in key, time and content all
    stay; a null time counts as the earliest; a null key is kept as it is.
    """
    version = F.struct(
        F.coalesce(F.col(at), F.lit(0).cast("timestamp")).alias("t"), F.xxhash64(F.coalesce(content, F.lit(""))).alias("h")
    )
    repeated = (
        df.select(F.col(key).alias("_key"), version.alias("v"))
        .groupBy("_key")
        .agg(F.max("v").alias("_last"), F.count("*").alias("n"))
        .where("n > 1")
        .select("_key", "_last")
    )
    known = materialize(repeated, "repeated")
    return (
        df.join(known, F.col(key) == F.col("_key"), "left")
        .where(F.col("_last").isNull() | (version == F.col("_last")))
        .drop("_key", "_last")
    )
