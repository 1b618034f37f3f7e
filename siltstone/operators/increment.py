"""Incremental maps: what changed between two states of the files, and applying it to a stored map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import scan


def parse_diff(lines: DataFrame, text: str = "text") -> DataFrame:
    """(status, path, to_path) of lines like ``M<tab>a`` or ``R087<tab>a<tab>b``.

    A renaming of less than full similarity is a change of the new path as well; other lines are ignored.
    """
    p = F.split(text, "\t")
    status = F.substring(p[0], 1, 1)
    base = lines.where(F.col(text).rlike(r"^(?:[AMD]\t[^\t]+|R\d{1,3}\t[^\t]+\t[^\t]+)$"))
    entry = F.struct(status.alias("status"), p[1].alias("path"), F.when(status == "R", F.get(p, 2)).alias("to_path"))
    changed = F.struct(F.lit("M").alias("status"), F.get(p, 2).alias("path"), F.lit(None).cast("string").alias("to_path"))
    partly = (status == "R") & (F.expr(f"try_cast(substring(split({text}, '\t')[0], 2) as int)") < 100)
    return base.select(F.explode(F.when(partly, F.array(entry, changed)).otherwise(F.array(entry))).alias("e")).select("e.*")


def changes(old: DataFrame, new: DataFrame, on: list[str], digest: str = "digest") -> DataFrame:
    """Status of every key of either state: added, removed, changed or same (nulls equal nulls)."""
    a = old.select(*on, F.col(digest).alias("before"), F.lit(True).alias("was"))
    b = new.select(*on, F.col(digest).alias("after"), F.lit(True).alias("is"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return a.join(b, on, "full_outer").select(*on, status.alias("status"))


def apply_changes(stored: DataFrame, rescanned: DataFrame, status: DataFrame, on: list[str]) -> DataFrame:
    """The stored map without what is removed or changed, and with what was scanned anew."""
    gone = status.where("status in ('removed', 'changed')").select(*on)
    return stored.join(gone, on, "left_anti").unionByName(rescanned.join(status.where("status in ('added', 'changed')").select(*on), on, "left_semi"))


def _state(spark: SparkSession, sf_dir: str, until: str | None) -> DataFrame:
    f = scan(spark, sf_dir, "files", "repo", "path", "content", "ingested_at")
    if until:
        f = f.where(F.col("ingested_at") < F.lit(until).cast("timestamp"))
    return f.groupBy("repo", "path").agg(F.max_by(F.struct(F.md5("content").alias("d")), "ingested_at").alias("x")).select("repo", "path", F.col("x.d").alias("digest"))


def map_changes(spark: SparkSession, sf_dir: str, since: str = "2025-07-01 00:00:00") -> DataFrame:
    """Files per repository and status between the state before ``since`` and the latest one."""
    both = changes(_state(spark, sf_dir, since), _state(spark, sf_dir, None), ["repo", "path"])
    return both.groupBy("repo", "status").agg(F.count("*").alias("files"))


QUERIES = {"map_changes": map_changes}
ORACLES = {
    "map_changes": """with a as (select repo, path, arg_max(coalesce(md5(content), '-'), ingested_at) as d from files where ingested_at < timestamp '2025-07-01' group by all),
b as (select repo, path, arg_max(coalesce(md5(content), '-'), ingested_at) as d from files group by all)
select coalesce(a.repo, b.repo) as repo, case when a.d is null then 'added' when b.d is null then 'removed' when a.d = b.d then 'same' else 'changed' end as status, count(*) as files
from a full join b on a.repo = b.repo and a.path = b.path group by all""",
}
