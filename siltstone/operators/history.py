"""Commit history: co-change, hotspots, contributors, bus factor, staleness.

Null authors, hashes and files are left out of what counts them; a commit that is delivered again
counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.rules import EXTENSIONS
from siltstone.plans import scan
from siltstone.sources.repository import EXCLUDED_SQL, TEST_SQL, extension, files, in_excluded_dir, is_test

_SOURCE = sorted(e for es in EXTENSIONS.values() for e in es)
_SOURCE_SQL = f"lower(regexp_extract(path, '\\.([^./]*)$', 1)) in {tuple(_SOURCE)}"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (repo, hash, file, author, ts)."""
    return scan(spark, sf_dir, "commits", "repo", "hash", "file", "author", "ts").distinct()


def co_changed(touched: DataFrame, least: int = 2, most: int = 20, threshold: int = 3) -> DataFrame:
    """(repo, file_a, file_b, n): pairs of files of one repository that commits touch together.

    Commits of fewer than ``least`` or more than ``most`` files say nothing about coupling, and the
    upper bound is part of the definition; it also bounds the pairs of a commit (190), which are
    made within one row of its files, not by a join.  Files are counted before they are collected, so
    a commit of a million files is never one row.
    """
    each = touched.select("repo", "hash", "path").distinct()
    sized = each.groupBy("repo", "hash").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    chosen = each.join(sized, ["repo", "hash"], "left_semi").groupBy("repo", "hash").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    pairs = F.flatten(
        F.transform("paths", lambda a, i: F.transform(F.slice("paths", i + 2, most), lambda b: F.struct(a.alias("file_a"), b.alias("file_b"))))
    )
    each = chosen.select("repo", F.explode(pairs).alias("p")).select("repo", "p.file_a", "p.file_b")
    return each.groupBy("repo", "file_a", "file_b").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scan(spark, sf_dir, "commits", "repo", "hash", F.col("file").alias("path")).where("hash is not null and path is not null")
    p = F.col("path")
    return c.where(extension(p).isin(*_SOURCE) & ~is_test(p) & ~in_excluded_dir(p))


def cochange_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that at least two commits change together."""
    return co_changed(_touched(spark, sf_dir), threshold=2)


def cochange_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the number of files they change with, and the sum of their common commits."""
    pairs = co_changed(_touched(spark, sf_dir), threshold=2)
    both = pairs.select("repo", F.explode(F.array("file_a", "file_b")).alias("file"), "n")
    return both.groupBy("repo", "file").agg(F.count("*").alias("coupled"), F.sum("n").alias("commits"))


def contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, first and last day, and files of each author."""
    c = commits(spark, sf_dir).where("author is not null")
    return c.groupBy("author").agg(
        F.countDistinct("hash").alias("commits"),
        F.countDistinct("repo", "file").alias("files"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def bus_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository, the fewest authors that together made 80 % of its commits."""
    per = (
        commits(spark, sf_dir).where("author is not null").groupBy("repo", "author").agg(F.countDistinct("hash").alias("c"))
    )
    order = Window.partitionBy("repo").orderBy(F.desc("c"), "author")
    total = F.sum("c").over(Window.partitionBy("repo"))
    before = F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = per.select("repo", "c", total.alias("total"), before.alias("before"))
    return marked.groupBy("repo").agg(
        F.count("*").alias("authors"), F.max("total").alias("commits"), F.count_if(F.col("before") * 5 < F.col("total") * 4).alias("bus_factor")
    )


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 files with the most commits, with their authors and last change."""
    c = commits(spark, sf_dir)
    per = c.groupBy("repo", "file").agg(
        F.countDistinct("hash").alias("changes"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_change")
    )
    return per.orderBy(F.desc("changes"), "repo", "file").limit(50)


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author with most commits of each file, and their share."""
    per = commits(spark, sf_dir).where("author is not null").groupBy("repo", "file", "author").agg(F.countDistinct("hash").alias("c"))
    return per.groupBy("repo", "file").agg(
        F.min_by("author", F.struct(-F.col("c"), "author")).alias("owner"), (F.max("c") / F.sum("c")).alias("share")
    )


def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that commits name and ``files`` does not have, with the time of their last commit."""
    there = files(spark, sf_dir).select("repo", F.col("path").alias("file")).distinct()
    gone = scan(spark, sf_dir, "commits", "repo", "file", "ts").join(there, ["repo", "file"], "left_anti")
    return gone.groupBy("repo", "file").agg(F.max("ts").alias("last_change"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, files and authors per repository and month, with the running sum of commits."""
    c = commits(spark, sf_dir)
    per = c.groupBy("repo", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.countDistinct("hash").alias("commits"), F.countDistinct("file").alias("files"), F.countDistinct("author").alias("authors")
    )
    order = Window.partitionBy("repo").orderBy("month")
    return per.withColumn("running", F.sum("commits").over(order))


def stale_repositories(spark: SparkSession, sf_dir: str, as_of: str = "2026-01-01 00:00:00", days: int = 30) -> DataFrame:
    """Repositories without a commit in the ``days`` before ``as_of``, and for how many whole days."""
    last = scan(spark, sf_dir, "commits", "repo", "ts").groupBy("repo").agg(F.max("ts").alias("last_commit"))
    repos = scan(spark, sf_dir, "repos", "repo", "default_branch")
    idle = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_commit")) / 86_400_000_000)
    return repos.join(last, "repo").withColumn("idle_days", idle).where(F.col("idle_days") >= days)


_C = "c as (select distinct repo, hash, file, author, ts from commits)"
_PAIRS = f"""with t as (select distinct repo, hash, file as path from commits where hash is not null and file is not null),
s as (select repo, hash, path, count(*) over (partition by repo, hash) as n from t where {_SOURCE_SQL} and not {TEST_SQL} and not {EXCLUDED_SQL}),
p as (select a.repo, a.path as file_a, b.path as file_b, count(*) as n from s a join s b on a.repo = b.repo and a.hash = b.hash and a.path < b.path
  where a.n between 2 and 20 group by all having count(*) >= 2)
"""
QUERIES = {
    "cochange_pairs": cochange_pairs,
    "cochange_hotspots": cochange_hotspots,
    "contributors": contributors,
    "bus_factor": bus_factor,
    "hotspots": hotspots,
    "ownership": ownership,
    "deleted_files": deleted_files,
    "activity": activity,
    "stale_repositories": stale_repositories,
}
ORACLES = {
    "cochange_pairs": _PAIRS + "select * from p",
    "cochange_hotspots": _PAIRS
    + "select repo, file, count(*) as coupled, sum(n)::bigint as commits from (select repo, file_a as file, n from p union all select repo, file_b, n from p) group by all",
    "contributors": f"with {_C} select author, count(distinct hash) as commits, count(distinct (repo, file)) as files, min(ts) as first_seen, max(ts) as last_seen from c where author is not null group by author",
    "bus_factor": f"""with {_C}, p as (select repo, author, count(distinct hash) as c from c where author is not null group by all),
w as (select repo, c, sum(c) over (partition by repo) as total, coalesce(sum(c) over (partition by repo order by c desc, author rows between unbounded preceding and 1 preceding), 0) as before from p)
select repo, count(*) as authors, max(total)::bigint as commits, count(*) filter (before * 5 < total * 4) as bus_factor from w group by repo""",
    "hotspots": f"with {_C} select repo, file, count(distinct hash) as changes, count(distinct author) as authors, max(ts) as last_change from c group by repo, file order by changes desc, repo, file limit 50",
    "ownership": f"""with {_C}, p as (select repo, file, author, count(distinct hash) as c from c where author is not null group by all),
r as (select *, row_number() over (partition by repo, file order by c desc, author) as rn, sum(c) over (partition by repo, file) as t from p)
select repo, file, author as owner, c / t as share from r where rn = 1""",
    "deleted_files": "select repo, file, max(ts) as last_change from commits c where not exists (select 1 from files f where f.repo = c.repo and f.path = c.file) group by repo, file",
    "activity": f"""with {_C}, p as (select repo, strftime(ts, '%Y-%m') as month, count(distinct hash) as commits, count(distinct file) as files, count(distinct author) as authors from c group by all)
select *, sum(commits) over (partition by repo order by month)::bigint as running from p""",
    "stale_repositories": """select r.repo, default_branch, max(ts) as last_commit,
floor((epoch_us(timestamp '2026-01-01') - epoch_us(max(ts)::timestamp)) / 86400000000)::bigint as idle_days
from repos r join commits c using (repo) group by r.repo, default_branch
having floor((epoch_us(timestamp '2026-01-01') - epoch_us(max(ts)::timestamp)) / 86400000000) >= 30""",
}
