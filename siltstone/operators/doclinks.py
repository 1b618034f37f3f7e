"""Links between documents and source: which files documents name, which exports none mentions.

Texts are cut into names, and names are joined by equality within a repository; no text is compared
with every name.  Documents without a repository link to nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.repomap import _F, _SYMBOL_SQL, _source, symbol_table
from siltstone.plans import scan
from siltstone.sources.repository import LATEST_FILES, files

FILE_NAME = r"([\w-]+\.(?:js|mjs|jsx|ts|py|go|rs|java|json|ya?ml|toml|sh))\b"
NAME = r"([A-Za-z_]\w+)"


def related_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_id): documents and the files of their repository whose name they mention."""
    d = scan(spark, sf_dir, "documents", "doc_id", "repo", "text").where("repo is not null and text is not null")
    named = d.select("doc_id", "repo", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FILE_NAME), 1))).alias("name"))
    there = files(spark, sf_dir).select("repo", F.element_at(F.split("path", "/"), -1).alias("name"), "file_id")
    return named.join(there, ["repo", "name"]).select("doc_id", "file_id")


def mentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (repo, name) of the names in a repository's documents."""
    d = scan(spark, sf_dir, "documents", "repo", "text").where("repo is not null and text is not null")
    return d.select("repo", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), 1))).alias("name")).distinct()


def undocumented_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports per repository, and how many of them none of its documents mentions."""
    exports = symbol_table(_source(spark, sf_dir)).where("exported and not startswith(name, '_')").select("repo", "name").distinct()
    seen = mentioned_names(spark, sf_dir).withColumn("seen", F.lit(True))
    return exports.join(seen, ["repo", "name"], "left").groupBy("repo").agg(
        F.count("*").alias("exports"), F.count_if(F.col("seen").isNull()).alias("undocumented")
    )


def mentioned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that documents mention, whether their repository has such a file or not."""
    d = scan(spark, sf_dir, "documents", "doc_id", "repo", "text").where("repo is not null and text is not null")
    named = d.select("doc_id", "repo", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FILE_NAME), 1))).alias("name"))
    there = files(spark, sf_dir).select("repo", F.element_at(F.split("path", "/"), -1).alias("name")).distinct().withColumn("there", F.lit(True))
    return named.join(there, ["repo", "name"], "left").groupBy("name").agg(
        F.count("*").alias("mentions"), F.count_if(F.col("there").isNull()).alias("broken")
    )


_NAMED = rf"""d as (select doc_id, repo, unnest(list_distinct(regexp_extract_all(text, '{FILE_NAME}', 1))) as name from documents where repo is not null and text is not null)"""
QUERIES = {"related_docs": related_docs, "undocumented_exports": undocumented_exports, "mentioned_files": mentioned_files}
ORACLES = {
    "related_docs": rf"with {LATEST_FILES}, {_NAMED} select d.doc_id, f.file_id from d join latest_files f on f.repo = d.repo and string_split(f.path, '/')[-1] = d.name",
    "mentioned_files": rf"""with {LATEST_FILES}, {_NAMED}, f as (select distinct repo, string_split(path, '/')[-1] as name from latest_files)
select d.name, count(*) as mentions, count(*) filter (f.name is null) as broken from d left join f on f.repo = d.repo and f.name = d.name group by d.name""",
    "undocumented_exports": rf"""with {_F}, s as ({_SYMBOL_SQL}), e as (select distinct repo, name from s where exported and not starts_with(name, '_')),
m as (select distinct repo, unnest(regexp_extract_all(text, '{NAME}', 1)) as name from documents where repo is not null)
select e.repo, count(*) as exports, count(*) filter (m.name is null) as undocumented from e left join m on m.repo = e.repo and m.name = e.name group by e.repo""",
}
