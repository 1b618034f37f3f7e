"""Tables of repositories: latest files, their lines, and what their paths say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.rules import EXCLUDED_DIRS, EXTENSIONS, TEST_DIRS, TEST_PATHS
from siltstone.operators.versions import latest
from siltstone.plans import scan

#: DuckDB view of the latest files, for the SQL twins.
LATEST_FILES = """latest_files as (
  select * exclude (rn) from (
    select *, row_number() over (partition by file_id order by ingested_at desc) as rn from files
  ) where rn = 1)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest delivery of every file."""
    return latest(scan(spark, sf_dir, "files"), "file_id", "ingested_at", "content")


def read_tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, error, size) of every file below ``root``; unreadable bytes give an error."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    text = F.try_validate_utf8(F.decode("content", "UTF-8")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    return raw.select("path", text.alias("content"), F.when(text.isNull(), "not UTF-8").alias("error"), F.col("length").alias("size"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; lines that do not parse are dropped."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def extension(path: Column) -> Column:
    """The part after the last dot of the file name, in lower case; empty without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """js, rust, go, python or java by extension; anything else counts as js."""
    ext = extension(path)
    out = F.lit("js")
    for name, known in EXTENSIONS.items():
        if name != "js":
            out = F.when(ext.isin(*known), name).otherwise(out)
    return out


LANGUAGE_SQL = "case lower(regexp_extract(path, '\\.([^./]*)$', 1)) when 'rs' then 'rust' when 'go' then 'go' when 'py' then 'python' when 'java' then 'java' else 'js' end"


def is_test(path: Column) -> Column:
    """Does the path look like that of a test?"""
    out = path.rlike(TEST_DIRS)
    for pattern in TEST_PATHS:
        out = out | path.rlike(pattern)
    return out


TEST_SQL = "(" + " or ".join(f"regexp_matches(path, '{p}')" for p in (*TEST_PATHS, TEST_DIRS)) + ")"


def in_excluded_dir(path: Column) -> Column:
    """Is any component of the path the name of an excluded directory?"""
    return F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*map(F.lit, EXCLUDED_DIRS)))


EXCLUDED_SQL = f"list_has_any(string_split(path, '/'), {list(EXCLUDED_DIRS)})"


def lines(content: Column) -> Column:
    """Array of (line, text), lines counted from 1 and split at LF."""
    return F.transform(F.split(content, "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
