"""Blocks of lines that occur in more than one file, and setups that nothing uses.

Windows of a few lines are hashed inside each file's row; hashes are counted with partial
aggregation (only the least and the greatest file of each), so a block that a third of all files
share is no group in any task.  Blank lines and indentation do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.plans import materialize, spread
from siltstone.sources.repository import LATEST_FILES, files


def cloned_blocks(source: DataFrame, window: int = 5, least_chars: int = 120) -> DataFrame:
    """(file_id, start, lines): maximal runs of filled lines covered by windows that other files have too.

    ``start`` counts filled lines from 1.  Windows of fewer than ``least_chars`` characters, such as
    closing brackets, say nothing.  Null, empty and short files have none.
    """
    filled = F.filter(F.transform(F.split("content", "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), lambda x: x != "")
    rows = source.where("content <> ''").select("file_id", filled.alias("l")).where(F.size("l") >= window)
    block = lambda i: F.array_join(F.slice("l", i, window), "\n")
    each = rows.select("file_id", "l", F.explode(F.sequence(F.lit(1), F.size("l") - window + 1)).alias("i")).select("file_id", "i", block(F.col("i")).alias("b"))
    hashed = materialize(each.where(F.length("b") >= least_chars).select("file_id", "i", F.xxhash64("b").alias("h"), F.hash("b").alias("g")), "windows")
    shared = hashed.groupBy("h", "g").agg(F.min("file_id").alias("a"), F.max("file_id").alias("z")).where("a <> z").select("h", "g")
    hit = hashed.join(shared, ["h", "g"], "left_semi").select("file_id", "i")
    order = Window.partitionBy("file_id").orderBy("i")
    before = F.lag("i").over(order)
    marked = hit.withColumn("new", F.when(before.isNull() | (F.col("i") > before + window), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("file_id", "run").agg(F.min("i").alias("start"), (F.max("i") - F.min("i") + window).alias("lines")).drop("run")


def duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of at least five lines that several files share."""
    return cloned_blocks(spread(files(spark, sf_dir).select("file_id", "content")))


#: An assignment that sets something up: the name is the first group.
SETUP = r"(?m)^[ \t]*(?:const|let|var)[ \t]+([A-Za-z_$][\w$]*)[ \t]*=[ \t]*(?:new[ \t]+[A-Z]\w*|(?:create|make|build|init|connect)\w*\()"
SETUP_PY = r"(?m)^[ \t]*([A-Za-z_]\w*)[ \t]*=[ \t]*(?:[A-Z]\w*\(|(?:create|make|build|init|connect)_?\w*\()"


def unused_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a file sets up and does not mention a second time, except one-letter ones."""
    f = files(spark, sf_dir).where("content <> ''")
    names = F.array_distinct(F.when(F.col("path").rlike(r"\.py$"), F.regexp_extract_all("content", F.lit(SETUP_PY), 1)).otherwise(F.regexp_extract_all("content", F.lit(SETUP), 1)))
    words = F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), 0)
    # only files that set something up list their words
    some = f.select("file_id", "path", "content", names.alias("names")).where(F.size("names") > 0).select("*", words.alias("words"))
    once = F.filter("names", lambda n: (F.length(n) >= 2) & (F.size(F.filter("words", lambda w: w == n)) == 1))
    return some.select("file_id", "path", F.explode(once).alias("name"))


QUERIES = {"duplicate_blocks": duplicate_blocks, "unused_setups": unused_setups}
ORACLES = {
    "duplicate_blocks": f"""with {LATEST_FILES},
l as (select file_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\r]', ' ', 'g'))), lambda x: x <> '') as l from latest_files where content <> ''),
w as (select file_id, l, unnest(range(1, len(l) - 3)) as i from l where len(l) >= 5),
b as (select file_id, i, array_to_string(list_slice(l, i, i + 4), chr(10)) as b from w),
s as (select b from b where length(b) >= 120 group by b having min(file_id) <> max(file_id)),
h as (select file_id, i from b where b in (select b from s)),
m as (select *, case when i > lag(i) over (partition by file_id order by i) + 5 or lag(i) over (partition by file_id order by i) is null then 1 else 0 end as new from h),
r as (select *, sum(new) over (partition by file_id order by i) as run from m)
select file_id, min(i)::int as start, (max(i) - min(i) + 5)::int as lines from r group by file_id, run""",
    "unused_setups": rf"""with {LATEST_FILES},
n as (select file_id, path, content, unnest(list_distinct(case when regexp_matches(path, '\.py$') then regexp_extract_all(content, '{SETUP_PY}', 1) else regexp_extract_all(content, '{SETUP}', 1) end)) as name from latest_files where content <> ''),
c as (select file_id, path, name, len(list_filter(regexp_extract_all(content, '[A-Za-z_$][\w$]*'), lambda x: x = name)) as k from n where length(name) >= 2)
select file_id, path, name from c where k = 1""",
}
