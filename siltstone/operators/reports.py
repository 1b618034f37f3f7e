"""Reports and sinks: findings as tables of text, differences of texts, written results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.hygiene import scan_findings, _FOUND


def short_path(path: Column, width: int = 30) -> Column:
    """The end of a long path after ``...``."""
    return F.when(F.length(path) > width, F.concat(F.lit("..."), F.substring(path, -(width - 3), width - 3))).otherwise(path)


def compact_table(findings: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` findings by severity, path and line, each as one row of a Markdown table."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    top = findings.orderBy(rank, "path", "file_id", "line", "rule").limit(most)
    return top.select(F.concat(F.lit("| "), F.concat_ws(" | ", short_path(F.col("path")), "line", "rule", "severity"), F.lit(" |")).alias("row"))


def by_file(findings: DataFrame) -> DataFrame:
    """One Markdown entry per file: its findings in order of line."""
    entry = F.concat(F.lit("- L"), F.col("line"), F.lit(": "), F.col("rule"), F.when(F.col("fix") != "flag", F.concat(F.lit(" ["), F.col("fix"), F.lit("]"))).otherwise(""))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "rule", entry.alias("e")))), lambda x: x["e"]), "\n")
    return findings.groupBy("file_id", "path").agg(listed.alias("entries"), F.count("*").alias("n"))


def line_diff(before: Column, after: Column) -> Column:
    """Lines that differ between two texts at the same place: (line, before, after), null where one is shorter."""
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    zipped = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b))),
        lambda i: F.struct(i.alias("line"), F.get(a, i - 1).alias("before"), F.get(b, i - 1).alias("after")),
    )
    return F.filter(zipped, lambda x: ~x["before"].eqNullSafe(x["after"]))


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a result as Parquet, in folders by ``by``."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_table(scan_findings(spark, sf_dir), most=50)


def report_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_file(scan_findings(spark, sf_dir))


QUERIES = {"report_table": report_table, "report_by_file": report_by_file}
ORACLES = {
    "report_table": _FOUND
    + """select '| ' || concat_ws(' | ', case when length(path) > 30 then '...' || right(path, 27) else path end, line, rule, severity) || ' |' as row from findings
order by case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 else 3 end, path, file_id, line, rule limit 50""",
    "report_by_file": _FOUND
    + """select file_id, path, string_agg('- L' || line || ': ' || rule || case when fix <> 'flag' then ' [' || fix || ']' else '' end, chr(10) order by line, rule) as entries, count(*) as n from findings group by file_id, path""",
}
