"""Benchmark samples, baselines and rule quality.

Samples are rows (run, scenario, metric, value); null values are no samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.plans import scan


def aggregate(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Median (the mean of the middle two), mean, least, greatest and number of the values."""
    v = F.col(value)
    return samples.where(v.isNotNull()).groupBy(*by).agg(
        F.median(v).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.count(v).alias("samples")
    )


def compare(baseline: DataFrame, current: DataFrame, on: list[str], value: str = "value") -> DataFrame:
    """Baseline and current value of each metric, the difference, and it as a fraction of the baseline.

    The fraction is null where the baseline is 0 or either value is missing.
    """
    a = baseline.select(*on, F.col(value).alias("baseline"))
    b = current.select(*on, F.col(value).alias("current"))
    delta = F.col("current") - F.col("baseline")
    return a.join(b, on, "full_outer").select(
        *on, "baseline", "current", delta.alias("delta"), F.try_divide(delta, F.col("baseline")).alias("fraction")
    )


def parse_metrics(lines: DataFrame, text: str = "text") -> DataFrame:
    """(line columns, scenario, metric, value) of lines like ``PERF_METRICS a=1 b=2.5 scenario=s``.

    Values that are no numbers are null; a key that repeats in a line takes its last value.
    """
    marked = lines.where(F.col(text).rlike(r"^\s*PERF_METRICS\s"))
    pairs = F.regexp_extract_all(F.col(text), F.lit(r"([\w.-]+)=(\S+)"), 1)
    values = F.regexp_extract_all(F.col(text), F.lit(r"([\w.-]+)=(\S+)"), 2)
    seq = marked.select(*lines.columns, F.posexplode(F.arrays_zip(pairs.alias("k"), values.alias("v"))).alias("pos", "p"))
    scenario = F.regexp_extract(F.col(text), r"\bscenario=(\S+)", 1)
    last = seq.groupBy(*lines.columns, F.col("p.k").alias("metric")).agg(F.max_by("p.v", "pos").alias("raw"))
    return last.where("metric <> 'scenario'").select(
        *lines.columns, F.when(scenario != "", scenario).alias("scenario"), "metric", F.expr("try_cast(raw as double)").alias("value")
    )


def quality(expected: DataFrame, found: DataFrame, key: list[str], group: str) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 per ``group``; 0 / 0 counts as 0."""
    a = expected.select(*key, group).distinct().withColumn("e", F.lit(1))
    b = found.select(*key, group).distinct().withColumn("f", F.lit(1))
    both = a.join(b, [*key, group], "full_outer").groupBy(group).agg(
        F.count_if(F.col("e").isNotNull() & F.col("f").isNotNull()).alias("tp"),
        F.count_if(F.col("e").isNull()).alias("fp"),
        F.count_if(F.col("f").isNull()).alias("fn"),
    )
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return both.select(
        group, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def passes(result: DataFrame, least: float = 0.8, most_false: int = 10) -> DataFrame:
    """The gate of rule quality: precision, recall and F1 of at least ``least``, few false positives."""
    ok: Column = (F.col("precision") >= least) & (F.col("recall") >= least) & (F.col("f1") >= least) & (F.col("fp") <= most_false)
    return result.withColumn("passed", ok)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")


def benchmark_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values as samples: scenario = event type, run = day."""
    e = _events(spark, sf_dir)
    return aggregate(e.withColumn("run", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "run"])


def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the second half of the month against those of the first, per event type."""
    e = _events(spark, sf_dir)
    early = F.dayofmonth("ts") <= 15
    a = aggregate(e.where(early), ["event_type"]).select("event_type", F.col("median").alias("value"))
    b = aggregate(e.where(~early), ["event_type"]).select("event_type", F.col("median").alias("value"))
    return compare(a, b, ["event_type"])


def rater_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raters against the majority of the labels of each document (ties: the first by name)."""
    labels = scan(spark, sf_dir, "doc_labels", "doc_id", "label", "rater").where("label is not null and rater is not null")
    votes = labels.groupBy("doc_id", "label").count()
    agreed = votes.groupBy("doc_id").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"))
    found = labels.select("doc_id", "label", "rater").distinct()
    expected = labels.select("doc_id", "rater").distinct().join(agreed, "doc_id").select("doc_id", "label", "rater")
    return passes(quality(expected, found, ["doc_id", "label"], "rater"))


QUERIES = {"benchmark_aggregate": benchmark_aggregate, "baseline_compare": baseline_compare, "rater_quality": rater_quality}
ORACLES = {
    "benchmark_aggregate": "select event_type, strftime(ts, '%Y-%m-%d') as run, median(value) as median, avg(value) as mean, min(value) as least, max(value) as greatest, count(value) as samples from events where value is not null group by all",
    "baseline_compare": """with a as (select event_type, median(value) as v from events where day(ts) <= 15 group by 1), b as (select event_type, median(value) as v from events where day(ts) > 15 group by 1)
select event_type, a.v as baseline, b.v as "current", b.v - a.v as delta, case when a.v <> 0 then (b.v - a.v) / a.v end as fraction from a full join b using (event_type)""",
    "rater_quality": """with l as (select doc_id, label, rater from doc_labels where label is not null and rater is not null),
v as (select doc_id, label, count(*) as n from l group by all),
m as (select doc_id, label from (select *, row_number() over (partition by doc_id order by n desc, label) as rn from v) where rn = 1),
e as (select distinct l.doc_id, m.label, l.rater, 1 as e from l join m using (doc_id)), f as (select distinct doc_id, label, rater, 1 as f from l),
c as (select rater, count(*) filter (e is not null and f is not null) as tp, count(*) filter (e is null) as fp, count(*) filter (f is null) as fn from e full join f using (doc_id, label, rater) group by rater),
q as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall, case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from c)
select *, precision >= 0.8 and recall >= 0.8 and f1 >= 0.8 and fp <= 10 as passed from q""",
}
