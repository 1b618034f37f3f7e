"""Suppression of findings: inline notes, configuration, learned entries, and severity overrides."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dialect import quote
from siltstone.operators.hygiene import _FOUND, active, line_hits
from siltstone.plans import spread
from siltstone.sources.repository import files

INLINE = r"(?:<!--|//|#)[ \t]*enhance:ignore[ \t]+([\w-]+)"


def path_glob(pattern: str) -> str:
    """``**`` crosses folders, ``*`` does not; anchored at both ends."""
    parts = re.split(r"(\*\*|\*)", pattern)
    return "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p).replace("/", "/") for p in parts if p) + "$"


@dataclass(frozen=True)
class Config:
    """What a project suppresses; every field may be empty."""

    patterns: tuple[str, ...] = ()
    rules_off: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    severity: dict[str, str] = field(default_factory=dict)
    rule_severity: dict[str, str] = field(default_factory=dict)


def reason(config: Config, rule: Column, path: Column, inline: Column, learned: Column) -> Column:
    """Why a finding is suppressed: inline, then patterns, rules, file globs, learned; null if it is not."""
    no = F.lit(False)
    in_globs = path.rlike("|".join(map(path_glob, config.globs))) if config.globs else no
    return (
        F.when(F.array_contains(inline, F.lower(rule)), "inline")
        .when(rule.isin(*config.patterns) if config.patterns else no, "pattern")
        .when(rule.isin(*config.rules_off) if config.rules_off else no, "rule")
        .when(in_globs, "file")
        .when(learned, "learned")
    )


def split_findings(findings: DataFrame, source: DataFrame, config: Config, learned: DataFrame | None = None) -> DataFrame:
    """Findings with ``suppressed_by`` (null for active ones) and the severity after overrides.

    ``learned(rule, path)`` are entries of earlier runs.  Inline notes count for their whole file;
    only files that have one are joined.
    """
    notes = F.transform(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(INLINE), 1), F.lower)
    inline = source.where(F.col("content").rlike("enhance:ignore")).select("file_id", F.array_distinct(notes).alias("inline"))
    with_notes = findings.join(inline, "file_id", "left").withColumn("inline", F.coalesce("inline", F.array().cast("array<string>")))
    if learned is None:
        with_notes = with_notes.withColumn("learned", F.lit(False))
    else:
        with_notes = with_notes.join(learned.select("rule", "path").distinct().withColumn("learned", F.lit(True)), ["rule", "path"], "left")
        with_notes = with_notes.withColumn("learned", F.coalesce("learned", F.lit(False)))
    severity = F.col("severity")
    for mapping, key in ((config.severity, severity), (config.rule_severity, F.col("rule"))):
        for k, v in mapping.items():
            severity = F.when(key == k, v).otherwise(severity)
    return with_notes.select(
        "file_id", "path", "rule", "line", severity.alias("severity"), reason(config, F.col("rule"), F.col("path"), F.col("inline"), F.col("learned")).alias("suppressed_by")
    )


def learn(findings: DataFrame, confidence: float = 0.9, least: int = 3) -> DataFrame:
    """Rules that mostly hit tests or fixtures: (rule, findings, confidence, files, at most 50 named)."""
    doubtful = F.col("path").rlike(r"(?i)(^|/)(tests?|fixtures?|mocks?|examples?)/|[._-]test[._-]|test_")
    per = findings.groupBy("rule").agg(
        F.count("*").alias("findings"), F.avg(doubtful.cast("double")).alias("confidence"), F.countDistinct(F.when(doubtful, F.col("path"))).alias("files")
    )
    return per.where((F.col("confidence") >= confidence) & (F.col("findings") >= least))


EXAMPLE = Config(
    patterns=("old_todos",), rules_off=("mixed_indentation",), globs=("tests/**", "**/*.json"), severity={"low": "medium"}, rule_severity={"aws_credentials": "high"}
)


def suppression_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per rule and reason of suppression, under an example configuration."""
    f = spread(files(spark, sf_dir).select("file_id", "path", "content"))
    split = split_findings(line_hits(f, active()), f, EXAMPLE)
    return split.groupBy("rule", "severity", F.coalesce("suppressed_by", F.lit("active")).alias("state")).agg(F.count("*").alias("n"))


def doubtful_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each rule's findings that lie in tests and the like, as the learner sees it."""
    return learn(line_hits(spread(files(spark, sf_dir).select("file_id", "path", "content")), active()), confidence=0.0, least=1)


_GLOBS = "|".join(map(path_glob, EXAMPLE.globs))
QUERIES = {"suppression_split": suppression_split, "doubtful_rules": doubtful_rules}
ORACLES = {
    "suppression_split": _FOUND
    + f"""select rule, case when rule = 'aws_credentials' then 'high' when severity = 'low' then 'medium' else severity end as severity,
case when rule = 'old_todos' then 'pattern' when rule = 'mixed_indentation' then 'rule' when regexp_matches(path, {quote(_GLOBS)}) then 'file' else 'active' end as state, count(*) as n
from findings group by all""",
    "doubtful_rules": _FOUND
    + """, d as (select rule, path, regexp_matches(path, '(?i)(^|/)(tests?|fixtures?|mocks?|examples?)/|[._-]test[._-]|test_') as t from findings)
select rule, count(*) as findings, avg(t::int) as confidence, count(distinct case when t then path end) as files from d group by rule""",
}
