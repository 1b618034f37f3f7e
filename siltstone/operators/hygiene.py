"""The hygiene scan: rules over lines, runs of lines, and what is reported about findings.

A file is first asked, as a whole, which rules can match anywhere in it; only then are its lines
tested, and only against those.  Everything stays in Catalyst: one scan, no shuffle until the
findings are aggregated.

Null and empty files have no findings; of the rows of one file the latest counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.dialect import globs, java, quote, re2
from siltstone.functions.rules import ALWAYS_EXCLUDED, HINTS, RULES, SECRET_CANDIDATE, SECRET_REJECTED, SEVERITIES, WITHOUT_LOOKAHEAD, Rule
from siltstone.plans import spread
from siltstone.sources.repository import EXCLUDED_SQL, LANGUAGE_SQL, LATEST_FILES, TEST_SQL, extension, files, in_excluded_dir, is_test, language, lines

_FAMILY = {"javascript": "js", None: None}


def active(runs: bool = False) -> list[Rule]:
    """Rules that one line can decide (or, with ``runs``, those that need several in a row).

    ``multiple_blank_lines`` asks for line ends within a line, so no line can match it.
    """
    return [r for r in RULES if r.name != "multiple_blank_lines" and r.pattern and not r.multi_pass and (r.run > 0) == runs]


def _gate(rule: Rule):
    """May the rule apply to a file of this path, language and content?"""
    gate = F.col("content").rlike(java(rule.pattern, rule.ignore_case, multiline=True))
    if rule.name in HINTS:
        hinted = F.lit(False)
        for hint in HINTS[rule.name]:
            hinted = hinted | F.contains(F.col("low"), F.lit(hint))
        gate = hinted & gate
    if rule.language:
        gate = (F.col("lang") == _FAMILY.get(rule.language, rule.language)) & gate
    if rule.exclude:
        gate = ~F.col("path").rlike(globs(rule.exclude)) & gate
    return gate


def line_hits(source: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file_id, path, rule, line, content) of every line that a rule matches; rule by number."""
    numbers = {r.name: i for i, r in enumerate(RULES)}
    base = source.where(F.col("content").isNotNull() & (F.col("content") != "") & ~F.col("path").rlike(globs(ALWAYS_EXCLUDED)))
    base = base.select("file_id", "path", "content", language(F.col("path")).alias("lang"), F.lower("content").alias("low"))
    split = base.select("*", lines(F.col("content")).alias("lines"))
    none = F.array().cast("array<struct<rule:int,line:int,text:string>>")

    def matched(rule: Rule):
        regex, number = java(rule.pattern, rule.ignore_case), F.lit(numbers[rule.name])
        hit = F.transform(
            F.filter("lines", lambda x: x["text"].rlike(regex)),
            lambda x: F.struct(number.alias("rule"), x["line"].alias("line"), x["text"].alias("text")),
        )
        return F.when(_gate(rule), hit).otherwise(none)

    hits = F.flatten(F.array(*map(matched, rules)))
    found = split.select("file_id", "path", F.explode(hits).alias("h"))
    names = F.array(*(F.lit(r.name) for r in RULES))
    severities = F.array(*(F.lit(r.severity) for r in RULES))
    fixes = F.array(*(F.lit(r.fix) for r in RULES))
    at = F.col("h.rule") + 1
    text = F.regexp_replace(F.regexp_replace("h.text", java(r"^\s+"), ""), java(r"\s+$"), "")
    return found.select(
        "file_id",
        "path",
        F.element_at(names, at).alias("rule"),
        F.col("h.line").cast("int").alias("line"),
        F.element_at(severities, at).alias("severity"),
        F.element_at(fixes, at).alias("fix"),
        F.lit("HIGH").alias("certainty"),
        F.substring(text, 1, 100).alias("text"),
    )


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every file that a rule of the core pack matches."""
    return line_hits(spread(files(spark, sf_dir).select("file_id", "path", "content")), active())


def finding_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal blocks of consecutive lines that match a rule for runs, of at least its length."""
    rules = active(runs=True)
    hits = line_hits(spread(files(spark, sf_dir).select("file_id", "path", "content")), rules)
    least = F.array(*(F.lit(r.run) for r in rules))
    order = Window.partitionBy("file_id", "rule").orderBy("line")
    island = hits.withColumn("island", F.col("line") - F.row_number().over(order))
    need = F.element_at(least, F.array_position(F.array(*(F.lit(r.name) for r in rules)), F.col("rule")).cast("int"))
    return (
        island.groupBy("file_id", "path", "rule", "severity", "island")
        .agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("line_count"))
        .where(F.col("line_count") >= need)
        .drop("island")
    )


def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity, by certainty, by fix, by rule and in all; known severities are zero-filled."""
    found = scan_findings(spark, sf_dir).select("severity", "certainty", "fix", "rule")
    sets = found.groupingSets([[], ["severity"], ["certainty"], ["fix"], ["rule"]], "severity", "certainty", "fix", "rule").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    names = F.create_map(*(F.lit(x) for kv in ((15, "total"), (7, "severity"), (11, "certainty"), (13, "fix"), (14, "rule")) for x in kv))
    kept = sets.where(F.col("g").isin(15, 7, 11, 13, 14)).select(
        names[F.col("g").cast("int")].alias("dimension"),
        F.coalesce("severity", "certainty", "fix", "rule", F.lit("all")).alias("value"),
        F.col("n"),
    )
    zero = spark.createDataFrame([("severity", s, 0) for s in SEVERITIES], "dimension string, value string, n bigint")
    return kept.unionByName(zero).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def finding_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with the gravest findings: score 8, 4, 2, 1 by severity, ranked, ties by path."""
    weight = F.when(F.col("severity") == "critical", 8).when(F.col("severity") == "high", 4).when(F.col("severity") == "medium", 2).otherwise(1)
    scored = scan_findings(spark, sf_dir).groupBy("file_id", "path").agg(F.sum(weight).alias("score"), F.count("*").alias("findings"))
    return scored.orderBy(F.desc("score"), "path", "file_id").limit(100)


def finding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one line and text count once; their rules are listed as sources."""
    found = scan_findings(spark, sf_dir)
    key = F.lower(F.trim("text"))
    return (
        found.groupBy("file_id", "line", key.alias("issue"))
        .agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("sources"), F.bool_or(F.col("fix") == "remove").alias("auto_fixable"))
    )


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, regular expressions and multi-pass rules per language."""
    rows = [(r.language or "universal", r.severity, r.pattern is not None, r.multi_pass) for r in RULES]
    df = spark.createDataFrame(rows, "language string, severity string, has_pattern boolean, multi_pass boolean")
    return df.groupBy("language").agg(
        F.count("*").alias("rules"), F.count_if("has_pattern").alias("patterns"), F.count_if("multi_pass").alias("multi_pass")
    )


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files per language, extension, and whether they are tests or in excluded directories."""
    f = files(spark, sf_dir)
    return f.groupBy(
        language(F.col("path")).alias("lang"),
        extension(F.col("path")).alias("ext"),
        is_test(F.col("path")).alias("is_test"),
        in_excluded_dir(F.col("path")).alias("excluded"),
    ).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def _line_sql(rules: list[Rule]) -> str:
    arms = []
    for r in rules:
        if r.name == "hardcoded_secrets":
            test = f"len(list_filter(regexp_extract_all(text, {quote(re2(SECRET_CANDIDATE, True))}, 1), lambda v: not regexp_matches(v, {quote(re2(SECRET_REJECTED, True))}))) > 0"
        else:
            test = f"regexp_matches(text, {quote(re2(WITHOUT_LOOKAHEAD.get(r.name, r.pattern), r.ignore_case))})"
        where = [test]
        if r.language:
            where.append(f"lang = '{_FAMILY.get(r.language, r.language)}'")
        if r.exclude:
            where.append(f"not regexp_matches(path, {quote(globs(r.exclude))})")
        arms.append(
            f"select file_id, path, '{r.name}' as rule, line, '{r.severity}' as severity, '{r.fix}' as fix, text from l where {' and '.join(where)}"
        )
    trim = f"regexp_replace(regexp_replace(text, {quote(re2('^' + chr(92) + 's+'))}, ''), {quote(re2(chr(92) + 's+$'))}, '')"
    return f"""with {LATEST_FILES},
l as (select file_id, path, {LANGUAGE_SQL} as lang, unnest(string_split(content, chr(10))) as text,
        generate_subscripts(string_split(content, chr(10)), 1)::int as line
      from latest_files where content <> '' and not regexp_matches(path, {quote(globs(ALWAYS_EXCLUDED))})),
findings as (select file_id, path, rule, line, severity, fix, 'HIGH' as certainty, substring({trim}, 1, 100) as text
      from ({' union all '.join(arms)}))
"""


_FOUND = _line_sql(active())
QUERIES = {
    "scan_findings": scan_findings,
    "finding_runs": finding_runs,
    "finding_summary": finding_summary,
    "finding_rank": finding_rank,
    "finding_dedup": finding_dedup,
    "rule_catalog": rule_catalog,
    "file_kinds": file_kinds,
}
ORACLES = {
    "scan_findings": _FOUND + "select * from findings",
    "finding_runs": _line_sql(active(runs=True))
    + """select file_id, path, rule, severity, min(line) as start_line, max(line) as end_line, count(*) as line_count
from (select *, line - row_number() over (partition by file_id, rule order by line) as island from findings)
group by file_id, path, rule, severity, island having count(*) >= 5""",
    "finding_summary": _FOUND
    + f"""select dimension, value, sum(n)::bigint as n from (
  select 'severity' as dimension, severity as value, count(*) as n from findings group by severity
  union all select 'certainty', certainty, count(*) from findings group by certainty
  union all select 'fix', fix, count(*) from findings group by fix
  union all select 'rule', rule, count(*) from findings group by rule
  union all select 'total', 'all', count(*) from findings
  union all select 'severity', unnest({list(SEVERITIES)}), 0) group by dimension, value""",
    "finding_rank": _FOUND
    + """select file_id, path, sum(case severity when 'critical' then 8 when 'high' then 4 when 'medium' then 2 else 1 end)::bigint as score,
count(*) as findings from findings group by file_id, path order by score desc, path, file_id limit 100""",
    "finding_dedup": _FOUND
    + """select file_id, line, lower(trim(text)) as issue, array_to_string(list_sort(list(distinct rule)), ',') as sources,
bool_or(fix = 'remove') as auto_fixable from findings group by file_id, line, lower(trim(text))""",
    "rule_catalog": "select language, count(*) as rules, count(*) filter (p) as patterns, count(*) filter (m) as multi_pass from (values "
    + ", ".join(f"('{r.language or 'universal'}', {str(r.pattern is not None).lower()}, {str(r.multi_pass).lower()})" for r in RULES)
    + ") t(language, p, m) group by language",
    "file_kinds": f"""with {LATEST_FILES}
select {LANGUAGE_SQL} as lang, lower(regexp_extract(path, '\\.([^./]*)$', 1)) as ext, {TEST_SQL} as is_test, {EXCLUDED_SQL} as excluded,
count(*) as files, sum(size)::bigint as bytes from latest_files group by all""",
}
