"""Project-level checks: over-engineering, claims and their evidence, framework and health facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dialect import java, quote, re2
from siltstone.plans import scan
from siltstone.sources.repository import LANGUAGE_SQL, LATEST_FILES, files, is_test, language

#: Words of each kind of claim, in catalogue order.
CLAIMS = {
    "production": ("production-ready", "production-grade", "prod-ready"),
    "enterprise": ("enterprise-grade", "enterprise-ready", "enterprise-class"),
    "security": ("secure", "secure by default", "security-focused"),
    "scale": ("scalable", "high-performance", "performant", "highly scalable"),
    "reliability": ("battle-tested", "robust", "reliable", "rock-solid"),
    "completeness": ("comprehensive", "complete", "full-featured", "feature-complete"),
}
CLAIMING = r"\b(?:is|are|provides?|offers?|features?|fully|100%|designed\s+(?:for|to\s+be))\s+"
NOT_CLAIMING = r"\b(?:TODO|FIXME|should\s+be|will\s+be|make\s+(?:it\s+(?:more|less|better)|this)|needs?\s+to\s+be|plan(?:ning)?\s+to|wants?\s+to)\b"
EVIDENCE = {
    "production": r"try\s*\{|catch\s*\(|\.catch\s*\(|except\s*:|logger\.|console\.error",
    "enterprise": r"(?i)authenticat|permission|rbac|audit|rate.?limit|throttle",
    "security": r"(?i)validat|sanitiz|escape|jwt|encrypt|hash|bcrypt",
    "scale": r"async\s+|await\s+|Promise|redis|memcache|pool",
    "reliability": r"(?i)coverage|try\s*\{|catch\s*\(|except\s*:",
    "completeness": r"(?i)edge.?case|boundary|corner.?case|/\*\*",
}
_WORDS = "|".join(w for ws in CLAIMS.values() for w in sorted(ws, key=len, reverse=True))


def _words_of(category: str) -> str:
    return rf"\b(?:{'|'.join(sorted(CLAIMS[category], key=len, reverse=True))})\b"


#: What counts as an export, per language (without lookahead, for both engines).
EXPORTS = {
    "js": r"export\s+(?:function|class|const|let|var|default|async\s+function)|export\s*\{[^}]+\}|module\.exports\s*=|exports\.\w+\s*=",
    "rust": r"(?m)^pub\s+(?:fn|struct|enum|mod|type|trait|const|static)",
    "go": r"(?m)^func\s+[A-Z]|^type\s+[A-Z]\w*\s+(?:struct|interface)|^var\s+[A-Z]|^const\s+[A-Z]",
    "python": r"(?m)^def\s+[A-Za-z]\w*\s*\(|^class\s+[A-Z]\w*[\s:(]|__all__\s*=\s*\[",
    "java": r"(?m)^\s*public\s+(?:static\s+)?(?:final\s+)?(?:class|interface|enum)\s+\w+",
}


def over_engineering(spark: SparkSession, sf_dir: str, most_files: int = 20, most_lines: int = 500, most_depth: int = 4) -> DataFrame:
    """Per repository: files and lines per export and depth of folders, against their thresholds."""
    f = files(spark, sf_dir).where("content <> ''").withColumn("lang", language(F.col("path")))
    count = F.lit(0)
    for lang, pattern in EXPORTS.items():
        count = F.when(F.col("lang") == lang, F.regexp_count("content", F.lit(pattern))).otherwise(count)
    per = f.where(~is_test(F.col("path"))).groupBy("repo").agg(
        F.count("*").alias("files"),
        F.sum(F.size(F.split("content", "\n", -1))).alias("lines"),
        F.greatest(F.sum(count), F.lit(1)).alias("exports"),
        F.max(F.size(F.split("path", "/")) - 1).alias("depth"),
    )
    a, b = F.col("files") / F.col("exports"), F.col("lines") / F.col("exports")
    flags = (a > most_files).cast("int") + (b > most_lines).cast("int") + (F.col("depth") > most_depth).cast("int")
    high = (a > 2 * most_files) | (b > 2 * most_lines) | (F.col("depth") > most_depth + 2)
    return per.select(
        "repo", "files", "lines", "exports", "depth", a.alias("files_per_export"), b.alias("lines_per_export"),
        F.when(high, "high").when(flags > 0, "medium").otherwise("ok").alias("verdict"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category of claim: lines with such a word, the words in them, lines that state it as a fact, and documents.

    A line takes part in every category that it has a word of; words of one category count once
    per place, the longest first.
    """
    d = scan(spark, sf_dir, "documents", "doc_id", "repo", "text")
    line = d.select("doc_id", "repo", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    count = lambda c: F.regexp_count("line", F.lit(java(_words_of(c), True)))
    hits = F.filter(F.array(*(F.struct(F.lit(c).alias("category"), count(c).alias("n")) for c in CLAIMS)), lambda x: x["n"] > 0)
    positive = F.col("line").rlike(java(CLAIMING, True)) & ~F.col("line").rlike(java(NOT_CLAIMING, True))
    claiming = line.where(F.col("line").rlike(java(rf"\b(?:{_WORDS})\b", True)))
    each = claiming.select("doc_id", positive.alias("positive"), F.explode(hits).alias("x"))
    return each.groupBy("x.category").agg(
        F.count("*").alias("lines"), F.sum("x.n").alias("words"), F.count_if("positive").alias("positive"), F.countDistinct("doc_id").alias("documents")
    )


def claim_gaps(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Repositories whose documents claim what fewer than ``least`` of their files give evidence of."""
    d = scan(spark, sf_dir, "documents", "repo", "text").where("repo is not null")
    line = d.select("repo", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    line = line.where(F.col("line").rlike(java(CLAIMING, True)) & ~F.col("line").rlike(java(NOT_CLAIMING, True)))
    hit = F.array_compact(F.array(*(F.when(F.col("line").rlike(java(rf"\b(?:{'|'.join(w)})\b", True)), F.lit(c)) for c, w in CLAIMS.items())))
    made = line.select("repo", F.explode(hit).alias("category")).groupBy("repo", "category").agg(F.count("*").alias("claims"))
    proof = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), F.lit(c)) for c, p in EVIDENCE.items())))
    shown = files(spark, sf_dir).where("content <> ''").select("repo", F.explode(proof).alias("category")).groupBy("repo", "category").agg(F.count("*").alias("evidence"))
    both = made.join(shown, ["repo", "category"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))
    return both.where(F.col("evidence") < least).withColumn("severity", F.when(F.col("evidence") == 0, "high").otherwise("medium"))


def repository_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each repository has: tests, configuration, scripts, and its most frequent language."""
    f = files(spark, sf_dir)
    lang = f.groupBy("repo", language(F.col("path")).alias("lang")).agg(F.count("*").alias("n"))
    main = lang.groupBy("repo").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("main_lang"))
    facts = f.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.count_if(is_test(F.col("path"))).alias("tests"),
        F.bool_or(F.col("path").rlike(r"\.(ya?ml|toml|json)$")).alias("has_config"),
        F.bool_or(F.col("path").rlike(r"\.(sh|bash)$")).alias("has_scripts"),
        F.count("error").alias("unreadable"),
    )
    return facts.join(main, "repo")


_EACH = " union all ".join(f"select '{c}' as category, doc_id, line, len(regexp_extract_all(line, {quote(re2(_words_of(c), True))})) as n from l" for c in CLAIMS)
_COUNT = " ".join(f"when '{k}' then len(regexp_extract_all(content, {quote(v)}))" for k, v in EXPORTS.items())
_IS_TEST = "(regexp_matches(path, '\\.test\\.[jt]sx?$') or regexp_matches(path, '\\.spec\\.[jt]sx?$') or regexp_matches(path, '_tests?\\.(go|rs|py)$') or regexp_matches(path, 'test_.*\\.py$') or regexp_matches(path, '__tests__') or regexp_matches(path, '(?i)tests?/'))"
QUERIES = {"over_engineering": over_engineering, "claims": claims, "claim_gaps": claim_gaps, "repository_health": repository_health}
ORACLES = {
    "over_engineering": f"""with {LATEST_FILES}, f as (select *, {LANGUAGE_SQL} as lang from latest_files where content <> '' and not {_IS_TEST}),
p as (select repo, count(*) as files, sum(len(string_split(content, chr(10))))::bigint as lines, greatest(sum(case lang {_COUNT} end), 1)::bigint as exports, max(len(string_split(path, '/')) - 1)::int as depth from f group by repo)
select *, files / exports as files_per_export, lines / exports as lines_per_export, case when files / exports > 40 or lines / exports > 1000 or depth > 6 then 'high' when files / exports > 20 or lines / exports > 500 or depth > 4 then 'medium' else 'ok' end as verdict from p""",
    "claims": f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents), e as ({_EACH})
select category, count(*) as lines, sum(n)::bigint as words, count(*) filter (regexp_matches(line, {quote(re2(CLAIMING, True))}) and not regexp_matches(line, {quote(re2(NOT_CLAIMING, True))})) as positive, count(distinct doc_id) as documents
from e where n > 0 group by category""",
    "repository_health": f"""with {LATEST_FILES}, n as (select repo, {LANGUAGE_SQL} as lang, count(*) as n from latest_files group by all),
m as (select repo, lang as main_lang from (select *, row_number() over (partition by repo order by n desc, lang) as rn from n) where rn = 1)
select repo, count(*) as files, count(*) filter ({_IS_TEST}) as tests, bool_or(regexp_matches(path, '\\.(ya?ml|toml|json)$')) as has_config, bool_or(regexp_matches(path, '\\.(sh|bash)$')) as has_scripts, count(error) as unreadable, any_value(main_lang) as main_lang
from latest_files join m using (repo) group by repo""",
}
