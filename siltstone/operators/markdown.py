"""Documents and prompts as Markdown: sections, fences, checkboxes, references, front matter.

Everything is a Column expression over whole texts; fences are paired by a running count over the
lines of one text, inside its row.  Null texts give null or empty results, never failures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dialect import java, re2, quote
from siltstone.operators.versions import latest
from siltstone.plans import scan

_B = "\\"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def sections(text: Column) -> Column:
    """Titles of the second level."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^##[ \t]+([^\r\n]+)"), 1)


def fences(text: Column) -> Column:
    """Array of (line, language, code, lines) of the fenced blocks; an open block ends with the text."""
    rows = F.split(text, "\n", -1)
    start = F.struct(
        F.lit(False).alias("open"),
        F.lit(0).alias("line"),
        F.lit("").alias("language"),
        F.array().cast("array<string>").alias("code"),
        F.array().cast("array<struct<line:int,language:string,code:string>>").alias("done"),
    )

    def block(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["line"].alias("line"), s["language"].alias("language"), F.array_join(s["code"], "\n").alias("code"))))

    def step(s: Column, x: Column) -> Column:
        line, value = x["i"], x["t"]
        fence = F.trim(value).startswith("```")
        keep = lambda name: s[name].alias(name)
        opened = F.struct(
            F.lit(True).alias("open"), line.alias("line"), F.lower(F.regexp_extract(value, r"```\s*([\w+#.-]*)", 1)).alias("language"),
            F.array().cast("array<string>").alias("code"), keep("done"),
        )
        closed = F.struct(
            F.lit(False).alias("open"), keep("line"), keep("language"), F.array().cast("array<string>").alias("code"), block(s).alias("done")
        )
        added = F.struct(keep("open"), keep("line"), keep("language"), F.concat(s["code"], F.array(value)).alias("code"), keep("done"))
        return F.when(fence & ~s["open"], opened).when(fence, closed).when(s["open"], added).otherwise(s)

    numbered = F.transform(rows, lambda t, i: F.struct((i + 1).cast("int").alias("i"), t.alias("t")))
    return F.aggregate(numbered, start, step, lambda s: F.when(s["open"], block(s)).otherwise(s["done"]))


def file_references(text: Column) -> Column:
    """Distinct targets of links and quoted paths, without web addresses, anchors and mail."""
    links = F.transform(
        F.filter(
            F.regexp_extract_all(text, F.lit(r"\[[^\]\[]*\]\(([^)]{0,500})\)"), 1),
            lambda h: ~(h.startswith("http") | h.startswith("#") | h.startswith("mailto:")),
        ),
        lambda h: F.element_at(F.split(h, "#"), 1),
    )
    quoted = F.filter(
        F.regexp_extract_all(text, F.lit(r"`([^`]+)`"), 1),
        lambda p: (p.contains(".") | p.contains("/")) & ~p.contains(" ") & ~p.startswith("$"),
    )
    return F.array_distinct(F.concat(links, quoted))


def front_matter(content: Column) -> Column:
    """Map of key to list of values of the block between the opening ``---`` lines; null without one."""
    body = F.regexp_extract(F.regexp_replace(content, "\r\n", "\n"), r"^---\n([\s\S]*?)\n---(?:\n|\z)", 1)
    entries = F.regexp_extract_all(body, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*([^\n]*(?:\n[ \t]+-[ \t]+[^\n]*)*)"), 0)
    pair = lambda e: F.struct(
        F.regexp_extract(e, r"^([\w-]+):", 1).alias("key"),
        F.when(
            F.regexp_extract(e, r"^[\w-]+:[ \t]*([^\n]*)", 1) != "",
            F.array(F.trim(F.regexp_extract(e, r"^[\w-]+:[ \t]*([^\n]*)", 1))),
        )
        .otherwise(F.transform(F.regexp_extract_all(e, F.lit(r"(?m)^[ \t]+-[ \t]+([^\n]*)"), 1), F.trim))
        .alias("value"),
    )
    return F.when(body != "", F.map_from_entries(F.array_distinct(F.transform(entries, pair))))


def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, flags, fences, checkboxes, words and estimated tokens of each document."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text")
    t = text_of()
    titles = F.lower(F.array_join(F.slice(sections(t), 1, 10), " "))
    return d.select(
        "doc_id",
        F.size(sections(t)).alias("sections"),
        titles.rlike("install|setup|getting.started").alias("has_installation"),
        titles.rlike("usage|how.to|example").alias("has_usage"),
        titles.rlike("api|reference|methods").alias("has_api"),
        titles.rlike("test|spec|coverage").alias("has_testing"),
        F.floor(F.regexp_count(t, F.lit("```")) / 2).alias("code_blocks"),
        F.regexp_count(t, F.lit(r"(?im)^[-*][ \t]+\[x\]")).alias("checked"),
        F.regexp_count(t, F.lit(r"(?im)^[-*][ \t]+\[[ \t]\]")).alias("unchecked"),
        F.size(F.split(t, java(r"\s+"), -1)).alias("words"),
        F.size(F.split(t, "\n", -1)).alias("lines"),
        F.length(t).alias("chars"),
        F.ceil(F.length(t) / 4).alias("tokens"),
    )


def listed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries of 6 to 79 characters, how often and in how many documents they occur (more than once)."""
    d = scan(spark, sf_dir, "documents", "doc_id", "text")
    entries = F.regexp_extract_all(text_of(), F.lit(r"(?m)^[-*][ \t]+([^\r\n]+)"), 1)
    each = d.select("doc_id", F.explode(entries).alias("e")).select("doc_id", F.trim("e").alias("feature"))
    kept = each.where(F.length("feature").between(6, 79))
    counted = kept.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
    return counted.where("n > 1")


def planned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TODO, FIXME and PLAN notes of the files, cut at 100 characters, by kind."""
    from siltstone.sources.repository import files

    f = files(spark, sf_dir)
    notes = F.regexp_extract_all(text_of("content"), F.lit(r"(?i)((?:TODO|FIXME|PLAN):?[ \t]+[^\r\n]+)"), 1)
    each = f.select("file_id", F.explode(notes).alias("note"))
    return each.select("file_id", F.upper(F.regexp_extract("note", r"^(\w+)", 1)).alias("kind"), F.substring("note", 1, 100).alias("note"))


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced blocks of the skills: where they begin, their language and their size."""
    s = latest(scan(spark, sf_dir, "skills", "prompt_id", "ingested_at", "body"), "prompt_id", "ingested_at", "body")
    each = s.select("prompt_id", F.posexplode(fences(text_of("body"))).alias("block", "b"))
    return each.select("prompt_id", "block", "b.line", "b.language", F.length("b.code").alias("chars"))


def block_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fence marks and their languages over all skills."""
    s = latest(scan(spark, sf_dir, "skills", "prompt_id", "ingested_at", "body"), "prompt_id", "ingested_at", "body")
    marks = F.regexp_extract_all(text_of("body"), F.lit(r"(?m)^[ \t]*```([\w+#.-]*)"), 1)
    return s.select("prompt_id", F.explode(marks).alias("mark")).groupBy(F.lower("mark").alias("mark")).agg(
        F.count("*").alias("n"), F.countDistinct("prompt_id").alias("prompts")
    )


def prompt_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that skills refer to, with the number of skills that do (at least two)."""
    s = latest(scan(spark, sf_dir, "skills", "prompt_id", "ingested_at", "body"), "prompt_id", "ingested_at", "body")
    quoted = F.filter(
        F.regexp_extract_all(text_of("body"), F.lit(r"`([^`\n]+)`"), 1),
        lambda p: (p.contains(".") | p.contains("/")) & ~p.contains(" ") & ~p.startswith("$"),
    )
    each = s.select("prompt_id", F.explode(F.array_distinct(quoted)).alias("reference"))
    return each.groupBy("reference").agg(F.count("*").alias("prompts")).where("prompts > 1")


def parsed_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front matter parsed from ``content``: keys per agent and skill, as one row per key."""
    both = scan(spark, sf_dir, "agents", "prompt_id", "ingested_at", "content").unionByName(
        scan(spark, sf_dir, "skills", "prompt_id", "ingested_at", "content")
    )
    one = latest(both, "prompt_id", "ingested_at", "content").select("prompt_id", front_matter(F.col("content")).alias("m"))
    return one.select("prompt_id", F.explode("m").alias("key", "values")).select("prompt_id", "key", F.size("values").alias("n_values"))


def token_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters, lines, words and estimated tokens per plugin of the agents, heaviest first."""
    a = latest(scan(spark, sf_dir, "agents", "prompt_id", "ingested_at", "plugin", "body"), "prompt_id", "ingested_at", "body")
    t = text_of("body")
    return a.groupBy("plugin").agg(
        F.count("*").alias("agents"),
        F.sum(F.length(t)).alias("chars"),
        F.sum(F.size(F.split(t, "\n", -1))).alias("lines"),
        F.sum(F.ceil(F.length(t) / 4)).alias("tokens"),
    )


_SPACES = re2(r"\s+")
_SKILLS = "s as (select * exclude (rn) from (select *, row_number() over (partition by prompt_id order by ingested_at desc) as rn from skills) where rn = 1)"
QUERIES = {
    "document_structure": document_structure,
    "listed_features": listed_features,
    "planned_items": planned_items,
    "prompt_blocks": prompt_blocks,
    "block_languages": block_languages,
    "prompt_references": prompt_references,
    "parsed_front_matter": parsed_front_matter,
    "token_metrics": token_metrics,
}
ORACLES = {
    "document_structure": rf"""with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '(?m)^##[ \t]+([^\r\n]+)', 1) as s from documents),
e as (select *, lower(array_to_string(list_slice(s, 1, 10), ' ')) as h from d)
select doc_id, len(s)::int as sections, regexp_matches(h, 'install|setup|getting.started') as has_installation, regexp_matches(h, 'usage|how.to|example') as has_usage,
regexp_matches(h, 'api|reference|methods') as has_api, regexp_matches(h, 'test|spec|coverage') as has_testing,
floor(len(regexp_extract_all(t, '```')) / 2)::bigint as code_blocks, len(regexp_extract_all(t, '(?im)^[-*][ \t]+\[x\]'))::int as checked,
len(regexp_extract_all(t, '(?im)^[-*][ \t]+\[[ \t]\]'))::int as unchecked, len(regexp_split_to_array(t, {quote(_SPACES)}))::int as words,
len(string_split(t, chr(10)))::int as lines, length(t)::int as chars, ceil(length(t) / 4)::bigint as tokens from e""",
    "listed_features": r"""with e as (select doc_id, trim(unnest(regexp_extract_all(text, '(?m)^[-*][ \t]+([^\r\n]+)', 1))) as feature from documents)
select feature, count(*) as n, count(distinct doc_id) as documents from e where length(feature) between 6 and 79 group by feature having count(*) > 1""",
    "planned_items": r"""with f as (select distinct on (file_id) file_id, content from files order by file_id, ingested_at desc),
e as (select file_id, unnest(regexp_extract_all(content, '(?i)((?:TODO|FIXME|PLAN):?[ \t]+[^\r\n]+)', 1)) as note from f)
select file_id, upper(regexp_extract(note, '^(\w+)', 1)) as kind, substring(note, 1, 100) as note from e""",
    "block_languages": rf"""with {_SKILLS}, e as (select prompt_id, lower(unnest(regexp_extract_all(body, '(?m)^[ \t]*```([\w+#.-]*)', 1))) as mark from s)
select mark, count(*) as n, count(distinct prompt_id) as prompts from e group by mark""",
    "prompt_references": rf"""with {_SKILLS}, e as (select prompt_id, unnest(list_distinct(regexp_extract_all(body, '`([^`\n]+)`', 1))) as reference from s)
select reference, count(*) as prompts from e where (contains(reference, '.') or contains(reference, '/')) and not contains(reference, ' ') and not starts_with(reference, '$')
group by reference having count(*) > 1""",
    "token_metrics": """with a as (select distinct on (prompt_id) prompt_id, plugin, coalesce(body, '') as t from agents order by prompt_id, ingested_at desc)
select plugin, count(*) as agents, sum(length(t))::bigint as chars, sum(len(string_split(t, chr(10))))::bigint as lines, sum(ceil(length(t) / 4))::bigint as tokens from a group by plugin""",
}
