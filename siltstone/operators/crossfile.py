"""Consistency of prompts across files: tools, instructions, references.

Of the rows of one prompt the latest counts; null bodies, plugins and front matter take part in
nothing they are needed for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.versions import latest
from siltstone.plans import scan

#: Tools that a prompt can name on any platform.
TOOLS = (
    "Task", "Read", "Write", "Edit", "Glob", "Grep", "Bash", "WebFetch", "WebSearch", "AskUserQuestion", "AskUser", "Ask", "NotebookEdit",
    "Notebook", "LSP", "Skill", "Plan", "EnterPlanMode", "ExitPlanMode", "Shell", "TaskCreate", "TaskUpdate", "TaskList", "TaskGet",
    "TaskOutput", "TaskStop",
)
#: What makes a line a critical instruction.
CRITICAL = r"\b(?:MUST|NEVER)\b|(?i:\b(?:ALWAYS|REQUIRED|FORBIDDEN|CRITICAL|DO NOT|don't)\b)"
AGENT = r"""subagent_type\s*[=:]\s*["']([^"']+)["']"""


def prompts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The latest agents or skills."""
    df = scan(spark, sf_dir, table, "prompt_id", "plugin", "name", "path", "frontmatter", "body", "ingested_at")
    return latest(df, "prompt_id", "ingested_at", "body")


def declared_tools(frontmatter: Column) -> Column:
    """Tools of the front matter, given as a list or as one line; restrictions in parentheses are cut off."""
    given = F.coalesce(frontmatter.getItem("tools"), F.array().cast("array<string>"))
    parts = F.flatten(F.transform(given, lambda x: F.split(x, r"\s*,\s*")))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_extract(F.trim(x), r"^([^(\s]*)", 1)), lambda x: x != ""))


def mentioned_tools(body: Column) -> Column:
    """Known tools that a text calls or names as a tool."""
    text = F.coalesce(body, F.lit(""))
    found = [F.when(text.rlike(rf"\b{t}\s*\(|\b{t} tool\b|\buse(?:s|ing)? (?:the )?{t}\b"), F.lit(t)) for t in TOOLS]
    return F.array_compact(F.array(*found))


def tool_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that agents use without having declared them; ``*`` declares all."""
    a = prompts(spark, sf_dir, "agents").where("frontmatter is not null and body is not null")
    tools = declared_tools(F.col("frontmatter"))
    used = F.array_except(mentioned_tools(F.col("body")), tools)
    return a.where(~F.array_contains(tools, "*")).select("prompt_id", "plugin", "name", F.explode(used).alias("tool"))


def declared_tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared tools over agents and skills, whether written as list or as one line."""
    both = prompts(spark, sf_dir, "agents").unionByName(prompts(spark, sf_dir, "skills"))
    each = both.where("frontmatter is not null").select("prompt_id", F.explode(declared_tools(F.col("frontmatter"))).alias("tool"))
    return each.groupBy("tool").agg(F.count("*").alias("prompts"))


def _instructions(df: DataFrame) -> DataFrame:
    """(prompt_id, line, text) of lines outside fences and headings."""
    split = F.split(F.coalesce("body", F.lit("")), "\n", -1)
    each = df.select("prompt_id", F.posexplode(split).alias("pos", "raw")).select(
        "prompt_id", (F.col("pos") + 1).alias("line"), F.regexp_replace(F.trim("raw"), "\r$", "").alias("text")
    )
    fence = F.col("text").startswith("```")
    order = Window.partitionBy("prompt_id").orderBy("line")
    marked = each.withColumn("inside", F.sum(fence.cast("int")).over(order) % 2)
    return marked.where(~fence & (F.col("inside") == 0) & (F.col("text") != "") & ~F.col("text").startswith("#")).drop("inside")


def critical_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that say MUST, NEVER, always and the like, per agent."""
    lines = _instructions(prompts(spark, sf_dir, "agents"))
    return lines.where(F.col("text").rlike(CRITICAL)).groupBy("prompt_id").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def duplicate_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that occur in three or more agents, without regard to case and spaces."""
    lines = _instructions(prompts(spark, sf_dir, "agents"))
    norm = F.lower(F.regexp_replace("text", r"[ \t]+", " "))
    each = lines.where(F.length("text") >= 20).select("prompt_id", norm.alias("instruction"))
    return each.groupBy("instruction").agg(F.countDistinct("prompt_id").alias("prompts"), F.count("*").alias("n")).where("prompts >= 3")


def unknown_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that prompts refer to and that do not exist, by name or by plugin:name."""
    a, s = prompts(spark, sf_dir, "agents"), prompts(spark, sf_dir, "skills")
    refs = a.unionByName(s).select("prompt_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(AGENT), 1))).alias("reference"))
    names = a.select(F.explode(F.array("name", F.concat_ws(":", "plugin", "name"))).alias("reference")).where("reference is not null").distinct()
    return refs.join(names, "reference", "left_anti").select("prompt_id", "reference")


def orphaned_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents per plugin that no prompt refers to."""
    a, s = prompts(spark, sf_dir, "agents"), prompts(spark, sf_dir, "skills")
    refs = a.unionByName(s).select(F.explode(F.regexp_extract_all("body", F.lit(AGENT), 1)).alias("name"))
    short = refs.select(F.element_at(F.split("name", ":"), -1).alias("name")).distinct()
    return a.where("name is not null").join(short, "name", "left_anti").groupBy("plugin").agg(F.count("*").alias("agents"))


def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several plugins use for an agent or a skill."""
    both = prompts(spark, sf_dir, "agents").unionByName(prompts(spark, sf_dir, "skills")).where("name is not null")
    return both.groupBy("name").agg(F.count("*").alias("prompts"), F.countDistinct("plugin").alias("plugins")).where("prompts > 1")


_LATEST = "{t} as (select * exclude (rn) from (select *, row_number() over (partition by prompt_id order by ingested_at desc) as rn from {t_}) where rn = 1)"
_A = "a as (select * exclude (rn) from (select *, row_number() over (partition by prompt_id order by ingested_at desc) as rn from agents) where rn = 1)"
_S = "s as (select * exclude (rn) from (select *, row_number() over (partition by prompt_id order by ingested_at desc) as rn from skills) where rn = 1)"
_TOOLS_OF = "list_distinct(list_filter(list_transform(flatten(list_transform(coalesce(frontmatter['tools'], []), lambda x: regexp_split_to_array(x, '\\s*,\\s*'))), lambda x: regexp_extract(trim(x), '^([^(\\s]*)', 1)), lambda x: x <> ''))"
_USED = " || ".join(f"case when regexp_matches(body, '\\b{t}\\s*\\(|\\b{t} tool\\b|\\buse(?:s|ing)? (?:the )?{t}\\b') then ['{t}'] else [] end" for t in TOOLS)
_LINES = rf"""l as (select prompt_id, unnest(string_split(coalesce(body, ''), chr(10))) as raw, generate_subscripts(string_split(coalesce(body, ''), chr(10)), 1)::int as line from a),
m as (select prompt_id, line, regexp_replace(trim(raw), '\r$', '') as text from l),
i as (select * from (select *, sum(starts_with(text, '```')::int) over (partition by prompt_id order by line) % 2 as inside from m)
  where inside = 0 and not starts_with(text, '```') and text <> '' and not starts_with(text, '#'))"""
QUERIES = {
    "tool_consistency": tool_consistency,
    "declared_tool_counts": declared_tool_counts,
    "critical_instructions": critical_instructions,
    "duplicate_instructions": duplicate_instructions,
    "unknown_agents": unknown_agents,
    "orphaned_agents": orphaned_agents,
    "name_collisions": name_collisions,
}
ORACLES = {
    "tool_consistency": f"""with {_A}, t as (select prompt_id, plugin, name, {_TOOLS_OF} as tools, {_USED} as used from a where frontmatter is not null and body is not null)
select prompt_id, plugin, name, unnest(list_filter(used, lambda x: not list_contains(tools, x))) as tool from t where not list_contains(tools, '*')""",
    "declared_tool_counts": f"""with {_A}, {_S}, t as (select prompt_id, unnest({_TOOLS_OF}) as tool from (select prompt_id, frontmatter from a union all select prompt_id, frontmatter from s) where frontmatter is not null)
select tool, count(*) as prompts from t group by tool""",
    "critical_instructions": rf"""with {_A}, {_LINES} select prompt_id, count(*) as n, min(line) as first_line from i
where regexp_matches(text, '\b(?:MUST|NEVER)\b|(?i:\b(?:ALWAYS|REQUIRED|FORBIDDEN|CRITICAL|DO NOT|don''t)\b)') group by prompt_id""",
    "duplicate_instructions": rf"""with {_A}, {_LINES} select lower(regexp_replace(text, '[ \t]+', ' ', 'g')) as instruction, count(distinct prompt_id) as prompts, count(*) as n
from i where length(text) >= 20 group by 1 having count(distinct prompt_id) >= 3""",
    "unknown_agents": rf"""with {_A}, {_S}, r as (select distinct prompt_id, unnest(regexp_extract_all(body, 'subagent_type\s*[=:]\s*["'']([^"'']+)["'']', 1)) as reference from (select prompt_id, body from a union all select prompt_id, body from s))
select prompt_id, reference from r where not exists (select 1 from a where a.name = r.reference or concat_ws(':', a.plugin, a.name) = r.reference)""",
    "orphaned_agents": rf"""with {_A}, {_S}, r as (select unnest(regexp_extract_all(body, 'subagent_type\s*[=:]\s*["'']([^"'']+)["'']', 1)) as n from (select body from a union all select body from s)),
k as (select distinct string_split(n, ':')[-1] as name from r)
select plugin, count(*) as agents from a where name is not null and name not in (select name from k) group by plugin""",
    "name_collisions": f"""with {_A}, {_S} select name, count(*) as prompts, count(distinct plugin) as plugins from (select name, plugin from a union all select name, plugin from s) where name is not null group by name having count(*) > 1""",
}
