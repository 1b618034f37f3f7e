"""Rules about prompts and documents, each a condition on one text and its front matter.

A condition is built once and says itself in both dialects: as a Column, and as SQL for DuckDB.
Null texts are empty; of the rows of one prompt the latest counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dialect import java, quote, re2
from siltstone.operators.versions import latest
from siltstone.plans import scan


@dataclass(frozen=True)
class Both:
    """A value as a Column, made when a session is there, and as SQL."""

    make: Callable[[], Column]
    sql: str

    @property
    def column(self) -> Column:
        return self.make()

    def __and__(self, other):
        return Both(lambda: self.column & other.column, f"({self.sql} and {other.sql})")

    def __or__(self, other):
        return Both(lambda: self.column | other.column, f"({self.sql} or {other.sql})")

    def __invert__(self):
        return Both(lambda: ~self.column, f"(not {self.sql})")

    def __add__(self, other):
        return Both(lambda: self.column + other.column, f"({self.sql} + {other.sql})")

    def at_least(self, n: float):
        return Both(lambda: self.column >= n, f"({self.sql} >= {n})")

    def below(self, n: float):
        return Both(lambda: self.column < n, f"({self.sql} < {n})")

    def equals(self, n: float):
        return Both(lambda: self.column == n, f"({self.sql} = {n})")


TEXT = Both(lambda: F.col("content"), "content")


def has(pattern: str, ignore_case: bool = True, multiline: bool = False, of: Both = TEXT) -> Both:
    """Does the expression match anywhere?"""
    m = "(?m)" if multiline else ""
    return Both(lambda: of.column.rlike(java(pattern, ignore_case, multiline)), f"regexp_matches({of.sql}, {quote(m + re2(pattern, ignore_case))})")


def count(pattern: str, ignore_case: bool = True, multiline: bool = False, of: Both = TEXT) -> Both:
    """How often does it match?"""
    m = "(?m)" if multiline else ""
    return Both(lambda: F.regexp_count(of.column, F.lit(java(pattern, ignore_case, multiline))), f"len(regexp_extract_all({of.sql}, {quote(m + re2(pattern, ignore_case))}))")


def any_of(*parts: Both) -> Both:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def total(*parts: Both) -> Both:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def one(condition: Both) -> Both:
    return Both(lambda: condition.column.cast("int"), f"({condition.sql})::int")


TOKENS = Both(lambda: F.ceil(F.length("content") / 4), "ceil(length(content) / 4)")
WORDS = Both(lambda: F.size(F.split("content", java(r"\s+"), -1)), f"len(regexp_split_to_array(content, {quote(re2(chr(92) + 's+'))}))")


def key(name: str) -> Both:
    """The values of a key of the front matter as one text; empty without it."""
    return Both(lambda: F.coalesce(F.array_join(F.col("frontmatter")[name], ","), F.lit("")), f"coalesce(array_to_string(frontmatter['{name}'], ','), '')")


SECTIONS = count(r"##\s+", False)
STEPS = r"step[- ]by[- ]step"
#: Terms that say nothing definite.
VAGUE = ("usually", "sometimes", "often", "rarely", "maybe", "might", "could", "should probably", "try to", "as much as possible", "if possible")
EMPHASIS = (r"\bABSOLUTELY\b", r"\bTOTALLY\b", r"\bCOMPLETELY\b", r"\bENTIRELY\b", r"\bDEFINITELY\b", r"\bEXTREMELY\b", r"\bEXTREMELY\s+IMPORTANT\b", r"\bSUPER\s+IMPORTANT\b", r"\bVERY\s+VERY\b", r"!{3,}", r"\?{3,}")
VERBOSE = ("in order to", "for the purpose of", "in the event that", "at this point in time", "due to the fact that", "has the ability to", "is able to", "make use of", "a large number of", "a small number of", "the majority of", "prior to", "subsequent to")
SIDE_EFFECTS = r"\b(?:deploy|ship|push|merge|commit|delete|remove|publish)\b|\bgit\s+(?:push|commit|reset)\b|\bcreate\s+(?:PR|pull\s+request|issue)\b|\bsend\s+(?:email|notification|message)\b|\brun\s+(?:migration|deploy)\b"
EXPLORES = r"\b(?:search|explore|analyze|scan)\s+(?:the\s+)?(?:codebase|repo|project)\b|\bread\s+(?:all|many|multiple)\s+files\b|\b(?:deep|thorough)\s+(?:analysis|review|investigation)\b"
COT = r"\bthink\s+step[- ]by[- ]step\b|\bstep[- ]by[- ]step\s+(?:reasoning|thinking|approach)\b|\blet's\s+think\s+(?:through|about)\s+this\b|\breason\s+through\s+each\s+step\b"

_OPENS = has(r"^\s*---", False)
_EXAMPLES = total(count(r"##\s+example"), count(r"<good[- ]?example>"), count(r"<bad[- ]?example>"))
_XML = has(r"<\w+>", False)
_FENCE = has("```", False)
AGENT_RULES = {
    "missing_frontmatter": ("HIGH", ~_OPENS),
    "missing_name": ("HIGH", ~has(r"\S", of=key("name"))),
    "missing_description": ("HIGH", ~has(r"\S", of=key("description"))),
    "missing_output_format": ("HIGH", ~has(r"##\s+(?:output\s+format|format|response)")),
    "missing_constraints": ("HIGH", ~has(r"#{2,3}\s+(?:constraints|(?:what\s+)?(?:this\s+agent\s+)?(?:you\s+)?(?:must\s+)?not\s+do|rules|workflow\s+gates)")),
    "unrestricted_tools": ("HIGH", ~has(r"\S", of=key("tools"))),
    "unrestricted_bash": ("HIGH", has(r"(?:^|,)\s*bash\s*(?:,|$)", of=key("tools"))),
    "missing_xml_structure": ("MEDIUM", (SECTIONS.at_least(5) | (has(r"^\s*[-*]\s+", False, True) & _FENCE)) & ~_XML),
    "unnecessary_cot": ("MEDIUM", (has(STEPS) | has("<thinking>")) & WORDS.below(500) & SECTIONS.below(4)),
    "missing_cot": ("MEDIUM", WORDS.at_least(1001) & SECTIONS.at_least(5) & has(r"analy[sz]e|evaluate|assess|review") & ~has(rf"{STEPS}|<thinking>|reasoning|think\s+through")),
    "example_count_suboptimal": ("LOW", _EXAMPLES.equals(1) | _EXAMPLES.at_least(6)),
    "vague_instructions": ("MEDIUM", total(*(one(has(rf"\b{t}\b")) for t in VAGUE)).at_least(4)),
    "prompt_bloat": ("LOW", TOKENS.at_least(2001)),
}
SKILL_RULES = {
    "missing_frontmatter": ("HIGH", ~_OPENS),
    "missing_name": ("HIGH", ~has(r"\S", of=key("name"))),
    "missing_description": ("HIGH", ~has(r"\S", of=key("description"))),
    "missing_trigger_phrase": ("MEDIUM", has(r"\S", of=key("description")) & ~has("use when user asks", of=key("description"))),
    "side_effect_without_disable": ("HIGH", any_of(has(SIDE_EFFECTS, of=key("name")), has(SIDE_EFFECTS, of=key("description")), has(SIDE_EFFECTS))),
    "missing_context_fork": ("MEDIUM", (has(EXPLORES, of=key("description")) | has(EXPLORES)) & ~has("^fork$", False, of=key("context"))),
    "missing_allowed_tools": ("MEDIUM", has("^fork$", False, of=key("context")) & ~has(r"\S", of=key("allowed-tools"))),
    "aggressive_emphasis": ("HIGH", total(*(count(p, False) for p in EMPHASIS)).at_least(3)),
    "redundant_cot": ("HIGH", count(COT).at_least(2)),
    "unsafe_eval": ("HIGH", has(r"\b(?:eval|Function)\s*\(", False)),
    "path_traversal": ("HIGH", has(r"^.*(?:path|file|dir).*\$.*\.\./", True, True)),
    "unrestricted_bash": ("HIGH", has(r"\bBash(?:[^(]|$)", False, of=key("tools"))),
    "broad_file_access": ("MEDIUM", has(r"\b(?:Write|Edit)(?:[^(]|$)", False, of=key("tools"))),
}
DOCUMENT_RULES = {
    "verbose_explanations": ("HIGH", total(*(count(rf"\b{p}\b") for p in VERBOSE)).at_least(3)),
    "missing_code_language": ("HIGH", Both(lambda: F.floor(count("```", False).column / 2) > count(r"```\w+", False).column, f"floor({count('```', False).sql} / 2) > {count('```' + chr(92) + 'w+', False).sql}")),
    "few_headings": ("MEDIUM", Both(lambda: (TOKENS.column > 500) & (count(r"^#{1,6}\s+", False, True).column < F.floor(TOKENS.column / 500)), f"({TOKENS.sql} > 500 and {count('^#{1,6}' + chr(92) + 's+', False, True).sql} < floor({TOKENS.sql} / 500))")),
    "no_contents": ("LOW", TOKENS.at_least(2001) & ~has(r"table of contents|##\s+contents")),
    "mixed_bullets": ("LOW", has(r"^- ", False, True) & has(r"^\* ", False, True)),
    "file_too_long": ("MEDIUM", Both(lambda: F.size(F.split("content", "\n", -1)) > 150, "len(string_split(content, chr(10))) > 150")),
    "excessive_token_count": ("MEDIUM", TOKENS.at_least(1501)),
}


LINES = Both(lambda: F.size(F.split("content", "\n", -1)), "len(string_split(content, chr(10)))")
LENGTH = Both(lambda: F.length("content"), "length(content)")


def times(a: Both, n: int) -> Both:
    return Both(lambda: a.column * n, f"({a.sql} * {n})")


def less(a: Both, b: Both) -> Both:
    return Both(lambda: a.column < b.column, f"({a.sql} < {b.sql})")


def at_most(n: int, b: Both) -> Both:
    return Both(lambda: F.least(b.column, F.lit(n)), f"least({b.sql}, {n})")


#: Phrases and expressions of the rules below.
VAGUE_IN_PROMPTS = (*VAGUE, "when appropriate", "as needed")
DIRECTIVES = tuple(rf"\b{w},?\s+(?:you\s+)?(?:must|should|need to)\b" for w in ("first", "then", "next", "finally"))
OBVIOUS = (r"\bthis is a (?:node|python|rust|go|java)\s+project\b", r"\bwe use (?:npm|yarn|pnpm|pip|cargo)\b", r"\bthe (?:src|lib|test) folder contains\b", r"\bstandard (?:REST|HTTP|JSON) conventions\b", r"\bfollow (?:PEP|ESLint|standard) (?:style|conventions)\b", r"\bwrite clean code\b", r"\buse meaningful variable names\b", r"\bcomment your code\b", r"\bhandle errors appropriately\b")
EVIDENT = (r"\bwrite tests\b", r"\bfollow best practices\b", r"\bbe consistent\b", r"\buse descriptive names\b", r"\bavoid code duplication\b", r"\bkeep functions small\b", r"\bsingle responsibility\b", r"\bDRY principle\b")
FILLERS = (r"in this (?:document|section|guide)", r"as you (?:can see|may know|probably know)", r"it(?:'s| is) (?:important|worth noting) (?:to note |that )?", r"please note that", r"the following (?:section|document|guide) (?:will |provides )", r"let(?:'s| us) (?:take a look|explore|dive into)", r"we(?:'ll| will) (?:cover|discuss|explore)", r"this allows you to", r"you(?:'ll| will) (?:learn|discover|find)", r"as mentioned (?:earlier|above|before)")

_SHOWN = total(count(r"##\s*example"), count(r"<good[_-]?example>"), count(r"<bad[_-]?example>"), count("<example>"))
_DEEP = count(r"^(?:\s{8,}[-*]|\t{3,}[-*])", False, True)
_STATED = count(r"must|never|always|do not|required|important")
#: Rules about the text of any prompt, agent or skill.
PROMPT_RULES = {
    "vague_instructions": ("HIGH", total(*(count(rf"\b{t}\b") for t in VAGUE_IN_PROMPTS)).at_least(4)),
    "missing_xml_structure": ("LOW", (TOKENS.at_least(801) | (count(r"^#{1,6}\s+", False, True).at_least(6) & _FENCE)) & ~has(r"<[a-z_][a-z0-9_-]*>")),
    "inconsistent_sections": ("LOW", count(r"^##\s+", False, True).at_least(2) & count(r"^\*\*[^*\n]+\*\*\s*$", False, True).at_least(2)),
    "suboptimal_example_count": ("LOW", _SHOWN.equals(1) | _SHOWN.at_least(8)),
    "examples_without_contrast": ("MEDIUM", count(r"<example>|##\s*example").at_least(3) & ~has(r"<good[_-]?example>|\bgood example\b|\bcorrect\b") & ~has(r"<bad[_-]?example>|\bbad example\b|\bincorrect\b|\bwrong\b")),
    "overly_prescriptive": ("LOW", count(r"^\s*\d+\.\s+\w+", False, True).at_least(10) | total(*(count(p) for p in DIRECTIVES)).at_least(6)),
    "prompt_bloat": ("LOW", TOKENS.at_least(2501)),
    "aggressive_emphasis": ("HIGH", total(*(count(p, False) for p in EMPHASIS)).at_least(3)),
    "redundant_cot": ("HIGH", count(COT).at_least(2)),
}
#: Rules about a project's memory, the guide that every session reads.
MEMORY_RULES = {
    "missing_critical_rules": ("HIGH", ~has(r"##\s+critical\s+rules|##\s+priority\s+rules|<critical-rules>|##\s+must[- ]know")),
    "missing_architecture": ("HIGH", ~has(r"##\s+architecture|##\s+(?:project\s+)?structure|##\s+overview") & ~(_FENCE & has(r"├──|└──|lib\/|src\/", False))),
    "missing_key_commands": ("HIGH", ~has(r"##\s+(?:key\s+)?commands|##\s+scripts|##\s+usage") & ~(has("```(?:bash|sh|shell)") & has(r"\b(?:npm|yarn|pnpm|git|make)\b"))),
    "verbose_instructions": ("MEDIUM", less(times(LINES, 81), total(LENGTH, Both(lambda: F.lit(1), "1"))) & count(r"[^\n]{200,}", False).at_least(4)),
    "missing_why": ("MEDIUM", _STATED.at_least(6) & less(times(count(r"\*WHY:|WHY:|because|reason:|rationale:"), 3), _STATED)),
    "example_overload": ("LOW", total(count(r"```[\s\S]*?```", False), count(r"##\s+example"), count(r"<(?:good-)?example>")).at_least(11)),
    "deep_nesting": ("LOW", count("^#####", False, True).at_least(3) | _DEEP.at_least(6) | (count("^####", False, True).at_least(6) & _DEEP.at_least(4))),
    "includes_obvious_information": ("MEDIUM", total(*(one(has(p)) for p in OBVIOUS)).at_least(3)),
    "missing_emphasis_markers": ("MEDIUM", count(r"\b(?:never|always|required|must not)\b").at_least(6) & count(r"\b(?:IMPORTANT|CRITICAL|MUST|YOU MUST|NEVER)\b", False).below(2)),
    "self_evident_practices": ("LOW", total(*(one(has(p)) for p in EVIDENT)).at_least(4)),
    "unnecessary_prose": ("HIGH", total(*(at_most(2, count(p)) for p in FILLERS)).at_least(3)),
}

def check(df: DataFrame, id_column: str, rules: dict[str, tuple[str, Both]]) -> DataFrame:
    """(id, rule, certainty) of every rule that a text breaks; ``df`` has content and, for prompts, front matter."""
    broken = F.array_compact(
        F.array(*(F.when(c.column, F.struct(F.lit(n).alias("rule"), F.lit(certainty).alias("certainty"))) for n, (certainty, c) in rules.items()))
    )
    base = df.withColumn("content", F.coalesce("content", F.lit("")))
    return base.select(id_column, F.explode(broken).alias("b")).select(id_column, "b.rule", "b.certainty")


def _prompts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = scan(spark, sf_dir, table, "prompt_id", "plugin", "frontmatter", "content", "ingested_at")
    return latest(df, "prompt_id", "ingested_at", "content")


def agent_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that agents break."""
    return check(_prompts(spark, sf_dir, "agents"), "prompt_id", AGENT_RULES)


def skill_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that skills break."""
    return check(_prompts(spark, sf_dir, "skills"), "prompt_id", SKILL_RULES)


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that documents break."""
    return check(scan(spark, sf_dir, "documents", "doc_id", F.col("text").alias("content")), "doc_id", DOCUMENT_RULES)


def prompt_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules about prompt texts that agents and skills break."""
    both = _prompts(spark, sf_dir, "agents").unionByName(_prompts(spark, sf_dir, "skills"))
    return check(both, "prompt_id", PROMPT_RULES)


def memory_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules about project memory, asked of every document that has text."""
    return check(scan(spark, sf_dir, "documents", "doc_id", F.col("text").alias("content")).where("text <> ''"), "doc_id", MEMORY_RULES)


def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of agents and skills by certainty, pivoted, with their total."""
    both = agent_rules(spark, sf_dir).withColumn("kind", F.lit("agent")).unionByName(skill_rules(spark, sf_dir).withColumn("kind", F.lit("skill")))
    return both.groupBy("kind").agg(
        *(F.count_if(F.col("certainty") == c).alias(c.lower()) for c in ("HIGH", "MEDIUM", "LOW")), F.count("*").alias("total"), F.countDistinct("prompt_id").alias("prompts")
    )


def _sql(id_column: str, rules: dict) -> str:
    return " union all ".join(f"select {id_column}, '{n}' as rule, '{certainty}' as certainty from p where {c.sql}" for n, (certainty, c) in rules.items())


def _p(table: str) -> str:
    return f"p as (select prompt_id, frontmatter, coalesce(content, '') as content from (select *, row_number() over (partition by prompt_id order by ingested_at desc) as rn from {table}) where rn = 1)"


QUERIES = {"agent_rules": agent_rules, "skill_rules": skill_rules, "document_rules": document_rules, "prompt_rules": prompt_rules, "memory_rules": memory_rules, "rule_summary": rule_summary}
ORACLES = {
    "agent_rules": f"with {_p('agents')} {_sql('prompt_id', AGENT_RULES)}",
    "skill_rules": f"with {_p('skills')} {_sql('prompt_id', SKILL_RULES)}",
    "document_rules": f"with p as (select doc_id, coalesce(text, '') as content from documents) {_sql('doc_id', DOCUMENT_RULES)}",
    "prompt_rules": f"with a as (with {_p('agents')} select prompt_id, content from p), s as (with {_p('skills')} select prompt_id, content from p), p as (select * from a union all select * from s) {_sql('prompt_id', PROMPT_RULES)}",
    "memory_rules": f"with p as (select doc_id, text as content from documents where text <> '') {_sql('doc_id', MEMORY_RULES)}",
    "rule_summary": f"""with f as (select 'agent' as kind, * from (with {_p('agents')} {_sql('prompt_id', AGENT_RULES)}) union all select 'skill', * from (with {_p('skills')} {_sql('prompt_id', SKILL_RULES)}))
select kind, count(*) filter (certainty = 'HIGH') as high, count(*) filter (certainty = 'MEDIUM') as medium, count(*) filter (certainty = 'LOW') as low, count(*) as total, count(distinct prompt_id) as prompts from f group by kind""",
}
