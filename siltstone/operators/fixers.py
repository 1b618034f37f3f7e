"""Rewriters of document and prompt texts; fenced code is left as it is.

A text is cut into fenced blocks, runs without a backtick and single backticks; only the runs are
rewritten, so nothing needs to be put away and brought back.  Null texts stay null, empty ones empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.dialect import quote
from siltstone.plans import scan

PARTS = r"```[\s\S]*?```|[^`]+|`"
#: Phrases and what says the same in fewer words.
CONCISE = {
    "in order to": "to",
    "for the purpose of": "for",
    "in the event that": "if",
    "at this point in time": "now",
    "due to the fact that": "because",
    "has the ability to": "can",
    "is able to": "can",
    "make use of": "use",
    "a large number of": "many",
    "a small number of": "few",
    "the majority of": "most",
    "prior to": "before",
    "subsequent to": "after",
}
#: Words that are written in capitals without shouting.
CAPITALS = (
    "API", "JSON", "XML", "HTML", "CSS", "URL", "HTTP", "HTTPS", "SQL", "CLI", "SDK", "JWT", "UUID", "REST", "YAML", "EOF", "TODO",
    "FIXME", "NOTE", "README", "MCP", "HIGH", "MEDIUM", "LOW",
)
TOKENS = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"


def _steps() -> list[tuple[str, str]]:
    """(expression, replacement) pairs; a phrase that begins with a capital gets one back."""
    return [
        (rf"\b{first}(?i:{phrase[1:]})\b", short.capitalize() if first.isupper() else short)
        for phrase, short in CONCISE.items()
        for first in (phrase[0].upper(), phrase[0])
    ]


def _outside_code(text: Column, change) -> Column:
    parts = F.regexp_extract_all(text, F.lit(PARTS), 0)
    return F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit("```")), x).otherwise(change(x))), "")


def concise(text: Column) -> Column:
    """The text with long-winded phrases replaced."""

    def change(x: Column) -> Column:
        for pattern, short in _steps():
            x = F.regexp_replace(x, pattern, short)
        return x

    return _outside_code(text, change)


def calm(text: Column) -> Column:
    """The text without shouted words and rows of exclamation marks."""

    def word(x: Column) -> Column:
        loud = x.rlike("^[A-Z]{3,}$") & ~x.isin(*CAPITALS)
        return F.when(loud, F.concat(F.substring(x, 1, 1), F.lower(F.substring(x, 2, 1 << 30)))).otherwise(F.regexp_replace(x, "!{2,}", "!"))

    return _outside_code(text, lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(TOKENS), 0), word), ""))


def _fixed(spark: SparkSession, sf_dir: str, fix) -> DataFrame:
    d = scan(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", "text", fix(F.col("text")).alias("fixed")).where("fixed <> text").select("doc_id", "fixed")


def concise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fixed): documents that say something at length, and their text in fewer words."""
    return _fixed(spark, sf_dir, concise)


def calm_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fixed): documents that shout, and their text in a calm voice."""
    return _fixed(spark, sf_dir, calm)


def _sql(change: str) -> str:
    parts = f"regexp_extract_all(text, {quote(PARTS)})"
    fixed = f"array_to_string(list_transform({parts}, lambda x: case when starts_with(x, '```') then x else {change} end), '')"
    return f"select doc_id, fixed from (select doc_id, text, {fixed} as fixed from documents where text is not null) where fixed <> text"


def _concise_sql() -> str:
    x = "x"
    for pattern, short in _steps():
        x = f"regexp_replace({x}, {quote(pattern)}, '{short}', 'g')"
    return x


_LOUD = f"regexp_matches(w, '^[A-Z]{{3,}}$') and w not in ({', '.join(map(quote, CAPITALS))})"
_CALM = f"array_to_string(list_transform(regexp_extract_all(x, {quote(TOKENS)}), lambda w: case when {_LOUD} then w[1] || lower(w[2:]) else regexp_replace(w, '!{{2,}}', '!', 'g') end), '')"
QUERIES = {"concise_documents": concise_documents, "calm_documents": calm_documents}
ORACLES = {"concise_documents": _sql(_concise_sql()), "calm_documents": _sql(_CALM)}
