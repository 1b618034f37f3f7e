"""Problem 3: credentials embedded in source code, and their redaction.

Code is tokenised; string literals (adjacent and joined ones as one) that are assigned or passed to
a name that means a credential are flagged unless they are placeholders.  Comments, configuration
and Markdown are read as text: a name, a separator and a value.  Values whose form alone gives them
away (URLs with a password, headers, keys with a vendor's prefix, web tokens, private keys) are
flagged under any name.  Redaction replaces the characters of the value inside its literal and
nothing else: delimiters, escapes, line ends and concatenations stay as they are.

Defined results: null and empty texts have no credentials; files that problem 1 finds have none; of
the rows of one id the latest counts; repeated rows count once; a line with several credentials is
one row of ``p3_found`` and several of ``p3_values``; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.lexing import FAMILY, MASTER, extension
from siltstone.llm.provenance import judge
from siltstone.plans import scan, spread

#: Words of names that mean a credential, alone or next to ``key``.
NAMES = frozenset(
    "password passwd pwd passphrase passcode secret token apikey credential credentials bearer jwt authorization pw".split()
)
PARTS = frozenset("pass auth".split())
BEFORE_KEY = frozenset("api access secret private signing encryption master auth account service storage ssh license app client session".split())
#: Words that turn such a name into something else.
ABOUT = frozenset(
    "id ids name names type kind field fields column columns label url uri path file prefix suffix length size count "
    "expiry expires ttl hash digest checksum format regex pattern public input placeholder env var index provider "
    "policy scope status mode method endpoint header-name issuer algorithm version".split()
)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_PLACEHOLDER = re.compile(
    r"(?i)^(?:<.*>?|\$.*|%.*%|\{\{.*|\[.*\]|#\{.*|@[\w.]+@|__\w+__|\*+|x+|\.+|-+|"
    r"(?:vault|env|ssm|kms|secretsmanager|secrets?|keyring|keychain|op|file|ref|arn|aws|gcp|azure|config|sealed|sops):.*|"
    r"(?:process\.env|os\.(?:environ|getenv)|env|settings|config|secrets)\b.*|"
    r".*(?:change[-_ ]?me|your[-_ ]|placeholder|example|dummy|redacted|not[-_ ]set|todo|fixme|insert|replace[-_ ]?me|\*{3,}|x{5,}|\.\.\.).*|"
    r"(?:none|null|nil|undefined|true|false|test|changeit|default|unset|empty|n/a|tbd))$"
)
_HARMLESS = re.compile(
    r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|(?:sha\d+|md5|crc32|blake\w*)[:=-].*|data:.*|"
    r"ssh-\w+.*|ecdsa-.*|pk[_-].*|-----BEGIN.*|v?\d+(?:\.\d+)+\S*|[\d.,:/+-]+|\d{4}-\d\d-\d\d.*|[a-z]+://\S*|[./~]+\w.*|@?[\w-]+/[\w./-]+\.\w{1,5})$"
)
_RUNS = ("abcdefgh", "ABCDEFGH", "01234567", "12345678", "qwerty")

_URL = re.compile(r"\b[a-z][a-z0-9+]*://([^\s/:@\"'`<>]+):([^\s/@\"'`<>]+)@[\w.-]+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:\\[rn]|[\s\"'+\\A-Za-z0-9/=:,.-])*?)-----END")
_AWS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_VENDOR = re.compile(r"(?<![A-Za-z0-9_.+/=-])(?!pk|sha|md|v\d)[a-z]{2,5}(?:[_-](?:[a-z]{2,5}))?[_.-]([A-Za-z0-9]{16,})(?![A-Za-z0-9+/=_.-])")
_HOOK = re.compile(r"https://[\w.-]+/services/(T\w+/B\w+/\w{12,})")
_BASIC = re.compile(r"\b[Bb]asic ([A-Za-z0-9+/]{12,}={0,2})(?![A-Za-z0-9+/=])")
_BEARER = re.compile(r"\b(?:[Bb]earer|[Tt]oken)[ =](?:token )?([A-Za-z0-9._~+/-]{16,}=*)")
_PAIR = re.compile(
    r"([A-Za-z][\w.-]*)[\"'`*]*(?:[ \t]*(?::=|=>|->|:|=)[ \t]*|[ \t]+(?:is|was)[ \t]+|[ \t]+)(?:(?:Bearer|Basic|token)[ \t]+)?[\"'`]?([^\s\"'`,;<>(){}]{8,})"
)
_HINT = re.compile(r"(?i)pass|pwd|pw|secret|token|key|cred|auth|bearer|jwt|connect|log_?in|sign_?in|open_?session|://|-----BEGIN|AKIA|ASIA|eyJ|basic |[a-z]{2,5}[_.-][A-Za-z0-9]{16}")


def names_credential(name: str) -> bool:
    """Does an identifier mean a credential?  Words are told apart by case, ``_``, ``-`` and ``.``."""
    words = [w.lower() for w in _SPLIT.findall(name) if not w.isdigit()]
    if not words or words[-1] in ABOUT or "public" in words:
        return False
    for i, w in enumerate(words):
        if w in NAMES or (w in PARTS and len(words) > 1):
            return True
        if w in ("key", "keys") and i and words[i - 1] in BEFORE_KEY:
            return True
        if w.startswith(("password", "passwd", "passphrase")) or w in ("apitoken", "authtoken", "secretkey", "accesskey", "dbpass"):
            return True
    return False


def live(value: str) -> bool:
    """Is a value given to a credential's name a credential, rather than a stand-in for one?"""
    v = value.strip().rstrip(".,;:)")
    if len(v) < 8 or " " in v or _PLACEHOLDER.match(v) or _HARMLESS.match(v) or any(r in v for r in _RUNS):
        return False
    digit = any(c.isdigit() for c in v)
    upper, lower = any(c.isupper() for c in v), any(c.islower() for c in v)
    if digit:
        return upper or lower
    return upper and lower and (any(not c.isalnum() and c not in "-_. " for c in v) or sum(c.isupper() for c in v[1:]) >= 4 and len(v) >= 20)


def _mixed(v: str) -> bool:
    return any(c.isdigit() for c in v) and any(c.isupper() for c in v) and any(c.islower() for c in v)


def by_form(text: str) -> list[tuple[int, int]]:
    """Spans of the values whose form gives them away."""
    out = []
    if "://" in text:
        out += [m.span(2) for m in _URL.finditer(text) if len(m[2]) >= 6 and live(m[2] + "0a") and not _PLACEHOLDER.match(m[2])]
        out += [m.span(1) for m in _HOOK.finditer(text)]
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\[rn]|[^A-Za-z0-9+/=]", "", m[1])
            if len(body) >= 40:
                out.append(m.span())
    if "AKIA" in text or "ASIA" in text:
        out += [m.span() for m in _AWS.finditer(text) if not text[m.start() : m.end()].endswith("EXAMPLE")]
    if "eyJ" in text:
        out += [m.span() for m in _JWT.finditer(text)]
    if "asic " in text:
        for m in _BASIC.finditer(text):
            try:
                user, colon, word = base64.b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode("ascii").partition(":")
            except (ValueError, UnicodeDecodeError):
                continue
            if colon and live(word + "0a"):
                out.append(m.span(1))
    out += [m.span() for m in _VENDOR.finditer(text) if _mixed(m[1]) and not any(r in m[1] for r in _RUNS)]
    if "earer" in text or "oken" in text:
        out += [m.span(1) for m in _BEARER.finditer(text) if live(m[1]) and any(c.isdigit() for c in m[1])]
    return out


def by_name(text: str) -> list[tuple[int, int]]:
    """Spans of the values that follow a credential's name in text."""
    out = []
    at = 0
    while m := _PAIR.search(text, at):
        if names_credential(m[1]):
            if live(m[2]):
                out.append(m.span(2))
                at = m.end()
                continue
        at = max(m.end(1), m.start() + 1)
    return out


_NAME = re.compile(
    r"([A-Za-z_$][\w$.-]*)[\"'`\])?!]*\s*(?::\s*(?:&\s*)?(?:'\w+\s+)?[\w<>\[\]., |*]+?\s*=|:=|=>|->|==|!=|=|:|\()\s*(?:[&(\[]\s*|new\s+|String\s*\(|\w+!\(|(?:[A-Za-z_]\w*\.)*(?:from|of|b64decode|encode)\()*$"
)
_CALL = re.compile(r"\b(?:connect|login|log_?in|sign_?in|auth|authenticate|authorize|set_?auth|basic_?auth|open_?session)\w*\s*\([^()]*,\s*$", re.I)
_CALLED = re.compile(r"(?:connect|login|log_?in|sign_?in|auth|authenticate|authorize|set_?auth|basic_?auth|open_?session)\w*$", re.I)
_PREFIX = re.compile(r"^[A-Za-z]{0,2}")


def _body(text: str, start: int, end: int) -> tuple[int, int]:
    """The span of a literal's contents."""
    s = text[start:end]
    head = re.match(r"[A-Za-z]{0,2}(#*)(\"\"\"|'''|[\"'`])", s)
    if not head:
        return start, end
    return start + head.end(), max(start + head.end(), end - len(head[2]) - len(head[1]))


class _Statements:
    """What stands before a literal in its statement, whatever line it is on; the text is lexed once, when first asked."""

    def __init__(self, text: str, family: str):
        self.text, self.family = text, family
        self.tokens: list[tuple[int, int, str]] | None = None

    def _lex(self) -> None:
        self.tokens, self.begins, self.last = [], [], []
        depth, end, mark = 0, 0, -1
        for m in MASTER[self.family].finditer(self.text):
            if m.lastgroup == "c" or (self.family == "py" and m.group()[0] == "\\"):
                end = m.end() if m.lastgroup != "c" else end
                continue
            c = m.group() if m.lastgroup == "o" else ""
            depth = max(0, depth - 1) if c and c in ")]}" else depth
            self.begins.append(self.family == "py" and depth == 0 and "\n" in self.text[end : m.start()] and not (c and c in ")]}"))
            self.last.append(mark)
            if c and c in "()[]{};":
                mark = len(self.tokens)
            depth += 1 if c and c in "([{" else 0
            self.tokens.append((m.start(), m.end(), m.lastgroup))
            end = m.end()

    def names(self, first: int) -> bool:
        """Is the literal at ``first`` assigned or passed to a credential's name that stands on an earlier line?"""
        if self.tokens is None:
            self._lex()
        at = bisect.bisect_left(self.tokens, (first,))
        if not at or at >= len(self.begins) or self.begins[at]:
            return False
        part, i, to = [], at, first
        while i and not self.begins[i]:
            i -= 1
            a, b, kind = self.tokens[i]
            word = self.text[a:b]
            if kind == "o" and word in (";", "{", "}"):
                break
            gap = self.text[b:to]
            part += ["\n" if "\n" in gap else " " if gap else "", word]
            to = a
            if kind == "s":
                break  # a quoted name at most
        before = "".join(reversed(part))
        m = _NAME.search(before)
        if m and names_credential(m[1]) and not re.search(r"\bcase\b", before):
            return True
        a, b, _ = self.tokens[at - 1]
        opening = self.last[at]
        if self.text[a:b] != "," or opening < 1 or self.text[self.tokens[opening][0]] != "(":
            return False
        a, b, kind = self.tokens[opening - 1]
        return kind == "w" and _CALLED.match(self.text[a:b]) is not None


def _code(text: str, family: str) -> list[list[tuple[int, int]]]:
    """Credentials in code; each is a list of spans, one for each of the literals that hold it."""
    found: list[list[tuple[int, int]]] = []
    group: list[tuple[int, int]] = []
    first = -1
    plus = False
    statements = _Statements(text, family)

    def close() -> None:
        if not group:
            return
        joined = "".join(text[a:b] for a, b in group)
        if len(joined) >= 8:
            spans = by_form(joined) if _HINT.search(joined) else []
            if not spans and " " not in joined and live(joined):
                line = text[text.rfind("\n", 0, first) + 1 : first]
                m = _NAME.search(line)
                if (m and names_credential(m[1])) or _CALL.search(line) or statements.names(first):
                    spans = [(0, len(joined))]
            if not spans and family == "py" and " " in joined or "\n" in joined:
                spans = spans or by_name(joined) if _HINT.search(joined) and len(joined) > 40 else spans
            for a, b in spans:
                parts, at = [], 0
                for x, y in group:
                    lo, hi = max(a, at), min(b, at + y - x)
                    if lo < hi:
                        parts.append((x + lo - at, x + hi - at))
                    at += y - x
                found.append(parts)

    for m in MASTER[family].finditer(text):
        kind = m.lastgroup
        if kind == "s":
            body = _body(text, m.start(), m.end())
            if group and (plus or family in ("py", "conf")):
                group.append(body)
            else:
                close()
                group, first = [body], m.start()
            plus = False
        elif kind == "o" and group and m.group() == "+":
            plus = True
        else:
            if kind == "c":
                comment = m.group()
                if _HINT.search(comment):
                    spans = by_form(comment)
                    spans += [s for s in by_name(comment) if not any(a < s[1] and s[0] < b for a, b in spans)]
                    found += [[(m.start() + a, m.start() + b)] for a, b in spans]
                continue
            close()
            group, plus = [], False
    close()
    return found


def _text(text: str) -> list[list[tuple[int, int]]]:
    """Credentials in configuration and Markdown: by form over the text, by name line by line."""
    found = by_form(text) if _HINT.search(text) else []
    at = 0
    for line in text.split("\n"):
        if _HINT.search(line):
            for a, b in by_name(line):
                if not any(x < at + b and at + a < y for x, y in found):
                    found.append((at + a, at + b))
            for m in re.finditer(r"[\"']([^\"'\n]{4,})[\"'](?:\s*\+?\s*[\"']([^\"'\n]{2,})[\"'])", line):
                joined = m[1] + m[2]
                head = _NAME.search(line[: m.start()])
                spans = by_form(joined)
                if not spans and head and names_credential(head[1]) and live(joined):
                    spans = [(0, len(joined))]
                if spans and not any(x < at + m.end() and at + m.start() < y for x, y in found):
                    found.append((at + m.start(1), at + m.end(2)))
        at += len(line) + 1
    return [[s] for s in sorted(found)]


def credentials(text: str | None, family: str) -> list[list[tuple[int, int]]]:
    """All credentials of a text, in order; spans of code points inside literals."""
    if not text or not _HINT.search(text):
        return []
    return sorted(_text(text) if family in ("conf", "text") else _code(text, family))


_ESCAPE = re.compile(r"\\(?:u\{[^}]*\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-7]{1,3}|[\s\S])|\r?\n|[\"'`+] *\+? *[\"'`]")


def redact(text: str, found: list[list[tuple[int, int]]], mask: str = "*") -> str:
    """``text`` with every credential's characters masked; escapes and line ends stay."""
    out, at = [], 0
    for a, b in sorted(s for spans in found for s in spans):
        if a < at:
            continue
        out.append(text[at:a])
        part, p = text[a:b], 0
        for m in _ESCAPE.finditer(part):
            out.append(mask * (m.start() - p) + m.group())
            p = m.end()
        out.append(mask * (len(part) - p))
        at = b
    return "".join(out) + text[at:]


def _find(source: str, masked: bool):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            paths = batch["path"].to_pylist() if source == "files" else [None] * n
            repos = batch["repo"].to_pylist() if source == "files" else [None] * n
            lines, starts, texts = [], [], []
            for path, repo, text in zip(paths, repos, batch["content"].to_pylist()):
                family = FAMILY.get(extension(path), "conf") if source == "files" else "text"
                found = credentials(text, family)
                if found and source == "files" and judge(path, repo, text):
                    found = []
                lines.append([text.count("\n", 0, spans[0][0]) + 1 for spans in found])
                starts.append([spans[0][0] for spans in found])
                texts.append(redact(text, found) if masked and text is not None else text if masked else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    batch["at"],
                    pa.array(lines, pa.list_(pa.int32())),
                    pa.array(starts, pa.list_(pa.int32())),
                    pa.array(texts, pa.string()),
                ],
                ["id", "at", "lines", "starts", "text"],
            )

    return run


def _latest_found(df: DataFrame, source: str, masked: bool = False) -> DataFrame:
    schema = "id bigint, at bigint, lines array<int>, starts array<int>, text string"
    rows = spread(df).mapInArrow(_find(source, masked), schema)
    if not masked:
        rows = rows.where(F.size("lines") > 0)  # an id's later deliveries repeat its content or replace it
    return rows.withColumn("source_table", F.lit(source))


def _inputs(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str]]:
    at = F.unix_micros(F.coalesce("ingested_at", F.lit(0).cast("timestamp"))).alias("at")
    files = scan(spark, sf_dir, "files", F.col("file_id").alias("id"), at, "path", "repo", "content")
    skills = scan(spark, sf_dir, "skills", F.col("prompt_id").alias("id"), at, "content")
    return [(files, "files"), (skills, "skills")]


def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, line, start): every credential and where it begins."""
    parts = []
    for df, source in _inputs(spark, sf_dir):
        last = df.groupBy("id").agg(F.max("at").alias("last"))
        found = _latest_found(df, source)
        parts.append(
            found.join(last, "id")
            .where("at = last")
            .select("source_table", F.col("id").alias("record_id"), F.explode(F.arrays_zip("lines", "starts")).alias("x"))
            .select("source_table", "record_id", F.col("x.lines").alias("line"), F.col("x.starts").alias("start"))
            .distinct()
        )
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, line) of every line on which a literal credential begins."""
    return p3_values(spark, sf_dir).select("source_table", "record_id", "line").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_table, record_id, text): every text with its credentials masked and all else unchanged."""
    parts = [_latest_found(df, source, masked=True).dropDuplicates(["id", "at"]) for df, source in _inputs(spark, sf_dir)]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("source_table", F.col("id").alias("record_id")).agg(F.max_by("text", "at").alias("text"))


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p3_redacted": p3_redacted}
ORACLES: dict[str, str] = {}
