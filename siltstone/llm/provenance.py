"""Problem 1: source files that were not written by hand in their repository.

Each file is lexed and emitted again in canonical layout (one line per statement and opening or
closing of a block), which is compared with the layout it has.  Far more canonical lines than lines
mark compressed code; lines that repeat a few shapes throughout, in the file as in its canonical
form, mark generated code; literals that outweigh everything else mark data.  Layout cannot tell who
made a well laid out file or where it comes from: comments that say a tool made it count wherever
they stand, the opening lines say whose it was, and a directory for outside code marks what is kept
in it; text inside strings says nothing.

Defined results: null or empty content is never a case, whatever the path; a null path or repo
gives no evidence; of the rows of one file the latest counts; repeated rows count once; unknown
extensions are lexed as configuration; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.lexing import FAMILY, MASTER, extension
from siltstone.plans import scan, spread

#: Directories that hold code of other projects.
OUTSIDE = frozenset(
    "vendor _vendor vendored third_party third-party thirdparty 3rdparty external externals extern contrib deps "
    "node_modules bower_components jspm_packages site-packages godeps pods carthage".split()
)
#: What tools write about their output.
MADE = re.compile(
    r"(?i)^[\s/*#!<-]*(?:"
    r"(?:this (?:file|code|class) (?:is|was|has been) )?(?:code |file )?(?:auto[- ]?|automatically |machine[- ])?(?:generated|produced|created|compiled) (?:by|from|with|using)\b.*(?:\d|do not|edit|lost|overwritten|modify)"
    r"|this (?:file|code) (?:is|was) (?:auto|automatically|machine)"
    r"|@generated\b|<auto-?generated\b|auto-?generated file\b|autogenerated\b"
    r"|(?:do not|don't) (?:edit|modify|touch)\b.*(?:generated|rebuilt|by (?:hand|make)|overwritten)"
    r"|output of .*(?:overwritten|do not edit|regenerat)"
    r")"
)
#: What opening lines say about another origin; the name is the group.
ORIGIN = re.compile(
    r"(?i)^[\s/*#!<-]*(?:"
    r"upstream\s*:\s*(?P<up>[^\s]+)"
    r"|(?:imported|copied|taken|vendored|ported|adapted|forked|mirrored)(?: \w+)? (?:from|out of)\b(?P<far>.*)"
    r"|(?:originally|derived|based) (?:from|on|part of|by)\b(?P<first>.*)"
    r"|(?:\(c\)|copyright)(?: \(c\)| ©)?(?:[ ,]*\d{4}(?:\s*-\s*\d{4})?)*,? (?:by )?(?:the )?(?P<who>[\w.-]+)(?: (?:contributors|authors|developers|project|team|inc|ltd|llc|foundation)\b)?"
    r")"
)
#: File names that tools give to their output.
NAMED = re.compile(r"(?i)(?:[.-]min\.(?:js|mjs|css)|\.(?:gen|generated|g)\.\w+|_pb2(?:_grpc)?\.pyi?|\.pb\.(?:go|cc|h)|_(?:gen|generated)\.\w+|(?:^|[.-])lock\.(?:json|ya?ml)|\.bundle\.js)$")
LOCKS = frozenset("package-lock.json npm-shrinkwrap.json yarn.lock pnpm-lock.yaml poetry.lock cargo.lock gemfile.lock composer.lock pipfile.lock".split())

#: The definition of problem 1 asks the opening lines for another origin; these are they.
OPENING = 12

_LOCK_KEY = re.compile(r'[{,]\s*"lockfileVersion"\s*:')
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"[^\"]*\"|'[^']*'")


_PLAIN = re.compile(r"[\w]*[\"'`]+[^\W\d_]+(?:[ ,.;:!?'-]+[^\W\d_]+){4,}")


def _own(name: str, repo: str) -> bool:
    """Is ``name`` the organisation (or the repository) itself?"""
    flat = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    org, _, project = repo.partition("/")
    return flat(name.strip(".,")) in {flat(org), flat(repo), flat(project)} if repo else False


def _comments(text: str, tokens: list[tuple[str, int, int]]) -> list[tuple[str, bool]]:
    """Lines of all comments, and whether they lie in the opening lines."""
    head = -1
    for _ in range(OPENING):
        head = text.find("\n", head + 1)
        if head < 0:
            head = len(text)
            break
    return [(line, start < head) for kind, start, end in tokens if kind == "c" for line in text[start:end].split("\n")]


_GLUED = frozenset(".,;:()[]")


def canonical(text: str, tokens: list[tuple[str, int, int]], family: str) -> list[str]:
    """The code of ``text`` in canonical layout: no comments, single spaces, one line per statement and
    per opening or closing of a block; Python keeps its logical lines, for they are its statements."""
    lines: list[str] = []
    now: list[str] = []
    depth = 0
    end = 0
    for kind, a, b in tokens:
        if kind == "c":
            continue
        t = text[a:b]
        if family == "py" and depth == 0 and now and text.find("\n", end, a) >= 0:
            lines.append(" ".join(now))
            now = []
        end = b
        if kind == "o":
            if t in "([":
                depth += 1
            elif t in ")]":
                depth = max(0, depth - 1)
            elif family != "py" and t == "}":
                if now:
                    lines.append(" ".join(now))
                lines.append("}")
                now = []
                continue
        if now and t in _GLUED:
            now[-1] += t
        else:
            now.append(t)
        if family != "py" and kind == "o" and (t == "{" or (t == ";" and depth == 0)):
            lines.append(" ".join(now))
            now = []
    if now:
        lines.append(" ".join(now))
    return lines


def layout(text: str, tokens: list[tuple[str, int, int]], family: str) -> dict[str, float]:
    """Measures of the layout of ``text`` against the canonical one."""
    literal = code = 0
    numbers = strings = longest = 0
    for kind, start, end in tokens:
        if kind == "s" and text[text.rfind("\n", 0, start) + 1 : start].strip() == "" and text[end : end + 2].strip(" \r")[:1] in ("", "\n"):
            continue  # a docstring stands alone, as a comment does
        if kind == "s":
            if _PLAIN.match(text, start, end) or text.startswith(("-----BEGIN", "data:"), start + 1):
                code += end - start  # sentences, certificates and images belong to ordinary source
                continue
            literal += end - start
            strings += 1
            longest = max(longest, end - start)
        elif kind == "n":
            literal += end - start
            numbers += 1
        elif kind != "c":
            code += end - start
            if kind == "o" and text[start] == ",":
                literal += 0.5
                code -= 0.5
    rows = [line for line in text.split("\n") if line.strip()]
    shapes = Counter(_SHAPE.sub("x", line.strip()) for line in rows)
    repeated = sum(n for _, n in shapes.most_common(8))
    emitted = canonical(text, tokens, family)
    again = Counter(_SHAPE.sub("x", line) for line in emitted)
    return {
        "lines": len(rows),
        "literal": literal,
        "literal_share": literal / max(1.0, literal + code),
        "expansion": len(emitted) / max(1, len(rows)),
        "steadiness": sum(n for _, n in again.most_common(12)) / max(1, len(emitted)),
        "code_per_line": code / max(1, len(rows)),
        "uniformity": repeated / max(1, len(rows)),
        "shapes": len(shapes),
        "longest": longest,
    }


def judge(path: str | None, repo: str | None, text: str | None) -> str | None:
    """Why the file is not hand-written here, or None."""
    if not text:
        return None
    path, repo = path or "", repo or ""
    folders = path.replace("\\", "/").lower().split("/")
    if not OUTSIDE.isdisjoint(folders[:-1]):
        return "outside"
    family = FAMILY.get(extension(path), "conf")
    tokens = [(m.lastgroup, m.start(), m.end()) for m in MASTER[family].finditer(text)]
    name = folders[-1]
    for line, opening in _comments(text, tokens):
        line = line.strip()
        if MADE.match(line):
            return "generated"
        if opening and (m := ORIGIN.match(line)):
            who = m["who"] or (m["up"] or "").partition("@")[0]
            if not (who and _own(who, repo)):
                return "origin"
    if name in LOCKS or (family == "json" and _LOCK_KEY.search(text)):
        return "lock"
    seen = layout(text, tokens, family)
    if family in ("js", "java", "go", "rs", "py") and seen["expansion"] >= 3 and seen["code_per_line"] >= 120:
        return "minified"
    if family != "conf" and family != "json" and seen["literal_share"] >= 0.78 and seen["literal"] >= 500:
        return "data"
    if family == "json" and seen["literal_share"] >= 0.62 and (seen["longest"] >= 1000 or (seen["lines"] >= 40 and seen["shapes"] <= 6)):
        return "data"
    if family in ("js", "java", "go", "rs", "py"):
        if seen["lines"] >= 24 and seen["uniformity"] >= 0.92 and seen["steadiness"] >= 0.9 and seen["shapes"] <= seen["lines"] / 4:
            return "uniform"
        if NAMED.search(name) and (seen["uniformity"] >= 0.6 or seen["expansion"] >= 2):
            return "named"
    return None


def judged(files: DataFrame) -> DataFrame:
    """(file_id, reason) of the latest row of each file, reason null for hand-written files."""

    def run(batches):
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("path", "repo", "content"))
            reasons = [judge(*row) for row in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["at"], pa.array(reasons, pa.string())], ["file_id", "at", "reason"])

    columns = files.select("file_id", F.unix_micros(F.coalesce("ingested_at", F.lit(0).cast("timestamp"))).alias("at"), "path", "repo", "content")
    rows = spread(columns).mapInArrow(run, "file_id bigint, at bigint, reason string")
    # only the verdicts are shuffled, never the contents
    return rows.groupBy("file_id").agg(F.max_by(F.struct("reason"), F.struct("at", F.coalesce("reason", F.lit("")))).alias("x")).select(
        "file_id", "x.reason"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id of every file that was not written by hand in its repository."""
    return p1_reasons(spark, sf_dir).where("reason is not null").select("file_id")


def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, reason) of every file; the reason is null for hand-written source."""
    return judged(scan(spark, sf_dir, "files", "file_id", "repo", "path", "content", "ingested_at"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons}
ORACLES: dict[str, str] = {}
