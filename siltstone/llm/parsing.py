"""Problem 6: source files that do not parse.

Files are lexed, brackets matched, and the contents of every pair and block recognised by
generalised LL parsing (``gll``) with the grammar that the extension names (``grammars``); the
dialects of an extension run together and a file is flagged if each of them rejects it.

Defined results: null and empty content is never a case; extensions other than the nine are never
cases, and a null path has none; a byte order mark is not part of the text; of the rows of one file
the latest counts; repeated rows count once; an empty table gives an empty table; other columns are
ignored.  Rates count the files of the nine extensions that have content.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.gll import Grammar
from siltstone.llm.grammars import CONTEXTUAL, KEYWORDS, START, TEXTS
from siltstone.llm.lexing import MASTER, extension
from siltstone.plans import scan, spread

#: Dialects of each extension; a file must parse in one of them.
DIALECTS = {"js": ("js",), "mjs": ("js",), "jsx": ("js",), "ts": ("ts",), "py": ("py",), "json": ("json",), "java": ("java",), "go": ("go",), "rs": ("rs",)}
FAMILY_OF = {"js": "js", "ts": "js", "py": "py", "json": "json", "java": "java", "go": "go", "rs": "rs"}

_NUMBER = {
    "js": re.compile(r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:0|[1-9](?:_?\d)*))n?$|(?:(?:0|[1-9](?:_?\d)*)\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?$"),
    "py": re.compile(r"(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|0(?:_?0)*|[1-9](?:_?\d)*)$|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?$"),
    "json": re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$"),
    "java": re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*)[lL]?$|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdD]?$|0[xX][\da-fA-F_.]+[pP][+-]?\d+[fFdD]?$"),
    "go": re.compile(r"(?:0[xX]_?[\da-fA-F_]+|0[oO]?_?[0-7_]+|0[bB]_?[01_]+|\d[\d_]*)i?$|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?$|0[xX][\da-fA-F_.]+[pP][+-]?\d+i?$"),
    "rs": re.compile(r"(?:0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d[\d_]*)(?:[iu](?:8|16|32|64|128|size))?$|\d[\d_]*(?:\.(?:\d[\d_]*)?)?(?:[eE][+-]?[\d_]+)?(?:f32|f64)?$"),
}
_NUMBER["ts"] = _NUMBER["js"]
_STRING = {
    "json": re.compile(r"\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[\da-fA-F]{4}))*\"$"),
    "java": re.compile(r"\"|'(?:[^\\]|[\ud800-\udbff].|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))'$"),
    "go": re.compile(r"[\"`]|'(?:[^\\]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))'$"),
}
_SPLIT_OPS = {">>=": (">", ">", "="), ">=": (">", "="), ">>": (">", ">")}
_CLOSE = {")": "(", "]": "[", "}": "{"}
_SPECIAL = frozenset("()[]{}")

#: After these an end of line can end a statement ...
_ENDS = {
    "js": frozenset("ID NUM STR TPL RE PRIV this super null true false return break continue debugger yield ++ -- async get set of from as let static".split()),
    "go": frozenset("ID NUM STR break continue fallthrough return ++ --".split()),
}
_ENDS["ts"] = _ENDS["js"] | KEYWORDS["ts"] - KEYWORDS["js"] | {"void", ">", "!", "await", "public", "private"}
#: ... unless one of these follows (JavaScript) or anything but a new token does (Go).
_NO_NL = frozenset("else catch finally instanceof in of as . ?. , ; : ? = => + - * / % ** < > <= == != === !== & | ^ && || ?? << += -= *= /= %= &= |= ^= **= &&= ||= ??= TPL extends implements satisfies".split())

_GRAMMARS: dict[str, Grammar] = {}


def grammar(dialect: str) -> Grammar:
    """The compiled grammar, once per process."""
    if dialect not in _GRAMMARS:
        _GRAMMARS[dialect] = Grammar(TEXTS[dialect])
    return _GRAMMARS[dialect]


def _word(text: str, dialect: str, words: frozenset) -> str:
    if text in words:
        return text
    if text[0] in "'#$@" or dialect == "json":
        if dialect == "rs":
            return "LIFE" if text[0] == "'" else "ID" if text.startswith("r#") else "ERR"
        if dialect in ("js", "ts"):
            return "PRIV" if text[0] == "#" and len(text) > 1 else "ID" if text[0] == "$" else "ERR"
        return "ERR"
    return "ID"


def parses(text: str, dialect: str) -> bool:
    """Is ``text`` a sentence of the dialect?"""
    text = text.removeprefix("﻿")
    try:
        if dialect == "py":
            return _python(text)
        return _braces(text, dialect)
    except _Reject:
        return False


#: Terminals of words and operators seen so far, by dialect.
_TERMINALS: dict[str, dict[str, tuple[str, ...]]] = {}


class _Reject(Exception):
    pass


def _terminals(kind: str, s: str, dialect: str, words: frozenset) -> tuple[str, ...]:
    if kind == "w":
        if dialect in ("js", "ts") and s[0] == "@":
            return ("@", _word(s[1:], dialect, words)) if len(s) > 1 else ("@",)
        if dialect == "java" and s[0] == "@":
            return ("@", _word(s[1:], dialect, words)) if len(s) > 1 else ("@",)
        if dialect == "rs" and s[0] in "#@$":
            return (s[0], _word(s[1:], dialect, words)) if len(s) > 1 else (s[0],)
        return (_word(s, dialect, words),)
    if kind == "n":
        if not _NUMBER[dialect].match(s):
            if dialect in ("rs", "go") and ".." in s:  # a range
                a, _, b = s.partition("..")
                rest = b.lstrip("=")
                if _NUMBER[dialect].match(a) and (not rest or _NUMBER[dialect].match(rest)):
                    return ("NUM", ".." if rest == b else "..=") + (("NUM",) if rest else ())
            if dialect == "rs" and re.match(r"\d+\.(?:\d+|[a-z_]\w*)$", s):  # tuple field or method
                a, _, b = s.partition(".")
                return ("NUM", ".", "NUM" if b[0].isdigit() else "ID")
            if dialect in ("js", "ts") and re.match(r"\d+\.\.\w+$", s):
                return ("NUM", ".", "ID")
            raise _Reject
        return ("NUM",)
    if kind == "s":
        check = _STRING.get(dialect)
        if check and not check.match(s):
            raise _Reject
        if dialect in ("js", "ts") and s[0] == "`":
            return ("TPL",)
        return ("STR",)
    if kind == "r":
        return ("RE",)
    if s in _SPLIT_OPS:
        return _SPLIT_OPS[s]
    if s in "\"'`\\" or (dialect != "rs" and s in "#$"):
        raise _Reject
    return (s,)


def _known(kind: str, s: str, dialect: str, words: frozenset):
    """The terminal of a token that needs no further thought, else the terminals as a tuple."""
    new = _terminals(kind, s, dialect, words)
    one = len(new) == 1 and new[0] not in _SPECIAL and not (dialect == "rs" and (new[0] in (".", "=") or new[0] in CONTEXTUAL["rs"]))
    return new[0] if one else new


def _braces(text: str, dialect: str, nested: bool = False) -> bool:
    g = grammar(dialect)
    words = KEYWORDS[dialect]
    soft = CONTEXTUAL.get(dialect, frozenset())
    lines = dialect in ("js", "ts", "go")
    ends = _ENDS.get(dialect, frozenset())
    go = dialect == "go"
    stack: list[tuple[str, list]] = [("", [])]
    now = stack[0][1]
    at, prior = 0, ""
    rust, script = dialect == "rs", dialect in ("js", "ts")
    known = _TERMINALS.setdefault(dialect, {})
    lexer = MASTER[FAMILY_OF[dialect]]
    matches = lexer.finditer(text)
    while True:
        m = next(matches, None)
        if m is None:
            break
        kind = m.lastgroup
        if kind == "c":
            continue
        s = m.group()
        end = -1
        if script and s[0] == "`":
            end = _special(text, m.start(), m.end(), dialect, nested)
            if end != m.end():
                matches = lexer.finditer(text, end)
            new = "TPL"
        elif kind == "s":
            new = _terminals(kind, s, dialect, words)[0]
        else:
            new = known.get(s)
            if new is None:
                if len(known) > 100_000:
                    known.clear()
                new = known[s] = _known(kind, s, dialect, words)
        plain = new.__class__ is str
        if lines:
            if prior != "" and (prior in ends or prior.__class__ is int) and text.find("\n", at, m.start()) >= 0:
                first = new if plain else new[0]
                if go or (stack[-1][0] not in ("(", "[") and first not in _NO_NL and not (first in ")]}")):
                    now.append("NL")
            at = m.end() if end < 0 else end
        if plain:
            now.append(new)
            prior = new
            continue
        if rust and len(new) == 1:
            t = new[0]
            if t == "." and now and now[-1] in ("..", ".") and text[m.start() - 1] == ".":
                now[-1] = prior = ".." if now[-1] == "." else "..."
                continue
            if t == "=" and now and now[-1] == ".." and text[m.start() - 1] == ".":
                now[-1] = prior = "..="
                continue
        for t in new:
            if t in ("(", "[", "{"):
                stack.append((t, []))
                now = stack[-1][1]
                prior = ""
            elif t in _CLOSE:
                if stack[-1][0] != _CLOSE[t]:
                    raise _Reject
                bracket, inner = stack.pop()
                now = stack[-1][1]
                prior = _close(g, bracket, inner, dialect)
                now.append(prior)
            else:
                if t in soft:
                    t = t if t in _MEANT and _soft(t, text, m.end()) else "ID"
                now.append(t)
                prior = t
    if len(stack) > 1:
        raise _Reject
    if lines and now and now[-1] not in (";", "NL"):
        now.append("NL")
    return g.derives(START[dialect], _expand(g, now, dialect, top=True))


def _soft(word: str, text: str, at: int) -> bool:
    """Is a word that is reserved in some places meant as such here?"""
    return _MEANT[word].match(text, at) is not None


_MEANT = {
    "macro_rules": re.compile(r"\s*!"),
    "union": re.compile(r"\s*[A-Za-z_]\w*\s*(?:<[^>]*>\s*)?(?:where\b|\{)"),
    "raw": re.compile(r"\s*(?:const|mut)\b"),
}


#: Words that are names wherever a name may stand.
_NAMES = {"js": frozenset("async get set of from as accessor".split())}
_NAMES["ts"] = _NAMES["js"] | (KEYWORDS["ts"] - KEYWORDS["js"])


def _expand(g: Grammar, inner: list, dialect: str, top: bool = False) -> tuple:
    """Names in JavaScript may be any word after a dot or before a colon: mark those places."""
    if dialect in ("js", "ts"):
        words = KEYWORDS[dialect] - _NAMES[dialect]
        out = list(inner)
        last = len(out) - 1
        for i, t in enumerate(out):
            if t.__class__ is str and t in words and ((i and out[i - 1] in (".", "?.")) or (i < last and _as_key(g, out, i))):
                out[i] = "WORD"
        return tuple(out)
    return tuple(inner)


def _as_key(g: Grammar, out: list, i: int) -> bool:
    """Is the reserved word ``out[i]`` the key of a property or member, or a name in a list?"""
    after = out[i + 1]
    before = out[i - 1] if i else ","
    if before in (",", "{", ";", "NL", "static", "async", "get", "set", "*", "readonly", "as") or before.__class__ is int:
        if out[i] in ("default", "case") and after == ":":
            return False
        if after == ":":
            return before != ";" and out[i] not in ("default",)
        if after in (",", "as"):
            return out[i] not in ("this", "super", "null", "true", "false", "var", "let", "const", "function", "class", "return", "import", "export")
        if after.__class__ is int and g.groups[after][0] == "(":
            return out[i] in ("delete", "default", "new", "catch", "finally", "throw", "return", "in", "with", "continue", "do", "try", "package", "interface", "enum", "export", "var", "const", "null", "true", "false", "else", "extends", "void", "typeof", "yield", "static", "public", "private", "protected", "implements", "let", "break", "case", "debugger", "class") and i + 2 < len(out) and out[i + 2].__class__ is int and g.groups[out[i + 2]][0] == "{" and out[i] not in ("catch",)
    return False


def _close(g: Grammar, bracket: str, inner: list, dialect: str) -> int:
    if dialect in ("js", "ts"):
        if bracket == "{" and inner and inner[-1] not in (";", "NL", ","):
            return _both(g, bracket, inner, dialect)
        return g.group(bracket, _expand(g, inner, dialect))
    if dialect == "go" and bracket in "{(" and inner and inner[-1] not in (";", "NL"):
        return _both(g, bracket, inner, dialect)
    return g.group(bracket, tuple(inner))


def _both(g: Grammar, bracket: str, inner: list, dialect: str) -> int:
    """A pair whose last statement needs no end: statements see one, lists do not."""
    plain = _expand(g, inner, dialect)
    key = (bracket, "both", plain)
    found = g.known.get(key)
    if found is None:
        a = g.groups[g.group(bracket, plain)][1]
        b = g.groups[g.group(bracket, _expand(g, [*inner, "NL"], dialect))][1]
        names = a | b
        found = g.classes.get((bracket, names))
        if found is None:
            found = g.classes[(bracket, names)] = len(g.groups)
            g.groups.append((bracket, names))
        g.known[key] = found
    return found


_PREFIX = re.compile(r"[^\W\d]*")
_PREFIXES = frozenset(["", "r", "b", "u", "f", "br", "rb", "fr", "rf"])
_TEXT_PART = {"`": re.compile(r"[^\\`$]+")} | {q: re.compile(rf"[^\\{q[0]}{{}}\n]+") for q in ("'", '"')} | {q * 3: re.compile(rf"[^\\{q}{{}}]+") for q in ("'", '"')}
_CONVERSION = re.compile(r"\s*[rsa]\s*(?=[:}])")


class _Open:
    """A formatted string or template that is being read: its quotes, and the field it is in."""

    __slots__ = ("quote", "raw", "start", "depth", "spec")

    def __init__(self, quote: str, raw: bool):
        self.quote, self.raw, self.start, self.depth, self.spec = quote, raw, -1, 0, 0


def _open_string(s: str, at: int, text: str) -> tuple[_Open, int]:
    prefix = _PREFIX.match(text, at).group()
    q = at + len(prefix)
    quote = text[q] * 3 if text[q] != "`" and text.startswith(text[q] * 3, q) else text[q]
    return _Open(quote, "r" in prefix.lower()), q + len(quote)


def _is_formatted(text: str, at: int) -> bool:
    c = text[at]
    return c == "`" or (c in "fFrR" and "f" in _PREFIX.match(text, at).group().lower())


def _fields(text: str, at: int, dialect: str) -> tuple[int, list[str]]:
    """The end of the formatted string (or template) at ``at`` and the code of its fields, those of
    strings within fields too.  A stack takes the place of recursion, so depth does not matter."""
    js = dialect != "py"
    lexer = MASTER["js" if js else "py"]
    now, i = _open_string("", at, text)
    stack = [now]
    code: list[str] = []
    n = len(text)
    while stack:
        now = stack[-1]
        if now.start < 0:  # among the text, or in a format
            if i >= n:
                raise _Reject
            m = _TEXT_PART[now.quote].match(text, i)
            if m:
                i = m.end()
                if i >= n:
                    raise _Reject
            c = text[i]
            if c == "\\":
                if js or text[i + 1 : i + 2] not in ("{", "}"):
                    if not js and not now.raw and text.startswith("N{", i + 1):
                        i = text.find("}", i)
                        if i < 0:
                            raise _Reject
                        i += 1
                    else:
                        i += 2
                else:
                    i += 1
            elif text.startswith(now.quote, i):
                if now.spec:
                    raise _Reject
                stack.pop()
                i += len(now.quote)
            elif js:
                if c == "$" and text.startswith("{", i + 1):
                    i += 2
                    now.start, now.depth = i, 0
                else:
                    i += 1
            elif c == "{":
                if not now.spec and text.startswith("{", i + 1):
                    i += 2
                else:
                    i += 1
                    now.start, now.depth = i, 0
            elif c == "}":
                if now.spec:
                    now.spec -= 1
                    i += 1
                elif text.startswith("}", i + 1):
                    i += 2
                else:
                    raise _Reject
            elif c == "\n" and len(now.quote) == 1:
                raise _Reject
            else:
                i += 1
            continue
        m = lexer.search(text, i)
        if m is None:
            raise _Reject
        kind, s, a = m.lastgroup, m.group(), m.start()
        i = m.end()
        if (kind == "s" or s == "`" or kind == "w") and _is_formatted(text, a) and (s[0] == "`" or kind == "s"):
            inner, i = _open_string(s, a, text)
            stack.append(inner)
        elif kind == "o" and s in ("(", "[", "{"):
            now.depth += 1
        elif kind == "o" and s in (")", "]", "}") and now.depth:
            now.depth -= 1
        elif kind == "o" and now.depth == 0 and s == "}":
            code.append(text[now.start : a])
            now.start = -1
        elif not js and kind == "o" and now.depth == 0 and (s[0] == ":" or s == "!" or (s == "=" and _SHOWN.match(text, i))):
            code.append(text[now.start : a])
            i = a + 1
            if s == "=":
                i = _SPACE.match(text, i).end()
                s = text[i]
                i += 1
            if s == "!":
                m = _CONVERSION.match(text, i)
                if not m:
                    raise _Reject
                i = m.end() + 1
                s = text[m.end()]
            now.start = -1
            if s[0] == ":":
                now.spec += 1
    return i, code


_SHOWN = re.compile(r"\s*[}!:]")
_SPACE = re.compile(r"\s*")

#: Verdicts on the code of fields seen so far, by dialect and code.
_CODE: dict[tuple[str, str], bool] = {}


def _check_field(x: str, dialect: str) -> None:
    key = (dialect, x)
    ok = _CODE.get(key)
    if ok is None:
        if len(_CODE) > 100_000:
            _CODE.clear()
        try:
            ok = _python(x, field=True) if dialect == "py" else _braces(f"({x}\n)", dialect, nested=True)
        except _Reject:
            ok = False
        _CODE[key] = ok
    if not ok:
        raise _Reject


#: Formatted strings and templates that were found right, by dialect.
_WHOLE: set[tuple[str, str]] = set()


def _special(text: str, start: int, end: int, dialect: str, nested: bool) -> int:
    """The true end of the formatted string or template at ``start``, which the lexer ends at ``end``; the
    code of its fields is checked unless it is ``nested``, for then the string around has collected it."""
    key = (dialect, text[start:end])
    if key in _WHOLE:
        return end
    to, code = _fields(text, start, dialect)
    if not nested:
        for x in code:
            _check_field(x, dialect)
        if to == end:
            if len(_WHOLE) > 100_000:
                _WHOLE.clear()
            _WHOLE.add(key)
    return to


def _python(text: str, field: bool = False) -> bool:
    """Is the text a file (or the code of a field) of Python?"""
    g = grammar("py")
    words = KEYWORDS["py"]
    stack: list[tuple[str, list]] = [("", [])]
    now = stack[0][1]
    indents = [0]
    depth = base = 1 if field else 0  # of brackets
    fresh = True  # at the start of a logical line
    at = 0

    def end_line() -> None:
        nonlocal fresh
        if not fresh:
            now.append("NL")
            fresh = True

    lexer = MASTER["py"]
    matches = lexer.finditer(text)
    while True:
        m = next(matches, None)
        if m is None:
            break
        kind, s = m.lastgroup, m.group()
        if depth == 0:
            start = m.start()
            if not fresh and text.find("\n", at, start) >= 0:
                end_line()
            at = m.end()
        if kind == "c":
            continue
        if s[0] == "\\" and len(s) > 1:
            continue
        if depth == 0 and fresh:
            line = text[text.rfind("\n", 0, start) + 1 : start].replace("\x0c", "")
            if not line.strip():
                width = len(line.expandtabs(8))
                if width > indents[-1]:
                    if not (len(now) > 1 and now[-1] == "NL" and now[-2] == ":"):
                        return False
                    now.pop()
                    indents.append(width)
                    stack.append(("I", []))
                    now = stack[-1][1]
                else:
                    while width < indents[-1]:
                        indents.pop()
                        inner = stack.pop()[1]
                        now = stack[-1][1]
                        now.append(g.group("I", tuple(inner)))
                    if width != indents[-1]:
                        return False
            fresh = False
        if kind == "w":
            now.append(s if s in words else "ID")
        elif kind == "n":
            if not _NUMBER["py"].match(s):
                return False
            now.append("NUM")
        elif kind == "s":
            if s[0] not in "\"'":
                if _PREFIX.match(s).group().lower() not in _PREFIXES:
                    return False
                if _is_formatted(s, 0) and ("{" in s or "}" in s):
                    end = _special(text, m.start(), m.end(), "py", field)
                    if end != m.end():
                        matches = lexer.finditer(text, end)
                        at = end
            now.append("STR")
        elif s in "([{":
            stack.append((s, []))
            now = stack[-1][1]
            depth += 1
        elif s in ")]}":
            if stack[-1][0] != _CLOSE[s]:
                return False
            bracket, inner = stack.pop()
            now = stack[-1][1]
            now.append(g.group(bracket, tuple(inner)))
            depth -= 1
            at = m.end()
        elif s in "\"'`\\$?!#":
            return False
        else:
            now.append(s)
    if depth != base:
        return False
    if field:
        return len(stack) == 1 and g.derives("Field", tuple(now))
    end_line()
    while len(stack) > 1:
        inner = stack.pop()[1]
        now = stack[-1][1]
        now.append(g.group("I", tuple(inner)))
    return g.derives("File", tuple(now))


def valid(path: str | None, text: str | None) -> bool | None:
    """Does the file parse in a dialect of its extension?  None where the question does not arise."""
    dialects = DIALECTS.get(extension(path))
    if dialects is None or not text:
        return None
    return any(parses(text, d) for d in dialects)


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, valid, repo, extension) of the latest row of each file; null where no case can arise."""

    def run(batches):
        for batch in batches:
            paths = batch["path"].to_pylist()
            verdicts = [valid(p, t) for p, t in zip(paths, batch["content"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch["file_id"], batch["at"], pa.array(verdicts, pa.bool_()), batch["repo"], pa.array([extension(p) for p in paths], pa.string())],
                ["file_id", "at", "valid", "repo", "extension"],
            )

    at = F.unix_micros(F.coalesce("ingested_at", F.lit(0).cast("timestamp"))).alias("at")
    rows = spread(files.select("file_id", at, "repo", "path", "content")).mapInArrow(
        run, "file_id bigint, at bigint, valid boolean, repo string, extension string"
    )
    last = F.max_by(F.struct("valid", "repo", "extension"), F.struct("at", "valid"))
    return rows.groupBy("file_id").agg(last.alias("x")).select("file_id", "x.*")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "files", "file_id", "repo", "path", "content", "ingested_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id of every file that is not valid in the language of its extension."""
    return parsed(_files(spark, sf_dir)).where(~F.col("valid")).select("file_id")


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, invalid files and their rate per repository and extension, with totals of either."""
    known = parsed(_files(spark, sf_dir)).where("valid is not null")
    return known.cube("repo", "extension").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("files"),
        F.count_if(~F.col("valid")).alias("invalid"),
        F.avg(F.when(F.col("valid"), 0.0).otherwise(1.0)).alias("rate"),
    )


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates}
ORACLES: dict[str, str] = {}
