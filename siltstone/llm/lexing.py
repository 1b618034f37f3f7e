"""Lexers for source text, one regular expression per family of languages.

A token is (kind, start, end) with kind one of ``c`` comment, ``s`` string, ``r`` regular
expression, ``n`` number, ``w`` word, ``o`` operator or bracket (one character, or two for the
operators listed), ``b`` a character that starts no token (such as an unclosed quote).
White space yields no tokens.
"""

from __future__ import annotations

import re

#: Extensions of each family.
FAMILY = {
    "js": "js", "mjs": "js", "cjs": "js", "jsx": "js", "ts": "js", "tsx": "js",
    "java": "java", "kt": "java", "c": "java", "h": "java", "cpp": "java", "cs": "java",
    "go": "go", "rs": "rs", "py": "py", "json": "json",
    "yml": "conf", "yaml": "conf", "toml": "conf", "env": "conf", "local": "conf", "ini": "conf",
    "sh": "conf", "bash": "conf", "cfg": "conf", "properties": "conf",
}

_LINE = r"//[^\n]*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/"
_QUOTED = r"\"(?:[^\"\\\n]|\\[\s\S])*+\""
_SINGLE = r"'(?:[^'\\\n]|\\[\s\S])*+'"
_NUMBER = r"(?<![\w$])(?:0[xXoObB][\w]+|\.?\d(?:[eE][+-]?\d|[\w.])*)"
_WORD = r"[^\W\d][\w$]*|[$#@][\w$]*"
_OPS = r"===|!==|\*\*=|\.\.\.|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|:=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|[-+*/%&|^!<>=]=|<-|\*\*|<<|\S"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*+\})*+`"

_SPEC = {
    "js": [
        ("c", rf"{_LINE}|{_BLOCK}|\A\#![^\n]*"),
        ("s", rf"{_QUOTED}|{_SINGLE}|{_TEMPLATE}"),
        ("r", r"(?:(?<=[=(,:\[!&|?{};+~])|(?<=[=(,:\[!&|?{};+~]\s)|(?<=return\s)|(?<=\n)|(?<==>\s))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*"),
        ("n", _NUMBER),
        ("w", _WORD),
        ("o", _OPS),
    ],
    "java": [
        ("c", rf"{_LINE}|{_BLOCK}"),
        ("s", rf'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|{_QUOTED}|{_SINGLE}'),
        ("n", _NUMBER),
        ("w", _WORD),
        ("o", _OPS),
    ],
    "go": [
        ("c", rf"{_LINE}|{_BLOCK}"),
        ("s", rf"{_QUOTED}|{_SINGLE}|`[^`]*`"),
        ("n", _NUMBER),
        ("w", _WORD),
        ("o", _OPS),
    ],
    "rs": [
        ("c", rf"{_LINE}|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*+\*/)*+\*/"),
        ("s", r"[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*+\"|b?'(?:[^'\\\n]|\\(?:u\{[^}]*\}|x..|.))'"),
        ("n", _NUMBER),
        ("w", rf"r\#\w+|'[^\W\d]\w*|{_WORD}"),
        ("o", _OPS),
    ],
    "py": [
        ("c", r"\#[^\n]*"),
        (
            "s",
            r"(?:[rRbBuUfFtT]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
            rf"|{_QUOTED}|{_SINGLE})",
        ),
        ("n", _NUMBER),
        ("w", r"[^\W\d]\w*"),
        ("o", r"\*\*=|//=|>>=|<<=|\.\.\.|[-+*/%&|^!<>=:@]=|->|\*\*|//|<<|>>|\\\r?\n|\S"),
    ],
    "json": [("s", _QUOTED), ("n", r"-?\d[\w.+-]*"), ("w", r"[^\W\d]\w*"), ("o", r"\S")],
    "conf": [("c", r"(?:(?<=\s)|\A)\#[^\n]*"), ("s", rf"{_QUOTED}|{_SINGLE}"), ("n", _NUMBER), ("w", r"[^\W\d][\w.-]*"), ("o", r"\S")],
}

MASTER = {
    family: re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in spec), re.ASCII if family == "json" else 0)
    for family, spec in _SPEC.items()
}


def extension(path: str | None) -> str:
    """The part of the file name after its last dot, in lower case."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


def lex(text: str, family: str) -> list[tuple[str, int, int]]:
    """Tokens of ``text``."""
    return [(m.lastgroup, m.start(), m.end()) for m in MASTER[family].finditer(text)]
