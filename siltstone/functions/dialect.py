"""Regular expressions and globs of the rule packs, in the dialects of Spark (Java) and of RE2."""

from __future__ import annotations

import re

#: What \s, \w and \d mean to the rules (all white space; ASCII words and digits).
SPACE = r"\t-\r \x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _translate(pattern: str, java: bool, multiline: bool) -> str:
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif two == r"\S" and not inside:
            out.append(f"[^{SPACE}]")
            i += 2
        elif two == r"\w" and java:
            out.append("A-Za-z0-9_" if inside else "[A-Za-z0-9_]")
            i += 2
        elif two == r"\b" and not inside and java:
            out.append(_EDGE)
            i += 2
        elif c == "\\":
            out.append(two)
            i += 2
        elif c == "$" and not inside:
            out.append((r"(?=\n|\z)" if multiline else r"\z") if java else "$")
            i += 1
        else:
            if c == "[" and not inside:
                inside = True
            elif c == "[" and java:
                out.append("\\")  # Java would read a nested class
            elif c == "]" and inside:
                inside = False
            elif c == "&" and inside and java:
                out.append("\\")
            out.append(c)
            i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """The pattern for ``rlike``; ``multiline`` lets ^ and $ stand at every line."""
    flags = ("i" if ignore_case else "") + ("m" if multiline else "")
    return (f"(?{flags})" if flags else "") + _translate(pattern, True, multiline)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for DuckDB."""
    return ("(?i)" if ignore_case else "") + _translate(pattern, False, False)


def glob(pattern: str) -> str:
    """An exclude glob as a regular expression for the whole path.

    ``*`` and ``**`` cross folders, everything else (braces too) stands for itself, and a glob with
    more than ten stars matches nothing.
    """
    if pattern.count("*") > 10:
        return r"[^\s\S]"
    return "".join(".*" if p.startswith("*") else re.sub(r"([^\w/ -])", r"\\\1", p) for p in re.split(r"(\*+)", pattern) if p)


def globs(patterns: tuple[str, ...]) -> str:
    """One anchored expression for several globs."""
    return "^(?:" + "|".join(glob(p) for p in patterns) + ")$"


def quote(text: str) -> str:
    """An SQL string literal for DuckDB."""
    return "'" + text.replace("'", "''") + "'"
