"""Problem 2: functions paired with their documentation.

Each file is lexed; functions and methods, and comments (or docstrings) that may document one, are
found among the tokens, never inside strings or comments.  A function has several candidates: the
comments above it, also beyond a blank line or another comment, the first one in its body and one
that trails its head.  Each link has a score from its place and distance, the parameters that the
tags name and the mention of the function's name; links below ``LEAST`` are rejected, and a bipartite
assignment (Hungarian method, whatever the size of a component) picks links of greatest total score,
so that no comment documents two functions.  An exact check follows: the pairs given out are those
whose comment stands where problem 2 wants documentation to stand and whose description informs.

Defined results: null and empty content and files that problem 6 finds hold no pairs; of the rows
of one file the latest counts; repeated rows count once; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.lexing import FAMILY, extension, lex
from siltstone.llm.parsing import valid
from siltstone.plans import scan, spread

#: The extensions in question.
LANGUAGES = frozenset("js mjs jsx ts py java go rs".split())

_BEFORE_JS = frozenset("export default async function const let var static get set public private protected readonly override abstract declare accessor *".split())
_NOT_NAMES = frozenset("if for while switch catch return function new typeof await super with do else delete void in of instanceof throw case yield synchronized try assert".split())
_CLOSERS = {")": "(", "]": "[", "}": "{"}


class Function:
    """A function: its name, the line of the name, its parameters, and where it starts and ends."""

    __slots__ = ("name", "at", "params", "first", "comments", "last")

    def __init__(self, name: str, at: int, params: list[str], first: int, comments: list[int], last: int):
        self.name, self.at, self.params, self.first, self.comments, self.last = name, at, params, first, comments, last


def _match(text: str, tokens: list) -> dict[int, int]:
    """Token number of each bracket's partner."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for i, (kind, a, b) in enumerate(tokens):
        if kind == "o" and b - a == 1:
            c = text[a]
            if c in "([{":
                stack.append(i)
            elif c in ")]}" and stack and text[tokens[stack[-1]][1]] == _CLOSERS[c]:
                j = stack.pop()
                out[i], out[j] = j, i
    return out


def _names(text: str, tokens: list, a: int, b: int, pair: dict[int, int]) -> list[str]:
    """Names of the parameters between two parentheses."""
    out, i, fresh = [], a + 1, True
    while i < b:
        kind, s, e = tokens[i]
        t = text[s:e]
        if kind == "o" and i in pair and pair[i] > i:
            i = pair[i]
        elif t == ",":
            fresh = True
        elif kind == "w" and fresh and t not in ("mut", "ref", "final", "public", "private", "readonly"):
            out.append(t)
            fresh = False
        i += 1
    return out


def functions(text: str, family: str, tokens: list) -> list[Function]:
    """Functions and methods of a text, with the comments that stand before them."""
    words = [text[a:b] for _, a, b in tokens]
    pair = _match(text, tokens)
    n = len(tokens)
    found: list[Function] = []

    def code(i: int, step: int = 1) -> int:
        while 0 <= i < n and tokens[i][0] == "c":
            i += step
        return i

    def body(i: int) -> int:
        """The token that ends the body which starts after token ``i``."""
        while i < n and words[i] not in ("{", ";"):
            i = pair[i] + 1 if words[i] in ("(", "[") and i in pair else i + 1
        return pair.get(i, i) if i < n else n - 1

    def before(i: int, allowed, annotated: bool) -> tuple[int, list[int]]:
        """Start of the declaration that token ``i`` belongs to, and the comments before it."""
        first, comments = i, []
        i -= 1
        while i >= 0:
            w, kind = words[i], tokens[i][0]
            if kind == "c":
                comments.append(i)
            elif comments and not (w == "]" or w.startswith("@") or w == ")"):
                break
            elif w == ")" and i in pair and annotated:
                j = pair[i]
                k = j - 1
                while k > 0 and (words[k] == "." or (tokens[k][0] == "w" and words[k - 1] == ".")):
                    k -= 1
                if words[k].startswith("@"):
                    i = first = k
                elif family == "rs" and words[k] == "pub":
                    i = first = k
                else:
                    break
            elif family == "rs" and w == "]" and i in pair and words[pair[i] - 1].endswith("#"):
                i = first = pair[i] - 1
            elif w.startswith("@") and len(w) > 1:
                first = i
            elif allowed(i):
                first = i
            else:
                break
            i -= 1
        return first, comments

    if family == "py":
        for i, w in enumerate(words):
            if w != "def" or tokens[i][0] != "w":
                continue
            j = code(i + 1)
            if j >= n or tokens[j][0] != "w":
                continue
            k = code(j + 1)
            if k < n and words[k] == "[" and k in pair:
                k = code(pair[k] + 1)
            if k >= n or words[k] != "(" or k not in pair:
                continue
            params = _names(text, tokens, k, pair[k], pair)
            k = pair[k] + 1
            while k < n and words[k] != ":":
                k = pair[k] + 1 if words[k] in ("[", "(", "{") and k in pair else k + 1
            d = code(k + 1)
            doc = []
            if d < n and tokens[d][0] == "s" and not re.match(r"(?i)[rt]?[bf]", words[d]):
                after = d + 1
                while after < n and tokens[after][0] == "s":
                    after += 1
                if after >= n or words[after] == ";" or "\n" in text[tokens[after - 1][2] : tokens[after][1]] or tokens[after][0] == "c":
                    doc = [d]
            found.append(Function(words[j], j, params, i, doc, d))
        return found

    if family == "go":
        for i, w in enumerate(words):
            if w != "func" or tokens[i][0] != "w":
                continue
            j = code(i + 1)
            if j < n and words[j] == "(" and j in pair:
                j = code(pair[j] + 1)
            k = code(j + 1)
            if j >= n or tokens[j][0] != "w" or k >= n or words[k] not in ("(", "["):
                continue
            if words[k] == "[" and k in pair:
                k = code(pair[k] + 1)
            if k not in pair:
                continue
            first, comments = before(i, lambda _: False, False)
            found.append(Function(words[j], j, _names(text, tokens, k, pair[k], pair), first, comments, body(pair[k] + 1)))
        return found

    if family == "rs":
        quiet = frozenset("pub async const unsafe extern default".split())
        for i, w in enumerate(words):
            if w != "fn" or tokens[i][0] != "w":
                continue
            j = code(i + 1)
            if j >= n or tokens[j][0] != "w":
                continue
            k = j + 1
            depth = 0
            while k < n and (words[k] != "(" or depth):
                depth += words[k].count("<") - words[k].count(">") if words[k] != "->" else 0
                if words[k] in ("{", ";"):
                    break
                k += 1
            if k >= n or words[k] != "(" or k not in pair:
                continue
            first, comments = before(i, lambda x: words[x] in quiet or tokens[x][0] == "s", True)
            found.append(Function(words[j], j, _names(text, tokens, k, pair[k], pair), first, comments, body(pair[k] + 1)))
        return found

    # JavaScript, TypeScript and Java: classes are told apart from other braces
    owner: list[str] = [""]
    pending = ""
    for i, (kind, a, b) in enumerate(tokens):
        w = words[i]
        if kind == "w" and w in ("class", "interface", "enum", "record") and (i == 0 or words[i - 1] != "."):
            if family == "java" or w == "class":
                pending = "class"
            continue
        if kind == "o":
            if w == "{":
                owner.append(pending or "block")
                pending = ""
            elif w == "}" and len(owner) > 1:
                owner.pop()
            continue
        if kind != "w" or w in _NOT_NAMES:
            continue
        nxt = code(i + 1)
        if nxt >= n:
            continue
        member = owner[-1] == "class"
        if family == "java":
            if member and words[nxt] == "(" and nxt in pair and words[i - 1] not in (".", "new", "=") and not w.startswith("@"):
                close = pair[nxt]
                after = code(close + 1)
                if after < n and words[after] in ("{", ";", "throws", "[", "default"):
                    first, comments = before(i, lambda x: words[x] not in (";", "{", "}"), True)
                    found.append(Function(w, i, _names(text, tokens, nxt, close, pair), first, comments, body(after)))
            continue
        previous = words[i - 1] if i else ""
        opening = -1
        if previous == "function" or (previous == "*" and i > 1 and words[i - 2] == "function"):
            opening = nxt
        elif member and previous not in (".", "new", "=", "=>", ":", "?", "(", ",", "[", "extends", "return"):
            if words[nxt] in ("(", "<", "?"):
                opening = nxt
            elif words[nxt] in ("=", ":"):
                opening = -2
        elif previous in ("const", "let", "var") and words[nxt] in ("=", ":"):
            opening = -2
        if opening == -1:
            continue
        k = nxt
        if opening == -2:  # a value: is it a function?
            while k < n and words[k] not in ("=", ";", "}"):
                k = pair[k] + 1 if words[k] in ("(", "[", "{") and k in pair else k + 1
            k = code(k + 1)
            if k < n and words[k] == "async":
                k = code(k + 1)
            if k < n and words[k] == "function":
                while k < n and words[k] != "(":
                    k += 1
                arrow = False
            else:
                arrow = True
                if k < n and tokens[k][0] == "w" and words[code(k + 1) if k + 1 < n else k] == "=>":
                    first, comments = before(i, lambda x: words[x] in _BEFORE_JS, True)
                    found.append(Function(w, i, [words[k]], first, comments, body(k + 1)))
                    continue
        else:
            arrow = False
        if k < n and words[k] == "?":
            k += 1
        if k < n and words[k] == "<":
            depth = 0
            while k < n:
                depth += (words[k] == "<") - words[k].count(">") * (words[k] != "=>")
                k += 1
                if depth <= 0:
                    break
        if k >= n or words[k] != "(" or k not in pair:
            continue
        close = pair[k]
        after = code(close + 1)
        if after < n and words[after] == ":":
            angle = 0
            while after < n and not (angle <= 0 and words[after] in ("{", ";", "=>") and not (words[after] == "{" and words[after - 1] in (":", "|", "&", "<", ","))):
                angle += (words[after] == "<") - words[after].count(">") * (words[after] != "=>")
                after = pair[after] + 1 if words[after] in ("(", "[", "{") and after in pair else after + 1
        if after >= n or words[after] != ("=>" if arrow else "{"):
            if not (member and not arrow and after < n and words[after] == ";"):
                continue
        first, comments = before(i, lambda x: words[x] in _BEFORE_JS, True)
        found.append(Function(w, i, _names(text, tokens, k, close, pair), first, comments, body(after)))
    return found


def description(comment: str, family: str) -> str:
    """The words of a comment without its marks and tag parts."""
    if family == "py":
        comment = re.sub(r"^[A-Za-z]{0,2}(\"\"\"|'''|[\"'])|(\"\"\"|'''|[\"'])$", "", comment)
    out = []
    for line in comment.splitlines():
        line = line.strip()
        if family != "py":
            line = re.sub(r"^(?:/\*\*?|//[/!]?|\*(?!/))\s?|\*/$", "", line)
            line = re.sub(r"\*/$", "", line).strip().lstrip("*").strip()
        if line.startswith("@"):
            continue
        if re.match(r"(?:Args|Arguments|Parameters)\s*:", line):
            break
        out.append(line)
    return "\n".join(out).strip()


_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def informative(text: str, name: str) -> bool:
    """At least four words, not all of which occur in the function's name."""
    words = [w.lower() for w in _WORDS.findall(text)]
    if len(words) < 4:
        return False
    flat = name.lower()
    return not all(w in flat for w in words)


_TAG = re.compile(r"@param\s+(?:\{[^}]*\}\s*)?\[?(\w+)|^\s*(\w+)\s*(?:\([^)]*\))?:", re.M)


#: What a link is worth by the place of its comment, and the least that is plausible.
PLACES = {"own": 3.0, "above": 1.6, "inside": 1.4, "trailing": 1.2}
LEAST = 1.0


def score(doc: str, place: str, gap: int, name: str, params: list[str]) -> float:
    """How plausible it is that ``doc`` documents the function.

    Tags that name none of the parameters speak against a link, so a comment that stands near loses
    to one further off that describes the function, if both can be had.
    """
    tags = {a or b for a, b in _TAG.findall(doc)} if ("@param" in doc or ":" in doc) else None
    total = PLACES[place] - 0.2 * min(max(gap - 1, 0), 10)
    if tags:
        total += 2.0 * len(tags & set(params)) / len(tags) if params else 0.0
        if "@param" in doc and tags.isdisjoint(params):
            total -= 1.5
    return total + 0.5 * (name in doc)


def _assign(scores: dict[tuple[int, int], float]) -> dict[int, int]:
    """Bipartite assignment of greatest total score: function -> comment."""
    by_function: dict[int, list[int]] = {}
    by_comment: dict[int, list[int]] = {}
    for f, c in scores:
        by_function.setdefault(f, []).append(c)
        by_comment.setdefault(c, []).append(f)
    out: dict[int, int] = {}
    done: set[int] = set()
    for start, first in by_function.items():
        if start in done:
            continue
        if len(first) == 1 and len(by_comment[first[0]]) == 1:
            out[start] = first[0]
            continue
        fs, cs, work = [], set(), [start]
        done.add(start)
        while work:
            f = work.pop()
            fs.append(f)
            for c in by_function[f]:
                if c not in cs:
                    cs.add(c)
                    for other in by_comment[c]:
                        if other not in done:
                            done.add(other)
                            work.append(other)
        columns = sorted(cs)
        rows = sorted(fs)
        # one column more for each function that goes without
        cost = [[-scores.get((f, c), -1e6) for c in columns] + [0.0] * len(rows) for f in rows]
        for f, at in zip(rows, _hungarian(cost)):
            if at < len(columns) and (f, columns[at]) in scores:
                out[f] = columns[at]
    return out


def _hungarian(cost: list[list[float]]) -> list[int]:
    """Column of each row in an assignment of least cost, by shortest augmenting paths; no fewer columns than rows."""
    n, m = len(cost), len(cost[0])
    row_price, column_price = [0.0] * n, [0.0] * m
    holder = [-1] * m
    for start in range(n):
        best, via, open_ = [float("inf")] * m, [-1] * m, set(range(m))
        row, column = start, -1
        while True:
            step, nearest = float("inf"), -1
            for j in open_:
                slack = cost[row][j] - row_price[row] - column_price[j]
                if slack < best[j]:
                    best[j], via[j] = slack, column
                if best[j] < step:
                    step, nearest = best[j], j
            row_price[start] += step
            for j in range(m):
                if j in open_:
                    best[j] -= step
                else:
                    row_price[holder[j]] += step
                    column_price[j] -= step
            column = nearest
            open_.discard(column)
            if holder[column] < 0:
                break
            row = holder[column]
        while column >= 0:
            holder[column] = holder[via[column]] if via[column] >= 0 else start
            column = via[column]
    out = [-1] * n
    for j, i in enumerate(holder):
        if i >= 0:
            out[i] = j
    return out


def _candidates(text, family, tokens, fn, line_of, comments: list[int]) -> list[tuple[int, int, str, int]]:
    """(start, end, place, gap) of the comments that may document ``fn``; the one that stands where
    documentation should comes first, as "own"."""
    out = []
    own = _block(text, family, tokens, fn, line_of) if fn.comments else None
    head = line_of(tokens[fn.first][1])
    if own:
        out.append((*own, "own", 0))
    if not comments:
        return out
    if family != "py":
        seen = 0
        for i in fn.comments:  # nearest first
            _, a, b = tokens[i]
            if own and a < own[1]:
                if a >= own[0]:
                    continue
            seen += 1
            if seen > 2:
                break
            if not text[text.rfind("\n", 0, a) + 1 : a].strip():
                out.append((a, b, "above", head - line_of(b - 1)))
    at = bisect_right(comments, fn.at)
    if at < len(comments) and comments[at] < fn.last:
        i = comments[at]
        _, a, b = tokens[i]
        previous = text[tokens[i - 1][1] : tokens[i - 1][2]]
        if previous in ("{", ":"):
            same = line_of(a) == line_of(tokens[i - 1][1])
            out.append((a, b, "trailing" if same else "inside", 0))
    return out


def links(text: str, family: str, tokens: list, todo: list[Function], line_of) -> tuple[dict[int, int], dict[int, tuple[int, int]], dict[int, int]]:
    """(function -> start of its comment, start -> span, function -> start of the comment where one should stand)."""
    comments = [i for i, t in enumerate(tokens) if t[0] == "c"]
    spans: dict[int, tuple[int, int]] = {}
    scores: dict[tuple[int, int], float] = {}
    wanted: dict[int, int] = {}
    for f, fn in enumerate(todo):
        for a, b, place, gap in _candidates(text, family, tokens, fn, line_of, comments):
            if place == "own":
                wanted[f] = a
                spans[a] = (a, b)
            worth = score(text[a:b], place, gap, fn.name, fn.params)
            if worth >= LEAST:
                spans.setdefault(a, (a, b))
                scores[(f, a)] = max(worth, scores.get((f, a), 0.0))
    return _assign(scores), spans, wanted


def pairs(text: str | None, path: str | None, check: bool = True, trivial: bool = False) -> list[tuple[int, int, str, str, str, int, int]]:
    """(line, documentation line, name, description, code, documentation lines, code lines)."""
    ext = extension(path)
    if not text or ext not in LANGUAGES:
        return []
    family = FAMILY[ext]
    tokens = lex(text, family)
    line_of = _lines(text)
    todo = functions(text, family, tokens)
    chosen, blocks, wanted = links(text, family, tokens, todo, line_of)
    out = []
    for f, key in chosen.items():
        if wanted.get(f) != key:
            continue
        fn = todo[f]
        a, b = blocks[key]
        words = description(text[a:b] if family in ("py", "js", "java") else _joined(text[a:b]), family)
        if trivial or informative(words, fn.name):
            start, end = tokens[fn.first][1], tokens[min(fn.last, len(tokens) - 1)][2]
            code = text[start:end]
            out.append((line_of(tokens[fn.at][1]), line_of(a), fn.name, words, code, line_of(b - 1) - line_of(a) + 1, code.count("\n") + 1))
    if out and check and not valid(path, text):
        return []  # asked last, as it is the dearest question
    return sorted(out)


def _joined(doc: str) -> str:
    return "\n".join(x.strip() for x in doc.splitlines() if x.strip().startswith("//"))


def _lines(text: str):
    """A function from offsets to line numbers."""
    import bisect

    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return lambda offset: bisect.bisect_right(starts, offset)


def _block(text, family, tokens, fn, line_of) -> tuple[int, int] | None:
    """The comment that documents ``fn`` if one stands where documentation may stand."""
    if family == "py":
        _, a, b = tokens[fn.comments[0]]
        return a, b
    near = fn.comments  # nearest first
    if family in ("js", "java"):
        _, a, b = tokens[near[0]]
        if not text.startswith("/**", a) or text.startswith("/**/", a):
            return None
        return (a, b) if _next_line(text, tokens, near[0], line_of) else None
    mark = "///" if family == "rs" else "//"
    taken = []
    for i in near:
        _, a, b = tokens[i]
        if not text.startswith(mark, a) or (family == "rs" and text.startswith("////", a)) or not _next_line(text, tokens, i, line_of):
            break
        if text[text.rfind("\n", 0, a) + 1 : a].strip():
            break  # ends a line of code
        taken.append(i)
    return (tokens[taken[-1]][1], tokens[taken[0]][2]) if taken else None


def _next_line(text, tokens, i, line_of) -> bool:
    """Does the token after comment ``i`` begin on the next line at the latest?"""
    return i + 1 < len(tokens) and line_of(tokens[i + 1][1]) - line_of(tokens[i][2] - 1) <= 1


PAIRS = "file_id bigint, at bigint, pairs array<struct<line:int,doc_line:int,name:string,description:string,code:string,doc_lines:int,code_lines:int>>"
_FIELDS = ("line", "doc_line", "name", "description", "code", "doc_lines", "code_lines")


def paired(files: DataFrame, texts: bool = True) -> DataFrame:
    """(file_id, line, doc_line, name, description, code, doc_lines, code_lines) of every pair."""
    kind = pa.list_(pa.struct([(n, pa.int32() if "line" in n else pa.string()) for n in _FIELDS]))

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                found = pairs(text, path)
                rows.append([dict(zip(_FIELDS, p if texts else (*p[:3], None, None, *p[5:]))) for p in found])
            yield pa.RecordBatch.from_arrays([batch["file_id"], batch["at"], pa.array(rows, kind)], ["file_id", "at", "pairs"])

    at = F.unix_micros(F.coalesce("ingested_at", F.lit(0).cast("timestamp"))).alias("at")
    source = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*LANGUAGES))
    rows = spread(source.select("file_id", at, "path", "content")).mapInArrow(run, PAIRS)
    last = rows.groupBy("file_id").agg(F.max_by("pairs", "at").alias("pairs"))
    return last.select("file_id", F.explode("pairs").alias("p")).select("file_id", "p.*")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every function with worthwhile documentation, its description and its code."""
    return paired(scan(spark, sf_dir, "files", "file_id", "path", "content", "ingested_at"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, line) of every function or method with worthwhile documentation."""
    return paired(scan(spark, sf_dir, "files", "file_id", "path", "content", "ingested_at"), texts=False).select("file_id", "line")


QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs}
ORACLES: dict[str, str] = {}
