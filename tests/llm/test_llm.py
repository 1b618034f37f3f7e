"""The operators for training data against brute force, round trips and worked cases."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import credentials, docpairs, neardup, packing, parsing, provenance, quality, spans, tokenize

TOKENIZER = tokenize.DEFAULT_VOCABULARY
BODY = "id bigint, text string"


# ---- 1
@pytest.mark.parametrize(
    "path, repo, text, reason",
    [
        ("a/vendor/x.js", "o/r", "let a = 1;", "outside"),
        ("a/vendor.js", "o/r", "let a = 1;", None),
        ("a/third_party_login.js", "o/r", "let a = 1;", None),
        ("a.go", "o/r", "// Code generated by x-gen v1.2. DO NOT EDIT.\npackage a\n", "generated"),
        ("a.go", "o/r", "// see DO NOT EDIT banner in x\npackage a\n", None),
        ("a.py", "o/r", "# Copyright (c) other\nx = 1\n", "origin"),
        ("a.py", "other/r", "# Copyright (c) other\nx = 1\n", None),
        ("a.js", "o/r", "x = 'Code generated by y v1. DO NOT EDIT.';\n", None),
        ("a.js", "o/r", "var a=1;function b(c){return c};" * 40, "minified"),
        ("a.py", "o/r", "x = [" + ", ".join(map(str, range(10000, 10300))) + "]\n", "data"),
        ("a.json", "o/r", '{"name": "' + "x" * 900 + '", "lockfileVersion": 3}', "lock"),
        ("a.json", "o/r", '{"name": "the \\"lockfileVersion\\": key"}', None),
        ("a.go", "o/r", "package a\n" + "var x = 1\n" * 3 + "\n" * 60 + "// Code generated by x-gen v1.2. DO NOT EDIT.\n" + "\n" * 30 + "var y = 2\n", "generated"),
        ("a.py", "o/r", None, None),
        ("a/vendor/b.py", "o/r", "", None),
        (None, None, "x = 1", None),
    ],
)
def test_provenance(path, repo, text, reason):
    assert provenance.judge(path, repo, text) == reason


def test_canonical_layout():
    lines = lambda x, f: provenance.canonical(x, docpairs.lex(x, f), f)
    short = "function f(a,b){for(let i=0;i<3;i++){g(a[i]);}return b}"
    long = "// says what\nfunction f(a, b) {\n  for (let i = 0; i < 3; i++) {\n    g(a[i]);\n  }\n  return b\n}\n"
    assert lines(short, "js") == lines(long, "js") and len(lines(short, "js")) == 6
    assert lines("x = [1,\n 2]\ny = 3\n", "py") == lines("x = [1, 2]\n\ny = 3", "py") and lines("", "py") == []


def test_provenance_table(spark):
    rows = [(1, "o/r", "vendor/a.js", "x", None), (1, "o/r", "vendor/a.js", "x", None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string, ingested_at timestamp")
    assert sorted((r.file_id, r.reason) for r in provenance.judged(df.withColumn("reason", F.lit("clash"))).collect()) == [(1, "outside"), (2, None)]
    assert provenance.judged(df.where("false")).count() == 0


# ---- 2
def found(path, text):
    return [(p[0], p[2]) for p in docpairs.pairs(text, path)]


def test_pairs_by_language():
    js = "/** Reads the whole file at once. */\nexport function a(x) {\n  return x;\n}\n/** short one */\nfunction b() {}\n/** Not right above it, sadly enough. */\n\nfunction c() {}\nclass K {\n  /**\n   * Gives back what was put in.\n   * @param y it\n   */\n  @dec(1)\n  async d(y) { return y; }\n}\n"
    assert found("a.ts", js) == [(2, "a"), (16, "d")]
    py = 'def a():\n    """Reads the whole file at once."""\n    return 1\n\n\ndef read_file():\n    "Read file read file"\n\n\nx = "def z(): pass"\n'
    assert found("a.py", py) == [(1, "a")]
    go = "package p\n\n// Read gives the whole file.\nfunc Read() int {\n\treturn 1\n}\n\n// far away from what follows\n\nfunc Far() int {\n\treturn 1\n}\n"
    assert found("a.go", go) == [(4, "Read")]
    rs = "/// Reads the whole file at once.\n#[inline]\npub fn read() -> i64 {\n    1\n}\n// Reads the whole file at once.\nfn no() -> i64 {\n    1\n}\n"
    assert found("a.rs", rs) == [(3, "read")]
    java = "class A {\n    /** Reads the whole file at once. */\n    @Override\n    public int read(int a) {\n        return a;\n    }\n}\n"
    assert found("A.java", java) == [(4, "read")]
    assert found("a.js", None) == [] and found("a.js", "") == [] and found(None, "x") == []
    assert found("a.js", js + "}") == []  # does not parse


def linked(path, text):
    family = docpairs.FAMILY[docpairs.extension(path)]
    tokens = docpairs.lex(text, family)
    todo = docpairs.functions(text, family, tokens)
    line_of = docpairs._lines(text)
    return {todo[f].name: line_of(a) for f, a in docpairs.links(text, family, tokens, todo, line_of)[0].items()}


def test_links_by_assignment():
    # the nearest comment names parameters of something else; the one beyond it describes the function
    text = "/**\n * Moves add on by a step.\n * @param left one\n * @param right other\n */\n\n/**\n * @param url where\n */\nfunction add(left, right) { return left + right; }\n"
    assert linked("a.js", text) == {"add": 1}
    # a comment in the body, one that trails the head, and none at all
    assert linked("a.js", "function a() {\n  // counts what there is\n  return 1;\n}\nfunction b() { // counts the rest\n  return 2;\n}\nfunction c() {}\n") == {"a": 2, "b": 5}
    # far away and about something else: rejected
    assert linked("a.js", "// one\n\n\n\n\n\nfunction a() {}\n") == {}
    # nested functions want the same comment: it goes to one of them
    text = "// outer counts all things\nfunction outer() {\n  // inner counts one thing\n  function inner() {}\n}\n"
    assert linked("a.js", text) == {"outer": 1, "inner": 3}


def test_assignment_is_best():
    r = random.Random(8)
    for _ in range(60):
        n, m = r.randint(1, 5), r.randint(1, 5)
        scores = {(f, c): r.random() for f in range(n) for c in range(m) if r.random() < 0.6}
        got = docpairs._assign(scores)
        assert len(set(got.values())) == len(got) and all(x in scores for x in got.items())
        best = max(sum(scores.get((f, c), -9) for f, c in enumerate(p) if c < m) for p in itertools.permutations(range(m + n), n))
        assert abs(sum(scores[x] for x in got.items()) - best) < 1e-9


def test_tags_and_names_are_trivial():
    assert not docpairs.informative(docpairs.description("/** @param a one two three four */", "js"), "f")
    assert not docpairs.informative("merge one two three", "mergeOneTwoThree")
    assert docpairs.informative("merge one two things", "mergeOneTwoThree")


# ---- 3
@pytest.mark.parametrize(
    "family, text, lines",
    [
        ("py", 'password = "Abc!defgh123"', [1]),
        ("py", 'password = "<your-password>"', []),
        ("py", 'password = "changeme"', []),
        ("py", 'token_id = "61e8554a-a8c3-7de1-881d-81a27b118cb2"', []),
        ("js", 'const apiKey = "abcDEF1234" +\n  "ghiJKL5678";', [1]),
        ("js", 'const u = "redis://svc:Xy12!abcdef@h.example/0";', [1]),
        ("js", 'const u = "redis://svc:${PASS}@h.example/0";', []),
        ("js", "// db_pass=H4lst4+holk3lk3l9083", [1]),
        ("js", 'const commit = "9926d15c70e52db15747dd8a640b289ebd91f2ae";', []),
        ("js", 'const integrity = "sha256:9926d15c70e52db15747dd8a640b289ebd91f2ae";', []),
        ("conf", "a: 1\nDB_PASSWORD: Inf3n*olz3l1368\n", [2]),
        ("text", "Use password `M4rur%borc4l5170` for the run.", [1]),
        ("text", "Nothing to see: the token is validated twice.", []),
        ("py", 'k = """-----BEGIN PRIVATE KEY-----\n' + "A1b2" * 20 + '\n-----END PRIVATE KEY-----"""', [1]),
        ("py", 'k = """-----BEGIN PUBLIC KEY-----\n' + "A1b2" * 20 + '\n-----END PUBLIC KEY-----"""', []),
        ("py", "", []),
        ("py", None, []),
    ],
)
def test_credentials(family, text, lines):
    got = credentials.credentials(text, family)
    assert sorted({text.count("\n", 0, s[0][0]) + 1 for s in got}) == lines
    if got:
        masked = credentials.redact(text, got)
        assert len(masked) == len(text) and masked.count("\n") == text.count("\n") and masked != text
        for quote in "\"'`":
            assert masked.count(quote) == text.count(quote)


def test_redaction_keeps_escapes():
    text = 'password = "Ab1\\n\\"x!cdefgh"'
    assert credentials.redact(text, credentials.credentials(text, "py")) == 'password = "***\\n\\"********"'


# ---- 4
def brute_spans(rows, length):
    out = []
    for i, x in rows:
        runs = [p for p in range(len(x) - length + 1) if any(x[p : p + length] in y for j, y in rows if j != i)]
        merged = []
        for p in runs:
            if merged and p <= merged[-1][1]:
                merged[-1][1] = p + length
            else:
                merged.append([p, p + length])
        out += [(i, a, b) for a, b in merged]
    return sorted(out)


def test_spans(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdef 😀\n") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 450, 1200)]
    rows = [(i, "".join(r.choice([*shared, word(r.randint(0, 300))]) for _ in range(4))) for i in range(40)]
    rows += [(100 + i, word(20) + shared[3] + word(30)) for i in range(30)]  # more than PAIRS in a group
    rows += [(200, "=" * 700), (201, "=" * 450), (202, ""), (203, "x" * 150)]
    df = spark.createDataFrame([*rows, (204, None)], BODY)
    want = brute_spans(rows, spans.LENGTH)
    assert sorted(map(tuple, spans.shared_spans(df).collect())) == want
    assert spans.shared_spans(df.where("false")).count() == 0
    hot, spans.HOT = spans.HOT, 5
    try:
        assert sorted(map(tuple, spans.shared_spans(df).collect())) == want
    finally:
        spans.HOT = hot


# ---- 5
def test_similar(spark, monkeypatch):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 4)):
            copy = list(words)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n + i, "one two three four five six") for i in range(60)] + [(n + 90, ""), (n + 91, None), (n + 92, "a b c")]
    rows.append(rows[0])
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame(rows, BODY)
    for block in (neardup.BLOCK, 7):  # the second one splits children into blocks
        links, members = neardup.similar(df, block=block)
        of = {}
        for m in members.collect():
            of.setdefault(m.rep, []).append(m.id)
        got = {tuple(sorted(p)) for x in links.collect() for p in itertools.product(of[x.a], of[x.b])}
        got |= {p for ids in of.values() for p in itertools.combinations(sorted(ids), 2)}
        assert got == want
        monkeypatch.setattr(neardup, "PART", 9)  # classes of several parts
        rows = [tuple(x) for x in neardup.expanded(links, members).collect()]
        assert set(rows) == want and len(rows) == len(want)
    links, members = neardup.similar(df.where("false"))
    assert links.count() == 0 and members.count() == 0


def test_tree_keeps_every_pair():
    import numpy as np

    r = np.random.default_rng(1)
    points = r.poisson(2, (300, neardup.DIMENSIONS)).astype("<u2")
    points[150:] = np.maximum(points[:150].astype(int) + r.integers(-1, 2, (150, neardup.DIMENSIONS)) * (r.random((150, neardup.DIMENSIONS)) < 0.1), 0)
    n = points.sum(1).astype(np.int64)
    a, b = neardup.Tree(n, points).pairs(0.6)
    got = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if neardup.overlap(points[i], points[j]) >= neardup.needed(n[i] + n[j])}
    assert got == want and (0, 150) in got
    points = r.poisson(r.uniform(0.1, 8, (300, 1)), (300, neardup.DIMENSIONS)).astype("<u2")
    tree = neardup.Tree(points.sum(1).astype(np.int64), points)
    tree.pairs(0.6)
    assert tree.cut > 0 and tree.tested < 300 * 299 / 2  # whole boxes were left out where sizes differ


# ---- 6
@pytest.mark.parametrize(
    "path, text, ok",
    [
        ("a.js", "export const f = async (a, {b = 1, ...c}) => { for (const x of a) { y?.[z]; } return `t${a}`; };", True),
        ("a.js", "class A extends B { static #p = 1; get q() { return this.#p } async *g() { yield* x } }\nlabel: while (1) break label", True),
        ("a.js", "const x = /[/]\\/(a)/gi.test(y) ? { default: 1, 'k': 2, [c]: 3, m() {} } : new Map", True),
        ("a.js", "const x;", False),
        ("a.js", "a b", False),
        ("a.js", "let package = 1;", False),
        ("a.js", "f(1, 2", False),
        ("a.js", "<<<<<<< HEAD\nx\n", False),
        ("a.ts", "export abstract class A<T extends B> implements C { private x?: Map<string, number[]> = new Map(); m<U>(a: U, b?: T): a is string { return a as any } }", True),
        ("a.ts", "type A = { readonly [k: string]: 'a' | 1 } & B['c']; enum E { A = 1, B } declare module 'x' { export function f(): void; }", True),
        ("a.ts", "function f(a: ) {}", False),
        ("a.py", "async def f(a, /, b: int = 1, *c, d, **e) -> None:\n  async with a as b, c:\n    x = [i async for i in y if i]\n  match z:\n    case {'a': [1, *r]} if r: pass\n    case _: pass\n", True),
        ("a.py", "def f():\nreturn 1\n", False),
        ("a.py", "if x\n  y\n", False),
        ("a.py", "x = f'{a'\n", False),
        ("a.py", "@d\nclass A(B, m=C):\n    x: int = 1; y = lambda *a: a\n    try: z\n    except* E: pass\n", True),
        ("a.py", "print 'a'\n", False),
        ("a.java", "package a; import java.util.*; @X(y = {1}) public final class A<T> extends B implements C { int[] x = {1, 2}; <U> U m(final List<? super T> l, int... n) throws E { for (var q : l) if (q instanceof String s && s.isEmpty()) continue; else break; return l.stream().map(A::new).reduce((a, b) -> a >>> 2)[0]; } enum F { P, Q { void g() {} }; } record R(int a) {} }", True),
        ("a.java", "class A { int f( { } }", False),
        ("a.java", "class A { void f() { int x = 1 } }", False),
        ("a.go", "package a\n\nimport (\n\t\"x\"\n)\n\ntype T[K any] struct {\n\tA, B int `j:\"a\"`\n\t*C\n}\n\nfunc (t *T[K]) M(a ...int) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\tgo func() { c <- T{A: 1} }()\n\t}\n\tfor i := range 10 {\n\t\tswitch y := z.(type) {\n\t\tcase int, string:\n\t\t\tfallthrough\n\t\tdefault:\n\t\t}\n\t}\n\treturn\n}\n", True),
        ("a.go", "package a\n\nfunc f() {\n\tx := \n}\n", False),
        ("a.go", "package a\n\nfunc f()\n{\n}\n", False),
        ("a.rs", "use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a, T: X + 'a>(pub &'a T);\nimpl<'a, T> Y for S<'a, T> where T: Z<U = i32> {\n    fn f(&mut self) -> Option<Box<dyn Fn(i32) -> i32>> {\n        let v = vec![1; 3];\n        match v.as_slice() { [a, .., b] if a > b => 1..=2, Some(x @ 1..=9) | None => return None, _ => {} };\n        if let Ok(q) = g::<u8>(1.0)? { 'o: loop { break 'o } }\n        |a| a + 1\n    }\n}\n", True),
        ("a.rs", "fn f() { let x = ; }", False),
        ("a.rs", "fn f( { }", False),
        ("a.json", '{"a": [1, -2.5e3, true, null, {"b": "\\u00e9"}]}', True),
        ("a.json", '{"a": 1,}', False),
        ("a.json", "{'a': 1}", False),
        ("a.json", "[01]", False),
        ("a.js", "const a = `${1 +}`;", False),
        ("a.js", "const a = `${{b: `}${c}`}.b} ${`${d(')')}`} \\${`;", True),
        ("a.js", "const a = `${`${x y}`}`;", False),
        ("a.ts", "const a = `${b as string} ${}`;", False),
        ("a.js", "const a = `${b", False),
        ("a.py", "x = f'{1 +}'\n", False),
        ("a.py", "x = f'{a!r:>{w}} {{}} {b[\"c\"]:%Y} {d=} {e = !s:x}' rf'\\d{a}' f'\\N{DASH}'\n", True),
        ("a.py", "x = f'{a['b']}' f'{f'{c}'}'\n", True),
        ("a.py", "x = f'{f'{c d}'}'\n", False),
        ("a.py", "x = f'{}'\n", False),
        ("a.py", "x = f'{a!q}'\n", False),
        ("a.py", "x = f'}'\n", False),
        ("a.py", "x = f'{lambda y: 1}'\n", False),
        ("a.py", 'x = f"""{\n  a  # b\n}\n"""\n', True),
        ("a.py", "x = " + "f'{" * 9 + "a" + "}'" * 9 + "\n", True),
        ("a.js", "x(" + "`${" * 300 + "a" + "}`" * 300 + ");", True),
        ("a.rs", "pub" + " " * 200 + "union" + " " * 200 + "U { a: u8 }", True),
        ("a.txt", "(((", None),
        ("a.py", "", None),
        ("a.py", None, None),
        (None, "x", None),
    ],
)
def test_parses(path, text, ok):
    assert parsing.valid(path, text) is ok


def test_python_like_its_own_parser(spark, small):
    import ast

    for r in spark.read.parquet(f"{small}/files.parquet").where("path like '%.py' or path like '%.json'").collect():
        if r.content:
            try:
                ast.parse(r.content) if r.path.endswith("py") else json.loads(r.content.removeprefix("\ufeff"))
                want = True
            except (SyntaxError, ValueError):
                want = False
            assert parsing.valid(r.path, r.content) is want, r.path


# ---- 7
def test_ids(spark, small):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenize.read_ranks(), special_tokens={})
    texts = [None, "", " ", "  a  b\n\n c", "it's we'LL don't", "naïve café 東京 🚀🚀", "x" * 300, "\u00a0\u2003a\u200bb", "abcQZ zq7 " * 50, "abcQZ", "<|endoftext|>"]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("row", F.lit(1)).repartition(3)
    got = {r.doc_id: list(r.ids) for r in tokenize.encode(df).collect()}
    assert got == {i: coder.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.tokens for r in tokenize.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = tokenize.decode(tokenize.encode(df), to="back")
    assert {r.doc_id: r.back for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenize.encode(df.where("false")).count() == 0


def test_many_missing_words(spark):
    """More missing words than 16 bits hold besides the vocabulary."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 65_000}
    rows = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(600)))], "doc_id bigint, text string")
    first = tokenize.coded(rows, ranks, "doc_id", "text").first()
    assert first.small is None and len(first.large) == len(set(first.missing)) + sum(c >= 0 for c in first.large) or first.large


def test_long_words(spark, monkeypatch):
    """Words folded in chunks have the ids of words folded whole; one word of 3,000 letters agrees."""
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenize.read_ranks(), special_tokens={})
    r = random.Random(4)
    texts = ["x" * 700, "ab" * 300] + ["".join(r.choice("etaoinshrdluéß的一是") for _ in range(r.randint(1, 60))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {i: coder.encode_ordinary(t) for i, t in enumerate(texts)}
    for long in (tokenize.LONG, 8):
        monkeypatch.setattr(tokenize, "LONG", long)
        assert {x.doc_id: list(x.ids) for x in tokenize.encode(df).collect()} == want
    monkeypatch.undo()
    big = "".join(r.choice("ACGT") for _ in range(3_000))
    assert list(tokenize.encode(spark.createDataFrame([(1, big)], "doc_id bigint, text string")).first().ids) == coder.encode_ordinary(big)


# ---- 8
def test_packing(spark):
    r = random.Random(2)
    sizes = [None, 0, 0, 256, 257, 5000] + [min(3000, int(r.paretovariate(1.1) * 20)) for _ in range(1500)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id bigint, tokens int")
    budgets = spark.createDataFrame([(1, 256), (2, 2048)], "budget_id int, capacity int")
    rows = packing.pack_all(items, budgets, block_rows=400).collect()
    for budget, capacity in ((1, 256), (2, 2048)):
        mine = [x for x in rows if x.budget_id == budget]
        room, count, docs = {}, {}, {}
        for x in mine:
            room[x.container] = room.get(x.container, 0) + x.tokens
            count[x.container] = count.get(x.container, 0) + 1
            docs.setdefault(x.doc_id, []).append(x.tokens)
        assert max(room.values()) <= capacity
        assert {i: sum(t) for i, t in docs.items()} == {i: n or 0 for i, n in enumerate(sizes)}
        assert all(len(docs[i]) == max(1, -(-(n or 0) // capacity)) for i, n in enumerate(sizes))
        assert len(room) <= 1.02 * sum(room.values()) / capacity + 3
    assert packing.pack_all(items.where("false"), budgets).count() == 0


def test_every_capacity_binds():
    """Each capacity alone keeps items out of containers, under either score, and none is ever exceeded."""
    import numpy as np

    r = np.random.default_rng(7)
    sizes = np.sort(np.minimum(1000, (r.pareto(1.1, 800) * 20 + 1).astype(int)))[::-1]
    for score in ("norm", "dot"):
        for documents, cost, binding in ((10**6, 1e12, "tokens"), (5, 1e12, "documents"), (10**6, 2e5, "cost")):
            tally = {}
            where = packing.pack(sizes, 1000, documents, cost, score, tally)
            assert tally[binding] > 0
            for b in range(where.max() + 1):
                mine = sizes[where == b].astype(float)
                assert mine.sum() <= 1000 and len(mine) <= documents and ((mine**2).sum() <= cost * (1 + 1e-9) or len(mine) == 1)
    free = len(set(packing.pack(sizes, 1000, 10**6, 1e12)))
    assert len(set(packing.pack(sizes, 1000, *packing.limits(sizes, 1000, packing.SPREAD)))) <= free * 1.01 + 1


# ---- 9
def test_quality(spark, small):
    common = quality.common_sets([("en", w) for w in "the of and to a in is it that for was on are with".split()] + [("zh", "的"), ("zh", "我们")])
    model = quality.Model([], seeds=[(quality.STATES.index(s), quality.observe(x, *common)) for s, xs in quality.SEEDS.items() for x in xs])
    texts = ["The reader is in the house and it was on the table. " * 5, "- a thing\n- other thing\n- third", "| a | b |\n| --- | --- |\n| 1 | 2 |", None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("label", F.lit("x"))
    got = {r.doc_id: r for r in quality.label_lines(df, model, common).collect()}
    assert got[0].prose_share > 0.5 and got[1].prose_share < 0.5 and got[2].table_share > 0.5
    assert all(got[i].prose_share is None for i in (3, 4, 5))
    stats = {r.doc_id: r for r in quality.text_statistics(df, spark.createDataFrame([("the",)], "word string")).collect()}
    assert stats[0].word_count == 60 and stats[3].word_count == 0 and stats[3].mean_word_length is None


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/doc_labels.parquet").where("label is not null")
    common = quality.common_sets(quality._common_words(spark, folder))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality.fit(docs, labels.where(~held), common)
    test = labels.where(held)
    rows = quality.label_lines(docs.join(test.select("doc_id").distinct(), "doc_id"), model, common).join(test, "doc_id")
    right = rows.select(((F.col("prose_share") >= 0.5) == (F.col("label") == "prose")).alias("ok")).agg(F.avg(F.col("ok").cast("double"))).first()[0]
    assert right > 0.95


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_found", "p7_ids", "p8_containers", "p9_found", "p1_reasons", "p2_pairs", "p3_redacted", "p4_shares", "p5_groups", "p6_rates", "p7_decoded", "p8_fill", "p9_labels"])
def test_queries_run(name, spark, small):
    from siltstone.llm import registry

    registry.queries()[name](spark, small).write.format("noop").mode("overwrite").save()
