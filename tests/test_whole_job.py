"""Cases that a shortened operator would lose."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import neardup, spans
from siltstone.llm.credentials import credentials
from siltstone.operators import repomap, structure


def documented(spark, folder, extensions):
    """What structural_findings and violations say of functions documented at more than three lines per line."""
    path = spark.read.parquet(f"{folder}/files.parquet").where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*extensions)).select("file_id").distinct()
    v = spark.read.parquet(f"{folder}/violations.parquet").join(path, "file_id", "left_semi")
    wanted = v.where("code_lines >= 3 and doc_lines > 3 * code_lines").select("file_id", "line", F.expr("doc_lines / code_lines")).distinct()
    found = structure.structural_findings(spark, folder).where("rule = 'doc_code_ratio'").join(path, "file_id", "left_semi").join(v, "file_id", "left_semi")
    return sorted(map(tuple, found.select("file_id", "line", "value").collect())), sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("extensions", [("go",), ("rs",), ("py",), ("java",), ("js", "mjs", "jsx"), ("ts",)])
def test_documentation_equals_violations(spark, small, extensions):
    found, wanted = documented(spark, small.replace("sf0.001", "sf0.01"), extensions)
    assert wanted and found == wanted


def test_documentation_of_go_and_rust():
    doc = lambda mark, n=10: "".join(f"{mark} word {i}\n" for i in range(n))
    go = "package p\n\n" + doc("//") + "func (c *C) Get(f func(int) int, v interface{}) (interface{}, error) {\n\ta()\n\tb()\n\treturn v, nil\n}\n"
    assert structure.documentation_ratio(go, "go") == [(3, "Get", 10, 3)]
    rust = doc("///") + "#[inline]\npub(crate) async fn get<'a, F: Fn(i32) -> i32>(x: &'a [u8; 4]) -> [u8; 4]\nwhere\n    F: Copy,\n{\n    a();\n    b();\n    *x\n}\n"
    assert structure.documentation_ratio(rust, "rust") == [(1, "get", 10, 3)]
    assert structure.documentation_ratio(doc("///", 9) + "fn get() {\n    a();\n    b();\n    c()\n}\n", "rust") == []
    assert structure.documentation_ratio(doc("///") + "fn get();\nfn other() {\n    a();\n    b();\n    c()\n}\n", "rust") == []


@pytest.mark.parametrize(
    "language, head, name",
    [
        ("java", "@Override\n    @SuppressWarnings({\"a)\", \"b\"})\n    int get(int a) {", "get"),
        ("java", "static <T extends Comparable<T>> java.util.List<T[]> get(T a) throws java.io.IOException {", "get"),
        ("java", "public Thing(int a) {", "Thing"),
        ("java", "protected int get(" + ", ".join(f"@Named(\"n{i}\") int a{i}" for i in range(60)) + ") {", "get"),
        ("java", "int get(int a);\n    int other(int a) {", None),
        ("java", "int first = 1;\n    public int other(int a) {", None),
        ("java", "if (a > 1) {", None),
        ("js", "export async function get(" + ", ".join(f"argument{i} = f({i})" for i in range(60)) + ") {", "get"),
        ("js", "export const get = async (a: { b: string }): Promise<{ c: string }> => {", "get"),
        ("js", "function get<T extends { a: 1 }>(a: T): { b: string } | null {", "get"),
        ("js", "static get(a) {", "get"),
        ("js", "async(a) {", "async"),
        ("js", "get(a);\nfunction other() {", None),
        ("js", "const first = 1;\nfunction other() {", None),
    ],
)
def test_documentation_heads(language, head, name):
    text = "/**\n" + " * word\n" * 16 + " */\n" + head + "\n  a();\n  b();\n  return c;\n}\n"
    assert [x[1] for x in structure.documentation_ratio(text, language)] == [name] * (name is not None)


def test_strong_components_by_reachability():
    r = random.Random(7)
    for _ in range(200):
        n = r.randint(2, 12)
        links = [(str(r.randrange(n)), str(r.randrange(n))) for _ in range(r.randint(1, 2 * n))]
        reach = set(links)
        for k, i, j in itertools.product(map(str, range(n)), repeat=3):
            if (i, k) in reach and (k, j) in reach:
                reach.add((i, j))
        wanted = {frozenset([a] + [b for b in map(str, range(n)) if (a, b) in reach and (b, a) in reach]) for a in map(str, range(n))}
        assert sorted(map(sorted, repomap.strong(links))) == sorted(sorted(x) for x in wanted if len(x) > 1)
    assert [len(x) for x in repomap.strong([(str(i), str((i + 1) % 50_000)) for i in range(50_000)])] == [50_000]


def test_import_rings_of_any_length(spark, tmp_path):
    """A ring of nine files, one of two that it leads to, and a chain: each ring comes out, the chain does not."""
    links = [(f"a{i}", f"a{(i + 1) % 9}") for i in range(9)] + [("a3", "b0"), ("b0", "b1"), ("b1", "b0"), ("b1", "c0"), ("c0", "c1"), ("d0", "a0")]
    names = sorted({x for link in links for x in link})
    rows = [(i, "r", f"{x}.py", "\n".join(f"import {b}" for a, b in links if a == x) + "\nx = 1\n", dt.datetime(2026, 1, 1)) for i, x in enumerate(names)]
    spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string, ingested_at timestamp").write.parquet(str(tmp_path / "files.parquet"))
    got = sorted((r.kind, r.repo, r.cycle, r.length) for r in repomap.import_cycles(spark, str(tmp_path)).collect())
    ring = ", ".join(f"a{i}.py" for i in range(9))
    assert got == [("component", "r", ring, 9), ("component", "r", "b0.py, b1.py", 2), ("cycle", "r", "b0.py -> b1.py", 2)]


VALUE = "hT7kQ92mLx0PzR4v"


@pytest.mark.parametrize(
    "family, text, cases",
    [
        ("js", 'const apiSecret =\n  "%s";', 1),
        ("js", 'const apiSecret: string = // note\n  Buffer.from("%s");', 1),
        ("js", 'login(\n  user,\n  "%s");', 1),
        ("js", 'login(\n  "bob",\n  "%s");', 1),
        ("py", 'PASSWORD = (\n    "%s"\n)', 1),
        ("py", 'PASSWORD = \\\n    "%s"\n', 1),
        ("json", '{"password":\n  "%s"}', 1),
        ("py", 'def f(password):\n    "%s"\n', 0),
        ("py", 'def f(password: str,\n      salt="%s"):\n    pass\n', 0),
        ("py", 'if password:\n    salt = "%s"\n', 0),
        ("js", 'password = a;\nname =\n  "%s";', 0),
        ("js", 'f(password,\n  "%s");', 0),
        ("js", '// password =\nname =\n  "%s";', 0),
    ],
)
def test_credentials_of_wrapped_statements(family, text, cases):
    found = credentials(text % VALUE, family)
    assert [(text % VALUE)[a:b] for spans in found for a, b in spans] == [VALUE] * cases


def test_wrapped_imports(spark, tmp_path):
    """Imports over several lines give edges and names; every ending of a folder's index is tried."""
    content = {
        "a/use.js": "import {\n  one,\n  two as too,\n} from './lib';\nimport d, {\n  three\n} from './tool';\nimport * as all\n  from './page';\n",
        "a/lib/index.tsx": "export const one = 1;\nexport const two = 2;\nexport const left = 3;\n",
        "a/tool.js": "export const three = 3;\n",
        "a/page/index.cjs": "x = 1;\n",
        "m.py": "def four():\n    pass\n\ndef five():\n    pass\n\ndef six():\n    pass\n",
        "n.py": "from m import (\n    four,  # (a note)\n)\nfrom m import \\\n    five\n",
        "r.rs": "pub fn seven() {}\npub fn eight() {}\n",
        "s.rs": "use crate::r::{\n    inner::{ten},\n    seven,\n};\n",
    }
    rows = [(i, "r", path, text, dt.datetime(2026, 1, 1)) for i, (path, text) in enumerate(content.items())]
    spark.createDataFrame(rows, "file_id bigint, repo string, path string, content string, ingested_at timestamp").write.parquet(str(tmp_path / "files.parquet"))
    unused = {r.name for r in repomap.unused_exports(spark, str(tmp_path)).collect()}
    assert unused == {"six", "eight"}  # left is in an index, which is an entry point
    got = {(r.target, r.importers) for r in repomap.dependents(spark, str(tmp_path)).collect()}
    assert got == {("a/lib/index.tsx", 1), ("a/tool.js", 1), ("a/page/index.cjs", 1), ("m.py", 1)}
    assert {r.source for r in repomap.imports(spark, str(tmp_path)).where("lang = 'js'").collect()} == {"./lib", "./tool", "./page"}


def test_records_without_an_id(spark):
    """Rows with a null id neither fail spans and similarity nor count as another record."""
    text = " ".join(f"word{i}" for i in range(60))
    alone = spark.createDataFrame([(None, text), (None, text), (1, text)], "id bigint, text string")
    assert spans.shared_spans(alone).count() == 0
    links, members = neardup.similar(alone)
    assert links.count() == 0 and [(r.id, r.rep) for r in members.collect()] == [(1, 1)]
    both = alone.unionByName(spark.createDataFrame([(2, text)], alone.schema))
    assert sorted(map(tuple, spans.shared_spans(both).collect())) == [(1, 0, len(text)), (2, 0, len(text))]
    links, members = neardup.similar(both)
    assert sorted((r.id, r.rep) for r in members.collect()) == [(1, 1), (2, 1)]
