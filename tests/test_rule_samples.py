"""Every rule that one line can decide fires on its positive sample and stays still on its negative one, in both dialects."""

import duckdb
import pytest

from siltstone.functions import rules
from siltstone.functions.dialect import quote, re2
from siltstone.operators import hygiene

A1 = "a1B2" * 16
#: rule -> (path, a line that it matches, a line that it does not match)
SAMPLES = {
    "console_debugging": ("a.js", "console.log(x)", "console.error(x)"),
    "python_debugging": ("a.py", "breakpoint()", "break_point()"),
    "rust_debugging": ("a.rs", "dbg!(x);", "debug!(x);"),
    "old_todos": ("a.js", "// TODO: later", "// todo later"),
    "placeholder_text": ("a.js", 'x = "lorem ipsum"', "x = lorem ipsum"),
    "placeholder_not_implemented_js": ("a.js", 'throw new Error("not implemented")', 'throw new Error("no such file")'),
    "placeholder_empty_function_js": ("a.js", "function f() {}", "function f() { g() }"),
    "placeholder_todo_rust": ("a.rs", "todo!()", "todos!()"),
    "placeholder_panic_todo_rust": ("a.rs", 'panic!("TODO")', 'panic!("bad state")'),
    "rust_bare_unwrap": ("a.rs", "x.unwrap();", "x.unwrap().y()"),
    "placeholder_not_implemented_py": ("a.py", "raise NotImplementedError", "raise ValueError"),
    "placeholder_pass_only_py": ("a.py", "def f(a): pass", "def f(a): return a"),
    "placeholder_ellipsis_py": ("a.py", "def f(a): ...", "def f(a): return ..."),
    "placeholder_panic_go": ("a.go", 'panic("not implemented")', 'panic("bad state")'),
    "placeholder_unsupported_java": ("A.java", "throw new UnsupportedOperationException();", "throw new IllegalStateException();"),
    "empty_catch_js": ("a.js", "try { f() } catch (e) {}", "try { f() } catch (e) { g(e) }"),
    "empty_except_py": ("a.py", "except ValueError: pass", "except ValueError: raise"),
    "disabled_linter": ("a.py", "import x  # noqa", "import x  # nothing"),
    "unused_imports_hint": ("a.js", "import a from 'b' // unused", "import a from 'b' // used"),
    "mixed_indentation": ("a.js", "\t x", "\tx"),
    "trailing_whitespace": ("a.js", "x ", "x"),
    "hardcoded_secrets": ("a.js", 'password = "hunter2hunter2"', 'password = "${PASSWORD_HERE}"'),
    "jwt_tokens": ("a.js", f"eyJ{A1[:12]}.eyJ{A1[:12]}.{A1[:12]}", f"eyJ{A1[:12]}.{A1[:12]}"),
    "openai_api_key": ("a.js", "sk-" + A1[:32], "sk-" + A1[:31]),
    "github_token": ("a.js", "ghp_" + A1[:36], "ghp_" + A1[:35]),
    "aws_credentials": ("a.js", "AKIA" + "A1" * 8, "AKIB" + "A1" * 8),
    "google_api_key": ("a.js", "AIza" + A1[:35], "AIza" + A1[:34]),
    "stripe_api_key": ("a.js", "sk_live_" + A1[:24], "sk_live_" + A1[:23]),
    "slack_token": ("a.js", "xoxb-" + "1" * 10 + "-" + "2" * 10 + "-" + A1[:24], "xoxb-1-2-" + A1[:24]),
    "discord_token": ("a.js", f'discord = "{A1[:24]}.{A1[:6]}.{A1[:27]}"', f'discord = "{A1[:24]}.{A1[:6]}"'),
    "sendgrid_api_key": ("a.js", f"SG.{A1[:22]}.{A1[:43]}", f"SG.{A1[:22]}.{A1[:42]}"),
    "twilio_credentials": ("a.js", "AC" + "0a" * 16, "AC" + "0g" * 16),
    "npm_token": ("a.js", "npm_" + A1[:36], "npm_" + A1[:35]),
    "private_key": ("a.js", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
    "high_entropy_string": ("a.js", f'"{A1[:40]}"', f'"{A1[:39]}"'),
    "issue_pr_references": ("a.js", "// fixed in #12", "// fixed at last"),
    "verbosity_preambles": ("a.js", "// Certainly, this adds", "// This certainly adds"),
    "verbosity_buzzwords": ("a.js", "// a seamless thing", "// a seam"),
    "verbosity_hedging": ("a.js", "// this should work", "// this works"),
    "boolean_blindness": ("a.js", "f(true, false, true)", "f(true, false)"),
    "mutable_globals_js": ("a.js", "let COUNT = 1", "const COUNT = 1"),
    "mutable_globals_py": ("a.py", "ITEMS = []", "items = []"),
    "speculative_generality_empty_interface": ("a.ts", "interface A {}", "interface A { b: string }"),
}


def test_every_rule_has_samples():
    assert set(SAMPLES) == {r.name for r in hygiene.active()}


def test_samples_in_spark(spark):
    rows = [(2 * i + k, path, line) for i, (path, *lines) in enumerate(SAMPLES.values()) for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string")
    hits = {(r.file_id, r.rule) for r in hygiene.line_hits(df, hygiene.active()).collect()}
    for i, name in enumerate(SAMPLES):
        assert (2 * i, name) in hits, name
        assert (2 * i + 1, name) not in hits, name


@pytest.mark.parametrize("name", sorted(set(SAMPLES) - {"hardcoded_secrets"}))
def test_samples_in_sql(name):
    rule = next(r for r in rules.RULES if r.name == name)
    pattern = quote(re2(rules.WITHOUT_LOOKAHEAD.get(name, rule.pattern), rule.ignore_case))
    got = [duckdb.connect().sql(f"select regexp_matches({quote(line)}, {pattern})").fetchall()[0][0] for line in SAMPLES[name][1:]]
    assert got == [True, False]
