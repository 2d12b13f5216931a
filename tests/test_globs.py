import re

import pytest

from textquarry.plans.globs import compile_glob, expand, from_exclusion


def hit(pattern, path, **k):
    g = compile_glob(pattern, **k)
    return bool(re.search(g.regex, path)) is not g.negated


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("**/*.ts", "a.ts", True), ("**/*.ts", "x/a.ts", True), ("**/*.ts", "_e.ts", True), ("**/*.ts", "x/a.d.ts", True), ("**/*.ts", ".h/a.ts", False), ("**/*.ts", "x/.a.ts", False),
        ("**/*.ts", "a.tsx", False), ("**/*.test.ts", "test.ts", False), ("**/node_modules/**", "node_modules/p/a.js", True), ("**/node_modules/**", "x/node_modules/a", True),
        ("d.ts", "x/d.ts", False), ("d.ts", "d.ts", True), ("src/*", "src/a", True), ("src/*", "src/a/b", False), ("a?c", "abc", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False),
        ("*.{ts,tsx}", "a.tsx", True), ("*.{ts,tsx}", "a.js", False), ("!*.ts", "a.js", True), ("!*.ts", "a.ts", False), ("#x", "#x", False), ("**", "a/b", True),
    ],
)
def test_hidden_names_stay_hidden(pattern, path, expected):
    assert hit(pattern, path) is expected


@pytest.mark.parametrize(("pattern", "path", "expected"), [("**/*.ts", ".h/a.ts", True), ("*", ".a", True), ("src/**", "src/.a/b", True), ("*.ts", "x/a.ts", False)])
def test_dot_option(pattern, path, expected):
    assert hit(pattern, path, dot=True) is expected


def test_case():
    assert hit("**/*.TS", "a.ts", case_sensitive=False)
    assert not hit("**/*.TS", "a.ts")


@pytest.mark.parametrize(
    ("pattern", "path", "expected"),
    [
        ("[a-c]*.MD", "B.md", True), ("[!a-c]x", "Bx", False), ("[É]", "é", True), ("[a-c]", "d", False), ("f{1..3}.ts", "F2.ts", True), ("f{1..3}.ts", "f4.ts", False), ("f{01..10}", "f07", True),
        ("f{01..10}", "f7", False), ("{a..e..2}", "c", True), ("{a..e..2}", "b", False), ("{3..1}", "2", True), ("{x}", "{x}", True), ("[[:digit:]a]", "7", True), ("[[:digit:]]", "a", False), ("[]a]", "]", True),
    ],
)
def test_classes_and_ranges(pattern, path, expected):
    regex = compile_glob(pattern, dot=True, case_sensitive=False).regex.replace(r"\p{Nd}", "0-9")
    assert bool(re.search(regex, path)) is expected


def test_bare_names_expand():
    assert expand("src") == ["src", "**/src", "src/**", "**/src/**"]
    assert expand("./.github")[0] == "github"
    assert expand("*.ts") == ["*.ts"]


def test_exclusions():
    assert from_exclusion("d.ts") == "**/*.d.ts"
    assert from_exclusion(".log") == "**/*.log"
    assert from_exclusion("docs/**") == "docs/**"


def test_extended_globs_are_refused():
    with pytest.raises(ValueError, match="extended"):
        compile_glob("+(a|b)")
