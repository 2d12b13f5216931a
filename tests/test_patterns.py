import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.functions.patterns import alike, any_literal, canonical, literal


@pytest.mark.parametrize(
    ("text", "other", "same"),
    [("É", "é", True), ("k", "K", True), ("k", "K", False), ("s", "ſ", False), ("µ", "μ", True), ("σ", "ς", True), ("ß", "ẞ", False), ("ß", "SS", False), ("i", "İ", False), ("ǆ", "ǅ", True)],
)
def test_folding_follows_units(text, other, same):
    assert bool(re.fullmatch(literal(text), other)) is same


def test_special_characters_are_literal():
    for text in (".*+?^${}()|[]\\", "api/", "a-b", "nd."):
        assert re.fullmatch(literal(text), text)
        assert re.fullmatch(literal(text, case_sensitive=True), text)


def test_order_decides():
    assert re.findall(any_literal(["foo", "foobar"]), "foobar") == ["foo"]
    assert re.findall(any_literal(["foobar", "foo"]), "foobar") == ["foobar"]


def test_no_strings_no_pattern():
    assert any_literal([]) is None
    assert any_literal(["", ""]) is None


@given(st.text(alphabet=st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), min_size=1, max_size=8))
def test_a_literal_matches_itself(text):
    assert re.fullmatch(literal(text), text)
    assert re.fullmatch(literal(text, case_sensitive=True), text)


@given(st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)))
def test_canonical_is_stable(ch):
    assert canonical(canonical(ch)) == canonical(ch) or canonical(ch) == ch


def alternation(texts, case_sensitive):
    return "|".join(literal(t, case_sensitive) for t in dict.fromkeys(texts) if t)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="abAB.&-^]é", max_size=4), max_size=12), st.text(alphabet="abAB.&-^]éÉ", max_size=40), st.booleans())
def test_shared_beginnings_match_what_the_list_does(texts, content, case_sensitive):
    pattern, plain = any_literal(texts, case_sensitive), alternation(texts, case_sensitive)
    assert (pattern is None) == (plain == "")
    if pattern:
        assert [m.span() for m in re.finditer(pattern, content)] == [m.span() for m in re.finditer(plain, content)]


def test_shared_beginnings():
    assert any_literal(["there", "then", "the", "them", "a", "ab"], True) == "the(?:re|n)?|a"
    assert any_literal(["x1", "x2", "x-"], True) == r"x[12\-]"
    # Nesting has an end: then it is the list itself.
    deep = ["a" * n for n in range(400, 0, -1)]
    assert any_literal(deep, True) == "|".join(deep)


def test_ten_thousand_literals(spark):
    from pyspark.sql import functions as F

    words = [f"{'kx'[i % 2]}{i * 7919 % 99_991:05d}{'é' * (i % 3)}" for i in range(10_000)]
    texts = [" ".join(words[k::997]) + " k1 " + "X" * 300 for k in range(40)] + ["nothing here " * 2000]
    pattern = any_literal(words)
    assert len(pattern) < 400_000
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m")).collect()
    for r in rows:
        # Every word is one here, and none begins another but by the marks behind it, which stand after it in the list.
        assert [m for m in re.findall(r"[kx]\d{5}", r["t"])] == [m[:6] for m in r["m"]]
