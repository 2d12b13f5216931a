import pytest
from pyspark.sql import functions as F

from textquarry.functions.text import extension, fence_language, pad_start, token_estimate, utf16_length
from textquarry.operators import render
from textquarry.operators.windows import context_windows, match_positions, windows_by_rows
from textquarry.plans.spec import QuerySpec
from textquarry.search import Search
from textquarry.sources.corpus import table_corpus


def windows(spark, text, pattern, n):
    df = spark.createDataFrame([(0, text)], "id int, content string")
    return df.select(context_windows(F.col("content"), pattern, n).alias("w")).first()["w"]


def bounds(ws):
    return [(w["start_line"], w["end_line"]) for w in ws]


def lines_with(*at, n=20):
    return "\n".join("X" if i in at else "-" for i in range(1, n + 1))


@pytest.mark.parametrize(
    ("text", "n", "expected"),
    [("a\nX\n", 5, [(1, 3)]), (lines_with(1, 6), 2, [(1, 8)]), (lines_with(1, 7), 2, [(1, 3), (5, 9)]), ("X X", 1, [(1, 1)]), ("none", 3, []), ("", 1, []), (lines_with(5, 19), 100, [(1, 20)])],
)
def test_bounds(spark, text, n, expected):
    assert bounds(windows(spark, text, "X", n)) == expected


def test_matches_have_utf16_columns(spark):
    df = spark.createDataFrame([("a😀X X\r\n\nX",)], "content string")
    m = df.select(match_positions(F.col("content"), "X").alias("m")).first()["m"]
    assert [(x["line"], x["column"], x["match"]) for x in m] == [(1, 3, "X"), (1, 5, "X"), (3, 0, "X")]


def test_windows_cover_each_match_once(spark):
    import random

    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("XX----------") * rng.randint(1, 2) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, content string")
    for n in (1, 2, 4):
        got = {r["id"]: r["w"] for r in df.select("id", context_windows(F.col("content"), "X", n).alias("w")).collect()}
        by_rows = {}
        for r in windows_by_rows(df, "id", "X", n).collect():
            by_rows.setdefault(r["id"], []).append((r["start_line"], r["end_line"], r["n_matches"]))
        for i, text in rows:
            lines, ws = text.split("\n"), got[i]
            assert sum(len(w["matches"]) for w in ws) == text.count("X")
            assert all(b["start_line"] > a["end_line"] + 1 for a, b in zip(ws, ws[1:]))
            for w in ws:
                assert w["lines"] == lines[w["start_line"] - 1 : w["end_line"]]
                assert all(w["start_line"] <= m["line"] <= w["end_line"] for m in w["matches"])
            assert sorted(by_rows.get(i, [])) == [(w["start_line"], w["end_line"], len(w["matches"])) for w in ws]


def test_text_functions(spark):
    df = spark.createDataFrame([("a😀b", "x/a..ts"), ("abc", ".bashrc"), ("", "a.")], "s string, p string")
    rows = df.select(utf16_length(F.col("s")).alias("n"), extension(F.col("p")).alias("e"), fence_language(F.col("p")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [(4, ".ts", "ts"), (3, "", "txt"), (0, ".", "txt")]
    sizes = spark.createDataFrame([(9,), (10,), (11,)], "n long").select(token_estimate(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in sizes] == [2, 3, 3]
    pads = spark.createDataFrame([("7",), ("1234567",)], "s string").select(pad_start(F.col("s"), 6).alias("p")).collect()
    assert [r["p"] for r in pads] == ["     7", "1234567"]


def corpus(spark, files):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files.items())], "i long, p string, t string")
    return table_corpus(df, F.col("p"), F.col("t"), F.col("i"))


def test_rendering(spark):
    files = corpus(spark, {"a.ts": "1\nfoo\n3\n4\n5\n6\n7\nfoo", "b.md": "no"})
    s = Search(files, QuerySpec(strings=("foo",), lines=1, extensions=("ts", "md")))
    body = "     1│ 1\n     2│ foo\n     3│ 3\n\n  ...\n     7│ 7\n     8│ foo\n"
    assert [r["block"] for r in s.blocks.collect()] == [f'<file path="a.ts" matches="2" windows="2">\n{body}</file>\n\n']
    md = Search(files, s.spec.where(style="plain"))
    assert md.blocks.first()["block"] == f"### a.ts\n\n**Matches:** 2 | **Context windows:** 2\n\n```ts\n{body}```\n\n"
    text = "".join(s.bundle())
    assert text.startswith("<file_summary>") and "a.ts\n</directory_structure>" in text and text.endswith("</files>")
    t = s.totals().first()
    size = len(f'<file path="a.ts" matches="2" windows="2">\n{body}</file>\n\n')
    assert (t["total_files"], t["total_matches"], t["total_windows"], t["total_chars"], t["total_tokens"]) == (1, 2, 2, size, (size + 2) // 4)


def test_newline_literal_selects_but_shows_nothing(spark):
    s = Search(corpus(spark, {"a.ts": "x\na\nb\n", "b.ts": "ab"}), QuerySpec(strings=("a\nb",), lines=2, extensions=("ts",)))
    assert s.selected.count() == 1
    assert s.blocks.count() == 0
    assert s.totals().first()["total_files"] == 1
    assert s.top_files().count() == 0


def test_size_guard_edge(spark):
    files = corpus(spark, {"a.ts": "x" * 20, "b.ts": "x" * 21})
    assert [r["rel"] for r in Search(files, QuerySpec(strings=("x",), extensions=("ts",), max_bytes=20)).selected.collect()] == ["a.ts"]
    assert Search(files, QuerySpec(extensions=("ts",), max_bytes=20)).selected.count() == 2


def test_streams(spark, tmp_path):
    from textquarry.streaming.search import search_stream

    corpus(spark, {"a.ts": "foo\n\n\n\n\nfoo", "b.ts": "no"}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = search_stream(stream, QuerySpec(strings=("foo",), lines=1, extensions=("ts",))).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("found").orderBy("start_line").collect()] == [("a.ts", 1, 2, 1), ("a.ts", 5, 6, 1)]
    assert render.tail(QuerySpec()) == "</files>"


def test_very_many_matches_on_one_line(spark):
    text = "ab " * 20_000
    df = spark.createDataFrame([(text,)], "content string")
    m = df.select(match_positions(F.col("content"), "ab").alias("m")).first()["m"]
    assert [x["column"] for x in m] == [3 * i for i in range(20_000)]
