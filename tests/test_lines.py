"""Files of any size as rows of lines: the same matches and windows as of whole texts."""

import random

import pytest

from textquarry.operators.line_windows import context_lines, context_pieces, line_positions, line_windows, selected_lines
from textquarry.operators.render import format_windows
from textquarry.operators.windows import context_windows, match_positions
from textquarry.plans.spec import QuerySpec
from textquarry.sources.lines import Lines, large_files, lines_of_files


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def written(folder, seed=3, n=12):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        lines = [rng.choice([b"", b"TODO one\r", b"plain", b"a todo, b todo", b"x" * 90, b"\xff\xfe todo", "é😀 TODO é".encode(), b"-"]) for _ in range(rng.choice([1, 2, 40, 120]))]
        data = rng.choice([b"", b"\xef\xbb\xbf"]) + b"\n".join(lines) + rng.choice([b"", b"\n", b"\n\n"])
        (folder / f"f{k}.txt").write_bytes(data)
        out[f"f{k}.txt"] = data.decode("utf-8", "replace")
    return out


@pytest.mark.parametrize("n", [0, 1, 3])
def test_windows_and_positions_of_split_files(spark, tmp_path, small_splits, n):
    from pyspark.sql import functions as F

    texts = written(tmp_path)
    (tmp_path / "empty.txt").write_bytes(b"")
    spec = QuerySpec(strings=("todo",), extensions=("txt",), lines=n, max_bytes=0, roots=(str(tmp_path),))
    files = large_files(spark, spec, str(tmp_path))
    assert files.select("path", "block").distinct().count() > 2 * len(texts)
    lines = lines_of_files(files)
    name = F.substring_index("path", "/", -1).alias("name")
    got = {tuple(r) for r in line_windows(lines, spec.pattern, n).select(name, "start_line", "end_line", "n_matches").collect()}
    at = sorted(tuple(r) for r in line_positions(lines, spec.pattern).select(name, "line", "column", "match").collect())
    whole = spark.createDataFrame(list(texts.items()), "name string, content string")
    windows = whole.select("name", F.explode(context_windows(F.col("content"), spec.pattern, n, lines=False, matches=False)).alias("w")).select("name", "w.start_line", "w.end_line", "w.n_matches")
    matches = whole.select("name", F.explode(match_positions(F.col("content"), spec.pattern)).alias("m")).select("name", "m.line", "m.column", "m.match")
    assert got == {tuple(r) for r in windows.collect()} and got
    assert at == sorted(tuple(r) for r in matches.collect())
    # The lines of windows, as they are written.
    written_ = {}
    for r in sorted(context_pieces(lines, spec.pattern, n).select(name, "line", "text").collect()):
        written_[r["name"]] = written_.get(r["name"], "") + r["text"]
    formatted = whole.select("name", format_windows(context_windows(F.col("content"), spec.pattern, n)).alias("text")).where("text <> ''")
    assert written_ == {r["name"]: r["text"] for r in formatted.collect()}


def test_large_files_are_those_beyond_the_guard(spark, tmp_path):
    for name, size in {"a.ts": 10, "b.ts": 2000, "c.js": 2000, "node_modules/d.ts": 2000, "sub/e.ts": 3000, "sub/x.test.ts": 3000, ".h/f.ts": 3000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("token\n" * (size // 6) + ("secret\n" if name == "b.ts" else ""))
    spec = QuerySpec(strings=("token",), extensions=("ts",), ignore=("**/*.test.ts",), max_bytes=1000, roots=(str(tmp_path), str(tmp_path / "sub"), str(tmp_path / "node_modules")))
    df = large_files(spark, spec, str(tmp_path))
    assert {r["rel"]: r["root_ord"] for r in df.select("rel", "root_ord").distinct().collect()} == {"b.ts": 0, "sub/e.ts": 0, "node_modules/d.ts": 2}
    # Read once, though two roots show them; each has its lines once.
    assert df.where("rel = 'sub/e.ts'").count() == 500
    kept = selected_lines(lines_of_files(df), spec.where(exclude_strings=("SECRET",)))
    assert line_windows(kept, spec.pattern, 1).count() == 2
    with pytest.raises(ValueError):
        selected_lines(kept, spec.where(strings=("a\nb",)))


def test_blocks_of_rows(spark):
    """Windows go on over blocks without matches, and nothing comes of nothing."""
    rows = [("p", b, i, "x" if (b, i) in {(0, 1), (3, 0), (3, 3), (9, 4)} else "-") for b in range(10) for i in range(5)]
    lines = Lines.of(spark.createDataFrame(rows, "path string, block int, i long, text string"))
    got = sorted(tuple(r) for r in line_windows(lines, "x", 7).select("start_line", "end_line", "n_matches").collect())
    assert got == [(1, 26, 3), (43, 50, 1)]
    assert sorted(tuple(r) for r in line_windows(lines, "x", 0).select("start_line", "end_line", "n_matches").collect()) == [(2, 2, 1), (16, 16, 1), (19, 19, 1), (50, 50, 1)]
    shown = sorted((r["line"], r["begins"], r["first"]) for r in context_lines(lines, "x", 7).collect())
    assert [x[0] for x in shown] == [*range(1, 27), *range(43, 51)] and [x for x in shown if x[1]] == [(1, True, True), (43, True, False)]
    assert line_windows(lines, "y", 2).collect() == [] and context_lines(lines, "y", 2).collect() == [] and line_positions(lines, "y").collect() == []


@pytest.mark.parametrize("few", [0, 100_000])
def test_lines_of_many_blocks(spark, few, monkeypatch):
    """Blocks that all belong to one file, which took time with the square of their number; broadcast, and dealt."""
    from pyspark.sql import functions as F

    from textquarry.operators import line_windows as own

    monkeypatch.setattr(own, "BROADCAST_BLOCKS", few)
    n = 5000
    text = F.when(F.col("block") % 1000 == 7, "x").otherwise("-")
    rows = spark.range(n).select(F.lit("p").alias("path"), F.col("id").alias("block"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("i", "_t")).withColumn("text", F.when(F.col("i") == 1, text).otherwise(F.lit("-"))).drop("_t")
    shown = context_lines(Lines.of(rows), "x", 2)
    # A frame that ends with the partition is gone through anew for each row.
    assert "unboundedfollowing" not in shown._jdf.queryExecution().toString().lower()
    got = sorted(tuple(r) for r in shown.select("line", "text", "begins", "first").collect())
    expected = [(m + k, "x" if k == 0 else "-", k == -2, m == 16 and k <= 0) for m in range(16, 2 * n + 1, 2000) for k in range(-2, 3)]
    assert got == expected
    assert [tuple(r) for r in line_windows(Lines.of(rows), "x", 2).select("start_line", "end_line").sort("start_line").collect()] == [(m - 2, m + 2) for m in range(16, 2 * n + 1, 2000)]
