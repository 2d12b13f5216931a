import pytest

import json
import os

from textquarry import cli
from textquarry.cli import main, parser, spec_of
from textquarry.plans.config import TEMPLATE, parse_config, write_template
from textquarry.plans.spec import DEFAULT_EXTENSIONS, QuerySpec, split_csv


def test_sections_and_aliases():
    c = parse_config("lost\n[strings]\n fetch( \n# no\n\n[other]\n[include]\nts\n[ignore]\nd.ts\n[exclude-extensions]\nx")
    assert c == {"search": ["fetch(", "[other]"], "extensions": ["ts"], "exclude": ["d.ts", "x"]}


def test_template_is_empty(tmp_path):
    assert parse_config(TEMPLATE) == {"search": [], "extensions": [], "exclude": []}
    write_template(str(tmp_path / "c.ini"))
    with pytest.raises(FileExistsError):
        write_template(str(tmp_path / "c.ini"))
    with pytest.raises(FileNotFoundError):
        write_template(str(tmp_path / "no" / "c.ini"))
    assert write_template(str(tmp_path / "yes" / "c.ini"), create_folder=True).exists()


def test_spec_rules():
    assert QuerySpec().extensions == DEFAULT_EXTENSIONS
    assert QuerySpec(extensions=("TS", ".md", "ts")).extensions == ("ts", "md")
    assert QuerySpec(strings=("a",), lines=0).context == 0
    assert QuerySpec(lines=3).context == 0
    for bad in (-1, 1.5, True):
        with pytest.raises(ValueError, match="lines"):
            QuerySpec(lines=bad)
    assert split_csv(" a, ,b ") == ["a", "b"]
    assert split_csv("*.{ts,tsx}") == ["*.{ts", "tsx}"]


def test_config_and_command_line_add_up(tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("[search]\na\n[extensions]\nts\n[exclude]\nd.ts\n")
    spec = spec_of(parser().parse_args(["-f", str(f), "-s", "b", "-e", "JS,ts", "-x", "d.ts", "root"]))
    assert spec.strings == ("a", "b")
    assert spec.extensions == ("ts", "js")
    assert spec.exclude == ("d.ts", "**/*.d.ts")
    assert spec.roots == ("root",)


@pytest.fixture
def folder(tmp_path, monkeypatch):
    files = {"_e.ts": "x TODO", ".f.ts": "TODO", "G.TS": "TODO", "x.d.ts": "todo\n", "test.ts": "none", "node_modules/d.ts": "TODO", "sub/a.ts": "1\n2\nTODO\n4", "b.md": "TODO"}
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    (tmp_path / "bad.ts").write_bytes(b"TODO \xff")
    monkeypatch.chdir(tmp_path)
    return tmp_path


def test_files_end_to_end(spark, folder, capsys):
    assert main(["-s", "TODO", "-e", "ts", "--preview"], spark) == 0
    out = capsys.readouterr().out
    names = [line.removeprefix(f"{folder}/") for line in out.splitlines() if line.startswith(str(folder))]
    assert names == ["_e.ts", "bad.ts", "sub/a.ts", "x.d.ts"]
    assert main(["-s", "TODO", "-e", "ts", "-l", "1", "-x", "d.ts", "--style", "markdown", "-o", "out.txt"], spark) == 0
    text = (folder / "out.txt").read_text()
    assert "### sub/a.ts\n\n**Matches:** 1 | **Context windows:** 1\n\n```ts\n     2│ 2\n     3│ TODO\n     4│ 4\n```\n\n" in text
    assert "�" in text
    assert main(["-s", "absent", "-e", "ts"], spark) == 3
    assert main(["-e", "zzz"], spark) == 2
    assert main(["-f", "missing.ini"], spark) == 1
    capsys.readouterr()
    assert main(["-s", "TODO", "-e", "md", "--stdout"], spark) == 0
    got = capsys.readouterr()
    assert got.out.endswith('<file path="b.md">\nTODO\n</file>\n\n</files>')
    assert "files packed: 1" in got.err and f"size: {len(got.out):,} characters" in got.err


def test_a_single_value_is_a_list_of_one():
    spec = QuerySpec(strings="TODO", exclude_strings="x", extensions="TS", exclude="a/**", include="src", ignore="lib", roots="r")
    assert (spec.strings, spec.exclude_strings, spec.extensions, spec.exclude, spec.include, spec.ignore, spec.roots) == (("TODO",), ("x",), ("ts",), ("a/**",), ("src",), ("lib",), ("r",))
    assert QuerySpec(strings=None, roots=()).roots == (".",) and QuerySpec(strings=["a", "b"]).strings == ("a", "b")


def test_roots_stand_anywhere_and_usage_errors_are_1(spark, folder, capsys):
    assert main(["sub", "-s", "TODO", "-e", "ts", ".", "--preview"], spark) == 0
    assert capsys.readouterr().out.splitlines()[1:5] == [f"{folder}/{x}" for x in ("sub/a.ts", "_e.ts", "bad.ts", "x.d.ts")]
    assert main(["--nonsense"], spark) == 1
    assert main(["-l", "many"], spark) == 1
    assert main(["--include", "+(a|b)"], spark) == 1
    assert main(["-x", "[z-a]*"], spark) == 1
    assert "extended globs" in capsys.readouterr().err
    assert main(["--version"], spark) == 0


def test_copy(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "CLIPBOARD_ELSE", ["sh", "-c", f"cat > {folder}/clip"])
    assert main(["-s", "TODO", "-e", "md", "-o", "out.txt", "--copy"], spark) == 0
    assert (folder / "clip").read_text() == (folder / "out.txt").read_text()
    assert "Copied" in capsys.readouterr().out
    monkeypatch.setattr(cli, "CLIPBOARD_ELSE", ["no-such-command"])
    assert main(["-s", "TODO", "-e", "md", "-o", "out.txt", "-c"], spark) == 0
    assert "Nothing was copied" in capsys.readouterr().out


def test_init_asks_before_it_makes_a_folder(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert main(["init", "new/conf"]) == 1 and not (tmp_path / "new").exists()
    monkeypatch.setattr("builtins.input", lambda _: "Yes")
    assert main(["init", "new/conf"]) == 0 and (tmp_path / "new" / "conf.ini").exists()
    assert main(["init", "new/conf"]) == 1


def test_what_is_ruled_out_is_not_opened(spark, folder):
    from textquarry.search import Search
    from textquarry.sources.corpus import files_corpus

    for name in ("node_modules/trap.ts", "big.ts", "other.bin"):
        os.mkfifo(folder / name) if name != "big.ts" else (folder / name).write_text("TODO " * 100)
    # A pipe would block whoever opens it; a file beyond the guard comes without content.
    spec = QuerySpec(strings=("TODO",), extensions=("ts",), max_bytes=100)
    rows = {r["rel"]: r for r in files_corpus(spark, spec, str(folder)).collect()}
    assert rows["big.ts"]["content"] is None and rows["big.ts"]["length"] == 500 and "node_modules/d.ts" not in rows
    assert {r["rel"] for r in Search(files_corpus(spark, spec, str(folder)), spec).selected.collect()} == {"_e.ts", "bad.ts", "sub/a.ts", "x.d.ts"}


def test_pruned_folders_are_not_walked(folder, monkeypatch):
    from textquarry.sources.corpus import _FolderReader

    (folder / "keep" / "deep").mkdir(parents=True)
    (folder / "keep" / "deep" / "z.ts").write_text("z")
    seen = []
    spec = QuerySpec(extensions=("ts",))
    options = {"path": str(folder), "keep": r"\.ts$", "drop": spec.ignore_regex, "prune": spec.prune_regex, "roots": json.dumps([str(folder)])}
    listed = _FolderReader._listed
    monkeypatch.setattr(_FolderReader, "_listed", lambda self, f, prune: (seen.append(f), listed(self, f, prune))[1])
    for least in ("1", "2", "1000"):
        seen.clear()
        reader = _FolderReader(options | {"folders": least})
        found = sorted(p.removeprefix(f"{folder}/") for part in reader.partitions() for p, *_ in reader.read(part))
        assert found == ["_e.ts", "bad.ts", "keep/deep/z.ts", "sub/a.ts", "test.ts", "x.d.ts"]
        assert not any("node_modules" in f for f in seen)


def test_unreadable_files_are_named(spark, folder, capsys):
    os.symlink(folder / "missing", folder / "gone.ts")
    assert main(["-e", "ts", "-o", "out.txt"], spark) == 0
    assert "gone.ts could not be read" in capsys.readouterr().err
    assert 'path="gone.ts"' not in (folder / "out.txt").read_text()
    assert main(["-s", "TODO", "-e", "ts", "-o", "out.txt"], spark) == 0
    assert "could not be read" not in capsys.readouterr().err


def test_roots_elsewhere(spark, folder):
    from textquarry.sources.corpus import files_corpus

    (folder / "tmp").mkdir()
    (folder / "tmp" / "t.ts").write_text("t")
    spec = QuerySpec(extensions=("ts",), roots=(".", "tmp", "../" + folder.name + "/sub", "sub"))
    rows = {r["rel"]: (r["root_ord"], r["root_rel"]) for r in files_corpus(spark, spec, str(folder)).collect()}
    # A root that another one leaves out is walked for itself.
    assert rows["tmp/t.ts"] == (1, "t.ts") and rows["sub/a.ts"] == (0, "sub/a.ts")
    below = {r["rel"] for r in files_corpus(spark, QuerySpec(extensions=("ts",), roots=("..",)), str(folder / "sub")).collect()}
    assert {"../x.d.ts", "a.ts"} <= below
    spark_read = files_corpus(spark, QuerySpec(extensions=("ts",), roots=(f"file://{folder}",)), str(folder), underscored=False)
    assert {r["root_rel"] for r in spark_read.collect()} == {"bad.ts", "sub/a.ts", "test.ts", "x.d.ts"}


def test_roots_overlap_once(spark, folder):
    from textquarry.sources.corpus import files_corpus

    spec = QuerySpec(extensions=("ts",), roots=("sub", "."))
    rows = {r["rel"]: r["root_ord"] for r in files_corpus(spark, spec, str(folder)).collect()}
    assert rows["sub/a.ts"] == 0
    assert rows["x.d.ts"] == 1


def test_many_config_files_at_once(spark):
    from textquarry.plans.config import config_rows

    texts = {"a": "lost\n[strings]\n fetch( \n# no\n\n[other]\n[include]\nts\n[ignore]\nd.ts\n[exclude-extensions]\nx", "b": "﻿[search]\r\n\xa0one\t\r\n[search] \n two words", "c": "", "d": "[extensions]", "e": TEMPLATE}
    rows = spark.createDataFrame([(p, n, line) for p, t in texts.items() for n, line in enumerate(t.split("\n"))], "path string, n int, text string")
    got = {p: {"search": [], "extensions": [], "exclude": []} for p in texts}
    for r in sorted(config_rows(rows).collect()):
        got[r["path"]][r["field"]].append(r["value"])
    assert got == {p: parse_config(t) for p, t in texts.items()}


def test_ordinals(spark):
    from pyspark.sql import functions as F

    from textquarry.operators.ordinals import with_ordinal

    df = spark.range(5000).select(F.struct((F.col("id") % 3).alias("a"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("b")).alias("ord"), "id")
    rows = with_ordinal(df, "ord", "n", ranges=16).collect()
    assert [r["ord"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(r["ord"] for r in rows)
    assert sorted(r["n"] for r in rows) == list(range(5000))
    for few in (0, 1, 40):
        assert sorted(r["n"] for r in with_ordinal(df.where(F.col("id") < few), "ord", "n").collect()) == list(range(few))
    # Equal keys stay together, and each row has a number of its own.
    assert sorted(r["n"] for r in with_ordinal(df.withColumn("k", F.lit(1)), "k", "n").collect()) == list(range(5000))
