"""The bundle's sink: the same text as the stream's, from ordered parts, or none."""

import os

import pytest
from pyspark.sql import functions as F

from textquarry.plans.spec import QuerySpec
from textquarry.search import Search
from textquarry.sources import bundle
from textquarry.sources.corpus import documents_corpus, files_corpus


@pytest.fixture()
def folder(tmp_path):
    for i in range(30):
        (tmp_path / f"{'_' * (i % 2)}f{i}.{('ts', 'md')[i % 2]}").write_text(f"TODO {i} 😀é\n" * (i % 7) + "end")
    return tmp_path


@pytest.mark.parametrize(("style", "lines"), [("xml", None), ("markdown", None), ("xml", 1)])
@pytest.mark.parametrize("strings", [("TODO",), ("nowhere",)])
def test_joined_parts_are_the_bundle(spark, folder, tmp_path_factory, style, lines, strings):
    spec = QuerySpec(strings=strings, extensions=("md", "ts"), style=style, lines=lines)
    search = Search(files_corpus(spark, spec, str(folder)), spec)
    at = tmp_path_factory.mktemp("bundle")
    found = search.write_bundle(str(at / "b"), parts=5)
    want = "".join(search.bundle())
    names = [p["file"] for p in found["parts"]]
    assert "".join((at / "b" / n).read_text() for n in names) == want and (len(names) > 2 or strings == ("nowhere",))
    assert found["chars"] == len(want.encode("utf-16-le")) // 2 and found["size"] == len(want.encode())
    assert bundle.join_parts(spark, str(at / "b"), str(at / "whole")) == found["size"]
    assert (at / "whole").read_text() == want
    assert sorted(os.listdir(at / "b")) == sorted([*names, bundle.MANIFEST])


def shown(path):
    """Without what a task may have left that was stopped."""
    return sorted(f for f in os.listdir(path) if not f.startswith("."))


def test_a_bundle_is_whole_or_none(spark, tmp_path):
    rows = spark.range(100).select(F.lit(0).alias("section"), F.col("id").alias("ord"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("text"))
    path = str(tmp_path / "b")
    broken = rows.withColumn("text", F.when(F.col("ord") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        bundle.write_parts(broken, path, 4)
    assert not os.path.exists(path) or not shown(path)
    bundle.write_parts(rows, path, 4)
    with pytest.raises(Exception, match="holds a bundle"):
        bundle.write_parts(rows, path, 4)
    # Replacing fails: the old one stays; replacing works: nothing of it is left.
    before = bundle.manifest(path)
    with pytest.raises(Exception, match="lost"):
        bundle.write_parts(broken, path, 4, overwrite=True)
    assert bundle.manifest(path) == before and bundle.join_parts(spark, path, str(tmp_path / "whole")) == 290
    assert (tmp_path / "whole").read_text() == "".join(f"{i}\n" for i in range(100))
    after = bundle.write_parts(rows.where("ord < 10"), path, 2, overwrite=True)
    assert after["rows"] == 10 and shown(path) == sorted([*(p["file"] for p in after["parts"]), bundle.MANIFEST])
    # A part that is too short is noticed, and the target stays what it was.
    with open(f"{path}/{after['parts'][0]['file']}", "r+b") as f:
        f.truncate(1)
    with pytest.raises(OSError, match="bytes are there"):
        bundle.join_parts(spark, path, str(tmp_path / "whole"))
    assert (tmp_path / "whole").stat().st_size == 290 and len(os.listdir(tmp_path)) == 2


def test_long_parts_are_copied_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundle, "STRETCH", 7)
    rows = spark.range(40).select(F.lit(0).alias("section"), F.col("id").alias("ord"), F.lit("abcde").alias("text"))
    bundle.write_parts(rows, str(tmp_path / "b"), 2)
    bundle.join_parts(spark, str(tmp_path / "b"), str(tmp_path / "t"))
    assert (tmp_path / "t").read_text() == "abcde" * 40
    nothing = bundle.write_parts(rows.where("false"), str(tmp_path / "e"))
    assert nothing["size"] == 0 and bundle.join_parts(spark, str(tmp_path / "e"), str(tmp_path / "t")) == 0


def test_documents_as_a_bundle(spark, data, tmp_path):
    spec = QuerySpec(extensions=("ts", "md"), strings=("license",), lines=2)
    search = Search(documents_corpus(spark, data), spec)
    found = search.write_bundle(str(tmp_path / "b"))
    assert found["chars"] == sum(len(p.encode("utf-16-le")) // 2 for p in search.bundle())
