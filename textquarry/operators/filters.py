"""Which files of a corpus a search keeps. A corpus has rel (path), length (bytes), content and ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.plans import globs
from textquarry.plans.spec import QuerySpec


def extension_rank(rel: Column, extensions: tuple[str, ...]) -> Column:
    """Place of the first extension that rel ends in, null if none does. Names are compared as they stand."""
    out = F.lit(None).cast("int")
    for i, ext in reversed(list(enumerate(extensions))):
        out = F.when(rel.rlike(globs.compile_glob(globs.extension_glob(ext)).regex), F.lit(i)).otherwise(out)
    return out


def extension_regex(extensions: tuple[str, ...]) -> str:
    return globs.union_regex([globs.extension_glob(e) for e in extensions])


def scan_filter(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """Files with one of the extensions that neither the built-in nor the search's exclusions name. The path within its root decides, before any content is read."""
    path = F.col("root_rel") if "root_rel" in corpus.columns else F.col("rel")
    return corpus.where(path.rlike(extension_regex(spec.extensions)) & ~path.rlike(spec.ignore_regex))


def _path_conditions(spec: QuerySpec) -> list[Column]:
    """Include globs, then ignore globs, which win."""
    out = [globs.any_match(F.col("rel"), spec.include_globs)] if spec.include else []
    return out + ([~globs.any_match(F.col("rel"), spec.ignore_globs)] if spec.ignore else [])


def path_filter(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    for condition in _path_conditions(spec):
        corpus = corpus.where(condition)
    return corpus


def path_matches(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """corpus with _path: whether the path filters keep a file."""
    kept = F.lit(True)
    for condition in _path_conditions(spec):
        kept &= condition
    return corpus.withColumn("_path", kept)


def contains_any(content: Column, strings: tuple[str, ...], case_sensitive: bool, pattern: str) -> Column:
    """One pass for any number of strings; a single exact string goes down to the scan."""
    return F.contains(content, F.lit(strings[0])) if case_sensitive and len(strings) == 1 else content.rlike(pattern)


def by_line(spec: QuerySpec) -> bool:
    """Whether each match of the strings lies in a line, so that a file has one if one of its lines does."""
    return bool(spec.strings) and not any("\n" in s for s in spec.strings)


def content_conditions(spec: QuerySpec, strings: bool = True) -> list[Column]:
    """What a file's length and content must meet, cheap conditions first. Only where content is asked are large files left out. strings: whether it must have one of them, too."""
    content, out = F.col("content"), []
    if spec.strings or spec.exclude_strings:
        out.append(F.col("length") <= spec.max_bytes)
    if spec.exclude_strings:
        out.append(~contains_any(content, spec.exclude_strings, spec.case_sensitive, spec.exclude_pattern))
    if strings and spec.strings:
        out.append(contains_any(content, spec.strings, spec.case_sensitive, spec.pattern))
    return out


def content_filter(corpus: DataFrame, spec: QuerySpec, strings: bool = True) -> DataFrame:
    """Some of strings and none of exclude_strings."""
    for condition in content_conditions(spec, strings):
        corpus = corpus.where(condition)
    return corpus


def select_files(corpus: DataFrame, spec: QuerySpec, strings: bool = True) -> DataFrame:
    """All filters, cheap ones first. Without strings: for those who look at the lines themselves and drop files without a match."""
    return content_filter(path_filter(scan_filter(corpus, spec), spec), spec, strings)


def searched_lines(corpus: DataFrame, spec: QuerySpec) -> DataFrame:
    """Files to be searched line by line: the content is searched before only where a match may lie across lines."""
    return select_files(corpus, spec, strings=not by_line(spec))
