"""Config files: sections of search strings, extensions and exclusions, a value a line."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import BLANK

#: Section headers and what they fill.
SECTIONS = {
    "[search]": "search", "[strings]": "search",
    "[extensions]": "extensions", "[include]": "extensions",
    "[exclude]": "exclude", "[exclude-extensions]": "exclude", "[ignore]": "exclude",
}

TEMPLATE = """\
# Search settings. A value a line; lines that start with # and empty lines count for nothing.

[search]
# strings to look for, such as
# TODO

[extensions]
# extensions without dots, such as
# ts
# none means the usual text and source files

[exclude]
# paths to leave out, as globs, such as
# **/*.min.js
"""


def parse_config(text: str) -> dict[str, list[str]]:
    """search, extensions and exclude. Unknown headers are values of the section they stand in; what stands before any header is dropped."""
    out: dict[str, list[str]] = {"search": [], "extensions": [], "exclude": []}
    section = None
    for line in text.split("\n"):
        value = line.strip(BLANK)
        if not value or value.startswith("#"):
            continue
        if value in SECTIONS:
            section = SECTIONS[value]
        elif section:
            out[section].append(value)
    return out


def config_rows(lines: DataFrame) -> DataFrame:
    """path, n, field and value of all values of many config files, given as lines: path, n (ascending in a path), text. The rules are those of ``parse_config``."""
    value = F.trim(F.col("text"), F.lit(BLANK))
    header = F.coalesce(*(F.when(F.col("value") == h, field) for h, field in SECTIONS.items()))
    own = lines.select("path", "n", value.alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#"))).withColumn("header", header)
    section = F.last("header", ignorenulls=True).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("field", section).where("header IS NULL AND field IS NOT NULL").select("path", "n", "field", "value")


def read_config(path: str) -> dict[str, list[str]]:
    return parse_config(Path(path).read_text(encoding="utf-8", errors="replace"))


def write_template(path: str = "search-config.ini", create_folder: bool = False) -> Path:
    """A new config file; one that exists is never overwritten."""
    target = Path(path)
    if target.exists():
        raise FileExistsError(path)
    if not target.parent.exists():
        if not create_folder:
            raise FileNotFoundError(f"folder does not exist: {target.parent}")
        target.parent.mkdir(parents=True)
    target.write_text(TEMPLATE, encoding="utf-8")
    return target
