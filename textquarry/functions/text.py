"""Small text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as blank around settings: also the no-break space and the byte order mark.
BLANK = "\ufeff \t\n\r\v\f\xa0"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def utf16_length(s: Column) -> Column:
    """UTF-16 code units. Only text with characters of four bytes is searched for them."""
    chars = F.length(s).cast("long")
    return F.when(F.octet_length(s) == chars, chars).otherwise(chars + F.regexp_count(s, F.lit(ASTRAL)))


def token_estimate(size: Column) -> Column:
    """A quarter of size, rounded half up."""
    return F.floor((size + 2) / 4).cast("long")


def pad_start(s: Column, width: int) -> Column:
    """Blanks in front up to width; longer text stays whole, which lpad would cut."""
    return F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(s))), s)


def extension(path: Column) -> Column:
    """The last .ext of the file name as it stands, '' if none or if the name only starts with a dot."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def fence_language(path: Column) -> Column:
    name = F.substring(extension(path), 2, 1_000_000)
    return F.when(name == "", F.lit("txt")).otherwise(name)


def short_path(path: Column) -> Column:
    """dir/base, or base alone at the top: the path itself, without a leading ./"""
    return F.regexp_replace(path, r"^\./", "")


def grouped_digits(n: Column) -> Column:
    """1,234,567"""
    return F.format_number(n, 0)


def csv_values(s: Column) -> Column:
    """The values of a comma-separated setting, blanks around them and empty ones left out."""
    return F.filter(F.transform(F.split(s, ",", -1), lambda x: F.trim(x, F.lit(BLANK))), lambda x: x != "")


def without_leading_dots(path: Column) -> Column:
    """A path pattern without the dots and slashes that it starts with."""
    return F.regexp_replace(path, r"^[./]+", "")


def has_glob(pattern: Column) -> Column:
    """Whether a character of it has a meaning in globs."""
    return pattern.rlike(r"[*?\[\]{}!]")
