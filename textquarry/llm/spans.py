"""Character spans of pattern matches, with functions of Spark only.

Everything here is linear in the text and near-linear in the matches: values
used twice are bound once by :func:`let`, and running sums are folded in blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.arrays import let, running

#: A match: where it starts and stops (code points, stop exclusive), its kind's place, and itself.
SPAN = "struct<start:bigint,ord:int,stop:bigint,hit:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def spans(text: Column, pattern: str, ord_: int, where: Column) -> Column:
    """Leftmost non-overlapping matches of pattern in text; none unless where, a cheap condition that each text with a match meets.

    Splitting and extracting go by the same rule, so gaps and hits alternate, and a match starts after all gaps and hits before it.
    """
    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"))

    def located(b: Column) -> Column:
        lengths = F.zip_with(F.slice(b["g"], F.lit(1), F.size(b["h"])), b["h"], lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.length(h).cast("long").alias("n")))

        def placed(n: Column) -> Column:
            before = running(F.transform(n, lambda x: x["g"] + x["n"]), lambda a, x: a + x, F.lit(0).cast("long"))
            return let(
                before,
                lambda at: F.transform(
                    n,
                    lambda x, i: F.struct(
                        (F.get(at, i) + x["g"]).alias("start"), F.lit(ord_).alias("ord"), (F.get(at, i) + x["g"] + x["n"]).alias("stop"), F.get(b["h"], i).alias("hit")),
                ),
            )

        return let(lengths, placed)

    return F.coalesce(F.when(where, let(both, located)), no_spans())


def joined(*parts: Column) -> Column:
    """All spans by start, then kind."""
    return F.array_sort(reduce(lambda a, b: F.concat(a, b), parts))


def render(found: Column, names: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count(found: Column, ord_: int) -> Column:
    return F.size(F.filter(found, lambda s: s["ord"] == ord_)).cast("long")


#: Characters of a block that a long text is cut into, so that a piece of it is found without walking all of it.
CUT = 4096


def cut(text: Column) -> Column:
    """text in blocks, for :func:`piece`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))


def piece(blocks: Column, start: Column, stop: Column) -> Column:
    """The characters from start to stop (exclusive) of the text in blocks; empty if there are none between."""
    first, last = F.floor(start / CUT).cast("int"), F.floor((stop - 1) / CUT).cast("int")
    begin = (start % CUT + 1).cast("int")
    within = F.substr(F.get(blocks, first), begin, (stop - start).cast("int"))
    across = F.concat(F.substr(F.get(blocks, first), begin), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substr(F.get(blocks, last), F.lit(1), ((stop - 1) % CUT + 1).cast("int")))
    return F.when(stop <= start, "").when(first == last, within).otherwise(across)


def replaced(text: Column, found: Column, label: Callable[[Column], Column]) -> Column:
    """text with each of the sorted spans replaced by its label; a span inside earlier ones adds nothing."""

    def built(b: Column) -> Column:
        shown = F.transform(b["f"], lambda s, i: F.concat(piece(b["c"], F.get(b["upto"], i), s["start"]), F.when(s["stop"] > F.get(b["upto"], i), label(s)).otherwise("")))
        last = F.array_max(F.transform(b["f"], lambda s: s["stop"]))
        return F.concat(F.array_join(shown, ""), piece(b["c"], last, b["n"]))

    upto = running(F.transform(found, lambda s: s["stop"]), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
    return F.when(F.size(found) > 0, let(F.struct(found.alias("f"), upto.alias("upto"), cut(text).alias("c"), F.length(text).cast("long").alias("n")), built)).otherwise(text)
