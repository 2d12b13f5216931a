"""Array functions that Spark's own don't spell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running values are folded in blocks of so many, since appending to an array copies it.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: Spark would compute a column again at each place of a lambda that names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however many filters and columns read it: Spark moves a filter on it below a projection, and computes the value again there, but never below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def running(xs: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each place of xs, op over all that stand before it, from zero; null for an empty array."""

    def fold(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def by_block(blocks: Column) -> Column:
        firsts = fold(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero)
        return let(firsts, lambda s: F.flatten(F.transform(blocks, lambda b, j: F.slice(fold(b, F.get(s, j)), F.lit(1), F.size(b)))))

    def of(values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(BLOCK)), lambda i: F.slice(values, i + 1, F.lit(BLOCK)))
        return F.when(F.size(values) > 0, let(cut, by_block))

    # Bound once: each block would compute all of xs again.
    return let(xs, of)
