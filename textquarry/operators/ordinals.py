"""Dense numbers in an order, without a task that has all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the rows are dealt into, and sampled keys for each.
RANGES, SAMPLED = 128, 16
#: Ranges of rows that figures are carried over.
CARRIED = 32


def _literal(value) -> Column:
    """A collected key, a struct too, as a column."""
    return F.struct(*(_literal(v).alias(n) for n, v in value.asDict().items())) if hasattr(value, "asDict") else F.lit(value)


def in_ranges(rows: DataFrame, key: str, name: str, ranges: int = RANGES) -> DataFrame:
    """rows with the number of the range that key, which holds no nulls, lies in: ascending in key, the rows of one key in one range.

    The ranges are cut at sampled keys, a few thousand whatever the rows; where the cuts lie decides how even ranges are, and nothing else.
    """
    some = rows.select(key).orderBy(F.xxhash64(key), key).limit(ranges * SAMPLED)
    keys = [r[0] for r in some.orderBy(key).collect()]
    # So few rows that all were sampled are one range.
    cuts = list(dict.fromkeys(keys[i] for i in range(SAMPLED, len(keys), SAMPLED))) if len(keys) == ranges * SAMPLED else []
    kind = rows.schema[key].dataType
    own = rows
    at = F.lit(0)
    if cuts:
        # The number of cuts up to the key, by halves: a comparison for each doubling of the ranges.
        bounds = F.array(*(_literal(c).cast(kind) for c in cuts))
        for step in [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]:
            own = own.withColumn(name, at)
            at = F.col(name) + F.when(F.coalesce(F.get(bounds, F.col(name) + step - 1) <= F.col(key), F.lit(False)), step).otherwise(0)
    return own.withColumn(name, at)


def with_ordinal(rows: DataFrame, key: str, name: str, ranges: int = RANGES) -> DataFrame:
    """rows with their number from 0 in the order of key, which holds no nulls; equal keys are numbered in any order.

    A range's first number is the count of the ranges before it, and each is numbered by itself.
    """
    own = in_ranges(rows, key, "_at", ranges)
    # One row a range.
    before = own.groupBy("_at").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("_at").orderBy(key)) - 1
    return own.withColumn("_place", place).join(F.broadcast(before), "_at").withColumn(name, F.col("_before") + F.col("_place")).drop("_at", "_before", "_place")


def carried(rows: DataFrame, group: str, order: str, **what: tuple[str, str, bool]) -> DataFrame:
    """rows with, by each name of what, (sum, min or max, of a column, behind): that of the group's rows before, or behind, in the order. Null where there are none; no two rows of a group share their place in the order, and nulls of a column are passed over.

    Each range of rows is gone through by itself, in one direction, and its total is carried to the ranges after it: linear in the rows, and no task has all of a large group.
    """
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    own = in_ranges(rows.withColumn("_key", F.struct(group, order)), "_key", "_at", CARRIED).drop("_key")
    names = {n: f"_c{i}" for i, n in enumerate(what)}
    totals = own.groupBy(group, "_at").agg(*(getattr(F, fn)(c).alias(names[n]) for n, (fn, c, _) in what.items()))

    def over(keys: list[str], by: str, behind: bool):
        return Window.partitionBy(*keys).orderBy(F.col(by).desc() if behind else F.col(by)).rowsBetween(Window.unboundedPreceding, -1)

    totals = totals.select(group, "_at", *(getattr(F, fn)(names[n]).over(over([group], "_at", behind)).alias(names[n]) for n, (fn, _, behind) in what.items()))
    own = own.select("*", *(getattr(F, fn)(c).over(over([group, "_at"], order, behind)).alias(n) for n, (fn, c, behind) in what.items()))
    out = own.join(totals, [group, "_at"])
    return out.select(*rows.columns, *(both[fn](F.col(n), F.col(names[n])).alias(n) for n, (fn, _, _) in what.items()))
