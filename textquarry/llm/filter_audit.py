"""How filters act together: what each of five filters removes at each place of each order of them.

A document is reduced to its part and five failure flags, documents to counts by
part and flags (32 rows a part at most), and a CUBE over part and flags counts
them for each set of selected flags. The rows of a grouping set whose selected
flags are all false are the survivors of these filters; no order of filters
matters for them. A step of an order is then a pair of subsets, the filters
before it and those with it: the pairs are joined to the survivors of either,
80 pairs a part, and the 600 steps of all orders to these.

The filters (words: maximal runs without white space, as they stand):
A: under MIN_WORDS words; B: distinct words under DISTINCT percent of words;
C: capitals over CAPITALS percent of characters; D: a character of SYMBOLS;
E: the same text as a document with a smaller doc_id, wherever that is.

Documents are grouped by their text's SHA-256, and only groups of several ids
are joined back; a group of any size is one number a task before it is shuffled.

Defined cases: a null text is empty and fails A alone (and E, if an empty text
has a smaller id); of rows that share id and text none is a copy of the other,
and each counts; a row without doc_id is no copy, none's original, and has no labels; rows
without source are part ''; of a doc_id's repeated labels one that is 1 counts;
an empty table has no parts and gives no rows. Very long texts are numbered in
pieces. Only doc_id, text and source are read, so others may have any name.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.bytewords import Words, blocks
from textquarry.llm.common import bounded_batches, materialize, table

QUERY = "op11_filter_audit"

FILTERS = "ABCDE"
#: Thresholds, all exclusive: words, percent of words, percent of characters; and the characters that D looks for.
MIN_WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
COUNTS = ("n", "good", "toxic")


def word_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(words, distinct words) of each text."""
    n, distinct = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for first, held in blocks(texts):
        w = Words(held)
        here = slice(first, first + len(held))
        n[here] = np.diff(w.bounds)
        text = np.repeat(np.arange(len(held), dtype=np.int32), n[here])
        order = np.lexsort((w.number, text))
        number, text = w.number[order], text[order]
        new = np.ones(len(order), bool)
        new[1:] = (number[1:] != number[:-1]) | (text[1:] != text[:-1])
        distinct[here] = np.bincount(text[new], minlength=len(held))
    return n, distinct


def _words(texts: pd.Series) -> pd.DataFrame:
    n, distinct = word_counts(texts.tolist())
    return pd.DataFrame({"n": n, "distinct": distinct})


def flags(documents: DataFrame) -> DataFrame:
    """doc_id, part and whether each filter fails, of each row."""
    bounded_batches(documents.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = F.pandas_udf(_words, "n long, distinct long")
    own = documents.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
    words = F.col("w.n"), F.col("w.distinct")
    own = own.select("doc_id", "part", counted("text").alias("w"), F.length("text").alias("chars"), F.regexp_count("text", F.lit("[A-Z]")).alias("capitals"), F.col("text").rlike(f"[{SYMBOLS}]").alias("D"), F.unhex(F.sha2("text", 256)).alias("key"))
    own = own.select("doc_id", "part", (words[0] < MIN_WORDS).alias("A"), (100 * words[1] < DISTINCT * words[0]).alias("B"), (100 * F.col("capitals").cast("long") > CAPITALS * F.col("chars").cast("long")).alias("C"), "D", "key")
    own = materialize(own, "audit-flags")
    copied = own.groupBy("key").agg(F.min("doc_id").alias("original"), F.max("doc_id").alias("last")).where("last > original").select("key", "original")
    return own.join(copied, "key", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("original"), F.lit(False))).select("doc_id", "part", *FILTERS)


def survivors(failing: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, mask (of the filters applied, the first one's bit lowest), and how many documents, good and toxic ones pass them. failing: doc_id, part and a flag for each filter."""
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    patterns = materialize(failing.join(marks, "doc_id", "left").groupBy("part", *filters).agg(F.count("*").alias("n"), one("good"), one("toxic")), "audit-patterns")
    cube = patterns.cube("part", *reversed(filters)).agg(F.grouping_id().alias("level"), *(F.sum(c).alias(c) for c in COUNTS))
    full = 2 ** len(filters) - 1
    passed = ~F.coalesce(*(F.when(F.col(f), F.lit(True)) for f in filters), F.lit(False))
    own = cube.where(F.col("level") <= full).select("part", (F.lit(full) - F.col("level")).cast("int").alias("mask"), passed.alias("passed"), *COUNTS)
    # The rows with failing flags keep a subset that nobody survives at zero.
    return own.groupBy("part", "mask").agg(*(F.sum(F.when(F.col("passed"), F.col(c)).otherwise(0)).alias(c) for c in COUNTS))


def audit(failing: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The counts of each step of each order of the filters in each part."""
    spark, n = failing.sparkSession, len(filters)
    alive = materialize(survivors(failing, labels, filters), "audit-survivors")
    bit = {f: 1 << i for i, f in enumerate(filters)}
    pairs = [(f, m := sum(bit[x] for x in before), m | bit[f], factorial(len(before)) * factorial(n - 1 - len(before))) for f in filters for k in range(n) for before in combinations([x for x in filters if x != f], k)]
    # 80 and 600 rows, whatever the data.
    pairs = F.broadcast(spark.createDataFrame(pairs, "filter string, before int, after int, orders long"))
    steps = [("".join(o), i + 1, f, sum(bit[x] for x in o[:i])) for o in permutations(filters) for i, f in enumerate(o)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int"))
    ahead = alive.select("part", F.col("mask").alias("before"), *(F.col(c).alias(f"had_{c}") for c in COUNTS))
    behind = alive.select("part", F.col("mask").alias("after"), *(F.col(c).alias(f"left_{c}") for c in COUNTS))
    step = ahead.join(pairs, "before").join(behind, ["part", "after"])
    step = step.select("part", "filter", "before", "orders", F.col("left_n").alias("kept"), *((F.col(f"had_{c}") - F.col(f"left_{c}")).alias(x) for c, x in zip(COUNTS, ("removed", "good_lost", "toxic_lost"), strict=True)))
    last = sum(bit.values()) - F.element_at(F.create_map(*(F.lit(x) for f in filters for x in (f, bit[f]))), F.col("filter"))
    of_filter = step.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("before") == last, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    out = step.join(of_filter, ["part", "filter"]).join(steps, ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flags(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


#: Every document through every order, step by step.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
             100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
      FROM d LEFT JOIN marks ON marks.doc_id = d.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
run AS (SELECT f.*, filter_order, list_filter([1, 2, 3, 4, 5], lambda i: CASE filter_order[i] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS failing FROM f, orders),
each AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM run),
counted AS (SELECT part, filter_order, step, filter_order[step] AS filter, count(*) FILTER (failing[1] IS NULL OR failing[1] > step) AS kept, count(*) FILTER (failing[1] = step) AS removed,
             count(*) FILTER (list_contains(failing, step) AND failing[1] < step) AS redundant, count(*) FILTER (failing = [step]) AS unique_fails,
             count(*) FILTER (failing[1] = step AND good) AS good_lost, count(*) FILTER (failing[1] = step AND toxic) AS toxic_lost
      FROM each GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""
