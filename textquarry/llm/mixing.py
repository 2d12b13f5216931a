"""Mixing sources to target weights by Pareto order sampling, on DataFrame operations only.

Every document gets ``c = min(MAX_COPIES, price * weight)`` expected copies; the
price is its source's own, such that the expected words are the source's target.
The weight is the number of binary digits of the document's size, so that of two
documents of a source the one twice as long is somewhat likelier (or a column's
value). The whole part of ``c`` is certain; the fraction is the document's inclusion
probability ``p`` in a Pareto sample (Rosen 1997): documents are ranked by
``odds(u) / odds(p)`` with a repeatable uniform ``u``, and the sample is the longest
head of that order that fits the words left after the certain copies. The order is
gone down further, past the documents that do not fit, until nothing fits; then
the document whose size fits the last gap best is added if that brings the source
nearer its target.

No source is ever gathered in one task: the head is found from histograms of
ranks (map-side summed, FINE rows a source, first of coarse buckets and then within
one of these), and only the documents of the one bucket in which the head ends are
sorted.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; documents of size 0 take 0 words; rows that share doc_id and
source share their rank and are taken together, and of equal ranks the smaller
doc_id goes first; an empty table gives an empty result; a null doc_id counts as
an empty one in the hash; of other columns only weight_col is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import BROADCAST_ROWS, WORD, materialize, release, table

QUERY = "op9_mixing"

#: Weights of the sources, in order, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often, and no target exceeds this many times its source.
MAX_COPIES = 3
#: Ranks of a source are counted in FINE coarse buckets, and in one of these in FINE fine ones, before the last is sorted.
FINE = 256
SEED = "mix-1"


def _uniform() -> Column:
    """52 bits of a digest of seed and doc_id; any engine with md5 gets the same number."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the columns of right's row for its source; right has one row a source and is broadcast only if counted to be small."""
    right = right.withColumnRenamed("source", "_s")
    small = right.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with ord, its place by code point with null last. Ranges are numbered apart and shifted by the counts before them."""
    parts = materialize(
        sources.withColumn("_null", F.col("source").isNull()).repartitionByRange(F.asc("_null"), F.asc("source")).withColumn("_part", F.spark_partition_id()), "mix-ranges"
    )
    before = parts.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    own = Window.partitionBy("_part").orderBy("_null", "source")
    return parts.join(F.broadcast(before), "_part").withColumn("ord", F.row_number().over(own) - 1 + F.col("_before")).drop("_part", "_null", "_before", "count")


def allot(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """sources (source, source_size) with share weight and target: total by weight, cut at max_copies * source_size, the excess reshared until none is above.

    The common price a unit of weight only rises from round to round, so each
    round is one aggregate of two sums, and the loop ends when no more targets are cut.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int"))
    sources = materialize(_ranked(sources).withColumn("share", weight), "mix-sources")
    cap = F.col("source_size") * max_copies
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    price, cut = 0.0, -1
    while True:
        above = F.lit(cut >= 0) & (F.col("share") * F.lit(price) > cap)
        n, capped, free = sources.agg(F.sum(above.cast("int")), F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("share")))).first()
        if n is None or n == cut or not free:
            break
        price, cut = (total - capped) / free, n
    return sources.withColumn("target", F.when(F.col("share") * F.lit(price) > cap, cap.cast("double")).otherwise(F.col("share") * F.lit(price)))


def _priced(sizes: DataFrame, sources: DataFrame, max_copies: int) -> DataFrame:
    """(source, w, c): the copies that a document of weight w can expect, so that the source's words come to its target.

    Classes of a source that would go beyond max_copies are cut there and the rest is shared anew. The price only rises, so the loop ends when no more are cut.
    """
    classes = materialize(_join(sizes.groupBy("source", "w").agg(F.sum("size").alias("words")), sources.select("source", "target")).withColumn("price", F.lit(0.0)), "mix-classes")
    before = -1
    while True:
        cut = F.col("price") * F.col("w") > max_copies
        sums = classes.groupBy("source").agg(
            F.first("target").alias("target"), F.sum(F.when(cut, F.col("words")).otherwise(0)).alias("capped"), F.sum(F.when(cut, 0).otherwise(F.col("words") * F.col("w"))).alias("free"), F.sum(cut.cast("int")).alias("n"), F.first("price").alias("price"))
        sums = materialize(sums, "mix-prices")
        n = sums.agg(F.sum("n")).first()[0] or 0
        if n == before:
            break
        before = n
        price = F.when(F.col("free") > 0, (F.col("target") - max_copies * F.col("capped")) / F.col("free")).otherwise(F.col("price"))
        after = materialize(_join(classes.drop("price"), sums.select("source", "capped", "free", "price")).withColumn("price", price).drop("capped", "free"), "mix-classes")
        release(classes, sums)
        classes = after
    # On a grid of 2**-32, so that what is whole but for the last bits of a double is whole.
    copies = F.floor(F.least(F.lit(float(max_copies)), F.col("price") * F.col("w")) * F.lit(float(2**32)) + 0.5) / F.lit(float(2**32))
    return classes.select("source", "w", copies.alias("c"))


def _ends(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, budget, cross, base) for each source of limits (source, budget): the bucket in which the running size of its rows (source, bucket, size) goes beyond the budget, null if it never does, and the size before that bucket."""

    def crossed(counts: DataFrame, bucket: str) -> DataFrame:
        upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy(bucket))
        over = F.col("upto") > F.col("budget")
        counts = counts.withColumn("upto", upto)
        return counts.groupBy("source").agg(F.first("budget").alias("budget"), F.min(F.when(over, F.col(bucket))).alias("cross"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.first("base")).alias("base"))

    coarse = F.floor(F.col("bucket") / FINE)
    counts = _join(rows.groupBy("source", coarse.alias("coarse")).agg(F.sum("size").alias("size")), limits.withColumn("base", F.lit(0).cast("long")))
    first = materialize(crossed(counts, "coarse"), "mix-coarse")
    at = first.where("cross IS NOT NULL")
    inner = _join(rows, at.select("source", F.col("cross").alias("_c"))).where(coarse == F.col("_c")).groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    fine = crossed(_join(inner, at.select("source", "budget", "base")), "bucket")
    found = first.where("cross IS NULL").unionByName(fine)
    right = found.select(F.col("source").alias("_s"), "cross", "base")
    return limits.join(right, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "budget", "cross", F.coalesce("base", F.lit(0)).cast("long").alias("base"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, weight_col: str | None = None) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken. weight_col: positive weights in place of the sizes' binary digits; null counts as 1."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    w = F.length(F.bin("size")).cast("long") if weight_col is None else F.coalesce(F.col("w").cast("double"), F.lit(1.0))
    given = [] if weight_col is None else [F.col(weight_col).alias("w")]
    sizes = materialize(documents.select("doc_id", "source", size.alias("size"), *given, _uniform().alias("u")).withColumn("w", w), "mix-sizes")
    sources = materialize(allot(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies), "mix-targets")

    classes = materialize(_priced(sizes, sources, max_copies), "mix-copies").withColumnsRenamed({"source": "_s", "w": "_w"})
    few = classes.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    docs = sizes.join(F.broadcast(classes) if few else classes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("w") == F.col("_w"))).drop("_s", "_w")
    docs = _join(docs, sources).withColumn("whole", F.floor("c")).withColumn("p", F.col("c") - F.col("whole"))
    odds = lambda p: p / (F.lit(1.0) - p)
    docs = docs.withColumn("q", F.when(F.col("p") > 0, odds(F.col("u")) / odds(F.col("p"))))
    # A non-decreasing function of q, between 0 and 1.
    docs = docs.withColumn("bucket", F.floor((F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.col("q"))) * (FINE * FINE)))
    docs = materialize(docs.select("doc_id", "source", "size", "source_size", "target", "whole", "q", "bucket"), "mix-ranks")

    # Where the head ends in each source.
    budget = docs.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("budget"))
    ends = materialize(_ends(docs.where("q IS NOT NULL"), materialize(budget, "mix-budgets")), "mix-ends")
    docs = _join(docs, ends)
    at = F.col("bucket") == F.col("cross")
    running = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = docs.where(at).withColumn("upto", running).withColumn("head", F.col("upto") <= F.col("budget"))
    rest = docs.where(~F.coalesce(at, F.lit(False))).withColumn("upto", F.lit(0).cast("long")).withColumn("head", F.col("q").isNotNull() & (F.col("cross").isNull() | (F.col("bucket") < F.col("cross"))))
    docs = materialize(edge.unionByName(rest).select("doc_id", "source", "size", "source_size", "target", "whole", "q", "bucket", "head", "upto", "budget", "base"), "mix-heads")

    # The last gap: down the order past what does not fit, and the one document that fits the rest best.
    used = docs.groupBy("source").agg(F.first("budget").alias("budget"), F.greatest(F.first("base"), F.coalesce(F.max(F.when(F.col("head"), F.col("upto"))), F.lit(0))).alias("used"))
    gaps = materialize(used.select("source", (F.col("budget") - F.col("used")).alias("gap")), "mix-gaps")
    docs = docs.select("doc_id", "source", "size", "source_size", "target", "whole", "q", "bucket", F.coalesce("head", F.lit(False)).alias("head"))
    docs, gaps = _walked(docs, gaps)
    docs = _filled(docs, gaps)
    copies = F.col("whole") + F.col("head").cast("long")
    return docs.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _filled(docs: DataFrame, gaps: DataFrame) -> DataFrame:
    """docs with the best fitting document of each source added."""
    miss = F.abs(F.col("gap") - F.col("size"))
    beyond = _join(docs.where(F.col("q").isNotNull() & ~F.col("head")), gaps).where(miss < F.col("gap"))
    fits = materialize(beyond.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "q", "doc_id", "size")).alias("fit")), "mix-fits")
    fitting = F.coalesce((F.col("q") == F.col("fit.q")) & F.col("doc_id").eqNullSafe(F.col("fit.doc_id")), F.lit(False))
    return _join(docs, fits, "left").withColumn("head", F.col("head") | fitting).drop("fit")


def _walked(docs: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs and gaps with all taken that fit when the order is gone down past what does not.

    A pass takes the head of what still fits, by buckets as the first head was. The
    next goes on behind it, without what is larger than the new gap: what was passed
    over never fits again. So a pass needs no more than each source's gap and place,
    and what it took is told by these. Each source takes at least one document a
    pass, and seldom needs many. Rows of one doc_id count together.
    """
    rows = _join(docs.where(F.col("q").isNotNull() & ~F.col("head") & (F.col("size") > 0)), gaps).where(F.col("size") <= F.col("gap"))
    groups = materialize(rows.groupBy("source", "bucket", "q", "doc_id").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).where(F.col("size") <= F.col("gap")).drop("gap"), "mix-groups")
    key = dict(groups.dtypes)["doc_id"]
    state = gaps.select("source", "gap", F.lit(-1).cast("long").alias("b0"), F.lit(-1.0).alias("q0"), F.lit(None).cast(key).alias("d0"))
    after = lambda b, q, d: (F.col("bucket") > F.col(b)) | ((F.col("bucket") == F.col(b)) & ((F.col("q") > F.col(q)) | F.coalesce((F.col("q") == F.col(q)) & (F.col("doc_id") > F.col(d)), F.lit(False))))
    passes: list[DataFrame] = []
    while True:
        rows = _join(groups, state).where((F.col("size") <= F.col("gap")) & after("b0", "q0", "d0"))
        open_ = materialize(rows.groupBy("source").agg(F.first("gap").alias("budget"), F.first("b0").alias("b0"), F.first("q0").alias("q0"), F.first("d0").alias("d0")), "mix-open")
        if open_.isEmpty():
            break
        ends = materialize(_ends(rows.select("source", "bucket", "size"), open_.select("source", "budget")), "mix-ends")
        running = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id"))
        edge = _join(rows.drop("gap", "b0", "q0", "d0"), ends).where(F.col("bucket") == F.col("cross")).withColumn("upto", running).where(F.col("upto") <= F.col("budget"))
        last = edge.groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("last"), F.max("upto").alias("upto"))
        # Up to where a source's documents were taken: the end, the last one in the bucket of the crossing, or what lies before that bucket.
        to = _join(_join(open_, ends.drop("budget")), last, "left").select(
            "source", F.col("budget").alias("gap"), "b0", "q0", "d0", "cross", F.coalesce("last.q", F.lit(-1.0)).alias("q1"), F.col("last.doc_id").alias("d1"), (F.col("budget") - F.coalesce("upto", "base")).alias("left"))
        passes.append(materialize(to, "mix-pass"))
        state = passes[-1].select("source", F.when(F.col("cross").isNotNull(), F.col("left")).otherwise(-1.0).alias("gap"), F.col("cross").alias("b0"), F.col("q1").alias("q0"), F.col("d1").alias("d0")).where("b0 IS NOT NULL")
    if not passes:
        return docs, gaps
    spans = reduce(lambda a, b: a.unionByName(b), passes)
    got = _join(groups, spans).where((F.col("size") <= F.col("gap")) & after("b0", "q0", "d0") & (F.col("cross").isNull() | ~after("cross", "q1", "d1")))
    got = materialize(got.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "size", F.lit(True).alias("_got")), "mix-got")
    used = got.groupBy("_s").agg(F.sum("size").alias("used"))
    gaps = materialize(gaps.join(used, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")), "mix-gaps")
    small = got.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    got = got.drop("size")
    docs = docs.join(F.broadcast(got) if small else got, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    docs = materialize(docs.withColumn("head", F.col("head") | (F.coalesce("_got", F.lit(False)) & (F.col("size") > 0))).drop("_s", "_d", "_got"), "mix-heads")
    return docs, gaps


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s0),
s2 AS (
  SELECT *, {MAX_COPIES} * source_size AS cap, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
         row_number() OVER o AS k,
         coalesce(sum({MAX_COPIES} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_w
  FROM s1 WINDOW o AS (ORDER BY {MAX_COPIES} * source_size / w::DOUBLE, source NULLS LAST)),
s3 AS (SELECT *, (total - capped)::DOUBLE / (all_w - capped_w)::DOUBLE AS price FROM s2),
p AS (SELECT min_by(price, k) AS price FROM s3 WHERE price * w <= cap),
s AS (SELECT source, source_size, CASE WHEN w * p.price > cap THEN cap::DOUBLE ELSE w * p.price END AS target FROM s3, p),
-- Classes of a source by binary digits of the size; the widest are cut first.
c0 AS (SELECT source, length(bin(size)) AS w, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
c1 AS (
  SELECT c0.*, s.target, row_number() OVER o AS k, coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(words * c0.w) OVER (PARTITION BY c0.source ORDER BY c0.w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source WINDOW o AS (PARTITION BY c0.source ORDER BY c0.w DESC)),
c2 AS (SELECT *, (target - {MAX_COPIES} * capped::DOUBLE) / free::DOUBLE AS price FROM c1 WHERE free > 0),
c3 AS (SELECT source, min_by(price, k) AS price FROM c2 WHERE price * w <= {MAX_COPIES} * (1 + 1e-12::DOUBLE) GROUP BY source),
r AS (
  SELECT d.*, s.source_size, s.target, floor(least({MAX_COPIES}::DOUBLE, coalesce(c3.price, 0) * length(bin(size))) * 4294967296::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE AS c
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN c3 ON d.source IS NOT DISTINCT FROM c3.source),
q AS (SELECT *, floor(c)::BIGINT AS whole, CASE WHEN c > floor(c) THEN (u / (1 - u)) / ((c - floor(c)) / (1 - (c - floor(c)))) END AS q FROM r),
o AS MATERIALIZED (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS budget, row_number() OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id) AS n, dense_rank() OVER (ORDER BY source NULLS LAST) AS g FROM q),
-- Down the order of each source: what fits is taken.
w AS (
  SELECT g, 0::BIGINT AS n, any_value(budget) AS gap, NULL::BIGINT AS doc_id, FALSE AS head FROM o GROUP BY g
  UNION ALL
  SELECT o.g, o.n, CASE WHEN o.size <= w.gap THEN w.gap - o.size ELSE w.gap END, o.doc_id, o.size <= w.gap FROM w JOIN o ON o.g = w.g AND o.n = w.n + 1 WHERE o.q IS NOT NULL),
e AS (SELECT g, min_by(gap, -n) AS gap FROM w GROUP BY g),
f AS (
  SELECT o.*, coalesce(w.head, FALSE) AS head, e.gap, q IS NOT NULL AND NOT coalesce(w.head, FALSE) AND abs(e.gap - size) < e.gap AS fits
  FROM o JOIN e USING (g) LEFT JOIN w ON w.g = o.g AND w.n = o.n AND w.n > 0),
l AS (SELECT *, fits AND row_number() OVER (PARTITION BY g ORDER BY CASE WHEN fits THEN 0 ELSE 1 END, abs(gap - size), q, doc_id) = 1 AS last FROM f)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN head OR last THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM l
"""
