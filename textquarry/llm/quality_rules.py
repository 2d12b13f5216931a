"""Quality rules judged by an isolation forest over their statistics.

The rules' statistics of a text (counts of words, symbols, repeated lines and
windows, case, digits, line ends) place it among the labelled texts. A forest of
random splits (Liu, Ting and Zhou, 2008) isolates an unusual text in few steps;
the mean path length over all trees gives its anomaly score. Texts that fail the
base rule are never kept, so the forest is there for the others, and labelled rows
that fail it teach nothing. All that pass it are learnt from, held-out rows never:
they grow the forest or calibrate its threshold. Two thirds of the good ones grow it,
and bad ones up to SHARE of these, since a statistic that is the same in all good
rows (no symbols, say) would never be split, and what differs by it not be isolated.
All other rows, good and bad, which no tree has seen, calibrate: of the thresholds that
reject no more than MAX_FALSE of the good ones it is the one at which the part
of bad rows that are rejected is furthest above that of good ones.

Every row's statistics are counted once and stored, and the labelled ones are read
from there. Each growing row is dealt to one tree at least, and to as many as fill
every tree with SUBSAMPLE rows: a tree grows from SUBSAMPLE rows, or from its part of
all (one in TREES) where that is more. Trees have the depth of SUBSAMPLE rows, so their
size is bounded, and their leaves count all rows that reach them. A tree follows from
its rows alone, not from their order, and is grown by a task; the threshold is found
exactly, by sums over ranges of scores.

Defined cases: null, empty and blank texts have no words and fail the base rule;
a text of any length is counted in pieces; repeated rows get equal results; a score
equal to the threshold is rejected; without labelled rows of both classes that pass
the base rule the forest rejects nothing; an empty table gives an empty result; no column but doc_id
and text is read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.bytewords import IS_SPACE, PIECE, U, Words, blocks, mixed
from textquarry.llm.common import bounded_batches, held_out, materialize, release, table, unit_hash

QUERY = "op7_quality_rules"

TREES = 128
#: Rows that a tree is grown from at least, where there are so many.
SUBSAMPLE = 1024
#: Part of the good rows that the forest is grown from.
GROWN = 2 / 3
#: Bad rows among those that trees are grown from: few, as unusual rows are.
SHARE = 0.01
MAX_FALSE = 0.04
SEED = 7
#: Ranges of scores that are summed apart.
RANGES = 1 << 14

def _bytes(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


#: What bytes are counted, in the order of statistics: code points in words, symbols, capitals, letters, digits, points.
_COUNTED = np.stack(
    [(np.arange(256) & 0xC0) != 0x80, _bytes(b"#*$%&|<>"), _bytes(bytes(range(65, 91))), _bytes(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)])), _bytes(b"0123456789"), _bytes(b".,;:!?")], 1
).astype(np.int64)
_COUNTED[IS_SPACE, 0] = 0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_letters", "n_digits", "n_points", "n_lines", "n_windows"]


def _histogram(x: np.ndarray) -> np.ndarray:
    return sum((np.bincount(x[i : i + PIECE], minlength=256) for i in range(0, len(x), PIECE)), np.zeros(256, np.int64))


def statistics(texts: list[str | None]) -> np.ndarray:
    """int64 rows of BASE and EXTRA."""
    out = np.zeros((len(texts), len(BASE) + len(EXTRA)), np.int64)
    for first, block in blocks(texts):
        w = Words(block)
        rows = slice(first, first + len(block))
        n = np.diff(w.bounds)
        out[rows, 0] = n
        counted = np.stack([_histogram(w.joined[a : b - 1]) for a, b in zip(w.offset[:-1], w.offset[1:], strict=True)]) @ _COUNTED
        out[rows, 1:3], out[rows, 5:9] = counted[:, :2], counted[:, 2:]
        # Windows of three words, those that reach into the next text left out; equal ones stand together once sorted.
        key = w.triples()
        if len(key):
            owner = np.repeat(np.arange(len(block), dtype=np.int32), n)
            own = np.flatnonzero(owner[:-2] == owner[2:])
            key = mixed(key[own] + owner[own].astype(np.uint64) * U(0xD6E8FEB86659FD93))
            order = np.argsort(key)
            key = key[order]
            again = key[1:] == key[:-1]
            twice = np.zeros(len(key), bool)
            twice[1:] |= again
            twice[:-1] |= again
            marked = np.zeros(len(owner), bool)
            for k in range(3):
                marked[own[order[twice]] + k] = True
            out[rows, 4] = np.bincount(owner[marked], minlength=len(block))
            out[rows, 10] = np.bincount(owner[own[order[np.concatenate([[True], ~again])[: len(order)]]]], minlength=len(block))
        for i, text in enumerate(block):
            lines, seen = 0, set()
            for x in BytesIO(text):
                if (x := x.removesuffix(b"\n")).strip(b" \t\x0b\x0c\r"):
                    lines += 1
                    seen.add(x)
            out[first + i, 3], out[first + i, 9] = lines - len(seen), lines
    return out


def features(stats: np.ndarray) -> np.ndarray:
    s = stats.astype(np.float64).T
    words, lines, letters = np.maximum(s[0], 1), np.maximum(s[9], 1), np.maximum(s[6], 1)
    return np.stack([s[1] / words, s[2] / words, s[3] / lines, s[4] / words, s[5] / letters, s[7] / np.maximum(s[1], 1), s[8] / words, np.log1p(s[0] / lines), s[10] / words], 1)


class Forest:
    """Trees as arrays: split feature (-1 for a leaf), split value, left child (right is next), and path length at leaves."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.depth = self.height(self.size)
        self.trees = [self.grow(x[rng.choice(len(x), self.size, replace=False)], self.depth, rng) for _ in range(trees)]

    @classmethod
    def of(cls, trees: list[tuple], size: int, depth: int) -> Forest:
        """A forest of trees that were grown elsewhere, from size rows each."""
        out = cls.__new__(cls)
        out.trees, out.size, out.depth = trees, size, depth
        return out

    @staticmethod
    def height(size: int) -> int:
        return max(1, math.ceil(math.log2(max(size, 2))))

    @classmethod
    def grow(cls, x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
        feature, value, left, path = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            at, part, level = todo.pop()
            lo, hi = part.min(0), part.max(0)
            split = np.flatnonzero(hi > lo)
            if level >= depth or len(part) <= 1 or not len(split):
                path[at] = level + cls.expected(len(part))
                continue
            f = int(rng.choice(split))
            v = float(rng.uniform(lo[f], hi[f]))
            feature[at], value[at], left[at] = f, v, len(feature)
            below = part[:, f] <= v
            for child in (part[below], part[~below]):
                todo.append((len(feature), child, level + 1))
                feature.append(-1)
                value.append(0.0)
                left.append(0)
                path.append(0.0)
        return tuple(map(np.array, (feature, value, left, path)))

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher is more unusual. Rounded, so that equal paths are equal scores on any machine."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] > value[at]), at)
            total += path[at]
        return np.round(2.0 ** (-total / len(self.trees) / max(self.expected(self.size), 1e-9)), 12)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def fit(texts: list[str], labels: list[int], max_false: float = MAX_FALSE) -> tuple[Forest | None, float]:
    """The forest over a few texts that are at hand, and the score from which a text is rejected; ``trained`` is for tables."""
    y, stats = np.array(labels), statistics(texts)
    passed = ~base_failed(stats)
    good, bad = (features(stats[passed & (y == label)]) for label in (1, 0)) if len(y) else ((), ())
    if not len(good) or not len(bad):
        return None, 2.0
    own = lambda x: np.arange(len(x)) % 3 == 0 if len(x) > 2 else np.ones(len(x), bool)
    grown = [x[~own(x)] if (~own(x)).any() else x for x in (good, bad)]
    forest = Forest(np.concatenate([grown[0], grown[1][: math.ceil(SHARE * len(grown[0]))]]))
    good, bad = (np.sort(forest.score(x[own(x)])) for x in (good, bad))
    # To choose from: halfway between each two scores seen, and what lies above all of them. A text at the threshold is rejected.
    at = np.unique(np.concatenate([good, bad]))
    at = np.append((at[1:] + at[:-1]) / 2, at[-1] + 1e-9)
    false, found = (1 - np.searchsorted(x, at) / len(x) for x in (good, bad))
    return forest, float(at[np.argmax(np.where(false <= max_false, found - false, -1.0))])


def _verdicts(stats: np.ndarray, forest: Forest | None, threshold: float) -> pd.DataFrame:
    anomaly = forest.score(features(stats)) if forest is not None and len(stats) else np.zeros(len(stats))
    failed = base_failed(stats)
    return pd.DataFrame({"base_failed": failed, "anomaly": anomaly, "kept": ~failed & (anomaly < threshold)})


def judge(forest: Forest | None, threshold: float) -> Callable[[Column], Column]:
    """A column of struct<n_words, ..., base_failed, anomaly, kept> of a text column."""

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, anomaly double, kept boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            stats = statistics(text.tolist())
            yield pd.concat([pd.DataFrame(dict(zip(BASE, stats.T[:5], strict=True))), _verdicts(stats, forest, threshold)], axis=1)

    return judged


def _counted(text: str) -> Column:
    """struct of BASE and EXTRA of a text column."""

    @F.pandas_udf(", ".join(f"{c} long" for c in BASE + EXTRA))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            yield pd.DataFrame(statistics(text.tolist()), columns=BASE + EXTRA)

    return counted(text)


def _judged(forest: Forest | None, threshold: float = 2.0) -> Column:
    """struct<base_failed, anomaly, kept> of the columns BASE and EXTRA."""

    @F.pandas_udf("base_failed boolean, anomaly double, kept boolean")
    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stats in batches:
            yield _verdicts(stats.to_numpy(np.int64), forest, threshold)

    return judged(F.struct(*BASE, *EXTRA))


def labelled(counted: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of counted that labels are learnt from: doc_id, y, BASE and EXTRA. Those that share all of these count once."""
    y = F.col("quality").cast("int")
    known = labels.select("doc_id", y.alias("y")).where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).distinct()
    passed = counted.where("n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words")
    return passed.join(known, "doc_id").select("doc_id", "y", *BASE, *EXTRA).dropDuplicates()


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame, float] | None:
    """Rows of labelled that the forest is grown from, those that calibrate it, and how many the first are, about; None unless there are rows of both labels.

    A label's rows are both where it has too few to be parted.
    """
    part = unit_hash(F.col("doc_id"), seed=SEED)
    of = {r["y"]: r for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.min(part).alias("least"), F.max(part).alias("most")).collect()}
    if len(of) < 2:
        return None
    share = {1: GROWN, 0: min(GROWN, SHARE * GROWN * of[1]["n"] / of[0]["n"])}
    to = {y: max(share[y], of[y]["least"]) for y in of}
    size = sum(of[y]["n"] * to[y] if of[y]["n"] > 2 else of[y]["n"] for y in of)
    grown = [(F.col("y") == y) & (part <= to[y]) for y in of]
    rest = [(F.col("y") == y) & ((part > to[y]) | F.lit(of[y]["most"] <= to[y])) for y in of]
    return rows.where(grown[0] | grown[1]), rows.where(rest[0] | rest[1]), size


def dealt(grown: DataFrame, size: float) -> DataFrame:
    """The rows with the trees that they grow, a row each: one tree at least, and SUBSAMPLE rows a tree or more, about."""
    keyed = grown.withColumn("_key", F.xxhash64(F.lit(SEED), "doc_id", "y", *BASE, *EXTRA))
    home = F.floor(unit_hash(F.col("_key")) * TREES).cast("int")
    more = min(1.0, (TREES * SUBSAMPLE / size - 1) / max(TREES - 1, 1))
    if size <= SUBSAMPLE:
        trees = F.sequence(F.lit(0), F.lit(TREES - 1))
    elif more <= 0:
        trees = F.array(home)
    else:
        trees = F.filter(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: (t == home) | (unit_hash(F.col("_key"), t) < more))
    return keyed.select(F.explode(trees).alias("tree"), *BASE, *EXTRA)


def forest_of(rows: DataFrame, size: float) -> Forest:
    """The forest of dealt rows, each tree grown by the task that has its rows."""
    depth = Forest.height(min(math.ceil(size), SUBSAMPLE))

    def tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = features(rows[BASE + EXTRA].to_numpy(np.int64))
        arrays = Forest.grow(x, depth, np.random.default_rng([SEED, key[0]]))
        return pd.DataFrame({"tree": [key[0]], "n": [len(x)], **{c: [a] for c, a in zip(("feature", "value", "left", "path"), arrays, strict=True)}})

    schema = "tree int, n long, feature array<int>, value array<double>, left array<int>, path array<double>"
    found = rows.repartition(max(1, TREES // 4), "tree").groupBy("tree").applyInPandas(tree, schema).collect()
    found.sort(key=lambda r: r["tree"])
    trees = [(np.array(r["feature"], np.int32), np.array(r["value"]), np.array(r["left"], np.int32), np.array(r["path"])) for r in found]
    return Forest.of(trees, round(sum(r["n"] for r in found) / len(found)), depth)


def threshold_of(scored: DataFrame, max_false: float = MAX_FALSE) -> float:
    """The score from which a row is rejected, by y and anomaly of all rows that calibrate; there are some of both labels.

    To choose from: halfway between each two scores seen, and above all of them.
    """
    seen = scored.groupBy("anomaly").agg(F.count_if(F.col("y") == 1).alias("good"), F.count_if(F.col("y") == 0).alias("bad"))
    seen = materialize(seen.withColumn("range", F.floor(F.col("anomaly") * RANGES)), "rules-scores")
    n = seen.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("anomaly").alias("least"), F.max("anomaly").alias("most")).first()
    # Rows at or above each score: those of the ranges above, one row a range, and those of its own.
    over, own = (w.rowsBetween(Window.unboundedPreceding, to) for w, to in ((Window.orderBy(F.desc("range")), -1), (Window.partitionBy("range").orderBy(F.desc("anomaly")), 0)))
    above = seen.groupBy("range").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    above = above.select("range", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(c) for c in "gb"))
    rejected = seen.join(F.broadcast(above), "range").select("anomaly", (F.col("g") + F.sum("good").over(own)).alias("false"), (F.col("b") + F.sum("bad").over(own)).alias("found"))
    allowed = rejected.where((F.col("false") / n["good"] <= max_false) & (F.col("anomaly") > n["least"]))
    best = allowed.withColumn("gain", F.col("found") * n["good"] - F.col("false") * n["bad"]).orderBy(F.desc("gain"), "anomaly").first()
    if best is None or best["gain"] < 0:
        at = n["most"] + 1e-9
    else:
        at = (seen.where(F.col("anomaly") < best["anomaly"]).agg(F.max("anomaly")).first()[0] + best["anomaly"]) / 2
    release(seen)
    return at


def trained(counted: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """The forest and threshold by all labelled rows of counted, a stored table of doc_id, BASE and EXTRA."""
    rows = materialize(labelled(counted, labels), "rules-labelled")
    parts = parted(rows)
    if parts is None:
        release(rows)
        return None, 2.0
    grown, rest, size = parts
    forest = forest_of(dealt(grown, size), size)
    threshold = threshold_of(rest.select("y", _judged(forest)["anomaly"].alias("anomaly")))
    release(rows)
    return forest, threshold


def apply(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents' doc_id with statistics, base_failed, anomaly and kept."""
    bounded_batches(documents.sparkSession)
    counted = materialize(documents.select("doc_id", _counted("text").alias("s")).select("doc_id", "s.*"), "rules-counted")
    return counted.select("doc_id", *BASE, _judged(*trained(counted, labels)).alias("j")).select("doc_id", *BASE, "j.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("anomaly")


#: Random splits have no SQL form; counts, scores and verdicts are tested against a brute-force version.
ORACLE_SQL = None
