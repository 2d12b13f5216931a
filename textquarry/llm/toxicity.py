"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text, one on
pieces of toxic text. A window's distance is how many bytes fewer it takes with
both dictionaries' contents before it than with the ordinary one alone: what only
toxic text explains. A text is read in windows that overlap by a third and cover
it whole; its distances are summed up by their mean, their greatest values and the
share of windows over each of LEASTS, and a logistic curve calibrated on labelled
rows turns these into a probability, in which the threshold lies.

A toxic text is mostly ordinary. So the toxic dictionary is trained on the
pieces of toxic texts that chance and ordinary text don't explain: those that
stand in far more surroundings there than elsewhere. A dictionary of whole toxic
windows against one of ordinary windows, each loaded alone, tells little, since
what the two hold of ordinary text differs by chance, and that outweighs a word.

Fitted on a bounded sample of labelled rows (PER_CLASS of each label, held-out
rows never); every text is scored whole.

Defined cases: null and empty texts have no windows and get the calibrated score
of zero distances; a text of any length is read window by window; repeated rows
get equal scores, and of equal pieces the first is kept; without labelled rows of
both classes every score is 0; an empty table gives an empty result; no column but
doc_id and text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.bytewords import U, mixed
from textquarry.llm.common import bounded_batches, held_out, labelled_sample, table

QUERY = "op6_toxicity"

PER_CLASS = 2000
WINDOW, STEP = 96, 64
DICTIONARY = 16_384
TELLING = 1024
#: A thorough search: at low levels, matches missed by chance drown what the toxic dictionary saves.
LEVEL = 9
#: Length of the runs of bytes that tell toxic text, and how far beyond chance they must stand.
GRAM = 6
LEAST_Z, LEAST_OF_BEST = 5.0, 0.15
#: Savings of a window, in bytes, that are counted.
LEASTS = (1, 2, 3, 4, 6)
N = 3 + 2 * len(LEASTS)
THRESHOLD = 0.5
#: Share of toxic rows that scores are calibrated to.
PRIOR = 0.2


def windows(text: bytes) -> Iterator[bytes]:
    """Overlapping pieces of WINDOW bytes that cover text; the last is the rest."""
    return (text[i : i + WINDOW] for i in range(0, max(len(text) - (WINDOW - STEP), 1), STEP)) if text else iter(())


#: The three repeated offsets that end a trained dictionary's tables, before its content.
_TABLES_END = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])


def _content(samples: list[bytes], size: int) -> bytes:
    """What a dictionary trained on samples holds, without its header and tables; where the samples are too few to train on, they are it themselves."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        trained = zstd.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, k=32, d=6).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]
    return trained[trained.index(_TABLES_END) + len(_TABLES_END) :]


class Distance:
    """Bytes saved by the toxic dictionary, by window.

    Both sides know ordinary text: the toxic dictionary's content stands before
    the ordinary one's. What differs is then what only toxic text explains.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.parts = []
        for data in (ordinary, toxic + ordinary):
            d = zstd.ZstdCompressionDict(data or b"\0" * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.parts.append(zstd.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, pieces: Iterable[bytes]) -> np.ndarray:
        a, b = (c.compress for c in self.parts)
        return np.fromiter((len(a(p)) - len(b(p)) for p in pieces), np.float64)


def summary(d: np.ndarray) -> np.ndarray:
    if not len(d):
        return np.zeros(N)
    top = np.sort(d)[::-1]
    return np.array([d.mean(), top[0], top[: min(4, len(top))].mean(), *((d >= least).mean() for least in LEASTS), *(np.log1p((d >= least).sum()) for least in LEASTS)])


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.ordinary, self.toxic, self.mean, self.scale, self.weights = ordinary, toxic, mean, scale, weights
        self._distance = None

    def __getstate__(self):
        return self.__dict__ | {"_distance": None}

    def features(self, text: str | None) -> np.ndarray:
        self._distance = self._distance or Distance(self.ordinary, self.toxic)
        return summary(self._distance(windows((text or "").encode("utf-8", "surrogatepass"))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and bias, by Newton steps; rows are weighed as if a share prior of them had label 1, however they were sampled."""
    weigh = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    ridge = l2 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve(x1.T @ (x1 * (weigh * p * (1 - p))[:, None]) + ridge, x1.T @ (weigh * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(joined bytes, a number for each run of GRAM bytes); texts are parted by zero bytes."""
    joined = np.frombuffer((b"\0" * 16).join([b"", *raw, b""]), np.uint8)
    return joined, _runs(joined, GRAM)


def _runs(joined: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(len(joined) - n + 1, 0), np.uint64)
    for i in range(n):
        out = mixed(out * U(0xD6E8FEB86659FD93) + joined[i : i + len(out)])
    return out


def _contexts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, and in how many different surroundings each stands: a text copied a thousand times counts once."""
    joined, grams = _grams(raw)
    if len(grams) < 17:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    around = _runs(joined, 8)
    at = np.arange(8, len(joined) - GRAM - 8)
    pair = mixed(mixed(around[at - 8] ^ grams[at]) + around[at + GRAM])
    _, first = np.unique(pair, return_index=True)
    return np.unique(grams[at[first]], return_counts=True)


def telling_pieces(toxic: list[bytes], plain: list[bytes]) -> list[bytes]:
    """The pieces of toxic texts that stand in more surroundings there than chance and ordinary text allow."""
    a_gram, a = _contexts(toxic)
    b_gram, b = _contexts(plain)
    if not len(a) or not len(b):
        return []
    at = np.minimum(np.searchsorted(b_gram, a_gram), len(b_gram) - 1)
    other = np.where(b_gram[at] == a_gram, b[at], 0)
    share = a.sum() / (a.sum() + b.sum())
    expected = (a + other) * share
    z = (a - expected) / np.sqrt(expected * (1 - share) + 1e-9)
    telling = a_gram[(z >= max(LEAST_Z, z.max() * LEAST_OF_BEST)) & (a >= 4)]
    joined, grams = _grams(toxic)
    hit = np.isin(grams, telling)
    covered = np.zeros(len(joined) + 2, bool)
    for i in range(GRAM):
        covered[1 + i : 1 + i + len(hit)] |= hit
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    data = joined.tobytes()
    return [data[i:j].strip(b"\0") for i, j in zip(edge[::2], edge[1::2], strict=True)]


def fit(texts: list[str], labels: list[int]) -> Model | None:
    y = np.array(labels, np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    # The dictionaries are trained on two thirds and the curve on the rest, which they haven't seen.
    seen = np.arange(len(raw)) % 3 != 0
    plain = [t for t, label, s in zip(raw, labels, seen, strict=True) if s and label == 0]
    toxic = [t for t, label, s in zip(raw, labels, seen, strict=True) if s and label == 1]
    pieces = [w for t in plain for w in islice(windows(t), 0, None, 2)]
    ordinary = _content(pieces[:: max(1, len(pieces) // 20_000)], DICTIONARY)
    telling = _content(telling_pieces(toxic, plain), TELLING)
    model = Model(ordinary, telling, np.zeros(N), np.ones(N), np.zeros(N + 1))
    rest = np.flatnonzero(~seen)
    x = np.array([model.features(texts[i]) for i in rest])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    model.weights = logistic((x - model.mean) / model.scale, y[rest], PRIOR)
    return model


def scorer(model: Model | None) -> Callable[[Column], Column]:
    """A column of scores of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series(model.score(text.tolist()) if model is not None else np.zeros(len(text)))

    return score


def apply(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each of documents."""
    bounded_batches(documents.sparkSession)
    score = scorer(fit(*labelled_sample(documents, labels, "toxic", per_class)))
    out = documents.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Compression has no SQL form; held-out accuracy is tested.
ORACLE_SQL = None
