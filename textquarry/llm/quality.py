"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are read in chunks of CHUNK that overlap by half and cover it
whole. Filters of WIDTH bytes slide over them in steps of STRIDE; a filter is a
learned weight for each byte value at each place, so that applying it is a
look-up and a sum. A byte comes in two forms, new or again (the run of RUN bytes
that begins with it stood in its half chunk before), since no sum over byte
values can tell a repetition; filters learn weights for either. A chunk keeps
each filter's greatest response (max pooling over its two halves). The
document's mean and greatest over its chunks go through a hidden layer to one
probability.

Trained by Adam on a bounded sample of labelled rows (PER_CLASS of each label,
held-out rows never); every text is scored whole.

Defined cases: null and empty texts have one chunk without response and get that
score; a NUL byte counts as none; a text of any length is read in blocks of BLOCK
bytes; of equal responses and chunks the first counts; repeated rows get equal
scores; without labelled rows of both classes every score is 1; an empty table
gives an empty result; no column but doc_id and text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import bounded_batches, held_out, labelled_sample, table

QUERY = "op1_quality"

PER_CLASS = 1500
WIDTH, STRIDE = 8, 4
RUN = 8
CHUNK = 256
FILTERS = 32
HIDDEN = 16
EPOCHS, BATCH, RATE, DECAY = 12, 32, 4e-3, 1e-4
SEED = 11
THRESHOLD = 0.3
#: Share of rows of label 1 that scores are calibrated to.
PRIOR = 0.7
#: Texts are scored in blocks of about so many bytes.
BLOCK = 1 << 19

_HALF = CHUNK // 2
_PAD = [0, 256]  # the byte that fills a text's last half chunk, in both forms; its weights stay zero


def halves(text: bytes) -> int:
    return max(1, -(-len(text) // _HALF))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first half chunk of each text and the end): every text padded to whole half chunks."""
    count = np.array([halves(t) for t in texts])
    data = b"".join(t.ljust(n * _HALF, b"\0") for t, n in zip(texts, count, strict=True))
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(count)])


def symbols(data: np.ndarray) -> np.ndarray:
    """Each byte, plus 256 where the RUN bytes from it on stood in its half chunk before.

    Runs are told apart by 24 bits of a product, so that one sort of small
    numbers, with places below, brings equal runs together in order.
    """
    x = data.reshape(-1, _HALF)
    n = _HALF - RUN + 1
    runs = np.zeros((len(x), n), np.uint32)
    for i in range(RUN):
        runs = (runs ^ x[:, i : i + n]) * np.uint32(0x9E3779B1)
    runs = (runs & np.uint32(0xFFFFFF00)) | np.arange(n, dtype=np.uint32)
    runs.sort(axis=1)
    row, at = np.nonzero((runs[:, 1:] ^ runs[:, :-1]) < 256)
    out = x.astype(np.int16)
    out[row, runs[row, at + 1] & np.uint32(255)] += 256
    return out.reshape(-1)


#: Symbols that a half chunk's filters see: its own, and the first of the next half chunk.
_SEEN = _HALF + WIDTH - STRIDE


def responses(data: np.ndarray, last: np.ndarray, weights: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """(half chunks, FILTERS): each filter's greatest sum; if asked for, its place, and the _SEEN symbols of each half chunk. last: whether a text ends with a half chunk; its filters see padding beyond. weights: (WIDTH, 512, FILTERS)."""
    n, step = len(data) // _HALF, max(1, BLOCK // _HALF)
    top = np.empty((n, weights.shape[2]), weights.dtype)
    at, kept = (np.empty(top.shape, np.int64), []) if places else (None, None)
    for i in range(0, n, step):
        rows = min(step, n - i)
        part = symbols(data[i * _HALF : (i + step + 1) * _HALF]).reshape(-1, _HALF)
        beyond = np.zeros((rows, WIDTH - STRIDE), np.int16)
        after = part[1 : rows + 1, : WIDTH - STRIDE]
        beyond[: len(after)] = after
        beyond[last[i : i + rows]] = 0
        seen = np.concatenate([part[:rows], beyond], 1)
        total = weights[0][seen[:, 0:_HALF:STRIDE]]
        for o in range(1, WIDTH):
            total += weights[o][seen[:, o : o + _HALF : STRIDE]]
        total.max(1, out=top[i : i + rows])
        if places:
            at[i : i + rows] = total.argmax(1)
            kept.append(seen)
    return top, at, np.concatenate(kept) if places else None


def ends(first: np.ndarray) -> np.ndarray:
    """Whether a half chunk is the last of its text."""
    last = np.zeros(first[-1], bool)
    last[first[1:] - 1] = True
    return last


def pooled(top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
    """Document vectors from half chunks: chunk k is half k and k + 1 of the same text; then mean and greatest over chunks."""
    n = len(top)
    follow = np.where(ends(first), np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    second = top[follow] > top
    chunk = np.where(second, top[follow], top)
    live = np.maximum(chunk, 0)
    count = np.diff(first)[:, None]
    mean = np.add.reduceat(live, first[:-1], axis=0) / count
    most = np.maximum.reduceat(live, first[:-1], axis=0)
    return np.concatenate([mean, most], 1), {"chunk": chunk, "second": second, "follow": follow, "live": live, "most": most, "count": count}


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        n = 2 * FILTERS
        self.p = {
            "conv": rng.normal(0, 0.25, (WIDTH, 512, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, n**-0.5, (n, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.p["conv"][:, _PAD] = 0
        self.mean, self.scale = np.zeros(n, np.float32), np.ones(n, np.float32)

    def _vectors(self, texts: list[bytes], where: bool = False):
        data, first = joined(texts)
        top, at, seen = responses(data, ends(first), self.p["conv"], where)
        v, state = pooled(top + self.p["bias"], first)
        return v, state | {"at": at, "symbols": seen, "first": first}

    def _head(self, v: np.ndarray) -> tuple[np.ndarray, ...]:
        x = (v - self.mean) / self.scale
        h = np.maximum(x @ self.p["w1"] + self.p["b1"], 0)
        return x, h, 1 / (1 + np.exp(-np.clip(h @ self.p["w2"] + self.p["b2"], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        out, held, size = [], [], 0
        for t in [*texts, None]:
            if held and (t is None or size + len(t) > BLOCK):
                out.append(self._head(self._vectors(held)[0])[2])
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t) + _HALF
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, texts: list[bytes], y: np.ndarray) -> Network:
        rng = np.random.default_rng(SEED)
        weigh = np.where(y == 1, PRIOR / y.mean(), (1 - PRIOR) / (1 - y.mean()))
        v = np.concatenate([self._vectors(texts[i : i + BATCH])[0] for i in range(0, len(texts), BATCH)])
        self.mean, self.scale = v.mean(0), np.maximum(v.std(0), 0.1)
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step, total = 0, EPOCHS * -(-len(texts) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                g = self._gradient([texts[r] for r in rows], y[rows], weigh[rows])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, x in self.p.items():
                    d = g[k] + DECAY * x
                    m[k] = 0.9 * m[k] + 0.1 * d
                    s[k] = 0.99 * s[k] + 0.01 * d * d
                    x -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
                self.p["conv"][:, _PAD] = 0
        return self

    def _gradient(self, texts: list[bytes], y: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
        v, c = self._vectors(texts, where=True)
        x, h, p = self._head(v)
        d = (weigh * (p - y) / len(y)).astype(np.float32)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = np.outer(d, self.p["w2"]) * (h > 0)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
        dv = (dh @ self.p["w1"].T) / self.scale
        owner = np.repeat(np.arange(len(texts)), np.diff(c["first"]))
        dlive = dv[owner, :FILTERS] / c["count"][owner]
        # The greatest chunk of each document and filter, the first of equals.
        place = np.where(c["live"] == c["most"][owner], np.arange(len(owner))[:, None], len(owner))
        winner = np.minimum.reduceat(place, c["first"][:-1], axis=0)
        np.add.at(dlive, (winner, np.arange(FILTERS)[None, :]), dv[:, FILTERS:])
        dchunk = (dlive * (c["chunk"] > 0)).astype(np.float32)
        g["bias"] = dchunk.sum(0)
        # Only the place of the greatest response has a gradient: a look-up for each byte under the filter there.
        half = np.where(c["second"], c["follow"][:, None], np.arange(len(owner))[:, None])
        f = np.broadcast_to(np.arange(FILTERS), half.shape)
        start = half * _SEEN + c["at"][half, f] * STRIDE
        live = dchunk != 0
        start, f, dchunk = start[live], f[live], dchunk[live]
        g["conv"], seen = np.empty_like(self.p["conv"]), c["symbols"].reshape(-1)
        for o in range(WIDTH):
            g["conv"][o] = np.bincount(seen[start + o].astype(np.int64) * FILTERS + f, dchunk, 512 * FILTERS).reshape(512, FILTERS)
        return g


def encoded(texts: list[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def fit(texts: list[str], labels: list[int]) -> Network | None:
    y = np.array(labels, np.float64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    return Network().fit(encoded(texts), y)


def scorer(network: Network | None) -> Callable[[Column], Column]:
    """A column of scores of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in batches:
            yield pd.Series(network.score(encoded(text.tolist())).astype(np.float64) if network is not None else np.ones(len(text)))

    return score


def trained(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Callable[[Column], Column]:
    bounded_batches(documents.sparkSession)
    return scorer(fit(*labelled_sample(documents, labels, "quality", per_class)))


def apply(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each of documents."""
    score = trained(documents, labels, per_class)
    out = documents.select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A trained network has no SQL form; held-out accuracy is tested.
ORACLE_SQL = None
