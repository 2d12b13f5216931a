"""MinHash near-duplicates with HyperMinHash registers.

A document is the set of its word shingles. The set's registers (Yu and Weber,
2022) hold, for each of REGISTERS buckets, the smallest hash in the form of its
leading-zero count and MANTISSA bits: 16 bits instead of 64. An empty bucket
borrows the register of the first filled one on a path of its own, so that short
documents have full registers too. Bands of registers are the blocking keys.

Exact copies (equal sets) are one node from the start. Then, in three rounds,
pairs of nodes are proposed, thinned by the collision-corrected estimate and
verified on the full sets; links of a round are joined to components before the
next round proposes pairs, and only pairs of different components are looked at:

1. each node with the smallest node it shares a band with,
2. each node with the smallest node of each of its bands,
3. within each band that still holds several components, all pairs across them,
   compared in blocks of at most about BLOCK nodes by BLOCK; what comes out is
   a link for each two components that it joins. Bands of at most SMALL nodes
   give their pairs, which are no more than SMALL / 2 a node.

So a group of thousands of near copies costs a link each, not a pair each, even
if most of its pairs fall just short of the threshold. No pair that shares a band
is given up unverified, except below the estimate's own margin (ESTIMATE_SIGMAS).

With ROWS = 5 and 40 bands a pair at 0.85 shares a band with a chance of
1 - (1 - 0.85**5)**40, all but 7e-11.

Defined cases: null and blank texts have no shingles and link with nothing; a
text of fewer words than the shingle is one shingle; a text of any length is
numbered in pieces; repeated rows get the same result, each; rows that share a
doc_id but not their set are documents of their own, and a component is named by
its smallest doc_id all the same; a null doc_id links with nothing, its component
is null and it is kept; of equal bands or estimates all are looked at; an empty
table gives an empty result; no column but doc_id and text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.bytewords import PIECE, U, Words, blocks, mixed
from textquarry.llm.common import bounded_batches, materialize, release, semi_join, table
from textquarry.llm.graph import components

QUERY = "op8_minhash"

SHINGLE = 3
#: Links have 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
ROWS = 5
BANDS = 40
REGISTERS = ROWS * BANDS
MANTISSA = 10
#: Pairs whose estimate lies so many standard deviations below the threshold aren't verified.
ESTIMATE_SIGMAS = 6
#: Nodes of a band compared at once on each side.
BLOCK = 512
SMALL = 12
#: Expected chance collisions a register pair, as a share of 2**-MANTISSA (Yu and Weber, 2022).
COLLISION = 0.169919487159739

_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle numbers of each text (lower-cased A-Z; words of white space rule)."""
    for _, block in blocks(texts):
        w = Words(block, lower=True)
        rolled = w.triples() if k == 3 else _rolled(w.number, k)
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for x in w.number[a:b]:
                    whole = mixed(whole * U(0xD6E8FEB86659FD93) + x)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def _rolled(n: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(len(n) - k + 1, 0), np.uint64)
    for at in range(0, len(out), PIECE):
        part = out[at : at + PIECE]
        for i in range(k):
            part[:] = mixed(part * U(0xD6E8FEB86659FD93) + n[at + i : at + i + len(part)])
    return out


_PATHS = np.argsort(np.random.default_rng(8).random((REGISTERS, REGISTERS)), axis=1).astype(np.int16)


def registers(s: np.ndarray) -> np.ndarray:
    """uint16 registers of a non-empty set: leading zeros of the smallest hash, then its next MANTISSA bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(REGISTERS, bool)
    for i in range(0, len(s), PIECE):
        part = s[i : i + PIECE]
        at = ((mixed(part ^ _SALT) >> U(32)) * U(REGISTERS) >> U(32)).astype(np.int64)
        np.minimum.at(least, at, mixed(part + _SALT) | U(1))
        filled[at] = True
    zeros = 63 - np.frexp(least.astype(np.float64))[1].astype(np.int64) + 1
    zeros = np.clip(zeros, 0, 62)
    body = (least << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA)
    reg = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | body.astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        paths = _PATHS[empty]
        reg[empty] = reg[paths[np.arange(len(empty)), filled[paths].argmax(1)]]
    return reg


def band_keys(reg: np.ndarray) -> np.ndarray:
    """A number for each band of each row of registers."""
    r = reg.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), r.shape[:2])
    for i in range(ROWS):
        out = mixed(out * U(0xD6E8FEB86659FD93) + r[:, :, i])
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of rows of registers, less the chance collisions of the short registers."""
    equal = (a == b).mean(1)
    chance = COLLISION / 2**MANTISSA
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def floor_of(n: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The least estimate that sets of n shingles are verified at; short sets have as many independent registers as shingles."""
    t = threshold / 100
    return t - ESTIMATE_SIGMAS * np.sqrt(t * (1 - t) / np.minimum(n, REGISTERS))


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, k1, k2, reg = [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist(), k):
            n.append(len(s))
            k1.append(int(np.bitwise_xor.reduce(s, initial=0)) - 2**63)
            k2.append(int(np.add.reduce(mixed(s + U(1)), initial=np.uint64(0))) - 2**63)
            reg.append(registers(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("key"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(reg, pa.binary())], ["doc_id", "key", "n", "k1", "k2", "reg"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            reg = np.frombuffer(b"".join(part.column("reg").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            # Two bands of a short document may hold the same registers, but their numbers differ.
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(reg).reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], ["band", "node"])


def _likely(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose estimate and sizes allow a link."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
        keep = (estimate(a, b) >= floor_of(np.maximum(na, nb), threshold)) & (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch], k: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full shingle sets meet the threshold."""
    for batch in batches:
        keep = []
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for x, y in zip(*(shingle_sets(part.column(c).to_pylist(), k) for c in ("ta", "tb")), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _joined(pdf: pd.DataFrame, k: int, threshold: int) -> pd.DataFrame:
    """Links that join the components of one cell: two blocks of a band, or one with itself. Estimates first, then intersections of the full sets."""
    node, root, own = (pdf[c].to_numpy() for c in ("node", "root", "own"))
    one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    out: list[tuple[int, int]] = []
    if (root != root[0]).any():
        sets = list(shingle_sets(pdf["text"].tolist(), k))
        size = np.array([len(s) for s in sets])
        reg = np.stack([registers(s) for s in sets])
        bits = _bitsets(sets)
        label = root.copy()
        for x in range(len(node) - 1):
            far = np.flatnonzero((label[x + 1 :] != label[x]) & (one | (own[x + 1 :] != own[x]))) + x + 1
            far = far[100 * np.minimum(size[far], size[x]) >= threshold * np.maximum(size[far], size[x])]
            far = far[estimate(reg[far], reg[x]) >= floor_of(np.maximum(size[far], size[x]), threshold)]
            if len(far):
                both = np.bitwise_count(bits[far] & bits[x]).sum(1, dtype=np.int64)
                for y in far[100 * both >= threshold * (size[far] + size[x] - both)]:
                    if label[y] != label[x]:
                        out.append((int(node[x]), int(node[y])))
                        label[label == label[y]] = label[x]
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _bitsets(sets: list[np.ndarray]) -> np.ndarray:
    """A bit for each shingle that stands in two sets or more; others are in no intersection."""
    shingles, count = np.unique(np.concatenate(sets), return_counts=True)
    shingles = shingles[count > 1]
    out = np.zeros((len(sets), max(1, -(-len(shingles) // 64))), np.uint64)
    for i, s in enumerate(sets):
        at = np.searchsorted(shingles, s)
        at = at[(at < len(shingles)) & (shingles[np.minimum(at, max(len(shingles) - 1, 0))] == s)] if len(shingles) else at[:0]
        np.bitwise_or.at(out[i], at // 64, U(1) << (at % 64).astype(np.uint64))
    return out


PAIR = "a long, b long"


def _verified(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that are links: estimate on registers first, then full sets of the texts of those left."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("reg").alias(f"r{c}"))
    likely = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(partial(_likely, threshold=threshold), PAIR), "near-likely")
    asked = materialize(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-asked")
    texts = materialize(semi_join(documents.select("doc_id", "text"), asked, "doc_id"), "near-texts")
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
    return materialize(likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(partial(_linked, k=k, threshold=threshold), PAIR), "near-links")


def near_duplicates(documents: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, component_id, kept, one row for each of documents. k: words of a shingle; threshold: percent."""
    bounded_batches(documents.sparkSession)
    documents = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    sketches = _sketches(documents, k)
    of_id = sketches.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d"))
    if of_id.where("a <> b OR c <> d").isEmpty():
        return _near_duplicates(documents, sketches, k, threshold)
    # Ids don't tell the documents apart: rows get numbers, and components are renamed by their smallest id.
    release(sketches)
    rows = materialize(documents.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "near-rows")
    numbered = rows.select(F.col("row").alias("doc_id"), "text", "key")
    found = _near_duplicates(numbered, _sketches(numbered, k), k, threshold).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("root"))
    found = materialize(rows.where("row IS NOT NULL").select("row", "doc_id", "key").join(found, "row"), "near-numbered")
    names = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.join(names, "root").select("doc_id", "key", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    rest = _sketches(rows.where("row IS NULL").select("doc_id", "text", "key"), k)
    return out.unionByName(rest.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _sketches(documents: DataFrame, k: int) -> DataFrame:
    return materialize(documents.select("doc_id", "text", "key").mapInArrow(partial(_sketch, k=k), "doc_id long, key long, n long, k1 long, k2 long, reg binary"), "near-sketches")


def _near_duplicates(documents: DataFrame, sketches: DataFrame, k: int, threshold: int) -> DataFrame:
    """The same for documents whose ids stand for one set each."""
    linkable = sketches.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    copies = linkable.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"))
    copies = materialize(copies, "near-copies")
    nodes = sketches.join(copies.select("k1", "k2", "n", F.col("node").alias("doc_id")), ["k1", "k2", "n", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "reg").dropDuplicates(["node"])
    nodes = materialize(nodes, "near-nodes")

    bands = nodes.select("node", "reg").mapInArrow(_bands, "band long, node long")
    pivots = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = materialize(bands.join(pivots, "band"), "near-bands")

    stars = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = _verified(stars.groupBy("a").agg(F.min("b").alias("b")), nodes, documents, k, threshold)
    roots = materialize(components(links), "near-roots")

    apart = _apart(stars.distinct(), roots)
    more = _verified(apart, nodes, documents, k, threshold)
    links = links.unionByName(more)
    roots = materialize(components(links), "near-roots")

    # Bands that still hold several components: all pairs across these, compared where they lie; only links that join components come out.
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed_bands = placed.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n")).where("x <> y").select("band", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = materialize(placed.join(mixed_bands, "band").select("band", "node", "root", "n", "blocks"), "near-mixed")
    few = placed.where(F.col("n") <= SMALL)
    pairs = few.select("band", F.col("node").alias("a"), F.col("root").alias("x")).join(few.select("band", F.col("node").alias("b"), F.col("root").alias("y")), "band").where("a > b AND x <> y")
    links = links.unionByName(_verified(pairs.select("a", "b").distinct(), nodes, documents, k, threshold))
    placed = placed.where(F.col("n") > SMALL)
    asked = materialize(placed.select(F.col("node").alias("doc_id")).distinct(), "near-asked")
    texts = semi_join(documents.select("doc_id", "text"), asked, "doc_id").withColumnRenamed("doc_id", "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root")
    across = cells.join(texts, "node").groupBy("band", "i", "j").applyInPandas(lambda pdf: _joined(pdf, k, threshold), PAIR)
    links = links.unionByName(materialize(across.distinct(), "near-across"))
    roots = components(links)

    by_copy = copies.join(roots, "node", "left").select("k1", "k2", "n", F.coalesce("root", "node").alias("component_id"))
    out = sketches.drop("reg").join(by_copy, ["k1", "k2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key")


#: All pairs of sets through an inverted list of shingles, and components by label spreading.
ORACLE_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(g) AS g FROM s),
p AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= {THRESHOLD} * (na.n + nb.n - k)),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id"""
