"""Embedding near-duplicates on robust-pruned flat graphs.

Vectors of one label (and length) form one partition, or, where they are more
than CAP, are cut into partitions around pivots, and these again, as long as that
makes them smaller. A partition holds the vectors that are nearest to its pivot
and, as an overlap, all those so near to its border that a link may cross it.
Within a partition the graph of DiskANN (Subramanya and others, 2019) is built as
there: on overlapping cluster shards, each robust-pruned, their adjacency lists
then united into one flat graph. Each vector asks its own partition only: a greedy
beam search from the shards' medoids that, once in range, goes on through all
neighbours in range (Manohar and others, "Range search on vectors", 2024). What is
found is verified in double precision. A part of the vectors (AUDIT_EVERY) is held
against brute force; a cell whose recall stays under RECALL is built again, denser,
and compared whole if that does not help. So are cells whose audit meets no link,
and those of so few queries that comparing all costs less than a graph. As a cell's
queries meet all vectors of the label that may link with them, the audit holds for
the label, and its recall is returned with the label's rows.

Equal vectors are one node with a weight. Partitions that stay beyond CAP are dealt
into cells (targets by queries) of at most about CAP each, so no task holds an
unbounded group, and a cell gives counts and links to one root, never its pairs.
The overlap is exact: where vectors spread evenly in many dimensions, few are far
from all borders, and the work then grows faster than the vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and those without label or vec_id, link with nothing: no links,
their own component, kept, no recall. Vectors of different lengths don't link.
Repeated rows are vectors of their own and link; of rows that share a vec_id each
counts. Of equal products the first pivot counts. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import BROADCAST_ROWS, materialize, table, unit_hash
from textquarry.llm.graph import components

QUERY = "op3_embedding"

THRESHOLD = 0.98
#: Vectors a cell holds, about, on each side.
CAP = 8192
#: Pivots that a partition is cut by at once; larger ones are cut again.
FANOUT = 64
#: A partition is cut again if it has at most this share of the one that it was cut from.
SHRINK = 0.5
#: Pivots are sent with the tasks up to so many numbers (8 bytes each), and joined to the vectors' groups beyond.
PIVOT_NUMBERS = 2_000_000
SHARD, DEGREE, POOL, BEAM, ALPHA = 512, 24, 96, 24, 1.2
MAX_DEGREES = 2
AUDIT_EVERY, RECALL, REBUILDS = 50, 0.999, 3
#: Cells with fewer queries than targets by this factor are compared whole.
WHOLE = 4
#: Slack of the search in single precision; the exact check follows.
SLACK = 1e-4


def robust_pruned(x: np.ndarray, degree: int, pool: int) -> np.ndarray:
    """Out-neighbours of each row of x, nearest first, -1 where there are fewer: of the pool nearest, those that no chosen one is ALPHA times nearer to. All rows advance together."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    dist = np.sqrt(np.maximum(2 - 2 * (x @ x.T), 0)).astype(np.float32)
    np.fill_diagonal(dist, np.inf)
    pool = min(pool, n - 1)
    near = np.argpartition(dist, pool - 1, axis=1)[:, :pool]
    own = np.take_along_axis(dist, near, 1)
    order = np.argsort(own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    alive, rows = np.ones(near.shape, bool), np.arange(n)
    out = np.full((n, min(degree, pool)), -1)
    for k in range(out.shape[1]):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        chosen = near[rows, first]
        out[has, k] = chosen[has]
        alive &= ALPHA * dist[chosen[:, None], near] > own
        alive[rows, first] = False
    return out


def flat_graph(x: np.ndarray, degree: int, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency padded with -1, medoids): shards overlap, as each row is in its two nearest; lists and their reverses are united."""
    n = len(x)
    k = max(1, math.ceil(n / SHARD))
    centres = x[np.linspace(0, n - 1, k).astype(int)]
    for _ in range(3 if k > 1 else 0):
        label = (x @ centres.T).argmax(1)
        for j in range(k):
            if (label == j).any():
                c = x[label == j].mean(0)
                centres[j] = c / max(np.linalg.norm(c), 1e-12)
    score = x @ centres.T
    mine = np.argsort(-score, axis=1)[:, : min(2, k)]
    heads, tails, medoids = [], [], []
    for j in range(k):
        members = np.flatnonzero((mine == j).any(1))
        for part in np.array_split(members, max(1, math.ceil(len(members) / (4 * SHARD)))) if len(members) else []:
            adj = robust_pruned(x[part], degree, pool)
            a, b = np.nonzero(adj >= 0)
            heads.append(part[a])
            tails.append(part[adj[a, b]])
            medoids.append(part[(x[part] @ x[part].mean(0)).argmax()])
    h, t = np.concatenate([*heads, *tails]), np.concatenate([*tails, *heads])
    # Own edges go before reverse ones, of which hubs keep only what makes up MAX_DEGREES lists.
    edges, first = np.unique(h * n + t, return_index=True)
    edges = edges[np.lexsort((first, edges // n))]
    h, t = edges // n, edges % n
    count = np.bincount(h, minlength=n)
    keep = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) < MAX_DEGREES * degree
    h, t = h[keep], t[keep]
    count = np.minimum(count, MAX_DEGREES * degree)
    adj = np.full((n, max(int(count.max(initial=0)), 1)), -1)
    adj[h, np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)] = t
    return adj, np.unique(medoids)


def range_search(x: np.ndarray, adj: np.ndarray, starts: np.ndarray, q: np.ndarray, own: np.ndarray, limit: float, beam: int) -> np.ndarray:
    """Boolean (queries, rows of x): the rows met with a product of limit or more. own: each query's place in x, or -1."""
    nq, rows = len(q), np.arange(len(q))
    seen = np.zeros((nq, len(x) + 1), bool)  # the last column stands for no neighbour
    seen[:, -1] = True
    found = np.zeros((nq, len(x)), bool)
    start = np.concatenate([np.broadcast_to(starts, (nq, len(starts))), np.where(own >= 0, own, starts[0])[:, None]], 1)
    sim = np.einsum("qsd,qd->qs", x[start], q)
    seen[rows[:, None], start] = True
    ids, sims, done = start, sim, np.zeros(start.shape, bool)
    # The same row twice would take two places of the beam.
    dup = np.zeros(start.shape, bool)
    dup[:, -1] = (start[:, :-1] == start[:, -1:]).any(1)
    sims = np.where(dup, -2.0, sims)
    done = done | dup
    found[rows[:, None], start] |= sim >= limit
    active = rows
    while len(active):
        best = np.where(done[active], -3.0, sims[active])
        at = best.argmax(1)
        go = best[np.arange(len(active)), at] > -3.0
        active, at = active[go], at[go]
        if not len(active):
            break
        done[active, at] = True
        nb = adj[ids[active, at]]
        fresh = ~seen[active[:, None], nb]
        s = np.where(fresh, np.einsum("qsd,qd->qs", x[nb], q[active]), -2.0)
        seen[active[:, None], nb] = True
        a, b = np.nonzero(fresh & (s >= limit))
        found[active[a], nb[a, b]] = True
        all_ids, all_sims = np.concatenate([ids[active], nb], 1), np.concatenate([sims[active], s], 1)
        all_done = np.concatenate([done[active], ~fresh], 1)
        width = min(max(beam, ids.shape[1]), all_ids.shape[1])
        top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        if ids.shape[1] < width:
            pad = width - ids.shape[1]
            ids, sims, done = np.pad(ids, ((0, 0), (0, pad))), np.pad(sims, ((0, 0), (0, pad)), constant_values=-2.0), np.pad(done, ((0, 0), (0, pad)), constant_values=True)
        ids[active], sims[active], done[active] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
    # Range expansion: every row in range passes the search on to its neighbours.
    fq, ft = np.nonzero(found)
    while len(fq):
        next_q, next_t = [], []
        for i in range(0, len(fq), 20_000):
            nb = adj[ft[i : i + 20_000]]
            at = np.repeat(fq[i : i + 20_000], nb.shape[1])
            nb = nb.reshape(-1)
            fresh = ~seen[at, nb]
            key = np.unique(at[fresh] * len(x) + nb[fresh])
            at, nb = key // len(x), key % len(x)
            seen[at, nb] = True
            hit = np.einsum("pd,pd->p", x[nb], q[at]) >= limit
            found[at[hit], nb[hit]] = True
            next_q.append(at[hit])
            next_t.append(nb[hit])
        fq, ft = np.concatenate(next_q), np.concatenate(next_t)
    return found


FOUND = "node long, linked long, root long, asked long, met long"


def cell(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cell's links: node, its linked weight, and the root of its links here; and the audit, in a row without node: links that audited queries have, and those of them that were met."""
    t, q = pdf[~pdf["asks"]], pdf[pdf["asks"]]
    label, dim = pdf["label"].iloc[0], int(pdf["dim"].iloc[0])
    result = lambda node, linked, root, asked=0, met=0: pd.DataFrame(
        {"label": [label] * (len(node) + 1), "dim": dim, "node": pd.array([*node, None], "Int64"), "linked": [*linked, 0], "root": pd.array([*root, None], "Int64"), "asked": [0] * len(node) + [asked], "met": [0] * len(node) + [met]}
    )
    if not len(t) or not len(q):
        return result([], [], [])
    t = t.sort_values("node", ignore_index=True)
    exact_t, exact_q = (np.stack(d["vector"].to_numpy()).astype(np.float64) for d in (t, q))
    # Scaled first, so that squares of very large or small components stay finite.
    exact_t, exact_q = (v / np.abs(v).max(1, keepdims=True) for v in (exact_t, exact_q))
    exact_t, exact_q = (v / np.sqrt((v * v).sum(1, keepdims=True)) for v in (exact_t, exact_q))
    tn, qn, weight = t["node"].to_numpy(), q["node"].to_numpy(), t["weight"].to_numpy()
    own = np.searchsorted(tn, qn)
    own = np.where((own < len(tn)) & (tn[np.minimum(own, len(tn) - 1)] == qn), own, -1)
    x, y = exact_t.astype(np.float32), exact_q.astype(np.float32)
    audited = np.flatnonzero(qn % AUDIT_EVERY == 0)
    truth = [set(np.flatnonzero(exact_t @ exact_q[i] >= THRESHOLD).tolist()) - {int(own[i])} for i in audited]
    links = sum(map(len, truth))
    degree, pool, beam = DEGREE, POOL, BEAM
    for _ in range(REBUILDS if links and WHOLE * len(y) > len(x) else 0):
        adj, medoids = flat_graph(x, degree, pool)
        parts = [np.nonzero(range_search(x, adj, medoids, y[i : i + 512], own[i : i + 512], THRESHOLD - SLACK, beam)) for i in range(0, len(y), 512)]
        a, b = _joined(parts)
        met = _met(a, b, audited, truth)
        if met >= RECALL * links:
            break
        degree, pool, beam = 2 * degree, 2 * pool, 2 * beam
    else:
        a, b = _joined([np.nonzero(y[i : i + 512] @ x.T >= THRESHOLD - SLACK) for i in range(0, len(y), 512)])
        met = _met(a, b, audited, truth)
    keep = np.concatenate([np.einsum("pd,pd->p", exact_q[a[i : i + 50_000]], exact_t[b[i : i + 50_000]]) >= THRESHOLD for i in range(0, len(a), 50_000)] or [np.zeros(0, bool)])
    keep &= qn[a] != tn[b]
    a, b = a[keep], b[keep]
    if not len(a):
        return result([], [], [], links, met)
    linked = np.bincount(a, weights=weight[b], minlength=len(qn)).astype(np.int64)
    # Roots: the smallest label spreads over the links of this cell.
    label_q, label_t = qn.copy(), tn.copy()
    while True:
        before = label_q.copy(), label_t.copy()
        np.minimum.at(label_t, b, label_q[a])
        np.minimum.at(label_q, a, label_t[b])
        if (before[0] == label_q).all() and (before[1] == label_t).all():
            break
    asks, hit = np.unique(a), np.unique(b)
    return result([*qn[asks], *tn[hit]], [*linked[asks], *np.zeros(len(hit), np.int64)], [*label_q[asks], *label_t[hit]], links, met)


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) of blocks of 512 queries."""
    return np.concatenate([a + 512 * i for i, (a, _) in enumerate(parts)]), np.concatenate([b for _, b in parts])


def _met(a: np.ndarray, b: np.ndarray, audited: np.ndarray, truth: list[set[int]]) -> int:
    """How many of the audited queries' links are among the pairs (a, b), which are sorted by a."""
    lo, hi = np.searchsorted(a, audited), np.searchsorted(a, audited, "right")
    return sum(len(own.intersection(b[i:j].tolist())) for own, i, j in zip(truth, lo, hi, strict=True))


def assigned(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, whether that is the row's own): each row with its nearest pivot, and with those across whose borders a link may reach."""
    # A vector further from the bisector of two pivots than this is linked with none beyond it.
    delta = math.sqrt(1 - THRESHOLD * THRESHOLD) + 1e-9
    c, v = (u / np.abs(u).max(1, keepdims=True) for u in (pivots, vectors))
    c, v = (u / np.sqrt((u * u).sum(1, keepdims=True)) for u in (c, v))
    s = v @ c.T
    home = s.argmax(1)
    apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) * delta
    row, pivot = np.nonzero(s >= s[np.arange(len(v)), home][:, None] - apart[home] - 1e-12)
    return row, pivot, pivot == home[row]


PART = ["label", "dim", "part", "node", "weight", "vector", "home", "above"]


def _dealt(pdf: pd.DataFrame, pivots: np.ndarray) -> pd.DataFrame:
    """Rows of one partition by the partitions that its pivots cut it into."""
    row, pivot, own = assigned(np.stack(pdf["vector"].to_numpy()).astype(np.float64), pivots)
    out = pdf.iloc[row].reset_index(drop=True)
    # The number of a partition is a mix of that of the one it was cut from and of its place.
    with np.errstate(over="ignore"):
        number = (out["part"].to_numpy().astype(np.uint64) * np.uint64(FANOUT + 1) + pivot.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out["part"], out["home"] = number.view(np.int64), out["home"].to_numpy() & own
    return out


def _cut(parts: DataFrame, sizes: DataFrame, cap: int, row: str) -> DataFrame:
    """parts (with above, the size of what they were cut from) where those that sizes, of one row each, names are cut by pivots of their own."""
    key = ["label", "dim", "part"]
    few = sizes.limit(BROADCAST_ROWS // 8 + 1).count() <= BROADCAST_ROWS // 8
    sized = parts.drop("above").join(F.broadcast(sizes) if few else sizes, key)
    k = F.least(F.ceil(F.col("above") / cap), F.lit(FANOUT))
    own = unit_hash(F.col("node"), F.col("part"), seed=3)
    # Some more than k are drawn, and the first k taken, by an aggregate that holds no more than k of them.
    drawn = sized.where("home").where(own < F.lit(4.0) * k / F.col("above")).select(*key, F.struct(own.alias("u"), "node", F.col("vector").alias("pivot")).alias("r"), k.cast("int").alias("k"))
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("r.u", "r.node"))).where("n <= k")
    pivots = materialize(drawn.select(*key, "r.pivot"), "vec-pivots")
    numbers = pivots.agg(F.sum(F.size("pivot"))).first()[0] or 0
    if numbers <= PIVOT_NUMBERS:
        by: dict[tuple, list] = {}
        for r in pivots.sort(*key, "pivot").toLocalIterator():
            by.setdefault((r["label"], r["dim"], r["part"]), []).append(r["pivot"])
        by = {k_: np.array(v, np.float64) for k_, v in by.items()}

        def run(batches):
            for pdf in batches:
                for key_, own_ in pdf.groupby(key, sort=False):
                    key_ = (key_[0].item() if hasattr(key_[0], "item") else key_[0], int(key_[1]), int(key_[2]))
                    yield _dealt(own_, by[key_])[PART] if key_ in by else own_[PART]

        return sized.select(*PART).mapInPandas(run, row)
    # The vectors of a partition go by a hash to groups of bounded size, each of which gets the pivots.
    slots = F.ceil(F.col("above") / cap).cast("int")
    left = sized.withColumn("slot", F.pmod(F.xxhash64(F.lit(7), "node"), slots).cast("int"))
    right = pivots.join(sizes, key).select(*key, F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"), "pivot")

    def grouped(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return _dealt(pdf, np.stack(sorted(own["pivot"], key=tuple)).astype(np.float64))[PART] if len(own) and len(pdf) else pdf[PART]

    return left.groupBy(*key, "slot").cogroup(right.groupBy(*key, "slot")).applyInPandas(grouped, row)


def _parted(nodes: DataFrame, cap: int) -> DataFrame:
    """nodes by partition: home ones, whose own partition it is, and the overlap."""
    key = ["label", "dim", "part"]
    row = f"label {dict(nodes.dtypes)['label']}, dim int, part long, node long, weight long, vector array<double>, home boolean, above long"
    parts = nodes.select("label", "dim", F.lit(0).cast("long").alias("part"), "node", "weight", F.col("vector").cast("array<double>").alias("vector"), F.lit(True).alias("home"), F.lit(2**62).cast("long").alias("above"))
    done: list[DataFrame] = []
    while True:
        sizes = materialize(parts.groupBy(*key).agg(F.count("*").alias("n"), F.first("above").alias("above")), "vec-sizes")
        large = sizes.where((F.col("n") > cap) & (F.col("n") <= F.col("above") * SHRINK)).select(*key, F.col("n").alias("above"))
        if large.isEmpty():
            break
        few = large.limit(BROADCAST_ROWS // 8 + 1).count() <= BROADCAST_ROWS // 8
        done.append(parts.join(F.broadcast(large.select(*key)) if few else large.select(*key), key, "left_anti"))
        parts = materialize(_cut(parts, large, cap, row), "vec-parts")
    for p in done:
        parts = parts.unionByName(p)
    return parts.drop("above")


def near_duplicates(embeddings: DataFrame, cap: int = CAP) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall (audited, of the label; 1 where no audited vector has links), one row for each of embeddings."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    usable = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = embeddings.select("vec_id", "label", "embedding", usable.alias("usable")).withColumn("k1", F.xxhash64(F.lit(1), "embedding")).withColumn("k2", F.xxhash64(F.lit(2), "embedding"))
    nodes = keyed.where("usable").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("embedding").alias("vector"))
    nodes = materialize(nodes.withColumn("dim", F.size("vector")), "vec-nodes")

    key = ["label", "dim", "part"]
    parts = _parted(nodes, cap)
    sizes = materialize(parts.groupBy(*key).agg(F.ceil(F.count("*") / cap).cast("int").alias("cells")), "vec-cells")
    few = sizes.limit(BROADCAST_ROWS // 8 + 1).count() <= BROADCAST_ROWS // 8
    parts = parts.join(F.broadcast(sizes) if few else sizes, key)
    own = F.pmod(F.xxhash64(F.lit(5), "node"), F.col("cells")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    keep = [*key, "node", "weight", "vector"]
    targets = parts.select(*keep, own.alias("t"), every.alias("q"), F.lit(False).alias("asks"))
    asking = parts.where("home").select(*keep, every.alias("t"), own.alias("q"), F.lit(True).alias("asks"))
    found = targets.unionByName(asking).groupBy(*key, "t", "q").applyInPandas(cell, f"label {dict(nodes.dtypes)['label']}, dim int, {FOUND}")
    found = materialize(found, "vec-found")

    links = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("node IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    audit = found.groupBy("label", "dim").agg(F.when(F.sum("asked") > 0, F.sum("met") / F.sum("asked")).otherwise(1.0).alias("recall"))
    audit = F.broadcast(audit) if few else audit
    by_node = nodes.join(audit, ["label", "dim"]).select("label", "k1", "k2", "node", "weight", "recall").join(links, "node", "left").join(roots, "node", "left")
    by_node = by_node.select("label", "k1", "k2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"), "recall")
    out = keyed.select("vec_id", "label", "k1", "k2", "usable").join(by_node.withColumn("usable", F.lit(True)), ["label", "k1", "k2", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), "recall")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(e, lambda z: z <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON r.vec_id = l.a),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.a"""
