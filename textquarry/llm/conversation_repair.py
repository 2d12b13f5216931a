"""Repair of damaged conversations by the cheapest edits, by a rank-compressed dynamic program.

A conversation is to read (s?(ua)+)? by its roles' initials. Every row is edited
once, after a run of inserted rows: such a macro (no, one or two inserts, then D, K
or R) is a code, and no code is the beginning of another. So two audits of the same
rows compare as their lists of codes do, and the place of an audit among those of
its layer stands for it: the program keeps, for each state (nothing yet, after s, u
or a), a cost, a rank and a pointer to the state before; audits and texts are put
together at the end, backwards along the pointers. A third insert in a run leads to
a state that one leads to already, so none is ever worth its cost.

Rows are dealt by ranges of conversation and turn and sorted, and cut into segments
of SEGMENT rows or SEGMENT_CHARS characters; a conversation of any length is many
segments. A segment is solved for each state that it may be entered in, which gives
16 costs and the order of the audits that share an entry. These are all that the
choice of each segment's entry and exit takes, one small row a segment; then each
segment is written out by itself. The digest of a conversation is one sequential
function of its text: it is fed segment by segment, and holds none of them.

The damage is a test's: by the crc32 of ``conv_id:turn``, modulo 20, a row is
dropped (0), emptied (1), loses its ``.!?`` (2), is repeated (3) or is the user's (4).

Defined cases: nulls of conv_id, turn, role and text are read as one space, but
rows without turn stand first, and do not count for gaps; rows of one turn go by
role, then text; rows that repeat both are repeats like others, and repeated
conversations' rows belong together; a row with an empty role has no initial, so it
can't be kept; a conversation that loses all rows, like one whose rows are all
deleted, has the digest of the empty text; an empty table gives no rows. Only
conv_id, turn, role and text are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import BROADCAST_ROWS, bounded_batches, materialize, table

QUERY = "op12_conversation_repair"

#: Rows and characters of a segment, about: one with a longer row has that row whole.
SEGMENT, SEGMENT_CHARS = 1024, 1 << 20

#: Costs: a new role, a deletion, an insertion, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing written, after a system row, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after what must come next, a system row at the start apart.
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserts at the end that make what was written whole.
TAIL = (0, 2, 1, 0)
CODES = sorted("I" * k + edit for k in range(3) for edit in "DKR")
NEVER = 1 << 40


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """[class of a row, state before, state after]: the cost of the best macro, and its code. A class: initial (3 for others) + 4 if it must go + 8 if truncated."""
    cost, code = np.full((16, 4, 4), NEVER, np.int64), np.zeros((16, 4, 4), np.int64)
    for kind in range(16):
        initial, gone, truncated = kind & 3, bool(kind & 4), bool(kind & 8)
        for before in range(4):
            for i, macro in enumerate(CODES):
                at, c = before, 0
                for edit in macro:
                    if edit == "I":
                        at, c = NEXT[at], c + INSERT
                    elif edit == "D":
                        c += DELETE
                    elif gone:
                        c = NEVER
                    elif edit == "R":
                        at, c = NEXT[at], c + REROLE + TRUNCATED * truncated
                    else:
                        to = SYSTEM if initial == 0 and at == START else initial + 1 if initial in (1, 2) and initial + 1 == NEXT[at] else None
                        at, c = (at, NEVER) if to is None else (to, c + TRUNCATED * truncated)
                # Codes come in their order: of equal costs the first stays.
                if c < cost[kind, before, at]:
                    cost[kind, before, at], code[kind, before, at] = c, i
    return cost, code


_COST, _CODE = _tables()


def solve(kinds: list[np.ndarray], entries: np.ndarray, pointers: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """cost and rank [segment, entry, exit] of the best audits of segments, and with pointers, a layer each, the state before and the code, as before * 16 + code. kinds: classes of the rows of each segment; entries: [segment, entry] states."""
    size = np.array([len(k) for k in kinds], np.int64)
    order = np.argsort(-size, kind="stable")
    n, e = entries.shape
    cost, rank = np.full((n, e, 4), NEVER, np.int64), np.full((n, e, 4), 3, np.int64)
    np.put_along_axis(cost, entries[:, :, None], 0, 2)
    np.put_along_axis(rank, entries[:, :, None], 0, 2)
    layers: list[np.ndarray] = []
    width = int(size.max(initial=0))
    grid = np.zeros((n, width), np.int8)
    for i, k in enumerate(kinds):
        grid[i, : len(k)] = k
    for t in range(width):
        own = order[: np.searchsorted(-size[order], -t, "left")]  # segments that have a row t
        kind = grid[own, t]
        total = cost[own][:, :, :, None] + _COST[kind][:, None, :, :]
        before = (total * 8 + rank[own][:, :, :, None]).argmin(2)
        code = _CODE[kind][np.arange(len(own))[:, None, None], before, np.arange(4)[None, None, :]]
        key = np.take_along_axis(rank[own], before, 2) * len(CODES) + code
        total = np.minimum(np.take_along_axis(total, before[:, :, None, :], 2)[:, :, 0, :], NEVER)
        key = np.where(total < NEVER, key, NEVER)
        cost[own], rank[own] = total, (key[..., :, None] > key[..., None, :]).sum(-1)
        if pointers:
            layer = np.zeros((n, e, 4), np.uint8)
            layer[own] = before * 16 + code
            layers.append(layer)
    return cost, rank, layers


def macros(layers: list[np.ndarray], i: int, length: int, exit_: int) -> list[str]:
    """The codes of segment i, which was solved for one entry, back from its exit."""
    found = []
    for t in range(length - 1, -1, -1):
        p = int(layers[t][i, 0, exit_])
        found.append(CODES[p & 15])
        exit_ = p >> 4
    return found[::-1]


def written(codes: list[str], tail: str, entry: int, roles: list[str], texts: list[str]) -> list[str]:
    """role:text of what the edits leave."""
    out, at = [], entry
    for code, role, text in zip(codes, roles, texts, strict=True):
        for edit in code:
            if edit == "D":
                continue
            to = SYSTEM if edit == "K" and role[:1] == "s" and at == START else NEXT[at]
            out.append(f"{role}:{text}" if edit == "K" else f"{NAMES[to]}:{text if edit == 'R' else ''}")
            at = to
    for _ in tail:
        at = NEXT[at]
        out.append(f"{NAMES[at]}:")
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after the damage."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _same(*names: str) -> Column:
    """Whether columns are those of the same names with an underscore before them, nulls equal."""
    out = F.lit(True)
    for c in names:
        out &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def faulty(rows: DataFrame) -> DataFrame:
    """rows with blank, earlier (an earlier turn has the same role and text) and truncated."""
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    rows = rows.withColumns({"blank": last == "", "truncated": ~last.isin(".", "!", "?"), "key": F.unhex(F.sha2("text", 256))})
    repeated = rows.where(~F.col("blank")).groupBy("conv_id", "role", "key").agg(F.count("*").alias("n"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    # Only what stands in several turns: repeats within a turn stand side by side once sorted.
    repeated = repeated.where("n > 1 AND (first_turn < last_turn OR unnumbered AND first_turn IS NOT NULL)").select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "key", "unnumbered", "first_turn")))
    out = rows.join(repeated, _same("conv_id", "role", "key"), "left")
    earlier = F.col("_unnumbered") & F.col("turn").isNotNull() | (F.col("_first_turn") < F.col("turn"))
    return out.select("conv_id", "turn", "role", "text", "blank", "truncated", F.coalesce(earlier, F.lit(False)).alias("earlier"))


def _kinds(initial: list[str], gone: list[bool], truncated: list[bool]) -> np.ndarray:
    return np.array([(INITIALS.find(i) if i else -1) % 4 + 4 * g + 8 * t for i, g, t in zip(initial, gone, truncated, strict=True)], np.uint8)


_SEGMENT = "seg long, roles array<string>, texts array<string>, kinds binary, cost array<long>, rank array<long>, blank long, duplicate long, truncated long, illegal long, head string, last string, first_turn long, last_turn long, turns long"


def segments(rows: DataFrame) -> DataFrame:
    """Segments of faulty rows in order: their rows, and what the choice between them takes."""
    bounded_batches(rows.sparkSession, 2000)
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        before = None
        for b in batches:
            for conv, turn, role, text, blank, truncated, earlier in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "blank", "truncated", "earlier")), strict=True):
                here = (conv, turn, role, text)
                yield conv, turn, role, text, blank, not blank and (earlier or here == before), truncated
                before = here

    def cut(found: Iterator[tuple]) -> Iterator[list[tuple]]:
        held, chars = [], 0
        for r in found:
            if held and (r[0] != held[0][0] or len(held) >= SEGMENT or chars + len(r[3]) > SEGMENT_CHARS):
                yield held
                held, chars = [], 0
            held.append(r)
            chars += len(r[3])
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 33

        def solved(held: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal seg
            out = []
            for own in held:
                _, turns, roles, texts, blank, duplicate, truncated = map(list, zip(*own, strict=True))
                initial = [r[:1] for r in roles]
                truncated = [t and not b and not d for t, b, d in zip(truncated, blank, duplicate, strict=True)]
                known = [t for t in turns if t is not None]
                kinds = _kinds(initial, [b or d for b, d in zip(blank, duplicate, strict=True)], truncated)
                illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initial, initial[1:], strict=False))
                out.append([own[0][0], seg, roles, texts, kinds, sum(blank), sum(duplicate), sum(truncated), illegal, initial[0], initial[-1], known[0] if known else None, known[-1] if known else None, len(set(known))])
                seg += 1
            cost, rank, _ = solve([x[4] for x in out], np.tile(np.arange(4), (len(out), 1)))
            for x, c, r in zip(out, cost.reshape(-1, 16).tolist(), rank.reshape(-1, 16).tolist(), strict=True):
                x[4:5] = [x[4].tobytes(), c, r]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds_of, strict=True)], names)

        held, size = [], 0
        for own in cut(rows_of(batches)):
            held.append(own)
            size += len(own) * 100 + sum(len(r[3]) for r in own)
            if size >= 4 << 20:
                yield solved(held)
                held, size = [], 0
        if held:
            yield solved(held)

    conv = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {conv}, {_SEGMENT}"
    names = [x.split()[0] for x in schema.split(", ")]
    text, number = pa.string(), pa.int64()
    conv_type = pa.string() if conv == "string" else pa.int32() if conv == "int" else number
    kinds_of = [conv_type, number, pa.list_(text), pa.list_(text), pa.binary(), pa.list_(number), pa.list_(number), *[number] * 4, text, text, *[number] * 3]
    return materialize(ordered.mapInArrow(run, schema), "repair-segments")


_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CHOICE = "seg long, entry int, exit int, tail int, " + ", ".join(f"{c} long" for c in _STATS)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """The rows of each conversation, which come one after the other."""
    held: list[dict] = []
    for b in batches:
        for r in b.select(names).to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def choose(segs: list[dict]) -> list[tuple]:
    """(seg, entry, exit, tail, counts of the conversation, which only its last segment has) of the segments of a conversation."""
    cost, rank, back = [0] + [NEVER] * 3, [0] * 4, []
    for s in segs:
        best = []
        for q in range(4):
            total, _, e = min((cost[e] + s["cost"][4 * e + q], rank[e], e) for e in range(4))
            best.append((total, rank[e], s["rank"][4 * e + q], e))
        reached = sorted((b[1], b[2]) for b in best if b[0] < NEVER)
        back.append([b[3] for b in best])
        cost = [min(b[0], NEVER) for b in best]
        rank = [reached.index((b[1], b[2])) if b[0] < NEVER else 4 for b in best]
    total, _, q = min((cost[q] + INSERT * TAIL[q], rank[q], q) for q in range(4))
    ways = []
    for own in reversed(back):
        ways.append((own[q], q))
        q = own[q]
    ways.reverse()
    known = [s for s in segs if s["first_turn"] is not None]
    turns = sum(s["turns"] for s in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
    illegal = sum(s["illegal"] for s in segs) + sum(a["last"] + b["head"] not in ("su", "ua", "au") for a, b in zip(segs, segs[1:], strict=False))
    # A span of turns beyond 64 bits wraps around, as Spark's own sums do.
    stats = ((gaps + 2**63) % 2**64 - 2**63, *(sum(s[c] for s in segs) for c in ("blank", "duplicate", "truncated")), illegal, total)
    end = len(segs) - 1
    return [(s["seg"], *way, TAIL[way[1]] if i == end else 0, *(stats if i == end else [None] * 6)) for i, (s, way) in enumerate(zip(segs, ways, strict=True))]


def repair(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, counts of faults, cost, audit, repaired_sha256 and rows (of the repaired conversation) of each conversation; see ``texts`` for the rows themselves."""
    rows = damaged(conversations) if damage else conversations.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    found = _digests(texts(rows))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found.withColumnRenamed("conv_id", "_conv_id"), _same("conv_id"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*_STATS, "rows")]
    return out.select("conv_id", *zero[:-1], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), zero[-1])


def texts(rows: DataFrame) -> DataFrame:
    """conv_id, seg, audit and lines (``role:text`` of the repaired rows) of each segment of the conversations in rows, in the order of seg; the last one has the conversation's counts."""
    segs = segments(faulty(rows))
    narrow = ["conv_id", "seg", "cost", "rank", "blank", "duplicate", "truncated", "illegal", "head", "last", "first_turn", "last_turn", "turns"]

    def choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for own in _groups(batches, narrow):
            held += choose(own)
            if len(held) > 5000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    chosen_names = [x.split()[0] for x in _CHOICE.split(", ")]
    chosen_types = [pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * 6]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), chosen_types, strict=True)], chosen_names)

    ordered = segs.select(narrow).repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    chosen = materialize(ordered.mapInArrow(choices, _CHOICE), "repair-choices")
    small = chosen.limit(BROADCAST_ROWS // 8 + 1).count() <= BROADCAST_ROWS // 8
    both = segs.select("conv_id", "seg", "roles", "texts", "kinds").join(F.broadcast(chosen) if small else chosen, "seg")
    names = ["conv_id", "seg", "audit", "lines", *_STATS]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, own, entry, exit_, tail = (b.column(c).to_pylist() for c in ("roles", "texts", "entry", "exit", "tail"))
            kinds = [np.frombuffer(k, np.uint8) for k in b.column("kinds").to_pylist()]
            _, _, layers = solve(kinds, np.array(entry, np.int64)[:, None], pointers=True)
            codes = [macros(layers, i, len(k), exit_[i]) for i, k in enumerate(kinds)]
            lines = [written(c, "I" * t, e, r, x) for c, t, e, r, x in zip(codes, tail, entry, roles, own, strict=True)]
            audit = ["".join(c) + "I" * t for c, t in zip(codes, tail, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(audit, pa.string()), pa.array(lines, pa.list_(pa.string())), *(b.column(c) for c in _STATS)], names)

    bounded_batches(rows.sparkSession, 500)
    return both.mapInArrow(write, f"conv_id {dict(rows.dtypes)['conv_id']}, seg long, audit string, lines array<string>, " + ", ".join(f"{c} long" for c in _STATS))


def _digests(parts: DataFrame) -> DataFrame:
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    names = ["conv_id", *_STATS, "audit", "repaired_sha256", "rows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, audit, digest, n = None, [], hashlib.sha256(), 0
        for b in batches:
            done = []
            for conv, own, lines, *stats in zip(*(b.column(c).to_pylist() for c in ("conv_id", "audit", "lines", *_STATS)), strict=True):
                audit.append(own)
                for line in lines:
                    if n:
                        digest.update(b"\n")
                    digest.update(line.encode("utf-8", "surrogatepass"))
                    n += 1
                if stats[0] is not None:  # the last segment
                    done.append((conv, *stats, "".join(audit), digest.hexdigest(), n))
                    audit, digest, n = [], hashlib.sha256(), 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [b.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64()], strict=True)], names)

    return ordered.mapInArrow(run, f"conv_id {dict(parts.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in _STATS) + ", audit string, repaired_sha256 string, rows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations")).drop("rows")


#: A fold over a conversation's rows that keeps whole audits and texts for each state, and compares them as strings.
ORACLE_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kind AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d FROM keyed, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kind WHERE d <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM hurt),
marked AS (SELECT *, role[1] AS i, lag(role[1]) OVER w AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, n > min(n) OVER (PARTITION BY conv_id, role, text) AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut
           FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
               count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
               list({i: i, role: role, text: text, gone: blank OR again, late: CASE WHEN cut THEN 5 ELSE 0 END} ORDER BY n) AS l
        FROM marked GROUP BY conv_id),
solved AS (SELECT *, list_reduce(l, lambda acc, x: list_transform([flatten(list_transform(flatten(list_transform(acc, lambda y:
             [y, {st: CASE WHEN y.st = 2 THEN 3 ELSE 2 END, c: y.c + 5, a: y.a || 'I', o: y.o || CASE WHEN y.st = 2 THEN 'assistant' ELSE 'user' END || ':' || chr(10)},
              {st: CASE WHEN y.st = 2 THEN 2 ELSE 3 END, c: y.c + 10, a: y.a || 'II', o: y.o || CASE WHEN y.st = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10)}])), lambda z:
             [{st: z.st, c: z.c + 2, a: z.a || 'D', o: z.o},
              {st: CASE WHEN x.gone THEN 9 WHEN x.i = 's' AND z.st = 0 THEN 1 WHEN x.i = 'u' AND z.st <> 2 THEN 2 WHEN x.i = 'a' AND z.st = 2 THEN 3 ELSE 9 END, c: z.c + x.late, a: z.a || 'K', o: z.o || x.role || ':' || x.text || chr(10)},
              {st: CASE WHEN x.gone THEN 9 WHEN z.st = 2 THEN 3 ELSE 2 END, c: z.c + 1 + x.late, a: z.a || 'R', o: z.o || CASE WHEN z.st = 2 THEN 'assistant:' ELSE 'user:' END || x.text || chr(10)}]))],
             lambda cs: flatten(list_transform([0, 1, 2, 3], lambda q: list_sort(list_filter(cs, lambda z: z.st = q))[1:1])))[1],
           [{st: 0, c: 0::BIGINT, a: '', o: ''}]) AS states FROM per),
ended AS (SELECT *, list_sort(list_transform(states, lambda y: {c: y.c + CASE y.st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END, a: y.a || CASE y.st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
            o: y.o || CASE y.st WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}))[1] AS best FROM solved)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(best.o[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
