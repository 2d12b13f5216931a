"""Packing documents into as few token sequences as can be: dominance reduction, then best fit.

Tokens. A document is its ids and an end mark. Only a document longer than a
sequence is cut, so that all its pieces but the first are whole sequences.

Cutting text into words as the tokenizer does, a byte-level one that starts a new
word at each blank, is done here for a block of texts at once: a unit is a word with
the blank before it, or white space between words, and has a number (see
``bytewords``). Only units that a worker hasn't met are encoded, joined to one text
and parted again by the lengths of their tokens. The tokens of each block are
decoded to bytes and compared with it, so equal numbers of different units can't
pass unseen. Texts with white space beyond ASCII or with a special token's string,
and texts of other tokenizers, are encoded as they are.

Packing. The sizes are counted: at most ``capacity`` counts, whatever the rows. On
these counts Martello and Toth's reduction runs: for each size j, largest first, a
set of at most three items around j is fixed for good if it dominates every other
set with j that fits, that is if the other's items can be dealt to its items without
exceeding any:
 - j alone, if nothing fits beside it;
 - j and the largest k beside it, if k fills up the rest, if no two items fit
   beside j, or if only two do and no fitting pair is more than k;
 - j, k and the largest b beside both, if only two items fit beside j, and each
   fitting pair has its smaller item at most b, or is not more than k.
A set that dominates is fixed as often as its items last: taking items away leaves
fewer alternatives. What remains is packed by best fit, largest items first, whole
groups of equally filled sequences at a time. The plan has some patterns for each
size, bounded by capacity alone.

Placing. Items of a size are numbered across buckets of a hash of the stored row, a
bucket's first number being a running sum of counts, so that no task needs all items
of a frequent size. A number and a size give pattern, sequence and offset.

Defined cases: null and empty texts are the end mark alone; repeated rows are items
each; a null doc_id is one more id; an empty table gives no rows; sizes that are
null, under 1 or over capacity are not packed, and their place is null. ``pieces``
reads doc_id and text only, ``pack`` keeps all columns.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from textquarry.llm import bytewords
from textquarry.llm.bytewords import IS_SPACE, U, mixed
from textquarry.llm.common import bounded_batches, materialize, table

QUERY = "op13_packing"

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 2048
END = 0
#: A worker remembers the tokens of so many units, 70 bytes each at most, and starts anew then.
KNOWN = 1 << 19
#: Rows of a bucket, about, and the least number of buckets. A bucket's items of one size are numbered in one task.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 18, 64

#: White space beyond ASCII, by the Unicode property.
WIDE_SPACE = "\x85\xa0  -     　"
_WIDE = re.compile(f"[{WIDE_SPACE}]")
#: Where any text may be parted: a blank alone between two characters that are no white space.
_SAFE = re.compile(rf"(?<=[^\s{WIDE_SPACE}]) (?=[^\s{WIDE_SPACE}])")
#: Bytes of a block, and of text that is encoded uncut at once, about.
BLOCK = bytewords.PIECE


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbers:
    """64-bit numbers and the order in which they were added, in a table with open addresses: many are looked up, or added, at once."""

    def __init__(self, most: int):
        """most: room is for twice as many."""
        self.mask = (1 << max(most - 1, 1).bit_length() + 1) - 1
        self.key, self.place, self.n = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32), 0

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for one that is not there."""
        out = np.full(len(numbers), -1, np.int32)
        at, left = (numbers & U(self.mask)).astype(np.int64), np.arange(len(numbers))
        while len(left):
            place = self.place[at]
            same = (place >= 0) & (self.key[at] == numbers[left])
            out[left[same]] = place[same]
            on = (place >= 0) & ~same
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def add(self, numbers: np.ndarray) -> None:
        """Adds numbers, each once and none of them there yet."""
        at, left = (numbers & U(self.mask)).astype(np.int64), np.arange(len(numbers), dtype=np.int32)
        while len(left):
            free = self.place[at] < 0
            # Of several that want one address the last written has it, the others go on.
            self.place[at[free]] = self.n + left[free]
            won = self.place[at] == self.n + left
            self.key[at[won]] = numbers[left[won]]
            left, at = left[~won], (at[~won] + 1) & self.mask
        self.n += len(numbers)


class Encoder:
    """A tokenizers file ready to encode many texts."""

    def __init__(self, data: str, known: int = KNOWN):
        # Texts go one by one, long ones as a whole: threads would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_str(data), known
        spec = json.loads(data)
        added = spec.get("added_tokens") or []
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.units = bool(plain) and not spec.get("normalizer") and not spec.get("post_processor")
        self.cut = self.units and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        if self.units:
            byte, special = _byte_of(), {t["id"]: t["content"].encode() for t in added}
            vocab = sorted((i, t) for t, i in self.tok.get_vocab().items())
            own = {i: special[i] if i in special else bytes(map(byte.__getitem__, t)) for i, t in vocab}
            parts = [own.get(i, b"") for i in range(max(own, default=-1) + 1)]
            self.size = np.array([len(p) for p in parts], np.int64)
            self.begin = np.cumsum(self.size) - self.size
            self.store = np.frombuffer(b"".join(parts), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers(self.most)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text by the tokenizer alone; a long one is parted where no token crosses, if it may be."""
        parts, begin = [np.zeros(0, np.uint32)], 0
        while begin < len(text):
            place = _SAFE.search(text, begin + BLOCK) if self.cut else None
            end = place.start() if place else len(text)
            parts.append(self._plain(text[begin:end]))
            begin = end
        return np.concatenate(parts)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text, without special tokens before or after."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owner, size
            for i, ids in zip(owner, self._block(held), strict=True):
                out[i].append(ids)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            parts = None if not self.units or _WIDE.search(text) or self.special.search(text) else self._parts(text.encode("utf-8", "surrogatepass"))
            if parts is None:
                out[i].append(self.whole(text))
                continue
            for p in parts:
                if held and size + len(p) + 2 > BLOCK:
                    flush()
                held.append(p)
                owner.append(i)
                size += len(p) + 1
        if held:
            flush()
        return [np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]

    @staticmethod
    def _parts(text: bytes) -> list[bytes] | None:
        """text in parts that fit in a block, each but the first with a blank in front that stands alone; None if a stretch has no such blank."""
        parts, begin, most = [], 0, BLOCK - 2
        while len(text) - begin > most:
            at = begin + most
            while (at := text.rfind(b" ", begin + 1, at)) > 0 and (IS_SPACE[text[at - 1]] or IS_SPACE[text[at + 1]]):
                pass
            if at <= 0:
                return None
            parts.append(text[begin:at])
            begin = at
        return [*parts, text[begin:]]

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.known.n > self.most:
            self._forget()
        x = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        bars = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        space = IS_SPACE[x]
        space[bars] = False
        word = ~space
        word[bars] = False
        begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        spaced = space[begin - 1]
        # A blank belongs to the word after it; other white space leaves its last character alone before a word.
        starts = np.zeros(len(x), bool)
        starts[begin - spaced] = True
        starts[begin[~(spaced & (x[begin - 1] == 0x20))]] = True
        starts[1:] |= space[1:] & ~space[:-1]
        starts[bars] = True
        begin = np.flatnonzero(starts)
        bar = np.zeros(len(x), bool)
        bar[bars] = True
        bar = bar[begin]
        end = np.append(begin[1:], len(x))[~bar]
        of_text = np.cumsum(bar)[~bar] - 1
        begin = begin[~bar]
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(bytewords._BYTE[x] * bytewords._PLUS[: len(x)], out=total[1:])
        number = mixed((total[end] - total[begin]) * bytewords._MINUS[begin] + (end - begin).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        at = self.known.find(number)
        new = np.flatnonzero(at < 0)
        if len(new):
            unique, first = np.unique(number[new], return_index=True)
            self._learn(unique, x, begin[new[first]], end[new[first]])
            at[new] = self.known.find(number[new])
        size = np.diff(self.ends)[at]
        ids = _gathered(self.ids, self.ends[at], size)
        if not np.array_equal(_gathered(self.store, self.begin[ids], self.size[ids]), np.delete(x, bars)):
            self._forget()
            return [self.whole(t.decode("utf-8", "surrogatepass")) for t in texts]
        return np.split(ids, np.cumsum(np.bincount(of_text, size, len(texts)).astype(np.int64))[:-1])

    def _learn(self, numbers: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encodes the units x[begin : end]: words with a blank as one text, bare words with newlines between, white space one by one."""
        kind = np.where(IS_SPACE[x[end - 1]], 2, x[begin] != 0x20)
        order, ids, sizes = np.argsort(kind, kind="stable"), [self.ids], []
        for own, between in ((np.flatnonzero(kind == 0), 0), (np.flatnonzero(kind == 1), 1)):
            if len(own):
                # A character more is taken after each bare word, and a newline put there.
                size = end[own] - begin[own] + between
                text, stop = _gathered(x, begin[own], size), np.cumsum(size)
                if between:
                    text[stop - 1] = 0x0A
                found = self._plain(text.tobytes().decode("utf-8", "surrogatepass"))
                upto = np.searchsorted(np.cumsum(self.size[found]), stop) + 1
                if between:
                    found = np.delete(found, upto - 1)
                    upto -= np.arange(1, len(upto) + 1)
                ids.append(found)
                sizes.append(np.diff(upto, prepend=0))
        for i in np.flatnonzero(kind == 2):
            ids.append(self._plain(x[begin[i] : end[i]].tobytes().decode()))
            sizes.append(np.array([len(ids[-1])]))
        self.known.add(numbers[order])
        self.ids = np.concatenate(ids)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])


def _gathered(store: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts store[begin : begin + size], one after the other."""
    return store[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] if len(size) else store[:0]


@lru_cache(maxsize=1)
def _encoder(data: str) -> Encoder:
    """A worker's own, kept from task to task with the units that it has met."""
    return Encoder(data)


def pieces(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit numbers, as binary) of each piece of each document."""
    bounded_batches(documents.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data)
        for batch in batches:
            owner, rows = [], []
            for i, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                begin, first = 0, len(ids) % capacity or capacity
                for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    owner.append(i)
                    rows.append((k, begin, stop - begin, ids[begin:stop].tobytes()))
                    begin = stop
            k, begin, length, ids = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(k, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, piece int, start long, length long, ids binary")


#: Sizes of a sequence, largest first, and how many sequences are so filled.
Plan = list[tuple[tuple[int, ...], int]]


def _upto(n: np.ndarray) -> np.ndarray:
    """For each number the largest size up to it that is there, 0 if none."""
    return np.maximum.accumulate(np.where(n > 0, np.arange(len(n)), 0))


def dominating(n: np.ndarray, j: int) -> tuple[int, ...] | None:
    """A set with an item of size j that dominates all sets with it that fit, of items counted by size in n; None if none of at most three items is known to."""
    n = n.copy()
    n[j] -= 1
    rest = len(n) - 1 - j
    upto = _upto(n)
    k = int(upto[rest])
    if not k:
        return (j,)
    if k == rest:
        return (j, k)
    sizes = np.flatnonzero(n[: rest + 1])
    least = np.repeat(sizes[:3], np.minimum(n[sizes[:3]], 3))[:3]
    if len(least) < 2 or least[:2].sum() > rest:
        return (j, k)
    if len(least) == 3 and least.sum() <= rest:
        return None
    # The largest partner of each size that is no larger than it.
    partner = upto[np.minimum(sizes, rest - sizes)]
    partner = np.where((partner == sizes) & (n[sizes] < 2), upto[np.maximum(sizes - 1, 0)], partner)
    fits = partner > 0
    pair, smaller = (sizes + partner)[fits], partner[fits]
    if pair.max(initial=0) <= k:
        return (j, k)
    n[k] -= 1
    b = int(_upto(n)[min(k, rest - k)])
    if b and bool(((smaller <= b) | (pair <= k)).all()):
        return (j, k, b)
    return None


def reduced(counts: np.ndarray) -> tuple[Plan, np.ndarray]:
    """Sequences that are fixed for good, and what remains to be packed. counts: of items by size, up to the capacity."""
    n, fixed, changed = counts.copy(), [], True
    while changed:
        changed = False
        for j in range(len(n) - 1, 0, -1):
            while n[j] and (found := dominating(n, j)):
                times = min(int(n[s]) // found.count(s) for s in set(found))
                for s in found:
                    n[s] -= times
                fixed.append((found, times))
                changed = True
    return fixed, n


def best_fit(counts: np.ndarray) -> Plan:
    """Items by size, largest first, each into the fullest sequence that it fits in."""
    capacity = len(counts) - 1
    # By what is left: how many sequences, and the sizes in them.
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for s in np.flatnonzero(counts)[::-1].tolist():
        m = int(counts[s])
        for left in sorted(r for r in groups if r >= s):
            each = left // s
            while m and groups[left]:
                filled, q = groups[left].pop()
                full = min(q, m // each)
                if full:
                    groups[left - each * s].append((filled + (s,) * each, full))
                    m, q = m - full * each, q - full
                if q and m and m < each:
                    groups[left - m * s].append((filled + (s,) * m, 1))
                    m, q = 0, q - 1
                if q:
                    groups[left].append((filled, q))
            if not groups[left]:
                del groups[left]
            if not m:
                break
        each = capacity // s
        if m // each:
            groups[capacity - each * s].append(((s,) * each, m // each))
        if m % each:
            groups[capacity - m % each * s].append(((s,) * (m % each), 1))
    return [g for own in groups.values() for g in own]


def plan(counts: np.ndarray) -> Plan:
    fixed, rest = reduced(counts)
    return fixed + best_fit(rest)


def slots(plan_: Plan, capacity: int) -> dict[str, np.ndarray]:
    """Where items go: of those of a size, numbered from 0, the ones from first on go each-wise into the sequences from base on, from offset on."""
    rows, upto, base = [], np.zeros(capacity + 1, np.int64), 0
    for filled, times in plan_:
        offset = 0
        for s in sorted(set(filled), reverse=True):
            each = filled.count(s)
            rows.append((s, upto[s], each, base, offset))
            upto[s] += times * each
            offset += s * each
        base += times
    rows.sort()
    return {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(("size", "first", "each", "base", "offset"))}


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset: sequences of at most capacity, as few as may be. The column of sizes has whole numbers."""
    own = items.select(F.struct("*").alias("row"), F.when(F.col(f"`{size}`").between(1, capacity), F.col(f"`{size}`").cast("int")).alias("size"), F.monotonically_increasing_id().alias("id"))
    stored = materialize(own, "packing-items")
    counts = np.zeros(capacity + 1, np.int64)
    for r in stored.where("size IS NOT NULL").groupBy("size").count().collect():  # capacity rows at most
        counts[r["size"]] = r["count"]
    where = slots(plan(counts), capacity)
    buckets = max(LEAST_BUCKETS, int(counts.sum()) // BUCKET_ROWS + 1)
    own = stored.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    first = own.where("size IS NOT NULL").groupBy("size", "bucket").count()
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select("size", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id")))
    ranked = ranked.join(first, ["size", "bucket"], "left").select("row", "size", (F.col("first") + F.col("rank") - 1).alias("rank"))
    # Sizes and numbers as one ascending key; the next slot's key ends a slot.
    key = where["size"] * (1 << 44) + where["first"]
    names = [*items.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = b.column("rank").is_null().to_numpy(zero_copy_only=False)
            s, n = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "rank"))
            sequence = offset = n
            if len(key):
                at = np.maximum(np.searchsorted(key, s * (1 << 44) + n, "right") - 1, 0)
                n = n - where["first"][at]
                sequence, offset = where["base"][at] + n // where["each"][at], where["offset"][at] + n % where["each"][at] * s
            yield pa.RecordBatch.from_arrays([*b.column("row").flatten(), pa.array(sequence, pa.int64(), mask=none), pa.array(offset, pa.int64(), mask=none)], names)

    schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence of packed pieces (length, ids, sequence_id, offset)."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.where("sequence_id IS NOT NULL").groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.concat_ws("", F.transform(own, lambda x: F.hex(x["ids"]))).alias("ids")).withColumn("ids", F.unhex("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = pieces(table(spark, sf_dir, "documents"))
    return pack(own.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


#: Tokens have no SQL form; tests hold the ids against the tokenizer's own, and the plan against item-by-item versions and the least possible number.
ORACLE_SQL = None
