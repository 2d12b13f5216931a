"""Filter audit, conversation repair and packing, each against a plain version over all rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.llm import conversation_repair as repair
from textquarry.llm import filter_audit, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, A string, E boolean, length long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None, 7) for r in rows], DOCS)


# Filter audit.


def naive_audit(docs, labels):
    """The rows of the audit, document by document and order by order."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    by_part = {}
    for i, t, s in docs:
        t, w = t or "", WORD.findall(t or "")
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and first[t] < i}
        by_part.setdefault(s or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, own in by_part.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(gone)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in own)
                out[part, order, k + 1] = [len(left), len(gone), sum(x[0][f] for x in own) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.flags(documents(spark, docs)), labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found}
    assert len(out) == len(found)
    return out


def test_audit_equals_orders_run_one_by_one(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "GAMMA", "d#", "e", "é", "\x0b"] + [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.choices(words[: rng.choice([5, 30, 87])], k=rng.choice([3, 49, 50, 51, 120]))) for _ in range(40)] + [None, "", " \t", "😀" * 3, "A" + "b" * 19, "A" + "b" * 18]
    docs = [(i, rng.choice(texts), rng.choice(["s", "s", "t", None, ""])) for i in range(150)]
    docs += [docs[0], docs[3], (None, docs[5][1], "s"), (None, docs[5][1], "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120)] + [(3, 1, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == naive_audit(docs, labels)


def test_audit_of_hot_groups_and_nothing(spark):
    docs = [(i, "same text", "hot") for i in range(3000)] + [(5000, "other", "cold")]
    assert audited(spark, docs, [(2, 1, 0)]) == naive_audit(docs, [(2, 1, 0)])
    assert audited(spark, [], []) == {}


def test_words_of_a_very_long_text():
    text = " ".join(f"w{i % 70_001}" for i in range(1_000_000))
    n, distinct = filter_audit.word_counts(["a b a", text, None])
    assert n.tolist() == [3, 1_000_000, 0] and distinct.tolist() == [2, 70_001, 0]


# Conversation repair.


def naive_repair(rows):
    """(counts, cost, audit, lines) of the damaged rows of a conversation: all ways, whole audits compared."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0] + [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    counts.append(sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)))
    # A way: what is written so far as initials, its cost, audit and lines.
    ways = [("", 0, "", ())]
    grow = lambda w: ("a" if w[0][-1:] == "u" else "u", "assistant" if w[0][-1:] == "u" else "user")

    def inserted(ways):
        out = list(ways)
        for _ in range(3):
            ways = [((w[0] + grow(w)[0])[-2:], w[1] + 5, w[2] + "I", (*w[3], grow(w)[1] + ":")) for w in ways]
            out += ways
        return out

    def best(ways):
        found = {}
        for w in ways:
            state = w[0][-1:]
            if state not in found or (w[1], w[2]) < (found[state][1], found[state][2]):
                found[state] = w
        return list(found.values())

    for (_, role, text), kind in zip(rows, kinds, strict=True):
        after = []
        for w in inserted(ways):
            after.append((w[0], w[1] + 2, w[2] + "D", w[3]))
            if kind not in ("blank", "duplicate"):
                late = 5 * (kind == "truncated")
                i = role[:1]
                if i and re.fullmatch("su|ua|au|^[su]", w[0][-1:] + i):
                    after.append((w[0] + i, w[1] + late, w[2] + "K", (*w[3], f"{role}:{text}")))
                after.append((w[0] + grow(w)[0], w[1] + 1 + late, w[2] + "R", (*w[3], f"{grow(w)[1]}:{text}")))
        ways = best(after)
    ended = [w for w in inserted(ways) if w[0][-1:] in ("", "a")]
    _, cost, audit, lines = min(ended, key=lambda w: (w[1], w[2]))
    return (*counts, cost, audit, lines)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        d = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def repaired(spark, rows, **options):
    df = spark.createDataFrame([(*r, "n", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, seg long")
    return {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "rows")) for r in repair.repair(df, **options).collect()}


def expected(rows, ids):
    out = {}
    for c in ids:
        *counts, lines = naive_repair([r[1:] for r in rows if r[0] == c])
        out[c] = (*counts, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(lines))
    return out


def random_rows(seed, n, most):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sub", "unit"]
    texts = ["Yes.", "No!", "Why?", "So", "", " \t", None, "Fine. \n", "a.b", "é?"]
    return [(rng.choice([0, 1, 2, None, *range(3, n)]), rng.choice([None, *range(most)]), rng.choice(roles), rng.choice(texts)) for _ in range(n * 6)]


@pytest.mark.parametrize("size", [2, 1024])
def test_repair_equals_all_ways(spark, monkeypatch, size):
    """Also where conversations are cut into segments of two rows."""
    monkeypatch.setattr(repair, "SEGMENT", size)
    rows = random_rows(size, 60, 9)
    assert repaired(spark, rows) == expected(damage(rows), {r[0] for r in rows})


def test_repair_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 16)
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"{i}.", "Again.", f"{i} so", ""])) for i in range(700)]
    assert repaired(spark, rows, damage=False) == expected(rows, {7})


def test_repair_of_odd_conversations(spark):
    assert repaired(spark, []) == {}
    empty = hashlib.sha256(b"").hexdigest()
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", empty, 0)}
    long = "word " * 400_000 + "."
    found = repaired(spark, [(1, 1, "user", long), (1, 2, "assistant", long), (2, None, None, None)], damage=False)
    assert found[1][:7] == (0, 0, 0, 0, 0, 0, "KK") and found[2][:7] == (0, 1, 0, 0, 0, 2, "D")


def test_macros_order_as_their_strings():
    assert repair.CODES == sorted(repair.CODES) and not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)


# Packing.


@pytest.fixture(scope="module")
def encoder():
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        return packing.Encoder(f.read(), known=200)


PARTS = ["a", "Wort", " ", "  ", "\n", "\n\n", "\t", "\r\n", "it's", "<|endoftext|>", " ", "\x85", "\x1c", "　", "é", "😀", "12", "...", "\x00", "x" * 50]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join), max_size=6))
def test_units_give_the_tokenizers_ids(encoder, texts):
    theirs = [e.ids for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == theirs


def test_long_texts_are_encoded_as_a_whole(encoder):
    texts = ["one " * 200_000, "x" * 300_000, "a b c " * 60_000, "<|endoftext|> " * 30_000, "\n" * 300_000, None, ""]
    theirs = [e.ids for e in encoder.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == theirs


def test_equal_numbers_of_units_are_noticed(encoder, monkeypatch):
    """With all units of a length taken for one another, ids still are right."""
    monkeypatch.setattr(packing, "mixed", lambda x: x * np.uint64(0))
    encoder._forget()
    assert encoder.encode(["ab cd ef"])[0].tolist() == encoder.tok.encode("ab cd ef").ids
    encoder._forget()


def test_every_document_is_cut_and_placed(spark, data, encoder):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, ""), (1, "again"), (1, "again")], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs.unionByName(odd)).withColumn("ids_crc32", F.crc32("ids"))).collect()
    texts = [r["text"] for r in docs.collect()] + [None, "", "again", "again"]
    theirs = [np.array([*encoder.tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    want = Counter()
    for ids in theirs:
        first = len(ids) % 2048 or 2048
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048), strict=True)):
            want[k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    n = len({r["sequence_id"] for r in rows})
    assert n <= -(-sum(map(len, theirs)) // 2048) + 1  # one more than the tokens need at most
    whole = packing.sequences(spark.createDataFrame([(r["length"], bytes(r["ids"]), r["sequence_id"], r["offset"]) for r in rows], "length long, ids binary, sequence_id long, offset long")).collect()
    assert len(whole) == n and all(len(r["ids"]) == 4 * r["n_tokens"] for r in whole)
    one = min(r["sequence_id"] for r in rows)
    assert bytes(next(r["ids"] for r in whole if r["sequence_id"] == one)) == b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["sequence_id"] == one), key=lambda r: r["offset"]))


def check_places(places, capacity):
    by = {}
    for s, offset, length in places:
        by.setdefault(s, []).append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_pack_of_odd_sizes(spark):
    rows = [(None, 1), (0, 2), (-5, 3), (11, 4), (10, 5), (4, 6), (6, 7)] + [(3, 100 + i) for i in range(3000)]
    found = packing.pack(spark.createDataFrame(rows, "length long, _size int"), capacity=10).collect()
    assert sorted(r["_size"] for r in found if r["sequence_id"] is None) == [1, 2, 3, 4]
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in found if r["sequence_id"] is not None], 10)
    assert len({r["sequence_id"] for r in found} - {None}) == 2 + 1000
    assert packing.pack(spark.createDataFrame([], "length long, name string"), capacity=10).collect() == []


def fewest(sizes, capacity):
    """The least number of sequences, by trying all."""
    best = len(sizes)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        s = left[0]
        for i, room in enumerate(bins):
            if s <= room and room not in bins[:i]:
                go(left[1:], [*bins[:i], room - s, *bins[i + 1 :]])
        go(left[1:], [*bins, capacity - s])

    go(sorted(sizes, reverse=True), [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 30), st.lists(st.integers(1, 30), max_size=9))
def test_fixed_sets_cost_no_sequence(capacity, sizes):
    """What is fixed, with the least for the rest, is the least for all; and every item is packed."""
    sizes = [min(s, capacity) for s in sizes]
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    fixed, rest = packing.reduced(counts)
    left = np.repeat(np.arange(capacity + 1), rest).tolist()
    assert sum(t for _, t in fixed) + fewest(left, capacity) == fewest(sizes, capacity)
    packed = Counter()
    for filled, times in packing.plan(counts):
        assert sum(filled) <= capacity and times > 0
        for s in filled:
            packed[s] += times
    assert packed == Counter(sizes)


def naive_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - s)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 60), st.lists(st.integers(1, 60), max_size=80))
def test_best_fit_by_groups_equals_item_by_item(capacity, sizes):
    sizes = [min(s, capacity) for s in sizes]
    plan = packing.best_fit(np.bincount(sizes, minlength=capacity + 1).astype(np.int64))
    assert sorted(capacity - sum(filled) for filled, times in plan for _ in range(times)) == naive_best_fit(sizes, capacity)
