"""Operators on documents: defined cases, and brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import bytewords, minhash, mixing, pii, quality, quality_rules, secrets, sentencepiece_codec, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, size string"


def frame(spark, texts, source=lambda i: f"s{i % 3}", first=0):
    rows = [(first + i, t, "en", source(i), len(t or ""), 0.5, None, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "one", "one two", "a b c", "a b c", "é" * 3, "x " * 30_000, "😀 mail a@b.co +1 (234) 567-8901 9.9.9.9", "\x01\x02 \x00"]


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark, ODD)
    return df.unionByName(df.where("doc_id = 5")).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, []) if False else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_odd_rows_and_empty_tables(odd, empty, labels):
    for op in (
        lambda d: mixing.mix(d), lambda d: minhash.near_duplicates(d), lambda d: pii.sanitise(d), lambda d: secrets.scan(d), lambda d: quality.apply(d, labels), lambda d: quality_rules.apply(d, labels),
        lambda d: toxicity.apply(d, labels), lambda d: sentencepiece_codec.encode(d),
    ):
        assert len(op(odd).collect()) == len(ODD) + 2
        assert op(empty).collect() == []


# Mixing.


def naive_mix(rows, weights=(5, 2, 1), weight=lambda size: size.bit_length() or 1):
    """{doc_id: (target, copies)} of rows (doc_id, size, source), one document after the other."""
    sizes = Counter()
    for _, n, s in rows:
        sizes[s] += n
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    share = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        price = (total - sum(3 * sizes[s] for s in capped)) / max(sum(share[s] for s in order if s not in capped), 1e-9)
        over = {s for s in order if share[s] * price > 3 * sizes[s]}
        if over <= capped:
            break
        capped |= over
    out = {}
    for s in order:
        target = float(3 * sizes[s]) if s in capped else share[s] * price
        own = [(i, n, weight(n)) for i, n, t in rows if t == s]
        cut, of_w = set(), 0.0
        while own:
            free = sum(n * w for _, n, w in own if w not in cut)
            of_w = (target - 3 * sum(n for _, n, w in own if w in cut)) / free if free else of_w
            over = {w for _, n, w in own if of_w * w > 3}
            if over <= cut:
                break
            cut |= over
        ranked, copies = [], {}
        for i, n, w in own:
            c = math.floor(min(3.0, of_w * w) * 2**32 + 0.5) / 2**32
            u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            copies[i] = math.floor(c)
            if c > copies[i]:
                ranked.append(((u / (1 - u)) / ((c - copies[i]) / (1 - (c - copies[i]))), i, n))
        gap = target - sum(copies[i] * n for i, n, _ in own)
        left = []
        for q, i, n in sorted(ranked):
            if n <= gap:
                copies[i] += 1
                gap -= n
            else:
                left.append((abs(gap - n), q, i, n))
        left = [(abs(gap - n), q, i, n) for _, q, i, n in left if abs(gap - n) < gap]
        if left:
            copies[min(left)[2]] += 1
        out |= {i: (target, copies[i]) for i, _, _ in own}
    return out


@pytest.mark.parametrize("fine", [3, 256])
def test_mix_by_brute_force(spark, fine, monkeypatch):
    monkeypatch.setattr(mixing, "FINE", fine)
    rng = random.Random(3)
    texts = [" ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(1.2) * 3))) if i % 17 else None for i in range(600)]
    source = lambda i: None if i % 11 == 0 else f"s{(i * i) % 7 if i % 2 else 0}"
    got = {r["doc_id"]: r for r in mixing.mix(frame(spark, texts, source)).collect()}
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    expected = naive_mix([(i, n, source(i)) for i, n in size.items()])
    for i, n in size.items():
        assert got[i]["size"] == n and got[i]["target"] == pytest.approx(expected[i][0])
        assert (got[i]["copies"], got[i]["taken"]) == (expected[i][1], expected[i][1] * n) or n == 0, i
    for s in {source(i) for i in size}:
        own = [i for i in size if source(i) == s]
        assert abs(sum(got[i]["taken"] for i in own) - got[own[0]]["target"]) <= max(2, 0.02 * got[own[0]]["target"])


def test_mix_repeats_and_unequal_probabilities(spark):
    df = frame(spark, ["a b c"] * 400).withColumn("w", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0))
    first, again = ({r["doc_id"]: r["taken"] for r in mixing.mix(df.repartition(n)).collect()} for n in (2, 5))
    assert first == again
    heavy = mixing.mix(df, weight_col="w").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in heavy}
    assert n[0] > 1.5 * n[1]
    # Without a column, of one source longer documents are likelier: by the binary digits of their size.
    rng = random.Random(8)
    docs = [(i, "w " * (4 if i % 2 else 60), "s" if i < 2000 else "t") for i in range(2400)] + [(9999, "w " * 90_000, "u")]
    rows = mixing.mix(spark.createDataFrame(rng.sample(docs, len(docs)), "doc_id long, text string, source string"), weights=(1, 1, 30)).where("source = 's'").collect()
    short, long = (np.mean([r["copies"] for r in rows if r["size"] == n]) for n in (4, 60))
    assert 0 < short < 1 and long / short == pytest.approx(6 / 3, rel=0.2)


def test_mix_goes_on_past_a_document_that_does_not_fit(spark):
    rng = random.Random(5)
    rows, words = [], 0
    for k in range(8):
        sizes = [rng.randint(5, 25) for _ in range(300)]
        sizes[rng.randrange(300)] = int(0.4 * sum(sizes))
        words += sum(sizes)
        rows += [(k * 1000 + i, "w " * n, f"b{k}") for i, n in enumerate(sizes)]
    rows.append((9000, "w " * (words // 2), "z"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1,) * 8 + (16,)).where("source <> 'z'").collect()
    for k in range(8):
        own = [r for r in got if r["source"] == f"b{k}"]
        gap = own[0]["target"] - sum(r["taken"] for r in own)
        # What is left of the gap holds no document that was not taken.
        assert gap < min(r["size"] for r in own if not r["copies"])
        assert abs(gap) <= 0.01 * own[0]["target"]


# Near-duplicates.


def shingles(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components_of(sets, threshold):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def copies(rng, n=260):
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ÀB", "Cd"]
    seeds = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 6, 30, 80)))] for _ in range(25)]
    out = []
    for _ in range(n):
        words = list(rng.choice(seeds))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(rng.choice((" ", "\n", "  ")).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words))
    return out


@pytest.mark.parametrize(("k", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, k, threshold):
    texts = copies(random.Random(5))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, texts), k, threshold).collect()}
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    expected = components_of(sets, threshold)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i for i, r in got.items() if r["kept"]} == {i for i, c in expected.items() if i == c}


def test_rows_that_share_an_id_but_not_their_text(spark):
    words = [f"w{i}" for i in range(30)]
    near = " ".join([*words[:-1], "x"])
    rows = [(5, " ".join(words)), (5, "other words here"), (7, near), (7, near), (3, "other words here"), (9, "alone"), (None, near), (9, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == Counter([(5, 28, 5, True), (7, 28, 5, False), (7, 28, 5, False), (5, 1, 3, False), (3, 1, 3, True), (9, 1, 9, True), (None, 28, None, True), (9, 0, 9, True)])


def test_blocks_of_a_large_band(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(minhash, "BLOCK", 20)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == components_of({i: shingles(t) for i, t in enumerate(texts)}, 85)


def test_registers_estimate():
    rng = np.random.default_rng(2)
    for j in (0.2, 0.5, 0.85, 1.0):
        n, errors = 1000, []
        for _ in range(20):
            both = int(2 * n * j / (1 + j))
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = minhash.registers(x[:n]), minhash.registers(x[n - both :])
            errors.append(minhash.estimate(a[None], b[None])[0] - j)
        assert abs(np.mean(errors)) < 0.03


# Personal data.

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base_of(text):
    out = []
    for k, (_, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (lambda: True, lambda: all(int(x) <= 255 for x in m[0].split(".")), lambda: 14 <= len(digits) <= 19 and luhn(digits), lambda: 10 <= len(digits) <= 15)[k]()  # noqa: B023
            out += [(m.start(), k, m.end())] if fine else []
    return sorted(out)


def noise(rng, pieces, n):
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_personal_data_by_brute_force(spark):
    rng = random.Random(4)
    texts = noise(rng, ["a@b.co", "@", ".", "+", "-", " ", "é😀", "x", "1.2.3.4", "256.1.1.1", "007", "4845168114407329", "4845-1681 1440 7329", "+1 (234) 567-8901", "+", "%", "\n", "0"], 300)
    texts += ["a" * 50_000 + "@", "1" * 50_000, "a@b.co+c@d.ef", "1.2.3.4.5.6.7.8.9"]
    for r in pii.detect(frame(spark, texts)).collect():
        base = [(s["start"], s["ord"], s["stop"]) for s in r["found"] if s["ord"] < pii.BASE]
        assert base == base_of(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_disclosure_by_brute_force(spark):
    """Pairs, their weight and the spans that follow, against loops over words."""
    rng = random.Random(21)
    people = [(f"Name{chr(97 + k)}", f"p{k}@mail.org") for k in range(6)]
    fill = "the and for that with from this have word text line page note time year".split()
    texts = []
    for _ in range(160):
        words = [rng.choice(fill) for _ in range(rng.randint(5, 40))]
        for name, mail in rng.sample(people, rng.randint(0, 2)):
            at = rng.randrange(len(words))
            words[at:at] = [name, rng.choice(fill), mail] if rng.random() < 0.8 else [mail]
            if rng.random() < 0.3:
                words.append(name)
        texts.append(" ".join(words))
    texts += texts[:5]
    term = re.compile(r"[^\W\d_]{3,}")
    seen, held, support = {}, Counter(), {}
    docs_of = Counter()
    for i, text in enumerate(texts):
        base = base_of(text)
        spots = [(m.start(), m.end(), m[0].lower()) for m in term.finditer(text)]
        held.update({w for _, _, w in spots})
        free = [s for s in spots if not any(s[0] < b and a < s[1] for a, _, b in base)]
        entities = set()
        for a, k, b in base:
            left = tuple(w for _, e, w in free if e <= a)[-pii.WINDOW :]
            right = tuple(w for s, _, w in free if s >= b)[: pii.WINDOW]
            entity = (k, text[a:b].lower())
            entities.add(entity)
            for w in {*left, *right}:
                seen.setdefault((entity, w), set()).add(i)
                support.setdefault((entity, w), set()).add((left, right))
        docs_of.update(entities)
    n, strong = len(texts), {}
    for (entity, w), c in seen.items():
        if len(c) >= pii.MIN_SUPPORT and len(support[entity, w]) >= pii.MIN_SUPPORT and docs_of[entity] < n:
            weight = math.log(len(c) * n / (held[w] * docs_of[entity])) / math.log(n / docs_of[entity])
            if weight >= pii.GENERALISE:
                strong[entity, w] = weight
    assert len(strong) >= 5
    for r in pii.detect(frame(spark, texts)).collect():
        text = texts[r["doc_id"]]
        base = base_of(text)
        own = {}
        for a, k, b in base:
            for (entity, w), weight in strong.items():
                if entity == (k, text[a:b].lower()):
                    own[w] = max(weight, own.get(w, 0))
        expected = sorted(base + [(m.start(), 5 if own[m[0].lower()] >= pii.REMOVE else 4, m.end()) for m in term.finditer(text) if m[0].lower() in own and not any(m.start() < b and a < m.end() for a, _, b in base)])
        assert [(s["start"], s["ord"], s["stop"]) for s in r["found"]] == expected


def test_terms_that_reveal(spark):
    fill = "the and of to in is on with for that".split()
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice(fill) for _ in range(12))
    texts = [f"{plain()} Zanzibarov {plain()[:9]} z@mail.com {plain()}" if i < 5 else f"{plain()} u{i}@mail.com {plain()}" for i in range(200)]
    texts += [f"rare{c} copied c@mail.com copied" for c in "a" * 50]
    rows = {r["doc_id"]: r for r in pii.sanitise(frame(spark, texts)).collect()}
    for i in range(5):
        added = [texts[i][s["start"] : s["stop"]] for s in rows[i]["found"] if s["ord"] >= pii.BASE]
        assert added == ["Zanzibarov"]
        assert "Zanzibarov" not in rows[i]["clean"] and "z@mail" not in rows[i]["clean"] and "<EMAIL>" in rows[i]["clean"]
    assert all(s["ord"] < pii.BASE for i, r in rows.items() if i >= 5 for s in r["found"])


def test_revealing_terms_go_wherever_they_stand(spark):
    rng = random.Random(9)
    plain = lambda n: " ".join(rng.choice("the and for that with from this have".split()) for _ in range(n))
    texts = [f"Zanzibarov {plain(30)} zanzibarov {plain(3)} z@mail.com {plain(30)} Zanzibarov" if i < 5 else f"{plain(20)} u{i}@mail.com {plain(9)}" for i in range(120)]
    for r in pii.sanitise(frame(spark, texts)).collect():
        added = [texts[r["doc_id"]][s["start"] : s["stop"]].lower() for s in r["found"] if s["ord"] >= pii.BASE]
        assert added == ["zanzibarov"] * (3 if r["doc_id"] < 5 else 0)
        assert "anzibarov" not in r["clean"]


def test_windows_of_terms_pass_over_other_matches(spark):
    long = "x" * 130
    texts = [f"card 4111111111111111, 12/26, Alice Smith {long} a@x.org, b@y.org +1 (234) 567-8901 Bob end"]
    df = frame(spark, texts).select("text", pii.base_spans(F.col("text")).alias("base"))
    got = {w["m"]["hit"]: (w["left"], w["right"]) for w in df.select(pii._windows(F.col("text"), F.col("base")).alias("w")).first()["w"]}
    words = ["card", "alice", "smith", long, "bob", "end"]
    assert got == {"4111111111111111": (words[:1], words[1:])} | {hit: (words[:4], words[4:]) for hit in ("a@x.org", "b@y.org", "+1 (234) 567-8901")}


def test_pii_query_digest(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.query(spark, data).collect():
        base = base_of(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]


# Secrets.


def test_secrets_by_brute_force(spark):
    rng = random.Random(8)
    texts = noise(rng, ["password", "PassWd", "api_key", "APIKEY", "token", "secret", "=", ":", " ", '"', "'", "abc", "DEADBEEF", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "ſecret", "toKen", "\n", "é"], 400)
    expected = {}
    for i, text in enumerate(texts):
        own = []
        for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
            own += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        own += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        expected[i] = sorted(own)
    for r in secrets.scan(frame(spark, texts)).collect():
        assert [(s["start"], s["ord"], s["stop"]) for s in r["found"] if s["ord"] < secrets.N_BASE] == expected[r["doc_id"]], texts[r["doc_id"]]


def test_trigram_queries():
    for rule in secrets.RULES:
        q = secrets.trigram_query(rule.pattern)
        assert (q is None) == (rule.kind == "hex")
    assert set(secrets.trigram_query("abcd(ef|gh)?x")) == {frozenset(x) for x in (("abc", "bcd", "cde", "def", "efx"), ("abc", "bcd", "cdx"), ("abc", "bcd", "cdg", "dgh", "ghx"))}
    assert secrets.trigram_query("a.c") is None


# Rules.


def test_rule_statistics_by_brute_force():
    rng = random.Random(12)
    texts = noise(rng, ["a", "b", "é", "# ", "| ", " ", "\n", "\t", "dup line here\n", "x y z "], 200) + [None, "", "\n \n"]
    for text, row in zip(texts, quality_rules.statistics(texts), strict=True):
        text = text or ""
        w = WORD.findall(text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, marked, lines, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            marked |= {i, i + 1, i + 2} if seen[x] > 1 else set()
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        assert row[:5].tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


def test_verdicts_by_brute_force(spark):
    """Each tree walked from its root, for each row by itself; the base rule; the threshold."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(120)]
    bad = [" ".join(word().upper() + "###" for _ in range(90)) for _ in range(20)] + ["x y z " * 40, "short", None, ""]
    forest, threshold = quality_rules.fit(good + bad, [1] * len(good) + [0] * len(bad))
    judged = frame(spark, good + bad).select("doc_id", quality_rules.judge(forest, threshold)("text").alias("j")).select("doc_id", "j.*").collect()
    kept = 0
    for r in judged:
        text = (good + bad)[r["doc_id"]]
        x = quality_rules.features(quality_rules.statistics([text]))[0]
        total = 0.0
        for feature, value, left, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(x[feature[at]] > value[at])
            total += path[at]
        anomaly = 2 ** (-total / len(forest.trees) / forest.expected(forest.size))
        assert r["anomaly"] == pytest.approx(anomaly)
        n = len(WORD.findall(text or ""))
        failed = n < 50 or 100 * r["n_repeat_words"] > 50 * n
        assert (r["n_words"], r["base_failed"], r["kept"]) == (n, failed, not failed and anomaly < threshold)
        kept += r["kept"] and r["doc_id"] < len(good)
    assert 0.8 * len(good) <= kept


def test_forest_paths_by_hand():
    """A tree of one split: two rows apart, a leaf each at depth 1; of equal rows, one leaf that counts the rows it holds."""
    f = quality_rules.Forest(np.array([[0.0], [1.0]]), trees=3)
    assert all(feature[0] == 0 and sorted(path[1:]) == [1, 1] for feature, _, _, path in f.trees)
    assert f.score(np.array([[0.0], [1.0]])).tolist() == [0.5, 0.5]
    same = quality_rules.Forest(np.zeros((4, 1)), trees=1)
    assert same.trees[0][3].tolist() == [pytest.approx(2 * (math.log(3) + 0.5772156649) - 2 * 3 / 4)]


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    f = quality_rules.Forest(x)
    assert f.score(np.array([[8.0, 8, 8]]))[0] > np.quantile(f.score(x), 0.99)


# Models, on labelled rows that weren't learnt from.


@pytest.fixture(scope="module")
def labelled():
    import zlib

    import duckdb

    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT doc_id, quality, toxic, text FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0
    return [r for r in rows if not held(r)], [r for r in rows if held(r)]


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y, bool)
    return float((score[y][:, None] > score[~y][None]).mean() + 0.5 * (score[y][:, None] == score[~y][None]).mean())


def naive_score(net, text):
    """The network's formulas, byte by byte, filter by filter."""
    half, filters = quality._HALF, quality.FILTERS
    n = max(1, -(-len(text) // half))
    data = text.ljust(n * half, b"\0")
    again = set()
    for h in range(n):
        seen = set()
        for i in range(half - quality.RUN + 1):
            run = data[h * half + i : h * half + i + quality.RUN]
            again |= {h * half + i} if run in seen else set()
            seen.add(run)
    symbol = [b + 256 * (i in again) for i, b in enumerate(data)] + [0] * quality.WIDTH
    sums = lambda at: sum(net.p["conv"][o][symbol[at + o]].astype(np.float64) for o in range(quality.WIDTH))
    tops = [np.max([sums(h * half + i) for i in range(0, half, quality.STRIDE)], axis=0) + net.p["bias"] for h in range(n)]
    chunks = [np.maximum(0, np.maximum(tops[h], tops[min(h + 1, n - 1)])) for h in range(n)]
    v = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    assert len(v) == 2 * filters
    hidden = np.maximum((v - net.mean) / net.scale @ net.p["w1"] + net.p["b1"], 0)
    return 1 / (1 + math.exp(-float((hidden @ net.p["w2"] + net.p["b2"])[0])))


def test_network_by_brute_force(monkeypatch):
    rng = random.Random(31)
    net = quality.Network(5)
    net.p["bias"] += np.linspace(-0.5, 0.5, quality.FILTERS).astype(np.float32)
    texts = ["", "a", "abc " * 100, "".join(rng.choice("abcdé \n|#") for _ in range(700)), "again and again " * 20, "x" * quality.CHUNK, "y\0z" * 60]
    raw = quality.encoded(texts)
    expected = [naive_score(net, t) for t in raw]
    assert net.score(raw) == pytest.approx(expected, rel=1e-4)
    monkeypatch.setattr(quality, "BLOCK", 2 * quality._HALF)
    assert net.score(raw) == pytest.approx(expected, rel=1e-4)


def test_gradient_by_differences():
    rng = random.Random(32)
    raw = quality.encoded(["".join(rng.choice("abcd efg") for _ in range(rng.randint(5, 400))) for _ in range(6)])
    y, weigh = np.array([1.0, 0, 1, 0, 1, 0]), np.linspace(0.5, 1.5, 6)
    net = quality.Network(4)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    net.p["bias"] += np.linspace(-0.31, 0.37, quality.FILTERS)  # off the kink at 0, where padding lies

    def loss():
        p = net._head(net._vectors(raw)[0])[2]
        return float(-(weigh * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    g = net._gradient(raw, y, weigh)
    for name, x in net.p.items():
        flat, own = x.reshape(-1), np.asarray(g[name]).reshape(-1)
        at = np.argsort(-np.abs(own))[:6]
        for i in at:
            before, step = flat[i], 1e-6
            flat[i] = before + step
            up = loss()
            flat[i] = before - step
            down = loss()
            flat[i] = before
            assert own[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4), (name, i)


def test_quality_on_held_out_rows(labelled):
    train, test = labelled
    bad, good = ([r for r in train if r[1] == v] for v in (0, 1))
    rows = sorted(bad[:400] + good[:800])
    net = quality.fit([r[3] for r in rows], [r[1] for r in rows])
    score, y = net.score(quality.encoded([r[3] for r in test])), np.array([r[1] for r in test])
    assert auc(score, y) > 0.97
    assert (score[y == 1] >= quality.THRESHOLD).mean() > 0.97


def test_toxicity_on_held_out_rows(labelled):
    train, test = labelled
    bad, good = ([r for r in train if r[2] == v] for v in (1, 0))
    rows = sorted(bad[:400] + good[:1200])
    model = toxicity.fit([r[3] for r in rows], [r[2] for r in rows])
    score, y = model.score([r[3] for r in test]), np.array([r[2] for r in test])
    assert auc(score, y) > 0.92
    assert (score[y == 1] >= toxicity.THRESHOLD).mean() > 0.7 and (score[y == 0] >= toxicity.THRESHOLD).mean() < 0.03


def test_distances_by_fresh_compressors():
    """A window's saving is the difference of two compressed lengths, each with its own dictionary and nothing kept from the window before."""
    import zstandard

    rng = random.Random(41)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7)))
    plain = [" ".join(word() for _ in range(80)) for _ in range(300)]
    toxic = [t.replace(" ", " zqxvile ", 2) for t in plain[150:]]
    model = toxicity.fit(plain[:150] + toxic, [0] * 150 + [1] * 150)
    assert b"zqxvile" in model.toxic and b"zqxvile" not in model.ordinary
    # Neither holds a dictionary's header or tables.
    assert not model.toxic.startswith(b"\x37\xa4\x30\xec") and toxicity._TABLES_END not in model.toxic + model.ordinary
    text = (plain[3] + " zqxvile " + plain[4]).encode()
    pieces = [text[i : i + toxicity.WINDOW] for i in range(0, len(text) - (toxicity.WINDOW - toxicity.STEP), toxicity.STEP)]
    expected = []
    for p in pieces:
        size = []
        for data in (model.ordinary, model.toxic + model.ordinary):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=toxicity.LEVEL)
            size.append(len(zstandard.ZstdCompressor(dict_data=d, level=toxicity.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress(p)))
        expected.append(size[0] - size[1])
    got = toxicity.Distance(model.ordinary, model.toxic)(pieces)
    assert got.tolist() == expected and max(expected) >= 3
    at = int(np.argmax(expected))
    assert b"zqxvile" in pieces[at]
    top = sorted(expected, reverse=True)
    assert toxicity.summary(got).tolist() == pytest.approx(
        [np.mean(expected), top[0], np.mean(top[:4]), *(np.mean([e >= least for e in expected]) for least in toxicity.LEASTS), *(math.log1p(sum(e >= least for e in expected)) for least in toxicity.LEASTS)])


def test_rules_on_held_out_rows(labelled):
    """Of rows that pass the base rule the forest rejects most bad ones and few good ones."""
    train, test = labelled
    rows = train[:2500]
    forest, threshold = quality_rules.fit([r[3] for r in rows], [r[1] for r in rows])
    stats, y = quality_rules.statistics([r[3] for r in test]), np.array([r[1] for r in test])
    passed = ~quality_rules.base_failed(stats)
    score, y = forest.score(quality_rules.features(stats[passed])), y[passed]
    assert (y == 0).sum() > 20 and auc(score, 1 - y) > 0.97
    assert (score[y == 0] >= threshold).mean() >= 0.8 and (score[y == 1] >= threshold).mean() <= 0.04


def test_threshold_by_both_labels():
    """Without bad rows that pass the base rule there is nothing to calibrate by; with some that lie apart all of them go."""
    words = lambda i, mark: " ".join(f"w{i * 7 + k * 13}{mark}" for k in range(60 + i % 17))
    good = [words(i, "") for i in range(200)]
    assert quality_rules.fit(good, [1] * 200) == (None, 2.0)
    assert quality_rules.fit([*good, "too short"], [1] * 200 + [0]) == (None, 2.0)
    forest, threshold = quality_rules.fit(good + [words(i, "###") for i in range(60)], [1] * 200 + [0] * 60)
    score = lambda texts: forest.score(quality_rules.features(quality_rules.statistics(texts)))
    assert (score([words(i, "###") for i in range(300, 340)]) >= threshold).mean() > 0.95
    assert (score([words(i, "") for i in range(300, 340)]) >= threshold).mean() < 0.1


def test_rules_learn_from_every_labelled_row(spark):
    """Good rows of a style that only rows beyond the first 2,000 of their label have, in the order of a hash of the id: once no model saw them, and most were rejected."""
    rng = random.Random(31)
    ids = [r["id"] for r in spark.range(3600).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64(F.lit(17), "id")).limit(2900).collect()]
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(60, 90)))
    style = {i: "bad" if k < 300 else "plain" if k < 2300 else "capitals" for k, i in enumerate(ids)}
    marked = lambda some: " ".join(word().upper() + "#" if k < some else word() for k in range(80))
    text = {"bad": lambda: marked(rng.randint(1, 40)), "plain": plain, "capitals": lambda: plain().upper()}
    docs = spark.createDataFrame([(i, text[s]()) for i, s in style.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(s != "bad")) for i, s in style.items()], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.apply(docs, labels).collect()}
    part = {s: np.mean([kept[i] for i in style if style[i] == s]) for s in text}
    assert part["capitals"] > 0.7 and part["plain"] > 0.9 and part["bad"] < 0.2


def test_all_labelled_rows_grow_or_calibrate_by_brute_force(spark, monkeypatch):
    """What is learnt from, how it is parted and dealt, trees that don't depend on the rows' order, and paths that count all rows."""
    import zlib

    rng = random.Random(32)
    names = quality_rules.BASE + quality_rules.EXTRA
    counted = [(i, *(rng.choice([20, 50, 80, 200]) if k == 0 else rng.randint(0, 60) for k in range(len(names)))) for i in range(900)]
    counted += [counted[5], (7, *counted[8][1:]), (None, *counted[9][1:])]
    known = [(i, rng.choice([0, 1, 1, 1, None])) for i in range(0, 1200)] + [(3, 1), (3, 0), (None, 1)]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in names)
    rows = quality_rules.labelled(spark.createDataFrame(counted, schema), spark.createDataFrame(known, "doc_id long, quality int")).cache()
    label = {(i, y) for i, y in known if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5}
    want = sorted({(c[0], y, *c[1:]) for c in counted for y in (0, 1) if (c[0], y) in label and c[1] >= 50 and 100 * c[5] <= 50 * c[1]})
    assert sorted(map(tuple, rows.collect())) == want
    grown, rest, size = quality_rules.parted(rows)
    one, two = (sorted(map(tuple, x.collect())) for x in (grown, rest))
    assert sorted(one + two) == want and not set(one) & set(two)
    good = sum(r[1] for r in one)
    assert size == pytest.approx(len(one), rel=0.2) and 0 < len(one) - good <= 0.05 * good + 3 and sum(r[1] for r in two) > 0
    for trees, subsample in ((8, 16), (8, 100), (4, 1000)):
        monkeypatch.setattr(quality_rules, "TREES", trees)
        monkeypatch.setattr(quality_rules, "SUBSAMPLE", subsample)
        dealt = [tuple(r) for r in quality_rules.dealt(grown, size).collect()]
        times = Counter(r[1:] for r in dealt)
        assert set(times) == {r[2:] for r in one} and len(dealt) == len(set(dealt)) and {r[0] for r in dealt} == set(range(trees))
        n = len(dealt) / trees
        assert n == len(one) / trees if subsample == 16 else n == len(one) if subsample == 1000 else 80 < n < 120
        forest = quality_rules.forest_of(quality_rules.dealt(grown, size), size)
        assert len(forest.trees) == trees and forest.size == round(n)
        for t, tree in enumerate(forest.trees):
            own = sorted((r[1:] for r in dealt if r[0] == t), reverse=True)
            again = quality_rules.Forest.grow(quality_rules.features(np.array(own)), forest.depth, np.random.default_rng([quality_rules.SEED, t]))
            assert all((a == b).all() for a, b in zip(tree, again, strict=True))


def test_threshold_by_brute_force(spark):
    rng = random.Random(33)
    for distinct, ranges in ((3, 1 << 14), (40, 5), (1000, 40)):
        rows = [(y := int(rng.random() < 0.7), min(rng.randint(0, distinct), rng.randint(0, distinct) + (y == 0) * distinct // 2) / distinct / 1.5) for _ in range(700)]
        at = sorted({s for _, s in rows})
        rate = lambda y, least: np.mean([s >= least for z, s in rows if z == y])
        for most in (0.0, 0.04, 0.5, 1.0):
            options = [((a + b) / 2, rate(1, b), rate(0, b)) for a, b in zip(at, at[1:])] + [(at[-1] + 1e-9, 0.0, 0.0)]
            best = max((round(found - false, 9), -t) for t, false, found in options if false <= most)
            with pytest.MonkeyPatch.context() as m:
                m.setattr(quality_rules, "RANGES", ranges)
                got = quality_rules.threshold_of(spark.createDataFrame(rows, "y int, anomaly double"), most)
            assert got == pytest.approx(-best[1])
    assert quality_rules.threshold_of(spark.createDataFrame([(0, 0.4), (1, 0.5)], "y int, anomaly double")) == pytest.approx(0.5 + 1e-9)


def test_windows_cover_the_text():
    for n in (0, 1, 63, 64, 95, 96, 97, 128, 1000):
        text = bytes(i % 251 for i in range(n))
        covered = set()
        for k, w in enumerate(toxicity.windows(text)):
            assert text[k * toxicity.STEP :].startswith(w)
            covered |= set(range(k * toxicity.STEP, k * toxicity.STEP + len(w)))
        assert covered == set(range(n))


# Tokens.

HARD = ["", None, " ", "  a  b", "<s> <0x41> \x00 x", "日本語 😀😀", "   \n\n  \t x", "a" * 500, "\n", "\nfoo", "ﬁ é", "a\r\n b", " " * 40 + "x" + " " * 17, "\n\n", " \n", "x \n y"]


@pytest.mark.parametrize("cache", [0, sentencepiece_codec.CACHE_BYTES])
def test_tokens_equal_the_library(cache, monkeypatch):
    import sentencepiece

    with open(sentencepiece_codec.MODEL, "rb") as f:
        data = f.read()
    codec, library = sentencepiece_codec.Codec(data, cache), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice(["the ", " ", "ing", "É", "\n", "x", "▁", "  ", ",", "😀", "12"]) for _ in range(60)) for _ in range(200)]
    whole = codec.model.tokenizer()
    for piece in (sentencepiece_codec.PIECE, 7):
        monkeypatch.setattr(sentencepiece_codec, "PIECE", piece)
        ids, bounds = codec.encode(texts)
        back = list(codec.decode(ids, bounds))
        for i, t in enumerate(texts):
            own = ids[bounds[i] : bounds[i + 1]].tolist()
            assert own == library.encode(t or "")
            assert back[i] == (t or "").replace("▁", " ")
            assert codec.differing(t or "", ids[bounds[i] : bounds[i + 1]]) == 0
        assert codec.differing("the quick", np.array(library.encode("the slow"), np.int32)) > 0
    assert whole.decode(library.encode("hello  world é")) == "hello  world é"
    assert whole.encode("the quick", add_special_tokens=False).ids == library.encode("the quick")


def test_all_documents_equal_the_library_and_decode(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tokens = sentencepiece_codec.encode(docs, audit_every=1)
    assert tokens.where("NOT audited OR differing > 0 OR NOT round_trip").count() == 0
    assert sentencepiece_codec.decode(tokens).exceptAll(docs.select("doc_id", "text")).count() == 0
    some = sentencepiece_codec.query(spark, data)
    assert 0 < some.where("audited").count() < docs.count() / 10


def test_every_text_is_held_against_the_library():
    """A cut that the library would encode in another way counts in each row that has it, chosen for the audit of whole texts or not."""
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    texts = HARD + ["the quick fox", "a fox, a fox\nfox", "none"]
    assert codec.compared(texts)[2].tolist() == [0] * len(texts)
    codec._forget()
    library = codec.reference
    other = lambda text: [*library.encode(text), *([0] if "fox" in text else [])]
    codec._reference = type("Other", (), {"encode": staticmethod(lambda x, num_threads: other(x) if isinstance(x, str) else [other(t) for t in x])})
    places = codec.compared(texts)[2].tolist()
    assert all(n > 0 for n, t in zip(places, texts) if t and "fox" in t) and places[-1] == places[2] == 0


# Long texts.


@pytest.mark.parametrize("piece", [7, 64])
def test_words_across_pieces_keep_their_numbers(piece, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", "É", " ", "\n", "d" * 11]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    whole = [bytewords.Words([t.encode() for t in texts[i : i + 5]], True) for i in range(0, 200, 5)]
    sets, stats = list(minhash.shingle_sets(texts, 5)), quality_rules.statistics(texts)
    for m in (bytewords, minhash, quality_rules):
        monkeypatch.setattr(m, "PIECE", piece)
    for i, w in zip(range(0, 200, 5), whole, strict=True):
        again = bytewords.Words([t.encode() for t in texts[i : i + 5]], True)
        assert (again.number == w.number).all() and (again.bounds == w.bounds).all() and (again.triples() == w.triples()).all()
    assert all((a == b).all() for a, b in zip(sets, minhash.shingle_sets(texts, 5), strict=True))
    assert (quality_rules.statistics(texts) == stats).all()


def test_a_text_of_50_mb_takes_bounded_memory():
    """Each reading of a long text in a process of its own, whose peak is compared with what it had before."""
    import subprocess
    import sys

    code = """
import resource, sys
from textquarry.llm import minhash, quality, quality_rules
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
text = " ".join(f"w{i * i % 100003}" for i in range(7_400_000))[:50_000_000]
{before}
before = peak()
{call}
print(peak() - before)
"""
    calls = {
        "minhash.registers(next(iter(minhash.shingle_sets([text]))))": 450,
        "quality_rules.statistics([text])": 600,
        "net.score([raw])": 200,
    }
    for call, most in calls.items():
        before = "net, raw = quality.Network(), text.encode()" if "net" in call else ""
        out = subprocess.run([sys.executable, "-c", code.replace("{before}", before).replace("{call}", call)], capture_output=True, text=True, check=True)
        assert float(out.stdout) < most, call


def test_personal_data_of_a_very_long_text(spark):
    """Neighbours are found, and mentions replaced, without looking at words one by one."""
    from textquarry.llm.spans import cut, piece, replaced

    head, tail = "lorem é ipsum dolor " * 150_000, "ok zz wort\U0001f600 " * 100_000
    text = head + "mailto a.b@c.orgé now +1 234 567 8901x " + tail
    df = spark.createDataFrame([(text,)], "text string").withColumn("base", pii.base_spans(F.col("text")))
    label = lambda s: F.lit("<HIT>")
    pieces = F.array(*(piece(cut(F.col("text")), F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in ((0, 3), (4095, 4097), (4096, 8192), (5, 5), (7, 3), (4000, 20_000))))
    r = df.select("base", pii._windows(F.col("text"), F.col("base")).alias("w"), F.sha2(replaced(F.col("text"), F.col("base"), label), 256).alias("sha"), pieces.alias("p")).first()
    assert [s["hit"] for s in r["base"]] == ["a.b@c.org", "+1 234 567 8901"]
    assert r["w"][0]["left"] == ["ipsum", "dolor", "lorem", "ipsum", "dolor", "lorem", "ipsum", "dolor", "mailto"][-8:]
    assert r["w"][0]["right"] == ["now"] + ["wort"] * 7 and r["w"][1]["left"][-2:] == ["mailto", "now"] and r["w"][1]["right"] == ["wort"] * 8
    want = text
    for s in reversed(r["base"]):
        want = want[: s["start"]] + "<HIT>" + want[s["stop"] :]
    assert r["sha"] == hashlib.sha256(want.encode()).hexdigest()
    assert r["p"] == [text[0:3], text[4095:4097], text[4096:8192], "", "", text[4000:20_000]]
