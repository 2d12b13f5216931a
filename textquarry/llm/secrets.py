"""Secret scans behind a trigram inverted index, on DataFrame operations only.

Each rule's regular expression is reduced to a Boolean query of trigrams, an OR
of ANDs of the strings that every match must hold (Cox, "Regular expression
matching with a trigram index", 2012). The index holds the postings of the
trigrams that some rule asks for, case folded. A rule's candidates are the
documents in which one of its branches finds all of its trigrams; only those
are matched against the rule. A rule without a mandatory trigram, such as a run
of hexadecimal digits, scans every text.

Defined cases: a null text is empty and has no spans; rows that repeat a
doc_id and text give equal results; of spans that start together the rule that is
listed first comes first; a text of any length is one row; an empty table gives an
empty result; no column but doc_id and text is read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import BROADCAST_ROWS, materialize, table
from textquarry.llm.spans import count, joined, render, spans

QUERY = "op5_secrets"


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java and RE2 share. value: the value's pattern, at the end of a hit. least: code points that the value must have at least."""

    kind: str
    pattern: str
    value: str | None = None
    least: int = 0


def any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + any_case("api") + "_?" + any_case("key")
_VALUE = "[A-Za-z0-9+/_.=-]+"

#: Base rules first; the order is that of kinds at equal starts.
RULES = (
    Rule("assign", rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?{_VALUE}""", _VALUE, 6),
    Rule("access", "AKIA[A-Z0-9]+", None, 20),
    Rule("hex", "[0-9a-f]+", None, 24),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", None, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", None, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", None, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
N_BASE = 3

#: Strings a set of literals may grow to before it is cut to what is known so far.
MAX_BRANCHES = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of case-folded trigrams that every match of pattern holds, or None if some match need hold none.

    The parsed pattern is walked for the exact strings of each part; runs of
    exact parts are multiplied out and give their trigrams, all else ends a run.
    """
    import re._constants as c
    import re._parser as parser

    def literals(item) -> set[str] | None:
        """The exact strings that one item matches, folded, if they are few."""
        op, arg = item
        if op is c.LITERAL:
            return {chr(arg).lower()}
        if op is c.IN and all(o is c.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is c.SUBPATTERN:
            return exact(arg[-1])
        if op is c.BRANCH:
            parts = [exact(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is c.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
            inner = exact(arg[2])
            return None if inner is None else inner | {""}
        return None

    def exact(seq) -> set[str] | None:
        out = {""}
        for item in seq:
            own = literals(item)
            if own is None or len(out) * len(own) > MAX_BRANCHES:
                return None
            out = {a + b for a, b in product(out, own)}
        return out

    runs, run = [], {""}
    for item in [*parser.parse(pattern), None]:
        own = literals(item) if item is not None else None
        if own is not None and len(run) * len(own) <= MAX_BRANCHES:
            run = {a + b for a, b in product(run, own)}
        else:
            runs.append(run)
            run = own or {""}
    best: list[frozenset[str]] = [frozenset()]
    for run in [*runs, run]:
        grams = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(grams) and len(best) * len(grams) <= MAX_BRANCHES:
            best = [a | b for a, b in product(best, grams)]
    best = sorted({b for b in best if not any(o < b for o in best)}, key=sorted)
    return None if frozenset() in best else best


def postings(keyed: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of the asked trigrams: (gram, key), one row for each trigram a text holds, sorted by gram."""
    folded = keyed.select("key", F.lower("text").alias("_t"))
    held = F.filter(F.array(*(F.when(F.contains("_t", F.lit(g)), F.lit(g)) for g in grams)), lambda g: g.isNotNull())
    return materialize(folded.select("key", F.explode(held).alias("gram")).sortWithinPartitions("gram"), "secret-postings")


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): the rules of which some branch has all its trigrams in the text's postings."""
    spark = index.sparkSession
    rows = [(r, b, g, len(branch)) for r, branches in queries.items() for b, branch in enumerate(branches) for g in sorted(branch)]
    wanted = spark.createDataFrame(rows, "rule int, branch int, gram string, least int")
    met = index.join(F.broadcast(wanted), "gram").groupBy("key", "rule", "branch").agg(F.count_distinct("gram").alias("n"), F.first("least").alias("least")).where("n = least")
    return materialize(met.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("rules")), "secret-candidates")


def _verified(text: Column, place: int, rule: Rule, where: Column) -> Column:
    found = spans(text, rule.pattern, place, where)
    if rule.least and rule.value is None:
        return F.filter(found, lambda s: F.length(s["hit"]) >= rule.least)
    if rule.least:
        # The value stands behind the first separator that is not in the key, with its blanks and quote.
        value = lambda s: F.regexp_replace(s["hit"], r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", "")
        return F.filter(found, lambda s: F.length(value(s)) >= rule.least)
    return found


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found (all spans of all rules, by start and kind), one row for each of documents."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    grams = sorted({g for q in queries.values() for b in q for g in b})
    picked = candidates(postings(keyed, grams), queries) if grams else keyed.sparkSession.createDataFrame([], "key long, rules array<int>")
    small = picked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = keyed.join(F.broadcast(picked) if small else picked, "key", "left")
    text = F.col("text")
    parts = []
    for i, rule in enumerate(rules):
        if i in queries:
            where = F.coalesce(F.array_contains("rules", F.lit(i)), F.lit(False))
        elif re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and rule.least:
            where = text.rlike(rule.pattern[:-1] + f"{{{rule.least}}}")
        else:
            where = F.lit(True)
        parts.append(_verified(text, i, rule, where))
    return keyed.select("doc_id", joined(*parts).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [r.kind for r in RULES]
    found = F.col("found")
    base = F.filter(found, lambda s: s["ord"] < N_BASE)
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(found, i).alias(f"n_{kinds[i]}") for i in range(N_BASE)),
        F.sha2(render(base, kinds), 256).alias("base_sha256"), render(found, kinds).alias("spans"))


def sql_spans(text: str, pattern: str, kind: str, place: int, keep: str) -> str:
    """DuckDB: rows (doc_id, s, o, x, hit) of one kind. keep: condition on hit."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, s, {place} AS o, '{kind}:' || s || ':' || (s + length(hit)) AS x, hit FROM (
    SELECT doc_id, hit, (CASE WHEN i > 1 THEN list_sum(list_transform(g[1:i], lambda z: length(z)))
                              + list_sum(list_transform(h[1:i-1], lambda z: length(z))) ELSE length(g[1]) END)::BIGINT AS s
    FROM (SELECT doc_id, g, h, unnest(h) AS hit, generate_subscripts(h, 1) AS i
          FROM (SELECT doc_id, string_split_regex({text}, '{p}') AS g, regexp_extract_all({text}, '{p}') AS h
                FROM documents WHERE regexp_matches({text}, '{p}'))))
  WHERE {keep}"""


def _oracle() -> str:
    def keep(r: Rule) -> str:
        if r.value:
            return r"""length(regexp_replace(hit, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?', '')) >= """ + str(r.least)
        return f"length(hit) >= {r.least}"

    rows = " UNION ALL ".join(sql_spans("text", r.pattern, r.kind, i, keep(r)) for i, r in enumerate(RULES))
    counts = ", ".join(f"count(x) FILTER (o = {i}) AS n_{r.kind}" for i, r in enumerate(RULES[:N_BASE]))
    return f"""
WITH m AS ({rows}),
a AS (SELECT doc_id, {counts}, coalesce(string_agg(x, ',' ORDER BY s, o) FILTER (o < {N_BASE}), '') AS base, string_agg(x, ',' ORDER BY s, o) AS spans FROM m GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES[:N_BASE])},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id"""


ORACLE_SQL = _oracle()
