"""Information-theoretic sanitisation of personal data, on DataFrame operations only.

Personal data that patterns find (addresses, numbers) are the protected
entities. Beside them stand terms that reveal them without being them: a name
that goes with one address gives the address away. Corpus co-occurrence says
how much. For a term t in the windows around the mentions of an entity e,

    disclosure(t, e) = PMI(t, e) / IC(e) = ln(c N / (n_t n_e)) / ln(N / n_e)

with c the documents in which t stands next to e, n_t and n_e the documents that
hold t and e, and N all documents; 1 says that t gives e away wholly (Sanchez,
Batet and Viejo, 2013). A term is generalised from GENERALISE on and removed
from REMOVE on, wherever it stands in a document that mentions that entity. Evidence needs MIN_SUPPORT
documents and as many different contexts, so that copies of one text prove nothing.

The counts cover all documents. Windows are bounded (WINDOW words on each side),
so the pairs of terms and entities grow with the mentions, never with the square
of a document or of a group.

Defined cases: a null text is empty and has no spans, but its row stays; rows
that repeat a doc_id and text give equal results and count as one document in c and
n_e; of spans that start together the kind that is listed first comes first; a text
of any length is one row, and only texts with personal data are split into words;
all columns are carried in ``row``, whatever they are called; an empty table gives
an empty result; without candidate pairs no term is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.arrays import let, running
from textquarry.llm.common import materialize, table
from textquarry.llm.spans import SPAN, count, cut, joined, no_spans, piece, render, replaced, spans

QUERY = "op4_pii"

#: Kinds in the order that breaks ties of starts; the last two are the method's.
KINDS = ["email", "ip", "card", "phone", "generalised", "removed"]
BASE = 4
#: Words on each side of a mention that may reveal it.
WINDOW = 8
MIN_SUPPORT = 3
GENERALISE = 0.6
REMOVE = 0.85
#: What may be a term: letters only, so that no part of a number or address is one.
TERM = r"\p{L}{3,}"

#: The same matches as the plain patterns below: a local part or number may start where a run starts or the last match ended, which spares one attempt at each character of a run.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """All valid emails, addresses, card and phone numbers of text, by start and kind."""
    email = spans(text, _EMAIL, 0, F.contains(text, F.lit("@")))
    ip = spans(text, _IP, 1, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    ip = F.filter(ip, lambda s: F.forall(F.split(s["hit"], r"\."), lambda part: part.cast("double") <= 255))
    card = spans(text, _CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"))
    card = F.filter(card, lambda s: F.length(_digits(s["hit"])).between(14, 19) & F.call_function("luhn_check", _digits(s["hit"])))
    phone = spans(text, _PHONE, 3, F.contains(text, F.lit("+")))
    phone = F.filter(phone, lambda s: F.length(_digits(s["hit"])).between(10, 15))
    return joined(email, ip, card, phone)


def _clear(found: Column) -> Column:
    """Sorted spans without the terms among them that meet a base span."""
    far = F.lit(2**62)
    is_base = lambda s: s["ord"] < BASE

    def kept(f: Column) -> Column:
        before = running(F.transform(f, lambda s: F.when(is_base(s), s["stop"]).otherwise(-1)), lambda a, x: F.greatest(a, x), F.lit(-1).cast("long"))
        after = running(F.transform(F.reverse(f), lambda s: F.when(is_base(s), s["start"]).otherwise(far)), lambda a, x: F.least(a, x), far.cast("long"))
        both = F.struct(f.alias("f"), before.alias("before"), F.reverse(after).alias("after"))
        return let(both, lambda b: F.filter(b["f"], lambda s, i: is_base(s) | ((F.get(b["before"], i) <= s["start"]) & (F.get(b["after"], i) >= s["stop"]))))

    return let(found, kept)


def _beginning(gap: Column) -> Column:
    """The first WINDOW terms of gap. Splitting ends behind the last of them, and what is left over is never looked at."""

    def of(parts: Column) -> Column:
        upto = F.when(F.size(parts) > WINDOW, F.length(gap) - F.length(F.element_at(parts, -1))).otherwise(F.length(gap))
        return F.transform(F.regexp_extract_all(F.substr(gap, F.lit(1), upto), F.lit(TERM), F.lit(0)), F.lower)

    return let(F.split(gap, TERM, WINDOW + 1), of)


def _windows(text: Column, base: Column) -> Column:
    """Each span of base as m, with the WINDOW terms before and after it. A term that meets a mention is none; those of other mentions are passed over.

    Only the gaps between mentions are looked at, and only their first and last WINDOW terms.
    """

    def around(b: Column) -> Column:
        # Each gap with a character of the mentions around it, so that letters which go on over its bounds show.
        between = F.transform(b["f"], lambda s, i: F.when(s["start"] <= F.get(b["upto"], i), "").when(F.get(b["upto"], i) == 0, F.concat(F.lit(" "), piece(b["c"], F.lit(0).cast("long"), s["start"] + 1))).otherwise(piece(b["c"], F.get(b["upto"], i) - 1, s["start"] + 1)))
        last = F.array_max(F.transform(b["f"], lambda s: s["stop"]))
        gaps = F.concat(between, F.array(F.concat(piece(b["c"], last - 1, b["n"]), F.lit(" "))))
        gaps = F.transform(gaps, lambda g: F.regexp_replace(g, r"^\p{L}+|\p{L}+\z", ""))
        ends = lambda g: F.struct(_beginning(g).alias("first"), F.reverse(F.transform(_beginning(F.reverse(g)), F.reverse)).alias("last"))

        def placed(e: Column) -> Column:
            count = lambda side: running(F.transform(e, lambda x: F.size(x[side]).cast("long")), lambda a, n: a + n, F.lit(0).cast("long"))
            sides = F.struct(F.flatten(F.transform(e, lambda x: x["first"])).alias("first"), F.flatten(F.transform(e, lambda x: x["last"])).alias("last"), count("first").alias("n_first"), count("last").alias("n_last"))

            def cut_out(w: Column) -> Column:
                def one(s: Column, i: Column) -> Column:
                    # Terms of the gaps up to the mention's own, which is the i-th.
                    before, behind = F.get(w["n_last"], i + 1).cast("int"), F.get(w["n_first"], i + 1).cast("int")
                    left = F.slice(w["last"], F.greatest(F.lit(1), before - WINDOW + 1), F.least(before, F.lit(WINDOW)))
                    return F.struct(s.alias("m"), left.alias("left"), F.slice(w["first"], behind + 1, F.lit(WINDOW)).alias("right"))

                return F.transform(b["f"], one)

            return let(sides, cut_out)

        return let(F.transform(gaps, ends), placed)

    upto = running(F.transform(base, lambda s: s["stop"]), lambda a, x: F.greatest(a, x), F.lit(0).cast("long"))
    both = F.struct(base.alias("f"), upto.alias("upto"), cut(text).alias("c"), F.length(text).cast("long").alias("n"))
    return F.when(F.size(base) > 0, let(both, around))


def _terms(found: DataFrame) -> DataFrame:
    """(doc_id, key, entity, context, term) for the terms around each mention."""
    mention = found.select("doc_id", "key", F.explode("windows").alias("w"))
    entity = F.when(F.col("w.m.ord") >= 2, _digits(F.col("w.m.hit"))).otherwise(F.lower("w.m.hit"))
    entity = F.concat_ws(":", F.col("w.m.ord").cast("string"), entity)
    context = F.xxhash64("w.left", F.lit(0), "w.right")
    return mention.select("doc_id", "key", entity.alias("entity"), context.alias("context"), F.explode(F.array_distinct(F.concat("w.left", "w.right"))).alias("term"))


def disclosing(keyed: DataFrame, terms: DataFrame) -> DataFrame | None:
    """(entity, term, disclosure) of the pairs at or over GENERALISE, or None if no pair has enough evidence to be weighed."""
    doc = F.struct("doc_id", "key")
    pairs = terms.groupBy("entity", "term").agg(F.count_distinct(doc).alias("c"), F.count_distinct("context").alias("support")).where((F.col("support") >= MIN_SUPPORT) & (F.col("c") >= MIN_SUPPORT))
    pairs = materialize(pairs, "pii-pairs")
    if pairs.isEmpty():
        return None
    n = keyed.count()
    entities = terms.groupBy("entity").agg(F.count_distinct(doc).alias("n_e"))
    held = keyed.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    # Counted before the join, whose rows would grow with terms times documents. A semi-join would be moved below the count.
    held = held.groupBy("term").agg(F.count("*").alias("n_t"))
    pmi = F.log(F.col("c") * F.lit(float(n)) / (F.col("n_t").cast("double") * F.col("n_e")))
    weighed = pairs.join(entities, "entity").join(held, "term").where(F.col("n_e") < n).withColumn("disclosure", pmi / F.log(F.lit(float(n)) / F.col("n_e")))
    return materialize(weighed.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"), "pii-disclosing")


def detect(documents: DataFrame) -> DataFrame:
    """doc_id, text, row (all columns of documents), found: all spans of each row of documents, base and added, by start and kind."""
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")).withColumn("key", F.xxhash64("doc_id", "text"))
    keyed = whole.drop("row")
    with_base = materialize(keyed.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0).withColumn("windows", _windows(F.col("text"), F.col("base"))).drop("text"), "pii-base")
    found = with_base.dropDuplicates(["doc_id", "key"])
    terms = materialize(_terms(found), "pii-mentions")
    pairs = disclosing(keyed, terms)
    spans_of = found.select("key", "doc_id", F.col("base").alias("found"))
    if pairs is None:
        spans_of = spans_of.withColumn("terms", F.array().cast("array<struct<term:string,ord:int>>"))
    else:
        place = F.when(F.col("disclosure") >= REMOVE, BASE + 1).otherwise(BASE)
        own = terms.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "entity").distinct().join(pairs, "entity").groupBy("_d", "_k", "term").agg(F.max("disclosure").alias("disclosure"))
        own = own.groupBy("_d", "_k").agg(F.collect_list(F.struct("term", place.alias("ord"))).alias("terms"))
        spans_of = spans_of.join(own, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").drop("_d", "_k")
    # Few documents hold personal data: the texts stay where they are, and the spans are sent to them while they are counted to be few.
    spans_of = materialize(spans_of.withColumnRenamed("doc_id", "_d"), "pii-spans")
    return _join_spans(whole, spans_of).select("doc_id", "text", "row", F.coalesce(_with_terms(F.col("text"), F.col("found"), F.col("terms")), no_spans()).alias("found"))


def _with_terms(text: Column, base: Column, terms: Column) -> Column:
    """base and all places of terms in text, by start and kind. An added span that meets a base span gives way."""

    def added(kinds: Column) -> Column:
        words = F.transform(spans(text, TERM, BASE, F.size(terms) > 0), lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, F.lower(s["hit"])).alias("ord"), s["stop"].alias("stop"), F.lit("").alias("hit")))
        return _clear(joined(base, F.filter(words, lambda s: s["ord"].isNotNull())))

    return F.when(F.size(terms) > 0, let(F.map_from_entries(terms), added)).otherwise(base)


#: Span and term lists are broadcast up to so many spans and terms, and shuffled beyond.
BROADCAST_SPANS = 100_000


def _join_spans(keyed: DataFrame, spans_of: DataFrame) -> DataFrame:
    lean = spans_of.withColumn("found", F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["stop"].alias("stop"), F.lit("").alias("hit"))))
    n = lean.agg(F.sum(F.size("found") + F.greatest(F.size("terms"), F.lit(0)) + 1)).first()[0] or 0
    right = F.broadcast(lean) if n <= BROADCAST_SPANS else lean
    return keyed.join(right, (keyed["key"] == right["key"]) & keyed["doc_id"].eqNullSafe(right["_d"]), "left").drop(right["key"])


def sanitise(documents: DataFrame) -> DataFrame:
    """doc_id, text, row, found, clean: the text with entities named by kind, revealing terms generalised or removed."""
    labels = F.array(*map(F.lit, ["<EMAIL>", "<IP>", "<CARD>", "<PHONE>", "<TERM>", ""]))
    out = detect(documents)
    return out.withColumn("clean", replaced(F.col("text"), F.col("found"), lambda s: F.get(labels, s["ord"])))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda s: s["ord"] < BASE)
    return detect(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count(found, i).alias(f"n_{KINDS[i]}") for i in range(BASE)), F.sha2(render(base, KINDS), 256).alias("base_sha256"), render(found, KINDS).alias("spans"),
        F.size(base).cast("long").alias("n_base"), (F.size(found) - F.size(base)).cast("long").alias("n_added"))


#: The base spans, the estimate with its windows, and the spans it adds are tested against brute-force versions.
ORACLE_SQL = None
