"""Personal data: base patterns, and terms that disclose the found entities.

Base spans (email, ip, card, phone) come from fixed patterns, leftmost and not
overlapping within a kind; matches that fail the kind's test are dropped.
Positions are code points, taken from the lengths of the pieces between the
matches by prefix sums over blocks of the match list, so texts with very many
numbers stay far from quadratic work.

The words of the documents that mention an entity are judged by corpus
co-occurrence. With N documents, the entity e in n(e), the term t in n(t) and
both in n(t, e) of them, wherever in the text, the pointwise mutual
information PMI = log(n(t, e) N / (n(t) n(e))) is what t tells of e, and
IC = log(N / n(e)) all there is to tell. A term met with the entity in at
least ``SUPPORT`` documents with PMI / IC of at least ``GENERALISE`` is
generalised, at every occurrence outside base spans, in the texts that mention
the entity; with at least ``REMOVE`` it is removed.

Everything is DataFrame expressions. Entities of fewer than ``SUPPORT``
documents disclose nothing and are left out before documents' words meet their
entities. Counts are combined in the tasks before each shuffle, and documents
are told apart by a row number written with them, so copies of a text are no
hot key.

Defined results: null text is empty; a text without spans has the hash of the
empty string and ``""``; repeated rows are documents of their own; empty
tables give empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, written so that no run of characters is tried from more than one start (possessive, from a run's
# first character or from the end of the match before).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
WORD = r"[\p{L}\p{N}]+"
SUPPORT = 2
GENERALISE = 0.9
REMOVE = 1.0
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def _running(steps: Column) -> Column:
    """Running sums of an array of longs: inside blocks of ``BLOCK``, then over the blocks."""
    def of_blocks(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(s) / BLOCK).cast("int") - 1)
        sums = F.transform(blocks, lambda b: _total(F.slice(s, b * BLOCK + 1, F.lit(BLOCK))))
        return _let(sums, lambda t: F.flatten(F.transform(blocks, lambda b: _let(
            F.struct(_total(F.slice(t, F.lit(1), b)).alias("base"), F.slice(s, b * BLOCK + 1, F.lit(BLOCK)).alias("own")),
            lambda r: F.transform(r["own"], lambda _, i: r["base"] + _total(F.slice(r["own"], F.lit(1), i + 1)))))))
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(_let(steps, of_blocks))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(r: Column) -> Column:
        steps = F.zip_with(F.slice(r["pieces"], F.lit(1), F.size(r["found"])), r["found"],
                           lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        return _let(_running(steps), lambda ends: F.transform(r["found"], lambda m, i: F.struct(
            (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), m.alias("match"))))
    return _let(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("pieces")), of)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits pass the Luhn test: every second digit from the right doubled, digit sums added."""
    figures = F.filter(F.split(F.reverse(_digits(m)), ""), lambda c: c != "")
    points = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return _total(F.transform(points, lambda p: p.cast("long"))) % 10 == 0


def _kind_spans(text: Column, kind: str) -> Column:
    n = {"card": (14, 19), "phone": (10, 15)}
    test = {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m.rlike(IP_PARTS),
        "card": lambda m: F.length(_digits(m)).between(*n["card"]) & _luhn(m),
        "phone": lambda m: F.length(_digits(m)).between(*n["phone"]),
    }[kind]
    # Without these a text has no valid match of the kind.
    possible = {
        "email": text.contains("@"),
        "ip": text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){13}"),
        "phone": text.contains("+"),
    }[kind]
    good = F.filter(matches(text, PATTERNS[kind]), lambda s: test(s["match"]))
    spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"),
                                                 F.lit(kind).alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    empty = F.array().cast("array<struct<start: bigint, place: int, kind: string, end: bigint, match: string>>")
    return F.when(possible, spans).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans of a non-null text, by start and then as the kinds are listed."""
    return F.array_sort(F.concat(*[_kind_spans(text, k) for k in KINDS]))


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def analysed(docs: DataFrame, keep: list[str], text_col: str, with_text: bool = False) -> DataFrame:
    """Stored (row number, kept columns as ``row``, spans, text where it has spans or all text is wanted)."""
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    source = docs.select(F.struct(*[docs[f"`{c}`"] for c in (docs.columns if with_text else keep)]).alias("row"), text.alias("text"))
    source = source.withColumn("base", base_spans(F.col("text")))
    spans = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.concat(s["kind"], F.lit(":"), F.lower(s["match"])).alias("entity")))
    kept = F.col("text") if with_text else F.when(F.size("base") > 0, F.col("text"))
    return stored(source.select(F.monotonically_increasing_id().alias("rid"), "row", spans.alias("spans"), kept.alias("text")), "spans")


def term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n): the number of documents that hold each word, over all words of all documents."""
    words = _distinct_words(docs[f"`{text_col}`"].cast("string"))
    return docs.select(F.explode_outer(words).alias("term")).filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def mentioning(rows: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Stored (rid, text, entities) of the documents with an entity of at least ``support`` documents; the entities
    are distinct, each with its number of documents."""
    mentions = rows.filter(F.size("spans") > 0).select("rid", F.explode(F.array_distinct(F.col("spans.entity"))).alias("entity"))
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support)
    of_rows = mentions.join(entities, "entity").groupBy("rid").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    return stored(rows.select("rid", "text").join(of_rows, "rid"), "mentions")


def _entity_words(mentions: DataFrame) -> DataFrame:
    """(rid, entity, n_entity, term): a document's distinct words with each of its distinct entities."""
    words = mentions.select("rid", "entities", _distinct_words(F.col("text")).alias("words"))
    each = words.select("rid", "words", F.explode("entities").alias("e"))
    return (each.select("rid", "e.entity", "e.n_entity", F.explode_outer("words").alias("term"))
            .filter("term IS NOT NULL"))


def disclosing_terms(rows: DataFrame, mentions: DataFrame, docs: DataFrame, text_col: str, generalise: float = GENERALISE,
                     support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure): the terms of an entity's documents that tell at least ``generalise`` of it."""
    both = (_entity_words(mentions).groupBy("entity", "n_entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
            .filter(F.col("n_both") >= support))
    total = rows.agg(F.count(F.lit(1)).alias("n_all"))
    # total is one row
    out = both.join(term_counts(docs, text_col), "term").crossJoin(F.broadcast(total))
    known = F.log(F.col("n_all") / F.col("n_entity"))
    told = F.log(F.col("n_both") * F.col("n_all") / (F.col("n_term") * F.col("n_entity").cast("double")))
    disclosure = F.when(known > 0, told / known)
    return out.withColumn("disclosure", disclosure).filter(F.col("disclosure") >= generalise - 1e-9).select("entity", "term", "disclosure")


def with_terms(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``terms``: all occurrences of terms that disclose an entity of the document, without those that
    overlap a base span, with their disclosure."""
    mentions = mentioning(rows)
    terms = disclosing_terms(rows, mentions, docs, text_col)
    told = (_entity_words(mentions).join(terms, ["entity", "term"])
            .groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure")))
    words = (mentions.select("rid", F.explode_outer(matches(F.col("text"), WORD)).alias("w"))
             .select("rid", F.lower("w.match").alias("term"), "w.start", "w.end").filter("term IS NOT NULL"))
    found = (words.join(told, ["rid", "term"])
             .groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")))
    free = F.filter("terms", lambda t: ~F.exists("spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    none = F.array().cast("array<struct<start: bigint, end: bigint, disclosure: double>>")
    return rows.join(found, "rid", "left").withColumn("terms", F.coalesce(free, none))


def _labels(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of base spans by kind, the hash of their list, and all spans."""
    rows = analysed(docs, [key_col], text_col)
    out = with_terms(rows, docs, text_col)
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.transform("terms", lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS)).alias("place"), F.lit("term").alias("kind"), t["end"].alias("end")))
    counts = [_count_of(k).alias(f"n_{k}") for k in KINDS]
    return out.select(F.col(f"row.`{key_col}`").alias("doc_id"), *counts,
                      F.sha2(_labels(base), 256).alias("base_sha256"),
                      _labels(F.array_sort(F.concat(base, terms))).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", remove: float = REMOVE) -> DataFrame:
    """``docs`` with personal data replaced by its kind, disclosing terms by what they are (a name, a number, a
    word), and terms of disclosure ``remove`` or more left out. Texts without spans stay as they are."""
    rows = analysed(docs, [], text_col, with_text=True)
    out = with_terms(rows, docs, text_col)
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    text = F.col("text")

    def put(t: Column) -> Column:
        word = F.substring(text, (t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int"))
        return F.when(t["disclosure"] >= remove - 1e-9, "").when(word.rlike("[0-9]"), "[NUMBER]").when(
            word.rlike("^\\p{Lu}"), "[NAME]").otherwise("[WORD]")

    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), put(t).alias("put")))
    every = F.array_sort(F.concat(base, terms))
    # Of overlapping spans of different kinds the first one is replaced and what it does not cover of the next one too.
    done = F.aggregate(every, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s["put"]))
        .otherwise(a["out"]).alias("out")))
    new = F.when(F.size(every) == 0, F.col(f"row.`{text_col}`")).otherwise(_let(done, lambda d: F.concat(d["out"], F.substring(text, (d["at"] + 1).cast("int"), F.length(text)))))
    return out.select(*[(new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
