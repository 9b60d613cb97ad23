"""Text normalisation queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import textops
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.sources.tables import read_table


def _docs(spark, base, *cols):
    return read_table(spark, base, "documents", spread_key="doc_id").select("doc_id", *cols)


@query("light_clean", f"SELECT doc_id, {S.light_clean('text')} AS light_clean FROM documents")
def light_clean(spark, base):
    return _docs(spark, base, "text").select("doc_id", tx.light_clean("text").alias("light_clean"))


@query("tokens", f"""
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)
""")
def tokens(spark, base):
    t = tx.tokens("text")
    return _docs(spark, base, "text").select("doc_id", F.size(t).cast("long").alias("n_tokens"),
                                             F.array_join(t, " ").alias("tokens"))


@query("preprocess", f"SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS text_clean FROM documents")
def preprocess(spark, base):
    return _docs(spark, base, "text").select("doc_id", tx.preprocess("text").alias("text_clean"))


@query("topic_tokens", f"""
SELECT doc_id, len(t) AS n_topic_tokens, array_to_string(t, ' ') AS topic_tokens
FROM (SELECT doc_id, {S.topic_tokens('text')} AS t FROM documents)
""")
def topic_tokens(spark, base):
    t = tx.topic_tokens("text")
    return _docs(spark, base, "text").select("doc_id", F.size(t).cast("long").alias("n_topic_tokens"),
                                             F.array_join(t, " ").alias("topic_tokens"))


@query("min_tokens", f"""
SELECT doc_id, len(t) AS n_topic_tokens
FROM (SELECT doc_id, {S.topic_tokens('text')} AS t FROM documents) WHERE len(t) >= 3
""")
def min_tokens(spark, base):
    d = _docs(spark, base, "text").withColumn("_t", tx.topic_tokens("text"))
    kept = textops.min_token_filter(d, "_t", 3)
    return kept.select("doc_id", F.size("_t").cast("long").alias("n_topic_tokens"))


_LEMMA_SQL = f"""
WITH toks AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
vocab AS (SELECT DISTINCT unnest(t) AS term FROM toks),
lemmas AS (
  SELECT v.term AS form, s.term AS lemma FROM vocab v JOIN vocab s ON v.term = s.term || 's'
  WHERE length(s.term) >= 2
),
ex AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM toks)
SELECT d.doc_id, coalesce(x.lemmas, '') AS lemmatised, coalesce(x.n_changed, 0) AS n_changed
FROM documents d LEFT JOIN (
  SELECT ex.doc_id, string_agg(coalesce(l.lemma, ex.tok), ' ' ORDER BY ex.pos) AS lemmas,
         count(l.lemma) AS n_changed
  FROM ex LEFT JOIN lemmas l ON ex.tok = l.form GROUP BY ex.doc_id
) x ON d.doc_id = x.doc_id
"""


@query("lemma_join", _LEMMA_SQL)
def lemma_join(spark, base):
    d = _docs(spark, base, "text").withColumn("_t", tx.tokens("text"))
    table = textops.plural_lemma_table(d, "_t", min_chars=2)
    out = textops.apply_lemmas(d, "doc_id", "_t", table)
    return out.select("doc_id", F.array_join("lemmatised", " ").alias("lemmatised"),
                      F.col("n_changed").cast("long").alias("n_changed"))


_THEME_COLS = {S.slug(k): v for k, v in presets.THEMES.items()}


@query("theme_flags", "SELECT doc_id, " + ", ".join(
    f"{S.theme_sql('text', p)} AS {c}" for c, p in _THEME_COLS.items()) + " FROM documents")
def theme_flags(spark, base):
    return _docs(spark, base, "text").select(
        "doc_id", *[tx.theme_flag("text", p).alias(c) for c, p in _THEME_COLS.items()])


_PREVIEW_SQL = f"substring(regexp_replace(coalesce(text, ''), '{S.WS}+', ' ', 'g'), 1, {presets.PREVIEW_CHARS})"


@query("comment_preview", f"""
SELECT doc_id, {_PREVIEW_SQL} AS comment_preview,
       concat_ws(' | ', CAST(doc_id AS VARCHAR), lang, {_PREVIEW_SQL}) AS comment_picker_label
FROM documents
""")
def comment_preview(spark, base):
    return _docs(spark, base, "lang", "text").select(
        "doc_id", tx.preview("text").alias("comment_preview"),
        tx.picker_label("doc_id", "lang", "text").alias("comment_picker_label"))


@query("ngrams", f"""
WITH t AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
g AS (
  SELECT doc_id, t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS b FROM t
)
SELECT doc_id, len(t) AS n_unigrams, len(b) AS n_bigrams, array_to_string(list_concat(t, b), '|') AS ngrams
FROM g
""")
def ngrams(spark, base):
    t = tx.tokens("text")
    d = _docs(spark, base, "text").select("doc_id", t.alias("_t"))
    return d.select("doc_id", F.size("_t").cast("long").alias("n_unigrams"),
                    F.size(tx.bigrams(F.col("_t"))).cast("long").alias("n_bigrams"),
                    F.array_join(tx.ngrams(F.col("_t"), 2), "|").alias("ngrams"))


_LOOKUP_SQL = f"""
WITH lab AS (SELECT doc_id, n_chars, lang, source, text,
                    concat_ws(' | ', CAST(doc_id AS VARCHAR), lang, {_PREVIEW_SQL}) AS label FROM documents),
target AS (SELECT label FROM lab ORDER BY n_chars DESC, doc_id DESC LIMIT 1)
SELECT doc_id, lang, source, n_chars, text FROM lab WHERE label = (SELECT label FROM target)
ORDER BY doc_id LIMIT 1
"""


def _picker_rows(spark, base):
    return _docs(spark, base, "n_chars", "lang", "source", "text").withColumn(
        "label", tx.picker_label("doc_id", "lang", "text"))


def _picked(rows):
    # The picker's current choice: the label of the longest comment.
    return rows.agg(F.max(F.struct("n_chars", "doc_id", "label")).getField("label").alias("label"))


@query("record_lookup", _LOOKUP_SQL)
def record_lookup(spark, base):
    d = _picker_rows(spark, base)
    return textops.lookup_first(d, "label", _picked(d), "doc_id").select("doc_id", "lang", "source", "n_chars", "text")


@query("record_lookup_stored", _LOOKUP_SQL)
def record_lookup_stored(spark, base):
    """The same look-up on a table in buckets by label: one bucket is read."""
    d = _picker_rows(spark, base)
    table = textops.store_for_lookup(d, "label", "doc_id")
    found = textops.lookup_stored(spark, table, "label", _picked(d).first()["label"], "doc_id")
    return found.select("doc_id", "lang", "source", "n_chars", "text")


# Words of the test items as keywords: those of six and more plain letters.
@query("benchmark_keyword_match", """
WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark),
lowered AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, coalesce(EXISTS (SELECT 1 FROM words WHERE contains(t, word)), false) AS keyword_match FROM lowered
""")
def benchmark_keyword_match(spark, base):
    words = read_table(spark, base, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"))).alias("word"))
    # One more than is allowed, so that a longer list raises without being read whole.
    keywords = [r["word"] for r in words.distinct().limit(tx.MAX_KEYWORDS + 1).collect()]
    docs = read_table(spark, base, "documents")
    return docs.select("doc_id", tx.many_keywords_match("text", keywords).alias("keyword_match"))
