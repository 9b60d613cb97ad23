"""Relational topic queries. Topic stand-in: ``documents.source`` (cross-tabs)
and ``documents.lang`` (top words / overlap); topic distributions: softmax of
``embeddings`` vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.operators import topics as tp
from murmur.plans import sqlfrag as S
from murmur.plans.feature_queries import _SOFTMAX_CTE, doc_tokens, softmax_table
from murmur.plans.registry import query
from murmur.plans.sampling_queries import DOC_LABELS
from murmur.sources.tables import read_table

_VALS = list(DOC_LABELS)
_CT_SQL = "SELECT source AS topic, " + ", ".join(
    f"count(*) FILTER (WHERE lang = '{v}') AS {v}" for v in _VALS) + " FROM documents GROUP BY source"


def _ct(spark, base):
    d = read_table(spark, base, "documents").select(F.col("source").alias("topic"), "lang")
    return tp.crosstab(d, "topic", "lang", _VALS)


@query("topic_label_crosstab", _CT_SQL)
def topic_label_crosstab(spark, base):
    return _ct(spark, base)


@query("topic_label_percent", f"WITH ct AS ({_CT_SQL}) SELECT topic, " + ", ".join(
    f"round({v} * 100.0 / ({' + '.join(_VALS)}), 9) AS {v}" for v in _VALS) + " FROM ct")
def topic_label_percent(spark, base):
    p = tp.row_percentages(_ct(spark, base), "topic", _VALS)
    return p.select("topic", *[F.round(v, 9).alias(v) for v in _VALS])


@query("topic_prevalence", "SELECT source AS topic, count(*) AS n FROM documents GROUP BY source")
def topic_prevalence(spark, base):
    d = read_table(spark, base, "documents").select(F.col("source").alias("topic"))
    return tp.prevalence(d, "topic")


_NAME_CTE = f"""
WITH toks AS (SELECT source, {S.topic_tokens('text')} AS t FROM documents),
c AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest(t) AS term FROM toks) GROUP BY ALL),
r AS (SELECT source, term, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rank FROM c),
names AS (SELECT source AS topic, 'Topic ' || source || ': ' || string_agg(term, ', ' ORDER BY rank) AS topic_name
          FROM r WHERE rank <= 3 GROUP BY source)"""


@query("topic_names", _NAME_CTE + f", ct AS ({_CT_SQL}) SELECT ct.topic, names.topic_name, "
       + ", ".join(f"ct.{v}" for v in _VALS) + " FROM ct LEFT JOIN names ON ct.topic = names.topic")
def topic_names(spark, base):
    top = tp.top_terms(doc_tokens(spark, base, True, "source"), "source", "tokens", 3)
    names = (top.groupBy(F.col("source").alias("topic"))
                .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
                .select("topic", F.concat(F.lit("Topic "), F.col("topic"), F.lit(": "),
                                          F.array_join(F.transform("_t", lambda s: s.getField("term")), ", "))
                        .alias("topic_name")))
    return tp.name_topics(_ct(spark, base), names, "topic").select("topic", "topic_name", *_VALS)


@query("topic_overlap", f"""
WITH toks AS (SELECT lang, {S.topic_tokens('text')} AS t FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(t) AS term FROM toks) GROUP BY ALL),
r AS (SELECT lang, term FROM (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rk
                              FROM c) WHERE rk <= {presets.TOP_WORDS}),
s AS (SELECT lang, list(term) AS w FROM r GROUP BY lang),
p AS (SELECT a.lang AS topic_a, b.lang AS topic_b, list_sort(list_intersect(a.w, b.w)) AS sh
      FROM s a JOIN s b ON a.lang < b.lang)
SELECT topic_a, topic_b, len(sh) AS shared_word_count, array_to_string(sh, ', ') AS shared_words FROM p
""")
def topic_overlap(spark, base):
    top = tp.top_terms(doc_tokens(spark, base, True, "lang"), "lang", "tokens", presets.TOP_WORDS)
    o = tp.topic_overlap(top, "lang", "term")
    return o.select("topic_a", "topic_b", F.col("shared_word_count").cast("long"), "shared_words")


@query("representative_docs", _SOFTMAX_CTE + f"""
SELECT predicted_index AS dominant_topic, rank, vec_id, round(top_probability, 9) AS topic_probability FROM (
  SELECT *, row_number() OVER (PARTITION BY predicted_index ORDER BY top_probability DESC, vec_id) AS rank FROM soft
) WHERE rank <= {presets.REPRESENTATIVE_DOCS}
""")
def representative_docs(spark, base):
    s = softmax_table(spark, base).withColumnRenamed("predicted_index", "dominant_topic")
    r = tp.representative(s, "dominant_topic", "top_probability", "vec_id", presets.REPRESENTATIVE_DOCS)
    return r.select("dominant_topic", F.col("rank").cast("long"), "vec_id",
                    F.round("top_probability", 9).alias("topic_probability"))
