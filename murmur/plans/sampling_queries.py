"""Sampling, splitting and label-table queries (label stand-in: ``documents.lang``)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.operators import sampling as sm
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.sources.tables import read_table

# Closed label set of the stand-in label column, in output order.
DOC_LABELS = ("de", "en", "es", "fr")
SAMPLE_N = 100
SEED = presets.SEED

_RANK = f"md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id"


def _docs(spark, base, *cols):
    return read_table(spark, base, "documents").select("doc_id", *cols)


@query("exact_sample", f"""
SELECT doc_id, lang, sample_rank FROM (
  SELECT doc_id, lang, row_number() OVER (ORDER BY {_RANK}) AS sample_rank FROM documents
) WHERE sample_rank <= {SAMPLE_N}
""")
def exact_sample(spark, base):
    return sm.exact_sample(_docs(spark, base, "lang"), "doc_id", n=SAMPLE_N, seed=SEED)


def _split_sql(test_size: float = 0.30, second: float = 0.50) -> str:
    return f"""
WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_RANK}) AS r FROM documents),
cc AS (SELECT lang, count(*) AS n_c FROM documents GROUP BY lang),
a1 AS (SELECT lang, n_c, CAST(sum(n_c) OVER () AS BIGINT) AS tot FROM cc),
a2 AS (SELECT *, tot - CAST(ceil(CAST({test_size} AS DOUBLE) * CAST(tot AS DOUBLE)) AS BIGINT) AS draws FROM a1),
a3 AS (SELECT *, (draws * n_c) // tot AS base, (draws * n_c) % tot AS rem FROM a2),
a4 AS (SELECT *, draws - sum(base) OVER () AS need, row_number() OVER (ORDER BY rem DESC, lang) AS rr FROM a3),
b1 AS (SELECT lang, base + CASE WHEN rr <= need THEN 1 ELSE 0 END AS train_c, n_c FROM a4),
b2 AS (SELECT *, n_c - train_c AS tmp_c, CAST(sum(n_c - train_c) OVER () AS BIGINT) AS tt FROM b1),
b3 AS (SELECT *, tt - CAST(ceil(CAST({second} AS DOUBLE) * CAST(tt AS DOUBLE)) AS BIGINT) AS draws2 FROM b2),
b4 AS (SELECT *, CASE WHEN tt > 0 THEN (draws2 * tmp_c) // tt ELSE 0 END AS base2,
              CASE WHEN tt > 0 THEN (draws2 * tmp_c) % tt ELSE 0 END AS rem2 FROM b3),
b5 AS (SELECT *, draws2 - sum(base2) OVER () AS need2, row_number() OVER (ORDER BY rem2 DESC, lang) AS rr2 FROM b4),
quota AS (SELECT lang, train_c, base2 + CASE WHEN rr2 <= need2 THEN 1 ELSE 0 END AS val_c FROM b5),
split AS (
  SELECT d.doc_id, d.lang, CASE WHEN r <= train_c THEN 'train' WHEN r <= train_c + val_c THEN 'val'
                                ELSE 'test' END AS split
  FROM d JOIN quota q ON d.lang = q.lang
)"""


SPLIT_CTE = _split_sql()


def doc_split(spark, base, *cols):
    """``documents`` with the canonical 70/15/15 stratified split on ``lang``."""
    return sm.stratified_split(_docs(spark, base, "lang", *cols), "doc_id", "lang", SEED)


@query("stratified_split", SPLIT_CTE + " SELECT doc_id, lang, split FROM split")
def stratified_split(spark, base):
    return doc_split(spark, base).select("doc_id", "lang", "split")


@query("stratified_folds", f"""
SELECT doc_id, lang, CAST((row_number() OVER (PARTITION BY lang ORDER BY {_RANK}) - 1) % 10 AS INTEGER) AS fold
FROM documents
""")
def stratified_folds(spark, base):
    return sm.stratified_folds(_docs(spark, base, "lang"), "doc_id", "lang", k=10, seed=SEED).select(
        "doc_id", "lang", "fold")


@query("split_label_pivot", SPLIT_CTE + " SELECT split, " + ", ".join(
    f"count(*) FILTER (WHERE lang = '{v}') AS {v}" for v in DOC_LABELS) + " FROM split GROUP BY split")
def split_label_pivot(spark, base):
    s = doc_split(spark, base)
    # Explicit pivot values: no extra job to discover them, and absent labels give 0.
    return s.groupBy("split").pivot("lang", list(DOC_LABELS)).count().na.fill(0)


_TRIM_SQL = f"regexp_replace(coalesce(text, ''), '^{S.WS}+|{S.WS}+$', '', 'g')"


@query("clean_labelled", f"""
SELECT doc_id, lang AS label, {_TRIM_SQL} AS text_clean FROM documents
WHERE lang IN ({', '.join(S.q(v) for v in DOC_LABELS)}) AND {_TRIM_SQL} <> ''
""")
def clean_labelled(spark, base):
    d = _docs(spark, base, "lang", "text").filter(F.col("lang").isin(*DOC_LABELS))
    d = d.withColumn("text_clean", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""))
    d = d.observe("clean_labelled", F.count_if(F.col("text_clean") == "").alias("dropped_blank"))
    return d.filter(F.col("text_clean") != "").select("doc_id", F.col("lang").alias("label"), "text_clean")


@query("label_encode", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id FROM documents
""")
def label_encode(spark, base):
    d = _docs(spark, base, "lang")
    # Distinct labels form a closed, small table: rank it alone, broadcast it back.
    ids = d.select("lang").distinct().withColumn(
        "label_id", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int"))
    return d.join(F.broadcast(ids), "lang").select("doc_id", "lang", "label_id")


@query("class_weights", """
SELECT lang, count(*) AS n,
       round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(count(*)) OVER () * count(*)), 9) AS weight
FROM documents GROUP BY lang
""")
def class_weights(spark, base):
    from murmur.operators.evaluate import class_weights as cw
    return cw(_docs(spark, base, "lang"), "lang").select("lang", "n", F.round("weight", 9).alias("weight"))
