"""Evaluation queries: truth = ``documents.lang`` on the test split; predictions
come from two deterministic function-word classifiers built from native
expressions (stand-ins for trained models' prediction files)."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import evaluate as ev
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.plans.sampling_queries import DOC_LABELS, SPLIT_CTE, doc_split

# Marker words per label for the two stand-in classifiers (test parameters).
MODELS = {
    "function_words": {"de": ("der", "die", "und", "das", "ist"), "en": ("the", "and", "of", "to", "in"),
                       "es": ("el", "los", "las", "y", "que"), "fr": ("le", "la", "les", "des", "et")},
    "pair_words": {"de": ("der", "und"), "en": ("the", "and"), "es": ("el", "los"), "fr": ("le", "la")},
}
MODEL_NAMES = tuple(MODELS)


def _words(col: str):
    return F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}]+")


def marker_classifier(text_col: str, markers: dict[str, tuple[str, ...]]):
    """Label with the most marker-word hits; ties go to the first label in order."""
    w = _words(text_col)

    def hits(ws):
        arr = F.array(*[F.lit(x) for x in ws])
        return F.size(F.filter(w, lambda t: F.array_contains(arr, t)))

    counts = {lab: hits(ws) for lab, ws in markers.items()}
    best = F.greatest(*counts.values())
    expr = None
    for lab in reversed(list(markers)):
        expr = F.when(counts[lab] == best, F.lit(lab)) if expr is None else \
            F.when(counts[lab] == best, F.lit(lab)).otherwise(expr)
    return expr


def _marker_sql(markers: dict[str, tuple[str, ...]]) -> str:
    words = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+')"
    cnt = {lab: f"len(list_filter({words}, lambda t: list_contains({S.str_list(ws)}, t)))"
           for lab, ws in markers.items()}
    best = f"greatest({', '.join(cnt.values())})"
    whens = " ".join(f"WHEN {c} = {best} THEN {S.q(lab)}" for lab, c in cnt.items())
    return f"CASE {whens} END"


def test_predictions(spark, base):
    """Long predictions (doc_id, true_label, model, predicted_label) for the test split."""
    test = doc_split(spark, base, "text").filter(F.col("split") == "test")
    return ev.predictions_long(test, "doc_id", "lang",
                               {m: marker_classifier("text", mk) for m, mk in MODELS.items()})


_PRED_CTE = SPLIT_CTE + ", test AS (SELECT s.doc_id, s.lang, d.text FROM split s JOIN documents d " \
    "ON s.doc_id = d.doc_id WHERE s.split = 'test'), preds AS (" + " UNION ALL ".join(
        f"SELECT doc_id, lang AS true_label, {S.q(m)} AS model, {_marker_sql(mk)} AS predicted_label FROM test"
        for m, mk in MODELS.items()) + "), counts AS (SELECT model, true_label, predicted_label, count(*) AS n " \
    "FROM preds GROUP BY ALL)"

_LABELS_SQL = ", ".join(f"({S.q(x)})" for x in DOC_LABELS)
_PER_CLASS_CTE = _PRED_CTE + f""",
grid AS (SELECT m.model, l.label FROM (SELECT DISTINCT model FROM counts) m, (VALUES {_LABELS_SQL}) l(label)),
pc AS (
  SELECT g.model, g.label,
         coalesce((SELECT sum(n) FROM counts c WHERE c.model = g.model AND c.true_label = g.label
                   AND c.predicted_label = g.label), 0) AS tp,
         coalesce((SELECT sum(n) FROM counts c WHERE c.model = g.model AND c.true_label = g.label), 0) AS support,
         coalesce((SELECT sum(n) FROM counts c WHERE c.model = g.model AND c.predicted_label = g.label), 0)
           AS predicted
  FROM grid g
),
pcm AS (
  SELECT model, label, tp, support, predicted,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM pc
)"""


def _counts(spark, base):
    return ev.confusion_counts(test_predictions(spark, base))


@query("align_predictions", _PRED_CTE + """
SELECT doc_id, true_label, predicted_label FROM preds WHERE model = 'function_words'
""")
def align_predictions(spark, base):
    test = doc_split(spark, base, "text").filter(F.col("split") == "test")
    truth = test.select("doc_id", F.col("lang").alias("true_label"))
    preds = test.select("doc_id", marker_classifier("text", MODELS["function_words"]).alias("predicted_label"))
    return ev.align(truth, preds, "doc_id")


@query("aligned_predictions", _PRED_CTE + " SELECT doc_id, true_label, " + ", ".join(
    f"max(predicted_label) FILTER (WHERE model = {S.q(m)}) AS {m}" for m in MODEL_NAMES)
    + " FROM preds GROUP BY doc_id, true_label")
def aligned_predictions(spark, base):
    return ev.aligned_wide(test_predictions(spark, base), "doc_id", MODEL_NAMES)


@query("confusion_matrix", _PRED_CTE + f"""
, g AS (SELECT m.model, l.label AS true_label FROM (SELECT DISTINCT model FROM counts) m, (VALUES {_LABELS_SQL}) l(label))
SELECT g.model, g.true_label, """ + ", ".join(
    f"CAST(coalesce(sum(c.n) FILTER (WHERE c.predicted_label = {S.q(x)}), 0) AS BIGINT) AS {x}" for x in DOC_LABELS) + """
FROM g LEFT JOIN counts c ON g.model = c.model AND g.true_label = c.true_label GROUP BY g.model, g.true_label
""")
def confusion_matrix(spark, base):
    return ev.confusion_matrix(_counts(spark, base), DOC_LABELS)


def _r(c: str) -> str:
    return f"round({c}, 9) AS {c.split('.')[-1]}"


@query("classification_report", _PER_CLASS_CTE + f"""
SELECT model, label AS row, {_r('precision')}, {_r('recall')}, {_r('f1')}, CAST(support AS BIGINT) AS support
FROM pcm
UNION ALL
SELECT model, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pcm GROUP BY model
UNION ALL
SELECT model, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT)
FROM pcm GROUP BY model
UNION ALL
SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT)
FROM pcm GROUP BY model
""")
def classification_report(spark, base):
    r = ev.classification_report(_counts(spark, base), DOC_LABELS)
    return r.select("model", "row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))


_COMPARE_CTE = _PER_CLASS_CTE + """,
present AS (SELECT DISTINCT model, true_label AS label FROM counts
            UNION SELECT DISTINCT model, predicted_label FROM counts),
pres AS (
  SELECT pr.model, pr.label,
         coalesce((SELECT sum(n) FROM counts c WHERE c.model = pr.model AND c.true_label = pr.label
                   AND c.predicted_label = pr.label), 0) AS tp,
         coalesce((SELECT sum(n) FROM counts c WHERE c.model = pr.model AND c.true_label = pr.label), 0) AS support,
         coalesce((SELECT sum(n) FROM counts c WHERE c.model = pr.model AND c.predicted_label = pr.label), 0)
           AS predicted
  FROM present pr
),
macro AS (
  SELECT model, avg(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END) AS macro_f1
  FROM pres GROUP BY model
),
acc AS (
  SELECT model, sum(n) FILTER (WHERE true_label = predicted_label) / sum(n) AS accuracy FROM counts GROUP BY model
),
cmp AS (
  SELECT p.model, any_value(a.accuracy) AS accuracy, any_value(m.macro_f1) AS macro_f1, """ + \
    ", ".join(f"max(p.f1) FILTER (WHERE p.label = {S.q(x)}) AS f1_{x}" for x in DOC_LABELS) + """
  FROM pcm p JOIN acc a ON p.model = a.model JOIN macro m ON p.model = m.model GROUP BY p.model
)"""

_F1_COLS = [f"f1_{x}" for x in DOC_LABELS]


def _compare(spark, base):
    c = ev.compare_models(_counts(spark, base), DOC_LABELS)
    return c.select("model", *[F.round(x, 9).alias(x) for x in ["accuracy", "macro_f1", *_F1_COLS]])


@query("compare_models", _COMPARE_CTE + " SELECT model, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in ["accuracy", "macro_f1", *_F1_COLS]) + " FROM cmp")
def compare_models(spark, base):
    return _compare(spark, base)


@query("best_model", _COMPARE_CTE + """
SELECT model, round(macro_f1, 9) AS macro_f1 FROM cmp ORDER BY macro_f1 DESC, model LIMIT 1
""")
def best_model(spark, base):
    return ev.best_row(_compare(spark, base), "macro_f1", "model").select("model", "macro_f1")


@query("metrics_long", _COMPARE_CTE + """
SELECT model, 'accuracy' AS metric, round(accuracy, 9) AS score FROM cmp
UNION ALL SELECT model, 'macro_f1', round(macro_f1, 9) FROM cmp
""")
def metrics_long(spark, base):
    return ev.metrics_long(_compare(spark, base), "model", ["accuracy", "macro_f1"])


@query("class_metrics_long", _COMPARE_CTE + " " + " UNION ALL ".join(
    f"SELECT model, {S.q(x.upper())} AS class, round(f1_{x}, 9) AS f1 FROM cmp" for x in DOC_LABELS))
def class_metrics_long(spark, base):
    return ev.class_metrics_long(_compare(spark, base), "model")


# Second evaluation stand-in: the labels table, truth = quality, prediction = 1 - toxic.
BINARY_LABELS = ("0", "1")


@query("quality_report", """
WITH p AS (SELECT 'one_minus_toxic' AS model, CAST(quality AS VARCHAR) AS true_label,
                  CAST(1 - toxic AS VARCHAR) AS predicted_label FROM labels),
counts AS (SELECT model, true_label, predicted_label, count(*) AS n FROM p GROUP BY ALL),
grid AS (SELECT m.model, l.label FROM (SELECT DISTINCT model FROM counts) m, (VALUES ('0'), ('1')) l(label)),
pc AS (
  SELECT g.model, g.label,
    coalesce((SELECT sum(n) FROM counts c WHERE c.model = g.model AND c.true_label = g.label
              AND c.predicted_label = g.label), 0) AS tp,
    coalesce((SELECT sum(n) FROM counts c WHERE c.model = g.model AND c.true_label = g.label), 0) AS support,
    coalesce((SELECT sum(n) FROM counts c WHERE c.model = g.model AND c.predicted_label = g.label), 0) AS predicted
  FROM grid g
),
pcm AS (
  SELECT model, label, tp, support, predicted,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM pc
)
SELECT model, label AS row, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM pcm
UNION ALL
SELECT model, 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM pcm GROUP BY model
UNION ALL
SELECT model, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT)
FROM pcm GROUP BY model
UNION ALL
SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 9),
       round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
       CAST(sum(support) AS BIGINT)
FROM pcm GROUP BY model
""")
def quality_report(spark, base):
    from murmur.sources.tables import read_table
    lab = read_table(spark, base, "labels").select(
        F.lit("one_minus_toxic").alias("model"), F.col("quality").cast("string").alias("true_label"),
        (F.lit(1) - F.col("toxic")).cast("string").alias("predicted_label"))
    r = ev.classification_report(ev.confusion_counts(lab), BINARY_LABELS)
    return r.select("model", "row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")],
                    F.col("support").cast("long").alias("support"))
