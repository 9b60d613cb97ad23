"""Annotation queries over ``documents`` (lexicon annotator) and model-output
strings derived from it plus ``events.props`` (free-text JSON payloads)."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.operators import annotate as an
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.sources.tables import read_table


def _list_sql(phrases) -> str:
    return S.str_list([p.lower().replace(" ", "  ") for p in dict.fromkeys(phrases)])


_NEG, _POS = presets.CODEBOOK_NEGATIVE, presets.CODEBOOK_POSITIVE
_PAD = S.padded_boundary("text")
_PREFIX = an.negation_prefix()
_SIDE = {"neg": f"(list_contains({_list_sql(_NEG)}, h.p) AND NOT h.n OR list_contains({_list_sql(_POS)}, h.p) AND h.n)",
         "pos": f"(list_contains({_list_sql(_POS)}, h.p) AND NOT h.n OR list_contains({_list_sql(_NEG)}, h.p) AND h.n)"}
_FIXED = f"list_contains({_list_sql(presets.CODEBOOK_FIXED)}, h.p)"


def _hits_sql(test: str) -> str:
    return f"len(list_filter(hits, lambda h: {test}))"


LEXICON_CTE = f"""
WITH lw AS (
  SELECT doc_id, text, {S.word_token_count('text')} AS words,
         list_distinct(regexp_extract_all(replace({_PAD}, ' ', '  '), {S.q(an.signal_pattern([*_NEG, *_POS, *presets.CODEBOOK_NEUTRAL]))})) AS f
  FROM documents
), lh AS (
  SELECT doc_id, text, words, list_transform(f, lambda x: {{'n': regexp_matches(x, {S.q('^ ' + _PREFIX)}),
         'p': trim(regexp_replace(x, {S.q('^ ' + _PREFIX)}, ''))}}) AS hits
  FROM lw
), lx0 AS (
  SELECT doc_id, text, words, {_hits_sql(_SIDE['neg'])} AS neg, {_hits_sql(_SIDE['pos'])} AS pos,
         {_hits_sql(f"list_contains({_list_sql(presets.CODEBOOK_NEUTRAL)}, h.p)")} AS neu,
         {_hits_sql(_SIDE['neg'] + ' AND h.n')} AS neg3, {_hits_sql(_SIDE['pos'] + ' AND h.n')} AS pos3,
         {_hits_sql(_SIDE['neg'] + ' AND ' + _FIXED)} AS neg6, {_hits_sql(_SIDE['pos'] + ' AND ' + _FIXED)} AS pos6
  FROM lh
), lx1 AS (
  SELECT *, (neg = 0 AND pos = 0) AS no_signal, (neg = 0 AND pos = 0 AND words < {presets.SHORT_COMMENT_WORDS}) AS short
  FROM lx0
), lex AS (
  SELECT doc_id, text,
    CASE WHEN short THEN 'UNCERTAIN' WHEN neg > pos THEN 'NEGATIVE' WHEN pos > neg THEN 'POSITIVE'
         ELSE 'NEUTRAL' END AS ai_label,
    CASE WHEN short THEN 'LOW' WHEN abs(neg - pos) >= 2 THEN 'HIGH' WHEN abs(neg - pos) = 1 THEN 'MEDIUM'
         WHEN no_signal AND neu > 0 THEN 'MEDIUM' ELSE 'LOW' END AS ai_confidence,
    printf('negative=%d positive=%d neutral=%d words=%d', neg, pos, neu, words) AS ai_rationale,
    CASE WHEN short THEN 'Rule 8: very short comment without signal'
         WHEN neg > pos AND neg3 > 0 OR pos > neg AND pos3 > 0 THEN 'Rule 3: negation'
         WHEN neg > pos AND neg6 > 0 OR pos > neg AND pos6 > 0 THEN 'Rule 6: term with fixed orientation'
         WHEN neg > pos THEN 'Rule 2: negative signals dominate'
         WHEN pos > neg THEN 'Rule 2: positive signals dominate'
         WHEN NOT no_signal THEN 'Rule 2: balanced mixed sentiment'
         WHEN neu > 0 THEN 'NEUTRAL definition: informational phrasing'
         ELSE 'NEUTRAL definition: no evaluative signal' END AS ai_rule_applied
  FROM lx1
)"""


def lexicon(spark, base):
    return an.lexicon_annotate(read_table(spark, base, "documents", spread_key="doc_id").select("doc_id", "text"))


@query("lexicon_annotate", LEXICON_CTE + " SELECT doc_id, ai_label, ai_confidence, ai_rationale, ai_rule_applied FROM lex")
def lexicon_annotate(spark, base):
    return lexicon(spark, base).select("doc_id", "ai_label", "ai_confidence", "ai_rationale", "ai_rule_applied")


def model_outputs(spark, base):
    """(src, id, raw): simulated annotator replies — JSON in a fenced block after a
    preamble, a refusal without JSON for UNCERTAIN rows — plus event payloads."""
    lx = lexicon(spark, base)
    js = F.concat(F.lit('Here is the classification:\n```json\n{"label": "'), F.col("ai_label"),
                  F.lit('", "confidence": "'), F.col("ai_confidence"), F.lit('", "rationale": "'),
                  F.col("ai_rationale"), F.lit('", "rule_applied": "'), F.col("ai_rule_applied"), F.lit('"}\n```'))
    refusal = F.concat(F.lit("I cannot classify this comment ("), F.col("ai_rationale"), F.lit(")."))
    docs = lx.select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"),
                     F.when(F.col("ai_label") == "UNCERTAIN", refusal).otherwise(js).alias("raw"))
    ev = read_table(spark, base, "events").select(F.lit("events").alias("src"), F.col("event_id").alias("id"),
                                                   F.col("props").alias("raw"))
    return docs.unionByName(ev)


_OUT_CTE = LEXICON_CTE + """,
outputs AS (
  SELECT 'documents' AS src, doc_id AS id,
         CASE WHEN ai_label = 'UNCERTAIN' THEN 'I cannot classify this comment (' || ai_rationale || ').'
              ELSE 'Here is the classification:' || chr(10) || '```json' || chr(10) || '{"label": "' || ai_label
                   || '", "confidence": "' || ai_confidence || '", "rationale": "' || ai_rationale
                   || '", "rule_applied": "' || ai_rule_applied || '"}' || chr(10) || '```' END AS raw
  FROM lex
  UNION ALL SELECT 'events', event_id, props FROM events
)"""

_TRIM = f"'^{S.WS}+|{S.WS}+$'"
_FAIL = presets.PARSE_FAILURE
_PARSED_CTE = _OUT_CTE + f""",
c1 AS (SELECT src, id, coalesce(raw, '') AS raw,
              regexp_extract(coalesce(raw, ''), '(?s)\\{{[^{{}}]*"label"[^{{}}]*\\}}', 0) AS found FROM outputs),
c2 AS (SELECT src, id, CASE WHEN found <> '' THEN found ELSE regexp_replace(raw, {_TRIM}, '', 'g') END AS c FROM c1),
c3 AS (SELECT src, id, regexp_replace(regexp_replace(c, '```json|```', '', 'g'), {_TRIM}, '', 'g') AS c FROM c2),
c4 AS (SELECT src, id, c, CASE WHEN json_valid(c) THEN json_type(c) = 'OBJECT' ELSE false END AS ok FROM c3),
parsed AS (
  SELECT src, id,
    CASE WHEN ok THEN json_extract_string(c, '$.label') ELSE {S.q(_FAIL[0])} END AS label,
    CASE WHEN ok THEN json_extract_string(c, '$.confidence') ELSE {S.q(_FAIL[1])} END AS confidence,
    CASE WHEN ok THEN json_extract_string(c, '$.rationale') ELSE {S.q(_FAIL[2])} END AS rationale,
    CASE WHEN ok THEN json_extract_string(c, '$.rule_applied') ELSE {S.q(_FAIL[3])} END AS rule_applied,
    ok AS parse_ok
  FROM c4
)"""


def parsed(spark, base):
    """Parsed annotator replies."""
    return an.parse_annotations(model_outputs(spark, base), "raw")


@query("parse_annotations", _PARSED_CTE + " SELECT * FROM parsed")
def parse_annotations(spark, base):
    return parsed(spark, base)


_REVIEW = ("(coalesce(label IN ('UNCERTAIN', 'ERROR'), false) OR coalesce(confidence = 'LOW', false))")
_CONFIRMED = ("(NOT coalesce(label IN ('UNCERTAIN', 'ERROR'), false) "
              "AND coalesce(confidence IN ('HIGH', 'MEDIUM'), false))")


@query("review_queue", _PARSED_CTE + f"""
SELECT src, id, label AS ai_label, confidence AS ai_confidence, '' AS human_label, '' AS human_notes
FROM parsed WHERE {_REVIEW}
""")
def review_queue(spark, base):
    p = parsed(spark, base).select("src", "id", F.col("label").alias("ai_label"),
                                   F.col("confidence").alias("ai_confidence"))
    return an.review_queue(p)


@query("confirmed_labels", _PARSED_CTE + f"""
SELECT src, id, label AS ai_label, confidence AS ai_confidence FROM parsed WHERE {_CONFIRMED}
""")
def confirmed_labels(spark, base):
    p = parsed(spark, base).select("src", "id", F.col("label").alias("ai_label"),
                                   F.col("confidence").alias("ai_confidence"))
    return an.confirmed_labels(p)


@query("label_counts", LEXICON_CTE + ", grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({S.q(x)})" for x in presets.AI_LABELS) + """) g(label))
SELECT g.label, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN (SELECT ai_label, count(*) AS n FROM lex GROUP BY ai_label) c ON g.label = c.ai_label
""")
def label_counts(spark, base):
    return an.label_counts(lexicon(spark, base), "ai_label", presets.AI_LABELS)


# Stand-in human labeller: the ``labels`` table's flags mapped to sentiment.
def human_label_expr():
    return (F.when(F.col("toxic") == 1, F.lit("NEGATIVE")).when(F.col("quality") == 1, F.lit("POSITIVE"))
             .otherwise(F.lit("NEUTRAL")))


_HUMAN_SQL = "CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END"


def _human(spark, base):
    return read_table(spark, base, "labels").select("doc_id", human_label_expr().alias("human_label"))


@query("adjudicate", LEXICON_CTE + f""",
h AS (SELECT doc_id, {_HUMAN_SQL} AS human_label FROM labels),
r AS (SELECT doc_id, ai_label AS label, ai_confidence AS confidence FROM lex)
SELECT doc_id, label AS ai_label, label AS final_label, 'ai' AS label_source FROM r WHERE {_CONFIRMED}
UNION ALL
SELECT r.doc_id, r.label, h.human_label, 'human' FROM r JOIN h ON r.doc_id = h.doc_id WHERE {_REVIEW}
""")
def adjudicate(spark, base):
    lx = lexicon(spark, base).select("doc_id", "ai_label", "ai_confidence")
    queue = an.review_queue(lx).drop("human_label").join(_human(spark, base), "doc_id", "left")
    return an.adjudicate(an.confirmed_labels(lx), queue, "doc_id")


@query("label_agreement", LEXICON_CTE + f"""
SELECT count(*) AS n_checked, count(*) FILTER (WHERE l.ai_label = h.human_label) AS n_agree,
       round(avg(CASE WHEN l.ai_label = h.human_label THEN 1.0 ELSE 0.0 END), 9) AS agreement_rate
FROM lex l JOIN (SELECT doc_id, {_HUMAN_SQL} AS human_label FROM labels) h ON l.doc_id = h.doc_id
""")
def label_agreement(spark, base):
    j = lexicon(spark, base).select("doc_id", "ai_label").join(_human(spark, base), "doc_id")
    a = an.agreement(j)
    return a.select("n_checked", "n_agree", F.round("agreement_rate", 9).alias("agreement_rate"))
