"""Audit queries: raw = ``documents`` keyed by a content id (duplicated texts
share it), model corpus = documents with a row in ``labels``."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import audit
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.sources.tables import read_table

KW = presets.SELECTION_KEYWORDS


def content_id(col: str = "text"):
    return F.concat(F.lit("DOC_"), F.upper(F.substring(F.sha2(F.coalesce(F.col(col), F.lit("")), 256), 1, 16)))


def _raw(spark, base):
    return read_table(spark, base, "documents", spread_key="doc_id").select(
        "doc_id", "lang", "source", "n_chars", "text", content_id().alias("_doc_id"))


_RAW_CTE = f"""
WITH raw AS (
  SELECT doc_id, lang, source, n_chars, text,
         'DOC_' || upper(substring(sha256(coalesce(text, '')), 1, 16)) AS _doc_id FROM documents
)"""


_UNUSED_SQL = _RAW_CTE + f""",
model AS (SELECT DISTINCT r._doc_id FROM raw r JOIN labels l ON r.doc_id = l.doc_id),
elig AS (SELECT DISTINCT _doc_id FROM raw WHERE {S.kw_match('text', KW)}),
unused AS (SELECT * FROM raw WHERE _doc_id NOT IN (SELECT _doc_id FROM model)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY _doc_id ORDER BY doc_id) AS rn,
         count(*) OVER (PARTITION BY _doc_id) AS raw_occurrences FROM unused
)
SELECT _doc_id, doc_id, lang, source, n_chars, raw_occurrences,
       CASE WHEN NOT {S.non_blank('text')} THEN 'no_usable_comment_text'
            WHEN _doc_id IN (SELECT _doc_id FROM elig) THEN 'keyword_eligible_not_in_final_corpus'
            ELSE 'keyword_ineligible' END AS exclusion_reason
FROM ranked WHERE rn = 1
"""


@query("unused_audit", _UNUSED_SQL)
def unused_audit(spark, base):
    raw = _raw(spark, base)
    labelled = read_table(spark, base, "labels").select("doc_id", F.lit(True).alias("_labelled"))
    # Row-level flags; the model id set is "content ids of labelled rows", so the
    # per-key maximum of the row flag is exactly that membership.
    flagged = raw.join(labelled, "doc_id", "left").withColumns({
        "_in_model": F.coalesce(F.col("_labelled"), F.lit(False)),
        "_eligible": tx.keyword_match("text", KW)})
    out = audit.unused_audit_flags(flagged, columns=["lang", "source", "n_chars"])
    return out.select("_doc_id", "doc_id", "lang", "source", "n_chars",
                      F.col("raw_occurrences").cast("long").alias("raw_occurrences"), "exclusion_reason")


@query("unused_audit_join", _UNUSED_SQL)
def unused_audit_join(spark, base):
    """The same audit from separate id sets, through the joins of ``audit.unused_audit``."""
    raw = _raw(spark, base)
    labels = read_table(spark, base, "labels").select("doc_id")
    model = raw.join(labels, "doc_id", "left_semi").select("_doc_id")
    eligible = raw.filter(tx.keyword_match("text", KW)).select("_doc_id")
    out = audit.unused_audit(raw, model, eligible, columns=["lang", "source", "n_chars"])
    return out.select("_doc_id", "doc_id", "lang", "source", "n_chars",
                      F.col("raw_occurrences").cast("long").alias("raw_occurrences"), "exclusion_reason")


@query("dedup_first", _RAW_CTE + """
SELECT _doc_id, doc_id, lang, source, n_occurrences FROM (
  SELECT *, row_number() OVER (PARTITION BY _doc_id ORDER BY doc_id) AS rn,
         count(*) OVER (PARTITION BY _doc_id) AS n_occurrences FROM raw
) WHERE rn = 1
""")
def dedup_first(spark, base):
    d = audit.dedup_first(_raw(spark, base), "_doc_id", "doc_id", "n_occurrences", ["lang", "source"])
    return d.select("_doc_id", "doc_id", "lang", "source", F.col("n_occurrences").cast("long"))


@query("duplicate_keys", _RAW_CTE + " SELECT _doc_id, count(*) AS n FROM raw GROUP BY _doc_id HAVING count(*) > 1")
def duplicate_keys(spark, base):
    return audit.duplicate_keys(_raw(spark, base).select("_doc_id"), "_doc_id")
