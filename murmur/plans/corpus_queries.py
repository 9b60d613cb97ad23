"""Corpus construction queries: eligibility, funnel, manifest, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import eligibility as el
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.session import scratch_dir
from murmur.sources.tables import read_table

KW = presets.SELECTION_KEYWORDS
# A second, test keyword list that actually occurs in the synthetic corpora,
# including one keyword with a regex metacharacter (matching is literal).
TEST_KEYWORDS = ("license", "gag", "the ", "(c)", "cyber security act no. 3")

_ELIG_SQL = f"""
WITH valid AS (
  SELECT conv_id, turn, text FROM conversations WHERE {S.non_blank('text')}
), parents AS (
  SELECT conv_id, {S.kw_match('text', KW)} AS pm FROM valid WHERE turn = 0
), comments AS (
  SELECT v.conv_id, v.turn, v.text, coalesce(p.pm, false) AS pm
  FROM valid v LEFT JOIN parents p ON v.conv_id = p.conv_id WHERE v.turn >= 1
), flags AS (
  SELECT conv_id, turn, {S.kw_match('text', KW)} AS comment_keyword_match,
         pm AS post_title_keyword_match, {S.substantive('text')} AS substantive_comment
  FROM comments
)
SELECT conv_id, turn, comment_keyword_match, post_title_keyword_match, substantive_comment,
       comment_keyword_match OR (post_title_keyword_match AND substantive_comment) AS keyword_eligible,
       CASE WHEN comment_keyword_match THEN 'comment'
            WHEN post_title_keyword_match AND substantive_comment THEN 'post_title_context'
            ELSE '' END AS keyword_match_source
FROM flags
"""


@query("keyword_eligibility", _ELIG_SQL)
def keyword_eligibility(spark, base):
    return el.keyword_eligibility(read_table(spark, base, "conversations", spread_key=["conv_id", "turn"]), KW)


@query("keyword_match", f"""
SELECT doc_id, {S.kw_match('text', TEST_KEYWORDS)} AS test_keyword_match,
       {S.kw_match('text', KW)} AS preset_keyword_match,
       {S.kw_match('text', presets.ANNOTATION_KEYWORDS)} AS annotation_keyword_match
FROM documents
""")
def keyword_match(spark, base):
    d = read_table(spark, base, "documents", spread_key="doc_id")
    return d.select("doc_id", tx.keyword_match("text", TEST_KEYWORDS).alias("test_keyword_match"),
                    tx.keyword_match("text", KW).alias("preset_keyword_match"),
                    tx.keyword_match("text", presets.ANNOTATION_KEYWORDS).alias("annotation_keyword_match"))


@query("substantive", f"""
SELECT doc_id, {S.word_token_count('text')} AS word_tokens, {S.substantive('text')} AS substantive_comment
FROM documents
""")
def substantive(spark, base):
    d = read_table(spark, base, "documents", spread_key="doc_id")
    return d.select("doc_id", tx.word_token_count("text").cast("long").alias("word_tokens"),
                    tx.substantive("text").alias("substantive_comment"))


@query("valid_comments", f"""
SELECT conv_id, turn, {S.non_blank('text')} AS valid_comment FROM conversations
""")
def valid_comments(spark, base):
    c = read_table(spark, base, "conversations", spread_key=["conv_id", "turn"]).select("conv_id", "turn", "text")
    return el.valid_comments(c, keep_flag=True).select("conv_id", "turn", "valid_comment")


_KEY_SQL = ("sha256(concat_ws('||', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), "
            "coalesce(lang, ''), '', coalesce(text, '')))")


@query("record_key", f"""
SELECT doc_id, {_KEY_SQL} AS _record_key, 'DOC_' || upper(substring({_KEY_SQL}, 1, 16)) AS _doc_id
FROM documents
""")
def record_key(spark, base):
    from murmur.operators.ingest import add_record_key
    d = read_table(spark, base, "documents", spread_key="doc_id")
    # Natural-key parts: id, source url, page url, date (absent -> ''), text.
    keyed = add_record_key(d, parts=[F.col("doc_id"), "source", "lang", "date", "text"])
    return keyed.select("doc_id", "_record_key", "_doc_id")


_ANON_SALT = "murmur-anon"


@query("anonymise", f"""
SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
       sha256({S.q(_ANON_SALT)} || coalesce(c_name, '')) AS anon_profile_hash,
       'ANON_' || upper(substring(sha256(CAST(c_custkey AS VARCHAR)), 1, 8)) AS anon_commenter_id
FROM customer
""")
def anonymise(spark, base):
    from murmur.operators.ingest import anonymise as anon
    c = read_table(spark, base, "customer").withColumn("_doc_id", F.sha2(F.col("c_custkey").cast("string"), 256))
    out = anon(c, "_doc_id", pii=("c_name",), profile_col="c_name", salt=_ANON_SALT)
    return out.drop("_doc_id")


@query("merge_sources", """
WITH d AS (
  SELECT 'documents' AS _dataset_name, CAST(doc_id AS VARCHAR) AS _source_key, text, lang, source, NULL AS role
  FROM documents
), c AS (
  SELECT 'conversations' AS _dataset_name, concat_ws('||', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS _source_key,
         text, NULL AS lang, NULL AS source, role FROM conversations
), b AS (
  SELECT 'benchmark' AS _dataset_name, CAST(item_id AS VARCHAR) AS _source_key, text,
         NULL AS lang, NULL AS source, NULL AS role FROM benchmark
), u AS (SELECT * FROM d UNION ALL SELECT * FROM c UNION ALL SELECT * FROM b)
SELECT _dataset_name, sha256(_dataset_name || '||' || _source_key) AS _doc_id, _source_key, text, lang, source, role
FROM u
""")
def merge_sources(spark, base):
    from murmur.operators.ingest import merge_sources as merge
    merged = merge({"documents": read_table(spark, base, "documents"),
                    "conversations": read_table(spark, base, "conversations", spread_key=["conv_id", "turn"]),
                    "benchmark": read_table(spark, base, "benchmark")},
                   {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "benchmark": ["item_id"]})
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("item_id").cast("string"),
                     F.concat_ws("||", "conv_id", "turn"))
    return merged.select("_dataset_name", "_doc_id", key.alias("_source_key"), "text", "lang", "source", "role")


# Sample share of the eligible comments used by the funnel and the manifest.
SELECT_FRACTION = 0.5


def _eligible_comments(spark, base):
    """Every comment row with its text, validity and eligibility flags."""
    conv = read_table(spark, base, "conversations", spread_key=["conv_id", "turn"]).select("conv_id", "turn", "text")
    comments = el.comments_with_parent_flag(conv, KW)
    flagged = el.add_keyword_flags(comments, title_col=None, keywords=KW, title_flag_col="_parent_match")
    flagged = flagged.withColumns({"valid_record": F.lit(True), "non_empty_valid": tx.non_blank("text")})
    return flagged.withColumn("_id", F.concat_ws(":", "conv_id", "turn"))


def _flagged_comments(spark, base):
    """The eligible comments' flags plus ``selected``: an exact share of the valid eligible ones."""
    from murmur.operators import sampling as sm
    # Stored, so that the cut's three looks at the ids and the rows themselves do not each test every keyword again.
    path = scratch_dir(spark, "eligibility-flags")
    _eligible_comments(spark, base).write.parquet(path)
    flagged = spark.read.parquet(path).withColumn("_stratum", F.col("non_empty_valid") & F.col("keyword_eligible"))
    eligible = flagged.filter("_stratum").select("_id")
    want = eligible.agg(F.floor(F.lit(SELECT_FRACTION) * F.count(F.lit(1))).cast("long").alias("_want"))
    cut = sm.rank_cuts(eligible, "_id", [], want, ["_want"]).select("cut__want")
    flagged = sm.with_cuts(flagged, [], cut, 1)
    return flagged.withColumn("selected", F.col("_stratum") & sm.not_after("_id", "cut__want")).drop("cut__want", "_stratum")


_FUNNEL_CTE = f"""
WITH conv AS (SELECT conv_id, turn, text FROM conversations),
parents AS (SELECT conv_id, {S.kw_match('text', KW)} AS pm FROM conv WHERE turn = 0),
c AS (
  SELECT v.conv_id, v.turn, {S.non_blank('v.text')} AS ne,
         {S.kw_match('v.text', KW)} OR (coalesce(p.pm, false) AND {S.substantive('v.text')}) AS el
  FROM conv v LEFT JOIN parents p ON v.conv_id = p.conv_id WHERE v.turn >= 1
), n AS (
  SELECT count(*) AS raw_records, count(*) AS valid_records, count(*) FILTER (WHERE ne) AS non_empty_valid,
         count(*) FILTER (WHERE ne AND el) AS keyword_eligible,
         count(*) FILTER (WHERE ne AND NOT el) AS keyword_ineligible,
         CAST(floor({SELECT_FRACTION} * count(*) FILTER (WHERE ne AND el)) AS BIGINT) AS selected
  FROM c
)"""


@query("corpus_funnel", _FUNNEL_CTE + """
SELECT CAST(stage_order AS INTEGER) AS stage_order, stage, n,
       round(n * 100.0 / nullif(raw_records, 0), 6) AS pct_of_raw
FROM n, (VALUES (0, 'raw_records'), (1, 'valid_records'), (2, 'non_empty_valid'), (3, 'keyword_eligible'),
                (4, 'keyword_ineligible'), (5, 'selected')) s(stage_order, stage),
     LATERAL (SELECT CASE stage WHEN 'raw_records' THEN raw_records WHEN 'valid_records' THEN valid_records
                  WHEN 'non_empty_valid' THEN non_empty_valid WHEN 'keyword_eligible' THEN keyword_eligible
                  WHEN 'keyword_ineligible' THEN keyword_ineligible ELSE selected END AS n) v
""")
def corpus_funnel(spark, base):
    return el.funnel_long(el.funnel_counts(_eligible_comments(spark, base), SELECT_FRACTION))


_RULE = ("Simple random sample without replacement from keyword-eligible comments: "
         "the first floor(fraction * eligible) rows in md5('<seed>:<id>') order.")


@query("selection_manifest", _FUNNEL_CTE + f"""
SELECT CAST({SELECT_FRACTION} AS DOUBLE) AS sample_fraction, {presets.SEED} AS random_seed, {len(KW)} AS keyword_count,
       raw_records, valid_records AS valid_raw_records_excluding_scraper_errors,
       non_empty_valid AS non_empty_valid_comments, keyword_eligible AS keyword_eligible_comments,
       keyword_ineligible AS keyword_ineligible_comments, selected AS selected_comments,
       {S.q(_RULE)} AS selection_rule
FROM n
""")
def selection_manifest(spark, base):
    c = el.funnel_counts(_eligible_comments(spark, base), SELECT_FRACTION)
    return c.select(
        F.lit(SELECT_FRACTION).alias("sample_fraction"), F.lit(presets.SEED).alias("random_seed"),
        F.lit(len(KW)).alias("keyword_count"), "raw_records",
        F.col("valid_records").alias("valid_raw_records_excluding_scraper_errors"),
        F.col("non_empty_valid").alias("non_empty_valid_comments"),
        F.col("keyword_eligible").alias("keyword_eligible_comments"),
        F.col("keyword_ineligible").alias("keyword_ineligible_comments"),
        F.col("selected").alias("selected_comments"), F.lit(_RULE).alias("selection_rule"))


# Every line of the three exports: valid rows only, with their text.
_EXPORT_ROWS_SQL = f"""
WITH parents AS (SELECT conv_id, {S.kw_match('text', KW)} AS pm FROM conversations WHERE turn = 0),
c AS (
  SELECT CAST(v.conv_id AS VARCHAR) || ':' || CAST(v.turn AS VARCHAR) AS _doc_id, v.text, {S.kw_match('v.text', KW)} AS cm,
         coalesce(p.pm, false) AND {S.substantive('v.text')} AS pt
  FROM conversations v LEFT JOIN parents p ON v.conv_id = p.conv_id WHERE v.turn >= 1 AND {S.non_blank('v.text')}
), k AS (
  SELECT *, row_number() OVER (ORDER BY md5('{presets.SEED}:' || _doc_id), _doc_id) AS r, count(*) OVER () AS n FROM c WHERE cm OR pt
), o AS (
  SELECT 'eligible' AS output, _doc_id, text, cm, pt FROM c WHERE cm OR pt
  UNION ALL SELECT 'ineligible', _doc_id, text, cm, pt FROM c WHERE NOT (cm OR pt)
  UNION ALL SELECT 'selected', _doc_id, text, cm, pt FROM k WHERE r <= floor({SELECT_FRACTION} * n)
)
SELECT output, _doc_id, text, CASE WHEN cm THEN 'comment' WHEN pt THEN 'post_title_context' ELSE '' END AS keyword_match_source,
       cm AS comment_keyword_match, (SELECT count(*) FROM o WHERE output = 'selected') AS selected_comments
FROM o
"""


@query("prompt_text", f"""
WITH p AS (SELECT conv_id, text AS title FROM conversations WHERE turn = 0)
SELECT c.conv_id, c.turn,
       {S.q(presets.PROMPT_HEAD + chr(10) + chr(10) + presets.PROMPT_TITLE_HEADER + chr(10))}
       || substring(coalesce(p.title, ''), 1, {presets.PROMPT_TITLE_CHARS})
       || {S.q(chr(10) + chr(10) + presets.PROMPT_COMMENT_HEADER + chr(10))} || coalesce(c.text, '') AS prompt_text
FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id WHERE c.turn >= 1
""")
def prompt_text(spark, base):
    conv = read_table(spark, base, "conversations", spread_key=["conv_id", "turn"]).select("conv_id", "turn", "text")
    parents = conv.filter("turn = 0").select("conv_id", F.col("text").alias("_title"))
    comments = conv.filter("turn >= 1").join(parents, "conv_id", "left")
    return comments.select("conv_id", "turn", tx.prompt_text("text", "_title").alias("prompt_text"))
