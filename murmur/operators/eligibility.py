"""Validity, keyword eligibility with parent-post context, funnel and manifest.

Eligibility = comment mentions a keyword, OR the parent post mentions one and
the comment itself is substantive (>= 5 word-like tokens). Provenance
``comment`` wins over ``post_title_context``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx


def valid_comments(df: DataFrame, text_col: str = "text", error_col: str = "error",
                   keep_flag: bool = False) -> DataFrame:
    """Rows with non-blank text and no scraper error; a missing error column means no errors."""
    ok = tx.non_blank(text_col)
    if error_col in df.columns:
        ok = ok & F.col(error_col).isNull()
    out = df.withColumn("valid_comment", ok)
    return out if keep_flag else out.filter("valid_comment").drop("valid_comment")


def add_keyword_flags(df: DataFrame, text_col: str = "text", title_col: str | None = "postTitle",
                      keywords: Sequence[str] = presets.SELECTION_KEYWORDS,
                      min_tokens: int = 5, title_flag_col: str | None = None) -> DataFrame:
    """Adds the five eligibility columns.

    Either ``title_col`` (raw parent text) or ``title_flag_col`` (a parent match
    flag computed upstream, e.g. once per parent before a join) is used.
    """
    if title_flag_col is not None:
        title_match = F.coalesce(F.col(title_flag_col), F.lit(False))
    elif title_col is not None and title_col in df.columns:
        title_match = tx.keyword_match(title_col, keywords)
    else:
        title_match = F.lit(False)
    out = df.withColumns({
        "comment_keyword_match": tx.keyword_match(text_col, keywords),
        "post_title_keyword_match": title_match,
        "substantive_comment": tx.substantive(text_col, min_tokens),
    })
    by_title = F.col("post_title_keyword_match") & F.col("substantive_comment")
    return out.withColumns({
        "keyword_eligible": F.col("comment_keyword_match") | by_title,
        "keyword_match_source": F.when(F.col("comment_keyword_match"), F.lit("comment"))
                                 .when(by_title, F.lit("post_title_context"))
                                 .otherwise(F.lit("")),
    })


def comments_with_parent_flag(conversations: DataFrame, keywords: Sequence[str] = presets.SELECTION_KEYWORDS,
                              key: str = "conv_id", order_col: str = "turn",
                              text_col: str = "text") -> DataFrame:
    """Comment rows (turn >= 1) with the parent post's keyword flag attached.

    The parent (turn 0) is matched once per conversation and only its boolean
    flag crosses the shuffle, never the parent text. The parent side is unique
    per key, so a hot conversation holding a third of all comments is a skewed
    many-to-one join that AQE splits; nothing is collected per conversation.
    """
    parents = (conversations.filter(F.col(order_col) == 0)
               .select(F.col(key), tx.keyword_match(text_col, keywords).alias("_parent_match")))
    comments = conversations.filter(F.col(order_col) >= 1)
    return comments.join(parents, key, "left")


def keyword_eligibility(conversations: DataFrame,
                        keywords: Sequence[str] = presets.SELECTION_KEYWORDS) -> DataFrame:
    valid = valid_comments(conversations.select("conv_id", "turn", "text"))
    flagged = add_keyword_flags(comments_with_parent_flag(valid, keywords), text_col="text",
                                title_col=None, keywords=keywords, title_flag_col="_parent_match")
    return flagged.select("conv_id", "turn", "comment_keyword_match", "post_title_keyword_match",
                          "substantive_comment", "keyword_eligible", "keyword_match_source")


def split_eligible(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Eligible / ineligible views of one flagged frame (persist it if both are written)."""
    return flagged.filter("keyword_eligible"), flagged.filter(~F.col("keyword_eligible"))


FUNNEL_STAGES = ("raw_records", "valid_records", "non_empty_valid", "keyword_eligible",
                 "keyword_ineligible", "selected")


def funnel_counts(flagged: DataFrame, select_fraction: float | None = None) -> DataFrame:
    """One-pass counters of the corpus funnel as a single row.

    The size of an exact sample follows from the eligible count, so with
    ``select_fraction`` no row needs to be ranked to count the selected ones.

    ``flagged`` has one row per raw record with boolean columns
    ``valid_record``, ``non_empty_valid``, ``keyword_eligible`` and ``selected``
    (null = false), so every stage is a conditional count of the same scan.
    """
    def on(c: str):
        return F.coalesce(F.col(c), F.lit(False))
    eligible = F.count_if(on("non_empty_valid") & on("keyword_eligible"))
    selected = F.count_if(on("selected")) if select_fraction is None else F.floor(F.lit(select_fraction) * eligible)
    return flagged.agg(
        F.count(F.lit(1)).alias("raw_records"),
        F.count_if(on("valid_record")).alias("valid_records"),
        F.count_if(on("non_empty_valid")).alias("non_empty_valid"),
        eligible.alias("keyword_eligible"),
        F.count_if(on("non_empty_valid") & ~on("keyword_eligible")).alias("keyword_ineligible"),
        selected.cast("long").alias("selected"))


def funnel_long(counts: DataFrame) -> DataFrame:
    """(stage_order, stage, n, pct_of_raw) with the division guarded."""
    stack = ", ".join(f"{i}, '{s}', {s}" for i, s in enumerate(FUNNEL_STAGES))
    long = counts.selectExpr("raw_records AS _raw",
                             f"stack({len(FUNNEL_STAGES)}, {stack}) AS (stage_order, stage, n)")
    return long.select(
        F.col("stage_order").cast("int").alias("stage_order"), "stage", F.col("n").cast("long").alias("n"),
        F.round(F.col("n") * 100.0 / F.nullif(F.col("_raw"), F.lit(0)), 6).alias("pct_of_raw"))


SELECTION_EXPORT = ("_doc_id", "_record_key", "date", "text", "postTitle", "facebookUrl", "commentUrl",
                    "_dataset_name", "keyword_match_source", "comment_keyword_match", "post_title_keyword_match")


def write_selection_outputs(flagged: DataFrame, counts: DataFrame, out_dir: str, sample_size: int, seed: int,
                            keyword_count: int, rule: str, raw_path: str) -> DataFrame:
    """Write eligible / ineligible / selected CSVs, sorted by document id, and the manifest (one JSON record with a
    nested ``outputs`` struct).

    ``flagged`` holds one row per raw record with its text and the columns ``valid_record``, ``non_empty_valid``,
    ``keyword_eligible`` and ``selected``; blank or errored records are in no CSV. It is persisted by the caller if it
    is expensive: it feeds three outputs. Returns the manifest frame.
    """
    from murmur.sources.files import write_csv, write_json
    from murmur.sources.schema import require_columns, select_present

    require_columns(flagged, ["_doc_id", "text", "keyword_eligible", "selected"])
    paths = {"eligible": f"{out_dir}/keyword_eligible_comments",
             "ineligible": f"{out_dir}/keyword_ineligible_comments",
             "selected": f"{out_dir}/selected_comments_for_annotation_{sample_size}_seed{seed}"}
    valid = flagged.filter("valid_record AND non_empty_valid")
    eligible, ineligible = split_eligible(valid)
    for name, rows in (("eligible", eligible), ("ineligible", ineligible), ("selected", valid.filter("selected"))):
        write_csv(select_present(rows, SELECTION_EXPORT), paths[name], order_by=["_doc_id"])
    manifest = counts.select(
        F.lit(raw_path).alias("raw_path"), F.lit(sample_size).alias("sample_size"), F.lit(seed).alias("random_seed"),
        F.lit(keyword_count).alias("keyword_count"), "raw_records",
        F.col("valid_records").alias("valid_raw_records_excluding_scraper_errors"),
        F.col("non_empty_valid").alias("non_empty_valid_comments"),
        F.col("keyword_eligible").alias("keyword_eligible_comments"),
        F.col("keyword_ineligible").alias("keyword_ineligible_comments"),
        F.col("selected").alias("selected_comments"), F.lit(rule).alias("selection_rule"),
        F.struct(*[F.lit(v).alias(k) for k, v in paths.items()]).alias("outputs"))
    write_json(manifest.coalesce(1), f"{out_dir}/selection_manifest_{sample_size}_seed{seed}")
    return manifest
