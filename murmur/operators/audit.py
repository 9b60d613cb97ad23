"""Audit of unused records: anti/semi joins, keep-first dedup, duplicate guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import text as tx


def dedup_first(df: DataFrame, key: str, order_col: str, count_col: str = "raw_occurrences",
                columns: Sequence[str] | None = None) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order_col``, plus the group size.

    ``min(struct(order, ...))`` is an ordinary partially-aggregated reduce, so a
    key holding a third of all rows is folded map-side before the shuffle;
    ``dropDuplicates`` would keep an arbitrary row.
    """
    cols = [c for c in (columns or df.columns) if c not in (key, order_col)]
    agg = df.groupBy(key).agg(F.min(F.struct(order_col, *cols)).alias("_first"),
                              F.count(F.lit(1)).alias(count_col))
    return agg.select(key, *[F.col("_first").getField(c).alias(c) for c in [order_col, *cols]], count_col)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys occurring more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, key: str, what: str = "input") -> None:
    """Raise if ``key`` repeats (one small job; stops at the first duplicate)."""
    if duplicate_keys(df, key).limit(1).count():
        raise ValueError(f"{what} contains duplicated {key} values.")


def unused_audit(raw: DataFrame, model_ids: DataFrame, eligible_ids: DataFrame, key: str = "_doc_id",
                 order_col: str = "doc_id", text_col: str = "text",
                 columns: Sequence[str] | None = None) -> DataFrame:
    """Raw records absent from the model corpus, one row per key, with a reason.

    Membership of the model and eligible id sets becomes two boolean columns
    (left joins to their distinct keys), then ``unused_audit_flags`` does the
    rest in one grouped pass.
    """
    def member(ids: DataFrame, flag: str) -> DataFrame:
        return ids.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))

    flagged = (raw.join(member(model_ids, "_in_model"), key, "left")
                  .join(member(eligible_ids, "_eligible"), key, "left"))
    return unused_audit_flags(flagged, key, order_col, text_col, columns)


def unused_audit_flags(flagged: DataFrame, key: str = "_doc_id", order_col: str = "doc_id",
                       text_col: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """Audit from per-row flags ``_in_model`` / ``_eligible`` (null = false).

    Membership is per key, so a key is either wholly in the model corpus or
    wholly unused: one ``groupBy(key)`` yields the keep-first row, the
    occurrence count and both memberships. Only a boolean "has text" travels in
    the aggregation buffer, never the text. Precedence of reasons:
    blank text > eligible > ineligible. Null keys form their own group and
    count as unused.
    """
    cols = [c for c in (columns or []) if c not in (key, order_col, text_col)]
    pre = flagged.select(key, order_col, *cols, tx.non_blank(text_col).alias("_has_text"),
                         F.coalesce(F.col("_in_model"), F.lit(False)).alias("_in_model"),
                         F.coalesce(F.col("_eligible"), F.lit(False)).alias("_eligible"))
    g = pre.groupBy(key).agg(
        F.min(F.struct(order_col, *cols, "_has_text")).alias("_first"),
        F.count(F.lit(1)).alias("raw_occurrences"),
        F.max("_in_model").alias("_in_model"), F.max("_eligible").alias("_eligible"))
    g = g.filter(~F.col("_in_model"))
    first = [F.col("_first").getField(c).alias(c) for c in [order_col, *cols]]
    reason = (F.when(~F.col("_first._has_text"), F.lit("no_usable_comment_text"))
               .when(F.col("_eligible"), F.lit("keyword_eligible_not_in_final_corpus"))
               .otherwise(F.lit("keyword_ineligible")))
    return g.select(key, *first, "raw_occurrences", reason.alias("exclusion_reason"))
