"""Faceted exploration aggregates (the dashboard's tables, as Spark jobs).

Each function takes the corpus DataFrame and returns a small aggregate; all
are single-pass conditional aggregates with map-side combine.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facets:
    sentiments: Sequence[str] | None = None
    themes: Sequence[str] | None = None
    date_from: dt.date | str | None = None
    date_to: dt.date | str | None = None


def faceted_filter(df: DataFrame, facets: Facets, label_col: str = "sentiment",
                   date_col: str | None = "date_parsed") -> DataFrame:
    """label in set AND any selected theme flag AND date between (inclusive).

    Undated rows are dropped whenever a date range is active. The predicates
    are plain column comparisons, so they reach the Parquet scan.
    """
    # Plain conjuncts (a filter already treats null as false) so each one can
    # be pushed into the Parquet scan; the date test is a timestamp range.
    conds: list[Column] = []
    if facets.sentiments is not None:
        conds.append(F.col(label_col).isin(*facets.sentiments))
    if facets.themes:
        conds.append(reduce(lambda a, b: a | b, [F.col(t) for t in facets.themes]))
    if date_col is not None and facets.date_from is not None and facets.date_to is not None:
        start = F.lit(str(facets.date_from)).cast("date")
        end = F.date_add(F.lit(str(facets.date_to)).cast("date"), 1)
        ts = F.col(date_col)
        conds.append((ts >= start) & (ts < end))
    out = df
    for c in conds:
        out = out.filter(c)
    return out


def label_shares(df: DataFrame, label_col: str, labels: Sequence[str]) -> DataFrame:
    """Percentage of rows per label over a closed label set; 0 when nothing matches."""
    aggs = [F.coalesce(F.avg((F.col(label_col) == x).cast("double")) * 100, F.lit(0.0)).alias(f"_{i}")
            for i, x in enumerate(labels)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{x}', _{i}" for i, x in enumerate(labels))
    return wide.selectExpr(f"stack({len(labels)}, {stack}) AS (label, share_pct)")


def weekly_volume(df: DataFrame, ts_col: str, label_col: str) -> DataFrame:
    """Rows per (Monday-start UTC week, label); undated rows dropped; gaps not filled."""
    return (df.filter(F.col(ts_col).isNotNull())
              .groupBy(F.date_trunc("week", F.col(ts_col)).alias("week"), F.col(label_col))
              .agg(F.count(F.lit(1)).alias("comments")))


def theme_prevalence(df: DataFrame, theme_cols: Sequence[str]) -> DataFrame:
    """(theme, comments, percentage) — multi-label, so percentages may sum past 100."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(t)).alias(t) for t in theme_cols])
    long = wide.unpivot(["_n"], list(theme_cols), "theme", "comments")
    return long.select("theme", "comments",
                       F.when(F.col("_n") > 0, F.col("comments") * 100.0 / F.col("_n")).alias("percentage"))


def theme_sentiment(df: DataFrame, theme_cols: Sequence[str], label_col: str,
                    labels: Sequence[str]) -> DataFrame:
    """Dense (theme, sentiment, comments) table: one grouped pass, zeros kept."""
    per_label = df.groupBy(F.col(label_col).alias("sentiment")).agg(
        *[F.count_if(F.col(t)).alias(t) for t in theme_cols])
    long = per_label.unpivot(["sentiment"], list(theme_cols), "theme", "comments")
    grid = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in theme_cols])).alias("theme"),
    ).select("theme", F.explode(F.array(*[F.lit(x) for x in labels])).alias("sentiment"))
    return grid.join(long, ["theme", "sentiment"], "left").select(
        "theme", "sentiment", F.coalesce("comments", F.lit(0)).cast("long").alias("comments"))


def date_range(df: DataFrame, ts_col: str) -> DataFrame:
    return df.agg(F.min(ts_col).alias("min_date"), F.max(ts_col).alias("max_date"))


def parse_mixed_timestamp(col: Column | str, formats: Sequence[str]) -> Column:
    """A date string in any of the usual layouts as a UTC timestamp; unparseable -> null.

    ISO dates and times (blank or ``T``, fractional seconds, ``Z`` or an offset,
    which is converted to UTC) are read first, then the other ``formats`` in order.
    """
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    iso = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([T ].*)?$"), c.try_cast("timestamp"))
    return F.coalesce(iso, *[F.try_to_timestamp(c, F.lit(f)) for f in formats])
