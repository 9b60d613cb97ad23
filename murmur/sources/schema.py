"""Schema contracts: required columns, column fallbacks, present-subset projection.

All three act on the analysed schema only, so they never start a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> DataFrame:
    """Raise with the sorted missing names when ``df`` lacks any required column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumnsError(f"{what} is missing columns: {missing}")
    return df


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """Name of the first candidate column present in ``df`` (column-name drift)."""
    for name in candidates:
        if name in df.columns:
            return name
    raise MissingColumnsError(f"none of {list(candidates)} present")


def first_present_col(df: DataFrame, candidates: Sequence[str]) -> Column:
    return F.col(first_present(df, candidates))


def select_present(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Project onto the preferred columns that exist, keeping the preferred order."""
    return df.select(*[c for c in preferred if c in df.columns])
