"""Ingest: merge sources, anonymise, stable record keys.

Ids are content hashes (``sha2``), never ``uuid()``: a recomputed partition
(lost executor, speculative task) must produce the same id again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import presets

KEY_PARTS = ("commentId", "commentUrl", "facebookUrl", "date", "text")


def _part(df: DataFrame, name: str | Column) -> Column:
    if isinstance(name, Column):
        c = name
    elif name in df.columns:
        c = F.col(name)
    else:
        return F.lit("")
    return F.coalesce(c.cast("string"), F.lit(""))


def record_key_expr(df: DataFrame, parts: Sequence[str | Column] = KEY_PARTS) -> Column:
    """SHA-256 of the parts joined by ``||``; a missing or null part is ``''``.

    Every part is coalesced first: ``concat_ws`` would otherwise drop nulls and
    shorten the key.
    """
    return F.sha2(F.concat_ws("||", *[_part(df, p) for p in parts]), 256)


def add_record_key(df: DataFrame, parts: Sequence[str | Column] = KEY_PARTS) -> DataFrame:
    """Fill ``_record_key`` where missing/empty and ``_doc_id`` as ``DOC_`` + 16 upper hex."""
    key = record_key_expr(df, parts)
    if "_record_key" in df.columns:
        cur = F.col("_record_key")
        key = F.when(cur.isNull() | (cur.cast("string") == ""), key).otherwise(cur)
    out = df.withColumn("_record_key", key)
    doc = F.concat(F.lit("DOC_"), F.upper(F.substring("_record_key", 1, 16)))
    if "_doc_id" in df.columns:
        cur = F.col("_doc_id")
        doc = F.when(cur.isNull() | (cur.cast("string") == ""), doc).otherwise(cur)
    return out.withColumn("_doc_id", doc)


def merge_sources(sources: Mapping[str, DataFrame], natural_keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Union of heterogeneous sources by column name, tagged with ``_dataset_name``.

    ``_doc_id`` is a hash of the dataset name and the source's natural key, so
    it is stable under recomputation and unique across sources.
    """
    frames = []
    for name, df in sources.items():
        parts = [F.lit(name)] + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in natural_keys[name]]
        frames.append(df.withColumns({"_dataset_name": F.lit(name),
                                      "_doc_id": F.sha2(F.concat_ws("||", *parts), 256)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def anonymise(df: DataFrame, id_col: str = "_doc_id", pii: Sequence[str] = presets.PII_FIELDS,
              profile_col: str | None = None, salt: str | None = None) -> DataFrame:
    """Drop personal columns; add ``anon_commenter_id`` = ``ANON_`` + first 8 id chars upper.

    With ``profile_col`` and ``salt`` it also adds ``anon_profile_hash``, a salted
    SHA-256 of the profile that does allow spotting repeat commenters without
    storing who they are.
    """
    out = df
    if profile_col is not None and salt is not None:
        out = out.withColumn("anon_profile_hash",
                             F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(profile_col).cast("string"), F.lit(""))), 256))
    out = out.withColumn("anon_commenter_id",
                         F.concat(F.lit("ANON_"), F.upper(F.substring(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 1, 8))))
    return out.drop(*[c for c in pii if c in out.columns])
