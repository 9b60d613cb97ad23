"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Every (key, shard) pair has its own uniform draw ``u``; a key belongs to the
shard with the least ``-ln(u) / weight``. A shard's draws do not depend on the
other shards, so adding one moves only the records it wins, and dropping one
moves only its own. Everything is Spark expressions on the record's own row:
no shuffle, no state.

``with_slots`` numbers the records of each shard from 0 without gaps. Records
are dealt over hash ranges (the leading hex digits of a digest of key and
text), the ranges are counted, and a record's slot is its range's offset plus
its rank in the range; equal rows are first counted into one, so neither a
shard nor a key that holds a third of all rows is ranked in one task.

Defined results: a null key hashes as the empty string; repeated keys share a
shard and get slots of their own; a null text has 0 bytes (and the CRC of no
bytes); an empty table gives an empty one. Input columns other than the key
pass through unread; derived columns are built apart from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import stored

RANGE_HEX = 3
_HEX = 13  # 52 bits: exact in a double


def _draw(key: Column, shard: int) -> Column:
    """A uniform draw in (0, 1) for a key and a shard."""
    h = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary")), 1, _HEX)
    return (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** _HEX))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a key; ``weights[i]`` is shard i's share, 0 for a shard that takes nothing."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be at least 0, and one of them over 0")
    text = F.coalesce(key.cast("string"), F.lit(""))
    costs = [F.struct((-F.log(_draw(text, i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
             for i, w in enumerate(weights) if w > 0]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def assign_shards(df: DataFrame, key_col: str, weights: Sequence[float], shard_col: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; a column of that name is replaced."""
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() != shard_col.lower()]
    return df.select(*kept, shard_of(df[f"`{key_col}`"], weights).alias(shard_col))


def with_slots(rows: DataFrame, shard_col: str = "shard", order_col: str = "order_hash",
               slot_col: str = "slot") -> DataFrame:
    """Adds gapless 0-based slots in each shard, in the order of ``order_col`` (hex) and then of the other columns.

    ``rows`` holds narrow columns only; it is read more than once, so pass a stored table.
    """
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_range", F.substring(order_col, 1, RANGE_HEX))
    sizes = counted.groupBy(shard_col, "_range").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(shard_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard_col, "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset"))
    rest = [c for c in cols if c not in (shard_col, order_col)]
    inside = (Window.partitionBy(shard_col, "_range").orderBy(order_col, *rest)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    # offsets has at most 16**RANGE_HEX rows a shard
    placed = placed.join(offsets, [shard_col, "_range"])
    first = F.col("_offset") + F.col("_before")
    return placed.select(*cols, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(slot_col))


def shard_documents(docs: DataFrame, n_shards: int = 8, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its size, its text's CRC-32, its shard, slot, and its shard were there one more."""
    key, text = docs[f"`{key_col}`"], docs[f"`{text_col}`"]
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    slim = stored(docs.select(
        key.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"), shard_of(key, [1.0] * n_shards).alias("shard"),
        shard_of(key, [1.0] * (n_shards + 1)).alias("grown_shard"),
        F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), crc.cast("string")).cast("binary"))
        .alias("order_hash")), "shards")
    out = with_slots(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                      F.col("slot").cast("long").alias("slot"), "grown_shard")
