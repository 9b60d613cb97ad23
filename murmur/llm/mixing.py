"""Mixing sources to target weights by hash-threshold histograms.

Targets: every source gets a share of ``total_share`` times all sizes by its
weight, at most ``max_repeats`` times its own size; what is over goes to the
others by weight until none is above (in closed form, by filling sources in
the order of limit over weight).

Taking: a source with target r times its size is taken ``floor(r)`` times
whole, and the documents whose hash lies under a threshold once more. The
thresholds come from histograms, never from a sort of documents: sizes are
summed by source and leading hash digits, the running sum gives the bucket in
which the budget ends, and only that boundary bucket is summed again by the
next digits, ``LEVELS`` times. Thresholds of growing budgets are nested, since
the hash does not depend on the budget.

Defined results: a null text has size 0; a null source is a source of its own
(last); equal rows have equal hashes and are taken alike; a document of size 0
adds nothing but follows the same rule; a source whose whole size is 0 has
target 0; an empty table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import packed, stored

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL_SHARE = 1.5
MAX_REPEATS = 2.0
LEVELS = 3
LEVEL_HEX = 3
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(key: Column, text: Column) -> Column:
    """The leading hex digits of a digest of key and text; the mix compares them as strings."""
    own_text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    own = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), own_text).cast("binary"))
    return F.substring(own, 1, LEVELS * LEVEL_HEX)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_repeats: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with target. One row per source, so the windows over all sources are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = (sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
            .withColumn("_ratio", F.col("_cap") / F.col("_w")))
    everything = Window.partitionBy()
    filled = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(everything) * F.lit(float(total_share)) - F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)))
             / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(filled), F.lit(0.0))))
    rows = rows.withColumn("_level", level)
    # The first source, in that order, whose limit lies over the level reached when it is its turn sets the level of
    # all later ones; those before it are full.
    first = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", -F.col("_level")))).over(everything)
    rows = rows.withColumn("_rest", -first["col2"])
    return rows.select("source", "source_size", F.when(F.col("_ratio") > F.col("_rest"), F.col("_rest") * F.col("_w"))
                       .otherwise(F.col("_cap")).alias("target"))


def with_source(rows: DataFrame, per_source: DataFrame, n_sources: int, salt: Column) -> DataFrame:
    """Join a per-source table: broadcast while it has at most ``BROADCAST_SOURCES`` rows, else a salted join."""
    right = per_source.withColumnRenamed("source", "_source")
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), rows["source"].eqNullSafe(right["_source"]), "left").drop("_source")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = rows.withColumn("_salt_", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return left.join(right, left["source"].eqNullSafe(right["_source"]) & (left["_salt_"] == right["_salt"]),
                     "left").drop("_source", "_salt", "_salt_")


def mix_thresholds(sized: DataFrame, targets: DataFrame, n_sources: int) -> DataFrame:
    """(source, source_size, target, repeats, threshold): a document is taken ``repeats`` times, and once more
    where its hash is at most ``threshold`` (null: none)."""
    state = targets.select(
        "source", "source_size", "target", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).alias("repeats"))
    state = state.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit("")).withColumn("below", F.lit(0).cast("long"))
    for level in range(LEVELS):
        digits = LEVEL_HEX * (level + 1)
        inside = with_source(sized, state.select("source", "prefix"), n_sources, F.col("hash"))
        inside = inside.filter(F.substring("hash", 1, digits - LEVEL_HEX) == F.col("prefix"))
        histogram = (inside.groupBy("source", F.substring("hash", 1, digits).alias("bucket"))
                     .agg(F.sum("size").alias("words")))
        h, s = histogram.alias("h"), state.alias("s")
        joined = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).select("s.*", "bucket", "words")
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        joined = joined.withColumn("upto", upto)
        over = F.col("upto") > F.col("budget")
        # The boundary bucket is the first whose running sum passes the budget; if none does, the last bucket.
        found = joined.groupBy("source").agg(
            F.min(F.when(over, F.struct("bucket", "upto", "words"))).alias("cut"),
            F.max(F.struct("bucket", "upto", "words")).alias("last"))
        cut = F.coalesce(F.col("f.cut"), F.col("f.last"))
        f = found.alias("f")
        state = s.join(f, F.col("s.source").eqNullSafe(F.col("f.source"))).select(
            "s.source", "s.source_size", "s.target", "s.repeats", "s.budget", cut["bucket"].alias("prefix"),
            (cut["upto"] - cut["words"]).alias("below"), cut["words"].alias("words"))
        state = stored(state, "mix-level")
        if level < LEVELS - 1:
            state = state.drop("words")
    # The last bucket goes with the side that ends nearer to the budget.
    more = F.col("below") + F.col("words") - F.col("budget") <= F.col("budget") - F.col("below")
    return state.select("source", "source_size", "target", "repeats", F.col("prefix").alias("boundary"),
                        more.alias("inclusive"))


def copies(hash_col: Column) -> Column:
    more = (hash_col < F.col("boundary")) | ((hash_col == F.col("boundary")) & F.col("inclusive"))
    return (F.col("repeats") + F.when(more, 1).otherwise(0)).cast("long")


def _prepared(docs: DataFrame, key_col: str, text_col: str, source_col: str, **shares) -> tuple[DataFrame, DataFrame, int]:
    key, text = docs[f"`{key_col}`"], docs[f"`{text_col}`"]
    sized = stored(docs.select(key.alias("doc_id"), docs[f"`{source_col}`"].cast("string").alias("source"),
                               n_words(text).alias("size"), document_hash(key, text).alias("hash")), "mix-sizes")
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n_sources = totals.count()
    return sized, mix_thresholds(sized, source_targets(totals, **shares), n_sources), n_sources


def mix_sources(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                **shares) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    sized, thresholds, n = _prepared(docs, key_col, text_col, source_col, **shares)
    out = with_source(sized, thresholds, n, F.col("hash"))
    return out.select("doc_id", "source", "size", "source_size", "target",
                      (copies(F.col("hash")) * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               **shares) -> DataFrame:
    """The mix itself: ``docs`` with every row repeated as often as the mix takes it."""
    _, thresholds, n = _prepared(docs, key_col, text_col, source_col, **shares)
    rows = packed(docs).withColumn("source", F.col(f"row.`{source_col}`").cast("string"))
    rows = rows.withColumn("hash", document_hash(F.col(f"row.`{key_col}`"), F.col(f"row.`{text_col}`")))
    out = with_source(rows, thresholds, n, F.col("hash")).withColumn("copies", copies(F.col("hash")))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
