"""Exact, seeded, partition-independent sampling and stratified splitting.

Rows of a stratum are ordered by ``md5('<seed>:<id>')`` (ties by id). A sample
or a split is a set of cuts in that order, and ``rank_cuts`` finds the row at a
given rank without sorting the stratum: ids are counted by hash bucket, the
running counts give the bucket in which the rank lies, and only that bucket's
ids are ranked. Whole rows are then decided one by one against the cuts (a
small table, one row per stratum), so no text is ever shuffled, and a stratum
that holds a third of all rows is no single task.

``stratified_rank`` ranks every row; it works on ids and strata alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions import presets


BROADCAST_STRATA = 10_000


def hash_key(id_col: str | Column, seed: int = presets.SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def _join_cond(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _keyed(df: DataFrame, id_col: str, strata: Sequence[str], seed: int, bucket_hex: int) -> DataFrame:
    return df.select(*strata, F.col(id_col).alias("_id"), hash_key(id_col, seed).alias("_h")).withColumn(
        "_b", F.conv(F.substring("_h", 1, bucket_hex), 16, 10).cast("int"))


def _offsets(keyed: DataFrame, strata: Sequence[str]) -> DataFrame:
    """(strata, _b, _n, _off, _stratum_n): ids per bucket, ids before it, ids of the stratum."""
    counts = keyed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_stratum = Window.partitionBy(*strata) if strata else Window.partitionBy()
    running = by_stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*strata, "_b", "_n", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_off"),
                         F.sum("_n").over(by_stratum).alias("_stratum_n"))


def stratified_rank(df: DataFrame, id_col: str, strata: Sequence[str] = (), seed: int = presets.SEED,
                    bucket_hex: int = 4, rank_col: str = "sample_rank") -> DataFrame:
    """(strata, id, ``rank_col``, _stratum_n): the 1-based rank of every id in its stratum."""
    strata = list(strata)
    # Dealt out by a stated number of partitions, which are not merged again, on one key of stratum and bucket:
    # counting, join and window all use it.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stratum = F.to_json(F.struct(*strata)) if strata else F.lit("")
    keyed = _keyed(df, id_col, strata, seed, bucket_hex).withColumn("_s", stratum)
    keyed = keyed.withColumn("_key", F.concat_ws(":", "_b", "_s")).repartition(n, "_key")
    counts = keyed.groupBy("_key").agg(F.first("_s").alias("_s"), F.first("_b").alias("_b"), F.count(F.lit(1)).alias("_n"))
    by_stratum = Window.partitionBy("_s")
    before = by_stratum.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                            F.sum("_n").over(by_stratum).alias("_stratum_n"))
    joined = keyed.join(offsets.hint("merge"), "_key")
    w = Window.partitionBy("_key").orderBy("_h", "_id")
    return joined.select(*strata, F.col("_id").alias(id_col), (F.col("_off") + F.row_number().over(w)).alias(rank_col),
                         "_stratum_n")


def rank_cuts(df: DataFrame, id_col: str, strata: Sequence[str], quotas: DataFrame, quota_cols: Sequence[str],
              seed: int = presets.SEED, bucket_hex: int = 4) -> DataFrame:
    """``quotas`` (one row per stratum) with ``cut_<q>`` for each quota column q: the (hash, id) of the row at rank q
    of the stratum; null for a quota under 1, the last row for one beyond the stratum."""
    strata = list(strata)
    keyed = _keyed(df, id_col, strata, seed, bucket_hex)
    long = quotas.select(*strata, F.explode(F.array(*[
        F.struct(F.lit(q).alias("_q"), F.col(q).cast("long").alias("_k")) for q in quota_cols])).alias("x")).select(*strata, "x.*")
    buckets = _offsets(keyed, strata).alias("_o")
    at = buckets.join(long.alias("_l"), _join_cond(buckets, long, strata) if strata else F.lit(True))
    k = F.least("_l._k", "_o._stratum_n")
    bounds = at.filter((k > F.col("_o._off")) & (k <= F.col("_o._off") + F.col("_o._n"))).select(
        *[F.col(f"_o.{c}").alias(c) for c in strata], F.col("_o._b").alias("_b"), "_q", (k - F.col("_o._off")).alias("_place"))
    # At most one bucket per stratum and quota: few ids are ranked.
    inside = keyed.alias("_i").join(bounds.alias("_p"), _join_cond(keyed, bounds, [*strata, "_b"]))
    w = Window.partitionBy(*[f"_i.{c}" for c in strata], "_q").orderBy("_h", "_id")
    found = (inside.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == F.col("_place"))
             .select(*[F.col(f"_i.{c}").alias(c) for c in strata], "_q", F.struct("_h", "_id").alias("_cut")))
    wide = found.groupBy(*strata).agg(*[F.max(F.when(F.col("_q") == q, F.col("_cut"))).alias(f"cut_{q}") for q in quota_cols])
    left, right = quotas.alias("_a"), wide.alias("_w")
    cond = _join_cond(quotas, wide, strata) if strata else F.lit(True)
    return left.join(right, cond, "left").select("_a.*", *[f"_w.cut_{q}" for q in quota_cols])


def with_cuts(df: DataFrame, strata: Sequence[str], cuts: DataFrame, n_strata: int) -> DataFrame:
    """Attach the cuts to whole rows: broadcast while there are at most ``BROADCAST_STRATA`` strata, else joined."""
    small = F.broadcast(cuts) if n_strata <= BROADCAST_STRATA else cuts
    keys = list(strata)
    renamed = small.select(*[F.col(c).alias(f"_c_{c}") for c in keys], *[c for c in cuts.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_c_{k}"]) for k in keys]) if keys else F.lit(True)
    return df.join(renamed, cond, "left").drop(*[f"_c_{k}" for k in keys])


def not_after(id_col: str, cut: str, seed: int = presets.SEED) -> Column:
    """Whether a row is not after a cut in the stratum's order; false for a null cut."""
    return F.coalesce(F.struct(hash_key(id_col, seed).alias("_h"), F.col(id_col).alias("_id")) <= F.col(cut), F.lit(False))


def exact_sample(df: DataFrame, id_col: str, n: int | None = None, fraction: float | None = None,
                 seed: int = presets.SEED, strata: Sequence[str] = (), bucket_hex: int = 4) -> DataFrame:
    """Simple random sample without replacement of exactly ``n`` rows (per stratum), with their ``sample_rank``.

    With ``fraction`` the size is ``floor(fraction * population)``. Asking for
    more rows than exist raises when the strata are counted.
    """
    if (n is None) == (fraction is None):
        raise ValueError("give exactly one of n or fraction")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    if n is not None:
        guard = F.when(F.col("_size") < n, F.raise_error(F.concat(
            F.lit(f"Requested {n} rows, but only "), F.col("_size").cast("string"), F.lit(" are available."))).cast("long"))
        want = F.coalesce(guard, F.lit(int(n)).cast("long"))
    else:
        want = F.floor(F.lit(float(fraction)) * F.col("_size")).cast("long")
    quotas = sizes.select(*strata, want.alias("_want"))
    n_strata = quotas.count()
    cuts = rank_cuts(df, id_col, strata, quotas, ["_want"], seed, bucket_hex).select(*strata, "cut__want")
    taken = with_cuts(df, strata, cuts, n_strata).filter(not_after(id_col, "cut__want", seed)).drop("cut__want")
    ranks = stratified_rank(taken, id_col, strata, seed, bucket_hex).select(F.col(id_col).alias("_rid"), "sample_rank")
    return taken.join(ranks, taken[id_col] == ranks["_rid"]).drop("_rid")


def largest_remainder(counts: DataFrame, key: str, n_col: str, draws: Column, out: str) -> DataFrame:
    """Largest-remainder allocation of ``draws`` items over classes (ties by key).

    Integer arithmetic only: base = draws*n_c div N, remainder = draws*n_c mod N, with the product as a decimal of
    38 digits, so that classes of 10^10 rows and more do not overflow.
    The frame has one row per class (a closed label set), so the global window
    over it is tiny.
    """
    all_rows = Window.partitionBy()
    tot = F.sum(n_col).over(all_rows)
    c = counts.withColumn("_draws", draws).withColumn("_tot", tot)
    c = c.withColumn("_base", F.when(F.col("_tot") > 0, F.expr(f"(cast(_draws AS decimal(19,0)) * cast({n_col} AS decimal(19,0))) div cast(_tot AS decimal(38,0))")).otherwise(0).cast("long")) \
         .withColumn("_rem", F.when(F.col("_tot") > 0, F.expr(f"cast((cast(_draws AS decimal(19,0)) * cast({n_col} AS decimal(19,0))) % cast(_tot AS decimal(38,0)) AS bigint)")).otherwise(0))
    c = c.withColumn("_need", F.col("_draws") - F.sum("_base").over(all_rows))
    order = Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(key))
    c = c.withColumn(out, F.col("_base") + F.when(F.row_number().over(order) <= F.col("_need"), 1).otherwise(0))
    return c.drop("_draws", "_tot", "_base", "_rem", "_need")


def split_quotas(class_counts: DataFrame, label_col: str, test_size: float = 0.30,
                 second_test_size: float = 0.50) -> DataFrame:
    """Per-class train/val/test quotas of the two-stage stratified split.

    Stage 1 holds out ``ceil(test_size*N)`` rows; stage 2 splits the held-out
    rows, giving ``ceil(second_test_size*N2)`` to test and the rest to val.
    Per-class counts follow the largest-remainder rule, so every class keeps its
    proportion and totals are exact (3,472 rows -> 2,430 / 521 / 521).
    """
    all_rows = Window.partitionBy()
    total = F.sum("n_c").over(all_rows)
    held = F.ceil(F.lit(float(test_size)) * total)
    q = largest_remainder(class_counts, label_col, "n_c", (total - held).cast("long"), "train_c")
    q = q.withColumn("tmp_c", F.col("n_c") - F.col("train_c"))
    tmp_total = F.sum("tmp_c").over(all_rows)
    val_draws = (tmp_total - F.ceil(F.lit(float(second_test_size)) * tmp_total)).cast("long")
    q = largest_remainder(q, label_col, "tmp_c", val_draws, "val_c")
    return q.withColumn("test_c", F.col("tmp_c") - F.col("val_c")).drop("tmp_c")


def stratified_split(df: DataFrame, id_col: str, label_col: str, seed: int = presets.SEED,
                     test_size: float = 0.30, second_test_size: float = 0.50, bucket_hex: int = 4) -> DataFrame:
    """Adds ``split`` in {train, val, test} with exact stratified sizes. Rows without a label are left out: they
    belong to no stratum."""
    labelled = df.filter(F.col(label_col).isNotNull())
    class_counts = labelled.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    quotas = split_quotas(class_counts, label_col, test_size, second_test_size).select(
        label_col, "train_c", (F.col("train_c") + F.col("val_c")).alias("dev_c"))
    n_strata = quotas.count()
    cuts = rank_cuts(labelled, id_col, [label_col], quotas, ["train_c", "dev_c"], seed, bucket_hex).drop("train_c", "dev_c")
    out = with_cuts(labelled, [label_col], cuts, n_strata)
    split = (F.when(not_after(id_col, "cut_train_c", seed), F.lit("train"))
              .when(not_after(id_col, "cut_dev_c", seed), F.lit("val")).otherwise(F.lit("test")))
    return out.withColumn("split", split).drop("cut_train_c", "cut_dev_c")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 10,
                     seed: int = presets.SEED, bucket_hex: int = 4) -> DataFrame:
    """Adds ``fold`` in [0, k): round-robin over the hash rank inside each class.

    Ranks are made on (id, label) alone and joined to the rows by id (ids are unique).
    """
    ranks = stratified_rank(df, id_col, [label_col], seed, rank_col="_r", bucket_hex=bucket_hex).select(
        F.col(id_col).alias("_rid"), F.pmod(F.col("_r") - 1, F.lit(k)).cast("int").alias("fold"))
    return df.join(ranks, df[id_col] == ranks["_rid"]).drop("_rid")
