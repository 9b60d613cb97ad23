"""Relational feature extraction: term counts, TF-IDF, vocabularies, id sequences,
dense-vector statistics.

Term counting explodes tokens and groups by (doc, term): all tokens of a
document sit in one partition, so the map-side partial aggregate already
reduces them to distinct pairs before anything is shuffled. Document
frequencies group by term; a hot term (in a third of all documents) is just a
large partial count, never a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_terms(df: DataFrame, tokens: str | Column, *keep: str, name: str = "term") -> DataFrame:
    """One row per token.

    ``explode_outer`` + a null filter instead of ``explode``: for ``explode`` the
    optimizer infers ``size(tokens) > 0`` and pushes it into the scan, which
    would run the whole tokenizer a second time per row.
    """
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select(*keep, F.explode_outer(col).alias(name)).filter(F.col(name).isNotNull())


def term_frequencies(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, term, tf)."""
    return explode_terms(df, tokens_col, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(df: DataFrame, tokens_col: str) -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    return (explode_terms(df, F.array_distinct(tokens_col))
              .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def top_k_rank(counts: DataFrame, key: str, count_col: str, k: int, prefix_chars: int = 3) -> DataFrame:
    """Exact 1-based rank by (count desc, key asc) for the first ``k`` rows only.

    No global sort and no single-task merge of per-partition top-k lists:
    (1) a histogram of count values (small) gives the count threshold ``c`` at
    which the running total reaches ``k``; (2) rows above ``c`` are all in;
    (3) the tie group at ``c`` is ranked by key through key-prefix buckets
    whose running offsets are computed on a small table, so even millions of
    tied keys are ranked in parallel. The result has at most ``k`` rows.
    """
    hist = counts.groupBy(count_col).agg(F.count(F.lit(1)).alias("_m"))
    desc = Window.orderBy(F.col(count_col).desc())
    hist = hist.withColumn("_cum", F.sum("_m").over(desc.rowsBetween(Window.unboundedPreceding, 0)))
    # Threshold: smallest count whose running total is still <= k, plus the next one (the tie group).
    thr = hist.withColumn("_above", F.col("_cum") - F.col("_m")).filter(F.col("_above") < k)
    thr = thr.select(F.col(count_col).alias("_c"), "_above")
    # Above-threshold counts are whole; the lowest kept count value is the (possible) tie group.
    # Rank inside each count value by key via ordered key-prefix buckets.
    kept = counts.join(F.broadcast(thr), counts[count_col] == thr["_c"], "inner")
    # A provably non-null bucket key: no inferred isnotnull filter is pushed
    # into this branch, so its count subtree stays identical to the histogram's
    # and the exchange after tokenization is reused.
    kept = kept.withColumn("_b", F.coalesce(F.substring(key, 1, prefix_chars), F.lit("")))
    buckets = kept.groupBy("_c", "_above", "_b").agg(F.count(F.lit(1)).alias("_bn"))
    bw = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_boff", F.coalesce(F.sum("_bn").over(bw), F.lit(0))).drop("_bn")
    ranked = kept.join(buckets, ["_c", "_above", "_b"], "inner")
    within = Window.partitionBy("_c", "_b").orderBy(key)
    ranked = ranked.withColumn("rank", F.col("_above") + F.col("_boff") + F.row_number().over(within))
    return ranked.filter(F.col("rank") <= k).drop("_c", "_above", "_b", "_boff")


def tfidf(df: DataFrame, id_col: str, tokens_col: str, min_df: int = 2, max_features: int | None = None,
          sublinear_tf: bool = True) -> DataFrame:
    """(id, term, tfidf) with sklearn's smooth idf: ln((1+N)/(1+df)) + 1, then L2 rows.

    ``N`` counts every document, including those without tokens; the
    vocabulary keeps terms with ``df >= min_df`` and, optionally, the
    ``max_features`` most frequent terms by corpus count.
    """
    tf = term_frequencies(df, id_col, tokens_col)
    n_docs = df.select(F.count(F.lit(1))).scalar()
    # count_if(tf > 0) equals the row count but keeps the tf column alive, so
    # this branch's (doc, term) aggregate stays identical to the one joined
    # below and the exchange after tokenization is reused: the tokenizer runs once.
    vocab = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("_total"))
    vocab = vocab.filter(F.col("df") >= min_df)
    if max_features is not None:
        vocab = top_k_rank(vocab, "term", "_total", max_features).drop("rank")
    # Hashed by term, not sorted: a partition's share of the vocabulary is small beside its rows. Counts go to the
    # documents, where they become weights: they take less room than weights.
    joined = tf.join(vocab.select("term", "df").hint("shuffle_hash"), "term", "inner").select(id_col, "term", "tf", "df").repartition(id_col)
    w_tf = (1 + F.log(F.col("tf"))) if sublinear_tf else F.col("tf").cast("double")
    weighted = joined.select(id_col, "term", (w_tf * (F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1)).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", (F.col("_w") / norm).alias("tfidf"))


def vocab_rank(df: DataFrame, tokens_col: str, num_words: int) -> DataFrame:
    """Keras-style word index: (term, n, word_id), id 1 is out-of-vocabulary,
    the most frequent term is 2; only ids below ``num_words`` are kept.
    Ties are broken by term (not by first appearance)."""
    counts = explode_terms(df, tokens_col).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = top_k_rank(counts, "term", "n", max(num_words - 2, 0))
    return top.select("term", "n", (F.col("rank") + 1).cast("long").alias("word_id"))


def pad_sequences(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, maxlen: int,
                  oov_id: int = 1) -> DataFrame:
    """Id sequence of exactly ``maxlen``: post-truncated, post-padded with 0.

    Every token yields an id (unknown -> ``oov_id``), so only the first
    ``maxlen`` tokens can reach the output; the vocabulary has at most
    ``num_words`` rows, so it is broadcast.
    """
    head = df.select(id_col, F.posexplode_outer(F.slice(tokens_col, 1, maxlen)).alias("_pos", "_tok"))
    j = head.join(F.broadcast(vocab.select(F.col("term").alias("_tok"), "word_id")), "_tok", "left")
    item = F.when(F.col("_tok").isNotNull(),
                  F.struct("_pos", F.coalesce(F.col("word_id"), F.lit(oov_id)).alias("_id")))
    seqs = j.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_s"))
    ids = F.transform("_s", lambda s: s.getField("_id"))
    padded = F.concat(ids, F.array_repeat(F.lit(0).cast("long"), F.lit(maxlen) - F.size(ids)))
    return seqs.select(id_col, padded.alias("sequence"))


def vector_stats(df: DataFrame, vec_col: str, population: bool = False) -> DataFrame:
    """(dim, mean, sd) per dimension; sample sd (Spark's scaler) or population sd
    (``population=True``, the scikit-learn convention)."""
    ex = df.select(F.posexplode(vec_col).alias("dim", "_x"))
    sd = F.stddev_pop if population else F.stddev_samp
    return ex.groupBy("dim").agg(F.avg(F.col("_x").cast("double")).alias("mean"),
                                 sd(F.col("_x").cast("double")).alias("sd"))


def standardise_long(df: DataFrame, id_col: str, vec_col: str, population: bool = False) -> DataFrame:
    """(id, dim, z) with z = (x - mean) / sd; the stats table has one row per
    dimension, so broadcasting it is bounded by the vector width."""
    stats = vector_stats(df, vec_col, population)
    ex = df.select(id_col, F.posexplode(vec_col).alias("dim", "_x"))
    j = ex.join(F.broadcast(stats), "dim")
    z = F.when(F.col("sd") > 0, (F.col("_x").cast("double") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return j.select(id_col, "dim", z.alias("z"))


def softmax(arr: Column) -> Column:
    """Numerically stable softmax over a numeric array column, linear per row.

    The running (sum, max) lives in the accumulator of one ``aggregate`` whose
    zero value holds the max, so neither is re-evaluated per element.
    """
    zero = F.struct(F.lit(0.0).alias("s"), F.array_max(arr).cast("double").alias("m"))
    return F.aggregate(
        arr, zero,
        lambda acc, v: F.struct((acc["s"] + F.exp(v.cast("double") - acc["m"])).alias("s"), acc["m"].alias("m")),
        lambda acc: F.transform(arr, lambda v: F.exp(v.cast("double") - acc["m"]) / acc["s"]))


def label_scores(df: DataFrame, id_col: str, scores: Column, labels: Sequence[str]) -> DataFrame:
    """(id, label, score) for every label of a closed set; a label without a score gets 0. ``scores`` is a map."""
    named = df.select(id_col, scores.alias("_m"))
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.coalesce(F.try_element_at("_m", F.lit(x)), F.lit(0.0)).alias("score"))
                     for x in labels])
    return named.select(id_col, F.inline(rows))


def l1_normalise(arr: Column) -> Column:
    """|x| / sum|x| per element, linear per row."""
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v.cast("double")),
                       lambda s: F.transform(arr, lambda v: F.abs(v.cast("double")) / s))


def first_argmax(arr: Column) -> Column:
    """0-based index of the first maximum (lowest index wins ties)."""
    return F.array_position(arr, F.array_max(arr)) - 1
