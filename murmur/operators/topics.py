"""Topic tables: dictionary filtering, top terms, dominant topic, cross-tabs,
pairwise overlap, representative documents, relevance and coherence.

Model fitting lives in ``murmur.operators.models``; everything here is
relational and works the same on LDA output or on any (doc, topic, p) table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.operators.features import document_frequency


def dictionary(df: DataFrame, tokens_col: str, no_below: int = 5, no_above: float = 0.5) -> DataFrame:
    """(term, df) kept by document-frequency limits: ``df >= no_below`` and
    ``df <= int(no_above * n_docs)``."""
    n_docs = df.select(F.count(F.lit(1))).scalar()
    d = document_frequency(df, tokens_col)
    return d.filter((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.lit(no_above) * n_docs)))


def top_terms(df: DataFrame, group_col: str, tokens_col: str, n: int) -> DataFrame:
    """(group, rank, term, n): the ``n`` most frequent terms per group (ties by term).

    The ``row_number() <= n`` filter is planned as a group limit that is applied
    before the shuffle as well, so a group with a third of all rows still
    ships only ``n`` rows per map task.
    """
    from murmur.operators.features import explode_terms
    counts = (explode_terms(df, tokens_col, group_col)
                .groupBy(group_col, "term").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(group_col).orderBy(F.col("n").desc(), F.col("term"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select(
        group_col, F.col("rank").cast("long").alias("rank"), "term", "n")


def dominant_topic(df: DataFrame, dist_col: str) -> DataFrame:
    """First arg-max of a distribution array: ``dominant_topic`` and its probability."""
    mx = F.array_max(dist_col)
    return df.withColumns({"dominant_topic": (F.array_position(dist_col, mx) - 1).cast("int"),
                           "topic_probability": mx.cast("double")})


def crosstab(df: DataFrame, row_col: str, col_col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row_col`` x ``col_col`` with explicit columns; absent ones are 0."""
    return df.groupBy(row_col).pivot(col_col, list(values)).count().na.fill(0, list(values))


def row_percentages(ct: DataFrame, row_col: str, values: Sequence[str]) -> DataFrame:
    total = sum((F.col(v) for v in values), F.lit(0))
    return ct.select(row_col, *[F.when(total > 0, F.col(v) * 100.0 / total).alias(v) for v in values])


def prevalence(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def topic_overlap(top: DataFrame, topic_col: str = "topic", term_col: str = "term") -> DataFrame:
    """Pairs ``a < b`` of topics with their shared top words (sorted, comma-joined).

    One row per topic (its word set) and a theta self-join on ``a < b``: the
    input has one row per topic, so the join is K*(K-1)/2 rows by construction.
    """
    sets = top.groupBy(topic_col).agg(F.collect_set(term_col).alias("words"))
    a = sets.select(F.col(topic_col).alias("topic_a"), F.col("words").alias("wa"))
    b = sets.select(F.col(topic_col).alias("topic_b"), F.col("words").alias("wb"))
    shared = F.array_sort(F.array_intersect("wa", "wb"))
    return (a.join(b, F.col("topic_a") < F.col("topic_b"))
             .select("topic_a", "topic_b", F.size(shared).alias("shared_word_count"),
                     F.array_join(shared, ", ").alias("shared_words")))


def representative(df: DataFrame, topic_col: str, score_col: str, id_col: str, n: int) -> DataFrame:
    """Top ``n`` rows per topic by score (ties by id) for all topics at once."""
    w = Window.partitionBy(topic_col).orderBy(F.col(score_col).desc(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def name_topics(ct: DataFrame, names: DataFrame, topic_col: str) -> DataFrame:
    """Attach names (one row per topic, so broadcast is bounded by K)."""
    return ct.join(F.broadcast(names), topic_col, "left")


def relevance(topic_term: DataFrame, term_freq: DataFrame, lam: float = 0.6,
              topic_col: str = "topic", term_col: str = "term", weight_col: str = "weight") -> DataFrame:
    """Term relevance per topic: lam*ln p(w|t) + (1-lam)*ln(p(w|t)/p(w)).

    ``topic_term`` holds unnormalised topic-word weights, ``term_freq`` the
    corpus count per term. Both normalisations are window sums over small
    tables (topic count x vocabulary).
    """
    p_wt = F.col(weight_col) / F.sum(weight_col).over(Window.partitionBy(topic_col))
    tt = topic_term.withColumn("p_wt", p_wt)
    # p(w) is over the dictionary: terms without a topic weight do not count.
    known = term_freq.join(topic_term.select(term_col).distinct(), term_col, "left_semi")
    tf = known.withColumn("p_w", F.col("n") / F.sum("n").over(Window.partitionBy()))
    j = tt.join(tf.select(term_col, "p_w"), term_col, "inner")
    return j.select(topic_col, term_col, "p_wt", "p_w",
                    (F.lit(lam) * F.log("p_wt") + F.lit(1 - lam) * F.log(F.col("p_wt") / F.col("p_w"))).alias(
                        "relevance"))


def topic_marginals(doc_topics: DataFrame, topic_col: str = "topic", weight_col: str = "weight",
                    length_col: str | None = None) -> DataFrame:
    """(topic, marginal): each topic's share of the corpus, documents weighted by length if a column is given.

    ``doc_topics`` has one row per document and topic.
    """
    w = F.col(weight_col) * F.col(length_col) if length_col else F.col(weight_col)
    per = doc_topics.groupBy(topic_col).agg(F.sum(w).alias("_w"))
    return per.select(topic_col, (F.col("_w") / F.sum("_w").over(Window.partitionBy())).alias("marginal"))
