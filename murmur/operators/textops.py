"""Relational text operators: token filters, lemma tables, point look-ups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from murmur.session import scratch_dir

LOOKUP_BUCKETS = 64
# A lemma table up to this size is broadcast to replace tokens without a shuffle.
BROADCAST_LEMMA_BYTES = 32 << 20
# Documents whose tokens a task replaces at once.
LEMMA_ROWS = 4096


def min_token_filter(df: DataFrame, tokens_col: str, n: int = 3, counter: Observation | None = None) -> DataFrame:
    """Rows with at least ``n`` tokens; ``counter.get["excluded_short_docs"]`` is the number left out, once an action ran."""
    counter = counter or Observation("min_token_filter")
    flagged = df.observe(counter, F.count_if(F.size(tokens_col) < n).alias("excluded_short_docs"))
    return flagged.filter(F.size(tokens_col) >= n)


def vocabulary(df: DataFrame, tokens_col: str) -> DataFrame:
    """Distinct terms; duplicates inside a document are dropped before the shuffle."""
    from murmur.operators.features import explode_terms
    return explode_terms(df, F.array_distinct(tokens_col)).distinct()


def plural_lemma_table(df: DataFrame, tokens_col: str, min_chars: int = 2) -> DataFrame:
    """(form, lemma) pairs where ``form`` is ``lemma + 's'`` and both occur in the corpus.

    A corpus-derived noun lemma table standing in for a dictionary lemmatiser;
    any user table with the same two columns can be passed to ``apply_lemmas``.
    """
    # One grouped pass over the vocabulary (no self-join): every term proposes
    # itself as a stem and, when it ends in "s", proposes its stripped form as
    # the stem of a plural. A key that receives both is a (plural, lemma) pair.
    v = vocabulary(df, tokens_col)
    proposals = F.array(
        F.struct(F.col("term").alias("key"), F.lit(None).cast("string").alias("plural")),
        F.when(F.col("term").endswith("s"),
               F.struct(F.expr("substring(term, 1, length(term) - 1)").alias("key"),
                        F.col("term").alias("plural"))))
    p = v.select(F.explode(F.array_compact(proposals)).alias("p")).select("p.key", "p.plural")
    g = p.groupBy("key").agg(F.max(F.col("plural").isNull().cast("int")).alias("_is_term"),
                             F.max("plural").alias("plural"))
    return g.filter((F.col("_is_term") == 1) & F.col("plural").isNotNull() & (F.length("key") >= min_chars)) \
            .select(F.col("plural").alias("form"), F.col("key").alias("lemma"))


def apply_lemmas(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    """Replace tokens by their lemma (identity when absent), keeping token order.

    The table is stored and measured first. Up to ``BROADCAST_LEMMA_BYTES`` it is
    broadcast and each document's tokens are replaced where they are read; a
    larger table is joined. A form with several lemmas raises.
    """
    path = scratch_dir(df.sparkSession, "lemmas")
    lemmas.select("form", "lemma").filter(F.col("form").isNotNull() & F.col("lemma").isNotNull()).write.parquet(path)
    stored = df.sparkSession.read.schema("form string, lemma string").parquet(path)
    size = stored.agg(F.sum(F.octet_length("form") + F.octet_length("lemma") + 16)).first()[0] or 0
    if size <= BROADCAST_LEMMA_BYTES:
        return _apply_broadcast(df, id_col, tokens_col, stored)
    return _apply_joined(df, id_col, tokens_col, stored)


def _apply_broadcast(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    table = lemmas.toArrow()  # size checked by the caller
    forms, own = (table[c].combine_chunks().cast(pa.string()) for c in ("form", "lemma"))
    if len(pc.unique(forms)) < len(forms):
        raise ValueError("the lemma table has a form with several lemmas")
    shared = df.sparkSession.sparkContext.broadcast((forms, own))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms, own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, LEMMA_ROWS):
                batch = whole.slice(at, LEMMA_ROWS)
                tokens = batch.column(1)
                words = tokens.flatten()
                places = pc.index_in(words, value_set=forms)
                ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()))).astype(np.int32)
                hits = np.concatenate(([0], np.cumsum(pc.is_valid(places).to_numpy(zero_copy_only=False))))
                out = pa.ListArray.from_arrays(pa.array(ends), pc.coalesce(own.take(places), words), mask=pc.is_null(tokens))
                yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(hits[ends[1:]] - hits[ends[:-1]], pa.int64())],
                                                 names=[id_col, "lemmatised", "n_changed"])
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, tokens_col).mapInArrow(replaced, f"`{id_col}` {kind}, lemmatised array<string>, n_changed long")


def _apply_joined(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    """Only the *distinct* tokens of each document meet the lemma table. The
    matches of one document become a small replacement map (bounded by that
    document's vocabulary), joined back by document id and applied in place
    with ``transform`` — token positions are never exploded or regrouped."""
    from murmur.operators.features import explode_terms
    cand = explode_terms(df, F.array_distinct(tokens_col), id_col, name="form")
    hits = cand.join(lemmas.select("form", "lemma"), "form", "inner")
    maps = hits.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_m"))
    j = df.select(id_col, tokens_col).join(maps, id_col, "left")
    m = F.col("_m")
    lem = F.when(m.isNull(), F.col(tokens_col)).otherwise(
        F.transform(tokens_col, lambda t: F.coalesce(F.element_at(m, t), t)))
    changed = F.when(m.isNull(), F.lit(0)).otherwise(
        F.size(F.filter(tokens_col, lambda t: F.element_at(m, t).isNotNull())))
    return j.select(id_col, lem.alias("lemmatised"), changed.cast("long").alias("n_changed"))


def lookup_first(df: DataFrame, label_col: str, target: DataFrame, order_col: str) -> DataFrame:
    """First record (by ``order_col``) whose ``label_col`` equals the single target value.

    ``target`` is a one-row frame, so the semi join broadcasts one row.
    """
    hits = df.join(F.broadcast(target), label_col, "left_semi")
    return hits.orderBy(order_col).limit(1)


def store_for_lookup(df: DataFrame, key_col: str, order_col: str, buckets: int = LOOKUP_BUCKETS) -> str:
    """Name of a table of ``df`` in buckets by ``key_col``, sorted by it and ``order_col``, in the shared folder.

    Choose ``buckets`` so that one is a file of usual size. Rows are rebalanced by key first, so that a bucket is few
    files and a key with very many rows is written by several tasks (adaptive execution splits it).
    """
    name = f"lookup_{uuid.uuid4().hex[:12]}"
    spread = df.hint("rebalance", key_col)
    spread.write.bucketBy(buckets, key_col).sortBy(key_col, order_col).option("path", scratch_dir(df.sparkSession, name)).saveAsTable(name)
    return name


def lookup_stored(spark: SparkSession, table: str, key_col: str, value, order_col: str) -> DataFrame:
    """First record (by ``order_col``) of a stored table with ``value`` as key: one bucket is read, and of that the row
    groups that can hold the value. No row for a null or unknown value."""
    return spark.table(table).filter(F.col(key_col) == F.lit(value)).orderBy(order_col).limit(1)
