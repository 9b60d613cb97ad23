"""Distributed models: Word2Vec, mean pooling, LDA and topic coherence (``svm`` and ``kernel_svm`` hold the classifiers).

Training data never leaves the executors except where MLlib itself keeps a
model on the driver (LDA topic matrix, Word2Vec vocabulary), whose size is
bounded by vocabulary x topics, not by the corpus.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.operators.features import explode_terms, top_k_rank
from murmur.session import stored


# --------------------------------------------------------------------------
# Word vectors
# --------------------------------------------------------------------------

# Shards that Word2Vec trains side by side. A fixed number, so that the vectors do not depend on the cluster's size.
W2V_SHARDS = 8
# A word-vector matrix up to this size is broadcast to score documents without a shuffle.
BROADCAST_VECTOR_BYTES = 512 << 20
# Documents and word vectors that a task averages at once.
MEAN_ROWS = 1024
MEAN_WORDS = 1 << 14
# Rows whose terms a task counts at once.
COUNT_ROWS = 2048


def fit_word2vec(df: DataFrame, tokens_col: str, vector_size: int = 300, window: int = 5, min_count: int = 2,
                 epochs: int = 30, seed: int = presets.SEED, partitions: int = W2V_SHARDS):
    """Skip-gram Word2Vec on ``partitions`` parallel shards. ``partitions=1`` is bit-reproducible but trains the
    whole corpus in a single task, which does not scale."""
    w2v = Word2Vec(vectorSize=vector_size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed,
                   numPartitions=partitions, inputCol=tokens_col, outputCol="_w2v")
    return w2v.fit(df)


def mean_vectors(df: DataFrame, id_col: str, tokens_col: str, vectors: DataFrame, dim: int) -> DataFrame:
    """Mean of the *in-vocabulary* word vectors per document; zeros if none.

    (``Word2VecModel.transform`` divides by all tokens, OOV included, which is
    not the same.) The vectors' size is counted first. Up to
    ``BROADCAST_VECTOR_BYTES`` they are broadcast as one matrix and each document
    is averaged where it is read; a larger table is joined by word.
    """
    n_words = vectors.count()
    if n_words * (dim * 4 + 64) <= BROADCAST_VECTOR_BYTES:
        return _mean_broadcast(df, id_col, tokens_col, vectors, dim)
    ex = explode_terms(df, tokens_col, id_col, name="word")
    j = ex.join(vectors.select("word", "vector"), "word", "inner")
    means = j.groupBy(id_col).agg(Summarizer.mean(F.col("vector")).alias("_m"), F.count(F.lit(1)).alias("n_in_vocab"))
    means = means.select(id_col, "n_in_vocab", vector_to_array("_m").alias("_a"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    out = df.select(id_col).join(means, id_col, "left")
    return out.select(id_col, F.coalesce("n_in_vocab", F.lit(0)).alias("n_in_vocab"),
                      F.coalesce("_a", zeros).alias("doc_vector"))


def _mean_broadcast(df: DataFrame, id_col: str, tokens_col: str, vectors: DataFrame, dim: int) -> DataFrame:
    rows = vectors.select("word", vector_to_array("vector", "float32").alias("v")).collect()  # size checked by the caller
    matrix = np.array([r["v"] for r in rows], dtype=np.float32).reshape(len(rows), dim)
    shared = df.sparkSession.sparkContext.broadcast((pa.array([r["word"] for r in rows], pa.string()), matrix))

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, MEAN_ROWS):
                batch = whole.slice(at, MEAN_ROWS)
                tokens = batch.column(1)
                # Words stay in Arrow: only the places of known ones become numbers.
                places = pc.index_in(tokens.flatten(), value_set=words)
                owner = pc.list_parent_indices(tokens).to_numpy()
                known = pc.is_valid(places).to_numpy(zero_copy_only=False)
                places, owner = places.drop_null().to_numpy(), owner[known]
                n, total = np.bincount(owner, minlength=batch.num_rows), np.zeros((batch.num_rows, dim))
                for i in range(0, len(places), MEAN_WORDS):
                    own = owner[i:i + MEAN_WORDS]
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    total[own[first]] += np.add.reduceat(m[places[i:i + MEAN_WORDS]].astype(np.float64), first, axis=0)
                total /= np.maximum(n, 1)[:, None]
                vectors = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * dim, total.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), vectors], names=[id_col, "n_in_vocab", "doc_vector"])
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, tokens_col).mapInArrow(mean, f"`{id_col}` {kind}, n_in_vocab long, doc_vector array<double>")


def embedding_coverage(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Share of vocabulary terms with a vector (misses get a zero vector downstream)."""
    found = vectors.select(F.col("word").alias("term"), F.lit(True).alias("_found"))
    j = vocab.select("term").join(found, "term", "left")
    return j.agg(F.count(F.lit(1)).alias("n_vocab"), F.count("_found").alias("n_found"),
                 (F.count("_found") / F.count(F.lit(1))).alias("coverage"))


# --------------------------------------------------------------------------
# Topics
# --------------------------------------------------------------------------

def term_counts(df: DataFrame, tokens_col: str) -> DataFrame:
    """(term, n, df): how often each term occurs, and in how many rows. Terms are counted in Arrow a few rows at a time
    before they are grouped."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, COUNT_ROWS):
                tokens = whole.slice(first, COUNT_ROWS).column(0)
                coded = pc.dictionary_encode(tokens.flatten())
                known = pc.is_valid(coded.indices).to_numpy(zero_copy_only=False)
                codes, owner = coded.indices.drop_null().to_numpy(), pc.list_parent_indices(tokens).to_numpy()[known].astype(np.int64)
                width = len(coded.dictionary)
                cells = np.unique(owner * width + codes) % max(width, 1)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(codes, minlength=width), pa.int64()),
                                                  pa.array(np.bincount(cells, minlength=width), pa.int64())], names=["term", "n", "df"])
    part = df.select(F.col(tokens_col).cast("array<string>")).mapInArrow(count, "term string, n long, df long")
    return part.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def bag_of_words(df: DataFrame, tokens_col: str, min_df: int = 5, max_df: float = 0.5,
                 vocab_size: int = presets.DICTIONARY_TERMS):
    """Dictionary with document-frequency limits, most frequent terms first and equal ones by term, so that reruns agree
    on the terms and their ids; raises if it ends up empty, and warns where ``vocab_size`` (the reference dictionary's own
    limit) leaves terms out."""
    most = max_df * df.count() if max_df < 1 else max_df
    counts = stored(term_counts(df, tokens_col).filter(F.col("df").between(min_df, most)), "dictionary")
    ranked = top_k_rank(counts, "term", "n", vocab_size).select("rank", "term").toArrow().sort_by("rank")
    vocabulary = ranked.column("term").to_pylist()
    if not vocabulary:
        raise ValueError("no term lies between the document-frequency limits")
    if len(vocabulary) >= vocab_size:
        warnings.warn(f"the dictionary holds its limit of {vocab_size} terms; rarer ones are left out", stacklevel=2)
    return CountVectorizerModel.from_vocabulary(vocabulary, tokens_col, "bow")


def fit_lda(bow: DataFrame, k: int, passes: int = presets.LDA_PASSES, seed: int = presets.SEED, subsampling: float = 1.0):
    """Online variational LDA that reads the corpus ``passes`` times. An iteration samples ``subsampling`` of it;
    with the default every document is read in every pass."""
    if not 0 < subsampling <= 1 or passes < 1:
        raise ValueError("passes must be at least 1 and subsampling over 0 and at most 1")
    lda = LDA(k=k, maxIter=math.ceil(passes / subsampling), seed=seed, optimizer="online", optimizeDocConcentration=True,
              subsamplingRate=subsampling, featuresCol="bow", topicDistributionCol="topic_distribution")
    return lda.fit(bow)


def topic_words(lda_model, vocabulary: Sequence[str], n: int = presets.TOP_WORDS) -> DataFrame:
    """(topic, rank, term, weight) for the top ``n`` words of every topic.

    The vocabulary is the fitted dictionary the model already holds on the
    driver (at most ``vocab_size`` terms); it is joined as a small table.
    """
    d = lda_model.describeTopics(n)
    spark = d.sparkSession
    vocab = spark.createDataFrame(list(enumerate(vocabulary)), "term_index int, term string")
    ex = d.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "z"))
    ex = ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("z.termIndices").alias("term_index"),
                   F.col("z.termWeights").alias("weight"))
    return ex.join(F.broadcast(vocab), "term_index").select("topic", "rank", "term", "weight")


def document_topics(lda_model, bow: DataFrame, id_col: str) -> DataFrame:
    """Dominant topic per document; an empty bag of words takes the normalised
    document-concentration prior instead of Spark's all-zero vector."""
    out = lda_model.transform(bow)
    alpha = [float(a) for a in lda_model.estimatedDocConcentration().toArray()]
    total = sum(alpha) or 1.0
    prior = F.array(*[F.lit(a / total) for a in alpha])
    dist = vector_to_array("topic_distribution")
    dist = F.when(F.aggregate(dist, F.lit(0.0), lambda a, b: a + b) > 0, dist).otherwise(prior)
    out = out.withColumn("_p", dist)
    mx = F.array_max("_p")
    return out.select(id_col, (F.array_position("_p", mx) - 1).cast("int").alias("dominant_topic"),
                      mx.alias("topic_probability"))


def window_cooccurrence(docs: DataFrame, tokens_col: str, words: Sequence[str],
                        window: int = presets.COHERENCE_WINDOW) -> DataFrame:
    """Boolean sliding-window counts for a small word set: (w1, w2, n) with
    w1 <= w2 (w1 == w2 gives single-word counts) plus ('', '', windows).

    Windows are all spans of ``window`` consecutive tokens (a shorter document
    is one window). Each document is handled inside its task with numpy
    (prefix sums over word indicators); Spark sums the per-document counts.
    """
    vocab = sorted(set(words))
    index = {w: i for i, w in enumerate(vocab)}

    def per_partition(batches):
        for pdf in batches:
            acc = np.zeros((len(vocab), len(vocab)), dtype=np.int64)
            total = 0
            for toks in pdf["t"]:
                toks = list(toks) if toks is not None else []
                n = len(toks)
                n_win = max(n - window + 1, 1)
                total += n_win
                hits = [(p, index[t]) for p, t in enumerate(toks) if t in index]
                if not hits:
                    continue
                present = sorted({i for _, i in hits})
                ind = np.zeros((len(present), n + 1), dtype=np.int32)
                row = {i: r for r, i in enumerate(present)}
                for p, i in hits:
                    ind[row[i], p + 1] = 1
                cs = np.cumsum(ind, axis=1)
                if n >= window:
                    inwin = (cs[:, window:] - cs[:, : n - window + 1]) > 0
                else:
                    inwin = cs[:, -1:] > 0
                m = inwin.astype(np.float64)  # counts below 2^53 are exact
                acc[np.ix_(present, present)] += (m @ m.T).astype(np.int64)
            rows = [(vocab[a], vocab[b], int(acc[a, b])) for a, b in np.argwhere(np.triu(acc))] + [("", "", total)]
            yield pd.DataFrame(rows, columns=["w1", "w2", "n"])

    schema = "w1 string, w2 string, n long"
    part = docs.select(F.col(tokens_col).alias("t")).mapInPandas(per_partition, schema)
    return part.groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def coherence_cv(top: DataFrame, counts: DataFrame, eps: float = 1e-12) -> DataFrame:
    """c_v per topic (Roeder et al. 2015): one-set segmentation, NPMI context
    vectors, cosine, mean. ``top`` = (topic, term); ``counts`` from
    ``window_cooccurrence``. Every table here is (topics x top words)^2 small."""
    total = counts.filter(F.col("w1") == "").select(F.max("n")).scalar()
    single = counts.filter((F.col("w1") == F.col("w2")) & (F.col("w1") != "")).select(
        F.col("w1").alias("w"), F.col("n").alias("nw"))
    pair = counts.filter(F.col("w1") != "").select("w1", "w2", F.col("n").alias("nab"))
    pair = pair.unionByName(pair.filter(F.col("w1") != F.col("w2")).select(
        F.col("w2").alias("w1"), F.col("w1").alias("w2"), "nab"))
    a = top.select("topic", F.col("term").alias("wi"))
    b = top.select("topic", F.col("term").alias("wj"))
    grid = a.join(b, "topic")  # K * N * N rows, N = top words per topic
    g = (grid.withColumn("_tot", total)
             .join(single.select(F.col("w").alias("wi"), F.col("nw").alias("ni")), "wi", "left")
             .join(single.select(F.col("w").alias("wj"), F.col("nw").alias("nj")), "wj", "left")
             .join(pair.select(F.col("w1").alias("wi"), F.col("w2").alias("wj"), "nab"), ["wi", "wj"], "left"))
    tot = F.col("_tot").cast("double")
    pab = F.coalesce(F.col("nab"), F.lit(0)) / tot
    pa = F.coalesce(F.col("ni"), F.lit(0)) / tot
    pb = F.coalesce(F.col("nj"), F.lit(0)) / tot
    npmi = F.when((pa > 0) & (pb > 0), F.log((pab + eps) / (pa * pb)) / -F.log(pab + eps)).otherwise(0.0)
    g = g.select("topic", "wi", "wj", npmi.alias("v"))
    # context vector of the whole set: sum over wi of v(wi, .)
    vw = g.groupBy("topic", "wj").agg(F.sum("v").alias("vs"))
    j = g.join(vw, ["topic", "wj"])
    cos = j.groupBy("topic", "wi").agg((F.sum(F.col("v") * F.col("vs")) /
                                        (F.sqrt(F.sum(F.col("v") * F.col("v"))) *
                                         F.sqrt(F.sum(F.col("vs") * F.col("vs"))))).alias("c"))
    return cos.groupBy("topic").agg(F.avg(F.coalesce("c", F.lit(0.0))).alias("coherence_cv"))


# --------------------------------------------------------------------------
# Model dispatch: kind -> scorer, with an availability probe
# --------------------------------------------------------------------------

class ScorerRegistry:
    """``kind -> (DataFrame -> DataFrame)`` scorers; a kind whose model is not
    available (e.g. no saved pipeline) is reported, not silently skipped."""

    def __init__(self):
        self._scorers: dict = {}

    def register(self, kind: str, loader):
        """``loader()`` returns a scorer or None when the model is unavailable."""
        self._scorers[kind] = loader
        return self

    def available(self) -> list[str]:
        return [k for k, load in self._scorers.items() if load() is not None]

    def score(self, kind: str, df: DataFrame) -> DataFrame:
        if kind not in self._scorers:
            raise KeyError(f"unknown model kind {kind!r}; known: {sorted(self._scorers)}")
        scorer = self._scorers[kind]()
        if scorer is None:
            raise RuntimeError(f"model {kind!r} is not available")
        return scorer(df)


def saved_classifier_loader(spark, path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "predicted_label"):
    """Loader for a saved text classifier; None if nothing is saved at ``path``."""
    from murmur.operators.svm import TextClassifier
    from murmur.sources.files import _fs_exists

    def load():
        if not _fs_exists(spark, path):
            return None
        model = TextClassifier.load(spark, path)
        return lambda df: df.join(model.predict(df, id_col, text_col, out_col), id_col)
    return load


def embedding_matrix(vocab: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(word_id, term, vector, found): one row per vocabulary id; a term without a
    vector gets zeros (the embedding layer's initial matrix)."""
    from pyspark.ml.functions import vector_to_array as v2a
    vec = vectors.select(F.col("word").alias("term"), v2a("vector").alias("_v"))
    j = vocab.select("word_id", "term").join(vec, "term", "left")
    return j.select("word_id", "term", F.coalesce("_v", F.array_repeat(F.lit(0.0), dim)).alias("vector"),
                    F.col("_v").isNotNull().alias("found"))
