"""Model queries (rows-only checks): word vectors, SVM classifiers, model
selection, LDA topics and their diagnostics. Truth = ``documents.lang`` on the
canonical split; dense vectors = ``embeddings`` (label 0-9).

All jobs run with the reference's training settings (``presets``). Queries
over the same fitted model share it: a model is fitted once per application and
table (word vectors are kept in the shared folder).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import evaluate as ev
from murmur.operators import kernel_svm as ks
from murmur.operators import lda
from murmur.operators import models as md
from murmur.operators import sampling as sm
from murmur.operators import skipgram as sg
from murmur.operators import svm
from murmur.operators import topics as tp
from murmur.plans.feature_queries import doc_tokens
from murmur.plans.registry import query
from murmur.plans.sampling_queries import DOC_LABELS, doc_split
from murmur.session import scratch_dir, stored
from murmur.sources.tables import read_table

LDA_K = 5
# The inverse penalty that the single classifier queries use; grid_search_cv searches it.
SVM_C = 1.0
_VECTORS: dict[tuple[str, str], str] = {}
_FITTED: dict[tuple, object] = {}


def _fitted(spark, base, name: str, fit):
    """``fit()`` once per application, table and name."""
    key = (spark.sparkContext.applicationId, base, name)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _labelled(spark, base):
    """Split documents with ``label``."""
    return doc_split(spark, base, "text").withColumnRenamed("lang", "label")


def _dev(rows):
    """What models learn from; the test rows are held out."""
    return rows.filter(F.col("split").isin("train", "val"))


def _w2v(spark, base):
    """(word, vector) of the train + val rows; trained once per application and table, then read back."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _VECTORS:
        d = doc_split(spark, base, "text").filter(F.col("split").isin("train", "val"))
        d = d.select("doc_id", tx.tokens("text").alias("tokens")).persist()
        model = md.fit_word2vec(d, "tokens", vector_size=presets.W2V_DIM, epochs=presets.W2V_EPOCHS)
        path = scratch_dir(spark, "word2vec")
        model.getVectors().write.parquet(path)
        d.unpersist()
        _VECTORS[key] = path
    return spark.read.parquet(_VECTORS[key])


@query("word2vec_vectors")
def word2vec_vectors(spark, base):
    from pyspark.ml.functions import vector_to_array
    v = _w2v(spark, base)
    return v.select("word", vector_to_array("vector").alias("vector"))


@query("word2vec_negative")
def word2vec_negative(spark, base):
    """Skip-gram vectors with negative sampling of the train + val rows."""
    dev = _dev(doc_split(spark, base, "text")).select("doc_id", tx.tokens("text").alias("tokens"))
    return sg.word2vec_negative(dev, "doc_id", "tokens")


@query("doc_vectors")
def doc_vectors(spark, base):
    return md.mean_vectors(doc_tokens(spark, base), "doc_id", "tokens", _w2v(spark, base), presets.W2V_DIM)


# A fixed vector table, so that the in-vocabulary mean has an exact counterpart.
_FIXED_VECTORS = (("de", 1.0, -2.0), ("que", 0.5, 4.0), ("und", -3.0, 0.25))


def _mean_sql() -> str:
    from murmur.plans import sqlfrag as S
    values = ", ".join(f"({S.q(w)}, {a}, {b})" for w, a, b in _FIXED_VECTORS)
    return f"""
WITH v AS (SELECT * FROM (VALUES {values}) v(term, x, y)),
t AS (SELECT doc_id, unnest({S.tokens('text')}) AS term FROM documents),
m AS (SELECT doc_id, count(*) AS n, avg(CAST(x AS DOUBLE)) AS x, avg(CAST(y AS DOUBLE)) AS y FROM t JOIN v USING (term) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_in_vocab, round(coalesce(x, 0.0), 6) AS x, round(coalesce(y, 0.0), 6) AS y
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id
"""


@query("mean_vectors_fixed", _mean_sql())
def mean_vectors_fixed(spark, base):
    """In-vocabulary means over a fixed vector table."""
    rows = [(w, [a, b]) for w, a, b in _FIXED_VECTORS]
    vectors = spark.createDataFrame(rows, "word string, v array<double>").select("word", array_to_vector("v").alias("vector"))
    m = md.mean_vectors(doc_tokens(spark, base), "doc_id", "tokens", vectors, 2)
    return m.select("doc_id", F.col("n_in_vocab").cast("long").alias("n_in_vocab"),
                    *[F.round(F.col("doc_vector")[i], 6).alias(c) for i, c in enumerate("xy")])


def _coverage_sql() -> str:
    # Word2Vec's vocabulary is deterministic: every token occurring at least
    # minCount (2) times in the train + val rows.
    from murmur.plans import sqlfrag as S
    from murmur.plans.sampling_queries import SPLIT_CTE
    return SPLIT_CTE + f""",
dev AS (SELECT d.doc_id, {S.tokens('d.text')} AS t FROM documents d JOIN split s ON d.doc_id = s.doc_id
        WHERE s.split IN ('train', 'val')),
w2v AS (SELECT term FROM (SELECT unnest(t) AS term FROM dev) GROUP BY term HAVING count(*) >= 2),
toks AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM toks) GROUP BY term),
vocab AS (SELECT term FROM (SELECT term, row_number() OVER (ORDER BY n DESC, term) + 1 AS word_id FROM counts)
          WHERE word_id < {presets.NUM_WORDS})
SELECT count(*) AS n_vocab, count(w.term) AS n_found, round(count(w.term) / count(*), 9) AS coverage
FROM vocab v LEFT JOIN w2v w ON v.term = w.term
"""


@query("embedding_coverage", _coverage_sql())
def embedding_coverage(spark, base):
    from murmur.operators.features import vocab_rank
    vocab = vocab_rank(doc_tokens(spark, base), "tokens", presets.NUM_WORDS)
    c = md.embedding_coverage(vocab, _w2v(spark, base))
    return c.select("n_vocab", "n_found", F.round("coverage", 9).alias("coverage"))


def _text_model(spark, base):
    """The linear text classifier of the train + val rows; fitted once per application and table, then loaded."""
    def fit():
        path = scratch_dir(spark, "text-classifier")
        svm.fit_text_classifier(_dev(_labelled(spark, base)), "doc_id", "text", "label", SVM_C).save(path)
        return path
    return svm.TextClassifier.load(spark, _fitted(spark, base, "text", fit))


def _predictions(model, rows):
    return rows.select("doc_id", F.col("label").alias("true_label")).join(model.predict(rows, "doc_id", "text"), "doc_id")


def _test(spark, base):
    return _labelled(spark, base).filter(F.col("split") == "test")


@query("svm_text_classify")
def svm_text_classify(spark, base):
    return _predictions(_text_model(spark, base), _test(spark, base))


@query("score_corpus")
def score_corpus(spark, base):
    docs = read_table(spark, base, "documents").select("doc_id", "text")
    return _text_model(spark, base).predict(docs, "doc_id", "text")


@query("model_roundtrip")
def model_roundtrip(spark, base):
    model = _text_model(spark, base)
    path = scratch_dir(spark, "model")
    model.save(path)
    loaded = svm.TextClassifier.load(spark, path)
    test = _test(spark, base)
    a = model.predict(test, "doc_id", "text")
    b = loaded.predict(test, "doc_id", "text", "again")
    return a.join(b, "doc_id").select("doc_id", "predicted_label", (F.col("predicted_label") == F.col("again")).alias("same"))


def _dense_classify(spark, base, kernel: ks.Kernel):
    e = read_table(spark, base, "embeddings").select("vec_id", "label", "embedding")
    e = sm.stratified_split(e, "vec_id", "label")
    own, labels, folds = ks.labelled(_dev(e), "vec_id", "embedding", "label")
    model = ks.fit(own, labels, folds, [kernel], [SVM_C])
    test = e.filter(F.col("split") == "test")
    found = ks.predict(model, test, "vec_id", "embedding")
    return test.select("vec_id", F.col("label").alias("true_label")).join(
        found.select("vec_id", F.col("predicted_label").cast("int").alias("predicted_label")), "vec_id")


@query("svm_dense_classify")
def svm_dense_classify(spark, base):
    return _dense_classify(spark, base, ks.Kernel("rbf", "scale"))


@query("svm_dense_rbf_fixed")
def svm_dense_rbf_fixed(spark, base):
    return _dense_classify(spark, base, ks.Kernel("rbf", 0.01))


@query("svm_dense_linear")
def svm_dense_linear(spark, base):
    return _dense_classify(spark, base, ks.Kernel("linear"))


def _document_vectors(spark, base):
    """Labelled split documents with the mean word vector of their tokens as ``vec``; stored once."""
    def make():
        data = _labelled(spark, base)
        vec = md.mean_vectors(data.select("doc_id", tx.tokens("text").alias("tokens")), "doc_id", "tokens",
                              _w2v(spark, base), presets.W2V_DIM)
        path = scratch_dir(spark, "document-vectors")
        data.drop("text").join(vec.select("doc_id", F.col("doc_vector").alias("vec")), "doc_id").write.parquet(path)
        return path
    return spark.read.parquet(_fitted(spark, base, "document vectors", make))


def _w2v_predictions(spark, base, kernel: ks.Kernel = ks.Kernel("rbf", "scale")):
    """tokens -> word vectors -> in-vocabulary mean -> scaler -> SVM: predictions of the test rows."""
    rows = _document_vectors(spark, base)
    own, labels, folds = ks.labelled(_dev(rows), "doc_id", "vec", "label")
    model = ks.fit(own, labels, folds, [kernel], [SVM_C])
    test = rows.filter(F.col("split") == "test")
    return test.select("doc_id", F.col("label").alias("true_label")).join(ks.predict(model, test, "doc_id", "vec"), "doc_id")


@query("w2v_svm_classify")
def w2v_svm_classify(spark, base):
    return _w2v_predictions(spark, base)


@query("compare_fitted_models")
def compare_fitted_models(spark, base):
    """The two fitted classifiers side by side, best macro-F1 first."""
    return ev.compare_predictions({"TF-IDF + SVM": svm_text_classify(spark, base), "Word2Vec + SVM": _w2v_predictions(spark, base),
                                   "CNN-LSTM + SVM": None, "DistilBERT": None}, DOC_LABELS)


def _folds(rows):
    return sm.stratified_folds(_dev(rows), "doc_id", "label", k=presets.FOLDS)


def _scored(spark, points: list[tuple], best: int, columns: str):
    rows = [(*p, i == best) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, columns + ", avg_macro_f1 double, best boolean")


def _text_search(spark, base):
    """((points, place of the best), path of the best point's classifier of all train + val rows)."""
    def search():
        g = presets.TEXT_GRID
        points, best, model = svm.search_text_classifier(_folds(_labelled(spark, base)), "doc_id", "text", "label", "fold",
                                                         g["n_max"], g["max_features"], g["c"])
        path = scratch_dir(spark, "best-classifier")
        model.save(path)
        return [tuple(p) for p in points], points.index(best), path
    return _fitted(spark, base, "text search", search)


@query("grid_search_cv")
def grid_search_cv(spark, base):
    """All grid points of the text classifier over all folds; ``best`` marks the one that is refitted."""
    points, best, _ = _text_search(spark, base)
    return _scored(spark, points, best, "ngram_max int, max_features int, c double")


@query("grid_search_refit")
def grid_search_refit(spark, base):
    """Predictions of the test rows by the best grid point's classifier of all train + val rows."""
    return _predictions(svm.TextClassifier.load(spark, _text_search(spark, base)[2]), _test(spark, base))


@query("w2v_grid_search_cv")
def w2v_grid_search_cv(spark, base):
    """All grid points of the word-vector classifier over all folds."""
    kernels = [ks.Kernel(k, g) for k, g in presets.DENSE_GRID]
    points, best = ks.search(_folds(_document_vectors(spark, base)), "doc_id", "vec", "label", "fold", kernels, presets.DENSE_C)
    rows = [(p.kernel.name, None if p.kernel.gamma is None else str(p.kernel.gamma), p.cost, p.macro_f1) for p in points]
    return _scored(spark, rows, points.index(best), "kernel string, gamma string, c double")


# --------------------------------------------------------------------------
# Topics
# --------------------------------------------------------------------------

def _bow(spark, base):
    """(stored rows with word ids and counts, their vocabulary); made once per application and table."""
    def make():
        path = scratch_dir(spark, "word-counts")
        # Stored, so that the dictionary and the counts do not both cut the texts into words.
        doc_tokens(spark, base, True).filter(F.size("tokens") >= 3).write.parquet(path + "/tokens")
        toks = spark.read.parquet(path + "/tokens")
        words = md.bag_of_words(toks, "tokens", min_df=5, max_df=0.5).vocabulary
        vocab = spark.createDataFrame(list(enumerate(words)), "term_id int, term string")
        vocab.write.parquet(path + "/vocabulary")
        rows = lda.counted_words(toks.select("doc_id", "tokens"), "doc_id", "tokens", vocab)
        # Passes are work for the processor: rows are spread however few bytes they have.
        spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        rows.repartition(spread, "doc_id").write.parquet(path + "/rows")
        return path, len(words)
    path, n_words = _fitted(spark, base, "word counts", make)
    return spark.read.parquet(path + "/rows"), spark.read.parquet(path + "/vocabulary"), n_words


def _lda(spark, base, k: int = LDA_K):
    bow, vocab, n_words = _bow(spark, base)
    return bow, vocab, _fitted(spark, base, f"topics {k}", lambda: lda.fit(bow, n_words, k))


@query("lda_topics")
def lda_topics(spark, base):
    _, vocab, model = _lda(spark, base)
    words = model.top_words(vocab, presets.TOP_WORDS)
    return (words.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_w"))
                 .select("topic", F.array_join(F.transform("_w", lambda s: s.getField("term")), ", ")
                         .alias("top_words")))


@query("topic_top_words")
def topic_top_words(spark, base):
    _, vocab, model = _lda(spark, base)
    return model.top_words(vocab, presets.TOP_WORDS)


@query("lda_bound")
def lda_bound(spark, base):
    """The bound of every pass over the corpus; it rises."""
    bounds = _lda(spark, base)[2].bounds
    return spark.createDataFrame([(i + 1, b) for i, b in enumerate(bounds)], "pass int, bound double")


@query("document_topics")
def document_topics(spark, base):
    bow, _, model = _lda(spark, base)
    return lda.dominant(model.transform(bow, "doc_id"), "doc_id")


def _coherence(bow, top):
    """(topic, coherence_cv) of top words (topic, term), also of several models at once."""
    top = stored(top, "top-words")
    words = [r["term"] for r in top.select("term").distinct().collect()]  # topics x N words at most
    counts = md.window_cooccurrence(bow, "tokens", words)
    return md.coherence_cv(top, counts)


@query("topic_coherence")
def topic_coherence(spark, base):
    bow, vocab, model = _lda(spark, base)
    return _coherence(bow, model.top_words(vocab, presets.TOP_WORDS).select("topic", "term"))


# Frequent words of the test texts, for the counting stage of the coherence.
WINDOW_WORDS = ("de", "die", "que", "und", "ou")


def _window_sql() -> str:
    from murmur.plans import sqlfrag as S
    n = presets.COHERENCE_WINDOW
    pairs = [(a, b) for i, a in enumerate(sorted(WINDOW_WORDS)) for b in sorted(WINDOW_WORDS)[i:]]
    has = ", ".join(f"list_contains(win, {S.q(w)}) AS w{i}" for i, w in enumerate(sorted(WINDOW_WORDS)))
    at = {w: f"w{i}" for i, w in enumerate(sorted(WINDOW_WORDS))}
    rows = " UNION ALL ".join(f"SELECT {S.q(a)} AS w1, {S.q(b)} AS w2, count(*) FILTER (WHERE {at[a]} AND {at[b]}) AS n FROM f" for a, b in pairs)
    return f"""
WITH t AS (SELECT {S.tokens('text')} AS t FROM documents),
w AS (SELECT t[i + 1:i + {n}] AS win FROM (SELECT t, unnest(range(greatest(len(t) - {n} + 1, 1))) AS i FROM t)),
f AS (SELECT {has} FROM w)
SELECT * FROM ({rows}) WHERE n > 0 UNION ALL SELECT '', '', count(*) FROM f
"""


@query("window_counts", _window_sql())
def window_counts(spark, base):
    """The counting stage of the coherence for a fixed word list."""
    return md.window_cooccurrence(doc_tokens(spark, base), "tokens", WINDOW_WORDS)


# A fixed topic-term table, so that the relevance formula has an exact counterpart.
_FIXED_TOPICS = ((0, "de", 6.0), (0, "que", 3.0), (0, "und", 1.0), (1, "de", 1.0), (1, "que", 1.0), (1, "und", 8.0))


def _relevance_sql() -> str:
    from murmur.plans import sqlfrag as S
    values = ", ".join(f"({t}, {S.q(w)}, {x})" for t, w, x in _FIXED_TOPICS)
    return f"""
WITH tt AS (SELECT topic, term, CAST(weight AS DOUBLE) AS weight FROM (VALUES {values}) v(topic, term, weight)),
tf AS (SELECT term, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS term FROM documents) GROUP BY term),
known AS (SELECT term, n, sum(n) OVER () AS total FROM tf WHERE term IN (SELECT term FROM tt)),
p AS (SELECT topic, term, weight / sum(weight) OVER (PARTITION BY topic) AS pt FROM tt)
SELECT CAST(topic AS INTEGER) AS topic, term, round(0.6 * ln(pt) + 0.4 * ln(pt / (n / CAST(total AS DOUBLE))), 9) AS relevance
FROM p JOIN known USING (term)
"""


@query("relevance_fixed", _relevance_sql())
def relevance_fixed(spark, base):
    """Relevance over the corpus's term counts, for a fixed topic-term table."""
    weights = spark.createDataFrame(list(_FIXED_TOPICS), "topic int, term string, weight double")
    freq = doc_tokens(spark, base).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return tp.relevance(weights, freq, lam=0.6).select("topic", "term", F.round("relevance", 9).alias("relevance"))


@query("topic_relevance")
def topic_relevance(spark, base):
    bow, vocab, model = _lda(spark, base)
    freq = (bow.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    rel = tp.relevance(model.weights(vocab), freq, lam=0.6)
    return tp.representative(rel, "topic", "relevance", "term", 30).select("topic", "rank", "term", "relevance")


@query("topic_marginals")
def topic_marginals(spark, base):
    """Each topic's share of the corpus, documents weighted by their dictionary terms."""
    bow, _, model = _lda(spark, base)
    per = model.transform(bow, "doc_id").select("n_words", F.posexplode("theta").alias("topic", "weight"))
    return tp.topic_marginals(per, "topic", "weight", "n_words")


@query("best_k")
def best_k(spark, base):
    """Coherence of every topic number in range; tokens and dictionary are made once for all of them."""
    bow, vocab, n_words = _bow(spark, base)
    ks = range(presets.LDA_K_RANGE[0], presets.LDA_K_RANGE[1] + 1)
    top = None
    for k, model in zip(ks, lda.fit_all(bow, n_words, ks, passes=presets.LDA_SEARCH_PASSES), strict=True):
        own = model.top_words(vocab, presets.TOP_WORDS).select(F.struct(F.lit(k).alias("topics"), "topic").alias("topic"), "term")
        top = own if top is None else top.unionByName(own)
    scores = _coherence(bow, top).groupBy(F.col("topic.topics").alias("topics")).agg(F.avg("coherence_cv").alias("coherence_cv")).collect()
    table = spark.createDataFrame([tuple(r) for r in scores], "topics int, coherence_cv double")  # one row per topic number
    best = ev.best_row(table, "coherence_cv", "topics").select("topics", F.lit(True).alias("best"))
    return table.join(best, "topics", "left").select("topics", "coherence_cv",
                                                     F.coalesce("best", F.lit(False)).alias("best"))
