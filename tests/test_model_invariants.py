"""Invariants for the rows-only model queries (no SQL oracle exists for them)."""

import math
import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def q(name):
    import __spark_entry__ as E
    return E.queries()[name]


def test_model_roundtrip_predicts_the_same(spark):
    rows = q("model_roundtrip")(spark, SF).collect()
    assert rows and all(r["same"] for r in rows)


def test_document_topics_are_distributions(spark):
    df = q("document_topics")(spark, SF)
    r = df.agg(F.min("topic_probability"), F.max("topic_probability"), F.min("dominant_topic"),
               F.max("dominant_topic")).first()
    assert 0 < r[0] <= r[1] <= 1 and 0 <= r[2] <= r[3] < 5


def test_topic_tables_shapes(spark):
    words = q("topic_top_words")(spark, SF)
    assert words.groupBy("topic").count().agg(F.max("count")).first()[0] <= 12
    for r in q("topic_coherence")(spark, SF).collect():
        assert math.isfinite(r["coherence_cv"])


def test_doc_vectors_width(spark):
    df = q("doc_vectors")(spark, SF)
    assert df.select(F.size("doc_vector")).distinct().first()[0] == 300


def test_mean_vectors_broadcast_equals_join(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    from murmur.operators import models as md
    vec = spark.createDataFrame([("a", Vectors.dense(1.0, 2.0)), ("b", Vectors.dense(3.0, -2.0))], ["word", "vector"])
    docs = spark.createDataFrame([(1, ["a", "b", "b", "x"]), (2, ["x"]), (3, []), (4, None)], "id int, tokens array<string>")
    one = sorted((r.id, r.n_in_vocab, tuple(r.doc_vector)) for r in md.mean_vectors(docs, "id", "tokens", vec, 2).collect())
    monkeypatch.setattr(md, "BROADCAST_VECTOR_BYTES", 0)
    two = sorted((r.id, r.n_in_vocab, tuple(r.doc_vector)) for r in md.mean_vectors(docs, "id", "tokens", vec, 2).collect())
    assert one[1:] == two[1:] and one[0][1] == 3 and all(abs(x - y) < 1e-9 for x, y in zip(one[0][2], two[0][2]))


def test_lda_reads_the_corpus_and_rejects_less_than_a_pass(spark):
    from pyspark.ml.linalg import Vectors

    from murmur.operators import models as md
    bow = spark.createDataFrame([(Vectors.sparse(3, [i % 3], [2.0]),) for i in range(9)], ["bow"])
    assert md.fit_lda(bow, 2, passes=3).getOrDefault("maxIter") == 3
    assert md.fit_lda(bow, 2, passes=3, subsampling=0.5).getOrDefault("maxIter") == 6
    with pytest.raises(ValueError):
        md.fit_lda(bow, 2, passes=0)


def test_comparison_skips_absent_models_and_needs_one(spark):
    from murmur.operators import evaluate as ev
    a = spark.createDataFrame([("x", "x"), ("y", "x")], "true_label string, predicted_label string")
    b = spark.createDataFrame([("x", "x"), ("y", "y")], "true_label string, predicted_label string")
    assert [r.model for r in ev.compare_predictions({"a": a, "none": None, "b": b}, ["x", "y"]).collect()] == ["b", "a"]
    with pytest.raises(RuntimeError):
        ev.compare_predictions({"none": None}, ["x"])


def test_topic_marginals_sum_to_one(spark):
    rows = q("topic_marginals")(spark, SF).collect()
    assert len(rows) == 5 and abs(sum(r["marginal"] for r in rows) - 1) < 1e-9


def test_stream_scores_equal_batch_scores(spark):
    one = sorted(tuple(r) for r in q("stream_score")(spark, SF).select("doc_id", "predicted_label").collect())
    assert one == sorted(tuple(r) for r in q("score_corpus")(spark, SF).select("doc_id", "predicted_label").collect())


def test_means_of_many_words_are_made_in_pieces_without_python_words(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from murmur.operators import models as md
    monkeypatch.setattr(md, "MEAN_ROWS", 3)
    monkeypatch.setattr(md, "MEAN_WORDS", 4)
    rng = np.random.default_rng(1)
    words = {w: [float(x) for x in rng.normal(size=2).astype(np.float32)] for w in "abcde"}
    docs = [(i, [str(w) for w in rng.choice(list("abcdexyz"), int(rng.integers(0, 30)))]) for i in range(40)] + [(40, None), (41, ["x"]), (42, [])]
    vec = spark.createDataFrame(list(words.items()), "word string, v array<double>").select("word", array_to_vector("v").alias("vector"))
    got = md.mean_vectors(spark.createDataFrame(docs, "id long, tokens array<string>").coalesce(1), "id", "tokens", vec, 2)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    found = {r.id: (r.n_in_vocab, r.doc_vector) for r in got.collect()}
    assert len(found) == len(docs)
    for i, tokens in docs:
        own = [words[t] for t in tokens or [] if t in words]
        assert found[i][0] == len(own)
        assert np.allclose(found[i][1], np.mean(own, axis=0) if own else [0.0, 0.0])
