"""Edge semantics from hand-made tables (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import text as tx
from murmur.operators import annotate as an
from murmur.operators import audit
from murmur.operators import eligibility as el
from murmur.operators import evaluate as ev
from murmur.operators import explore as ex
from murmur.operators import features as fx
from murmur.operators import ingest
from murmur.operators import sampling as sm
from murmur.operators import topics as tp
from murmur.sources.schema import MissingColumnsError, first_present, require_columns, select_present


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr(F.col("x")).alias("y")).first()["y"]


def test_keyword_substring_and_null(spark):
    assert one(spark, lambda c: tx.keyword_match(c, ["laz"]), "lazy people") is True
    assert one(spark, lambda c: tx.keyword_match(c, ["laz"]), None) is False
    assert one(spark, lambda c: tx.keyword_match(c, ["no. 3"]), "Act No. 3 of 2025") is True


def test_substantive(spark):
    assert one(spark, tx.substantive, "one two - three four") is False
    assert one(spark, tx.substantive, "one two three four five") is True
    assert one(spark, tx.substantive, None) is False


def test_provenance(spark):
    rows = [("gag order here", "nothing"), ("a b c d e", "the gag bill"), ("a b c d", "gag")]
    df = spark.createDataFrame(rows, "text string, postTitle string")
    out = [r["keyword_match_source"] for r in el.add_keyword_flags(df, keywords=["gag"]).collect()]
    assert out == ["comment", "post_title_context", ""]


def test_validity(spark):
    df = spark.createDataFrame([("  ", None), ("ok", "boom"), ("ok", None)], "text string, error string")
    assert el.valid_comments(df).count() == 1
    assert el.valid_comments(df.drop("error")).count() == 2


def test_record_key_not_shortened(spark):
    import hashlib
    df = spark.createDataFrame([("a", None, None, None, None)],
                               "commentId string, commentUrl string, facebookUrl string, date string, text string")
    r = ingest.add_record_key(df).first()
    assert r["_record_key"] == hashlib.sha256(b"a||||||||").hexdigest()
    assert r["_doc_id"] == "DOC_" + r["_record_key"][:16].upper()


def test_light_clean_and_mentions(spark):
    assert one(spark, tx.light_clean, "See https://x.y/z @bob  NOW") == "See NOW"
    assert one(spark, tx.light_clean, "@é1x hi") == "hi"


@pytest.mark.parametrize("text,expected", [
    ("#Safe not SAFE! www.a.b @x", ["safe", "not", "safe"]),
    ("don't go", ["don", "go"]),
    ("été", []),
    (None, []),
    ("", []),
])
def test_tokens(spark, text, expected):
    assert one(spark, tx.tokens, text) == expected


def test_json_extraction(spark):
    df = spark.createDataFrame([('Sure: {"label":"NEUTRAL","confidence":"HIGH"} ok',), ("no json",),
                                ('```json\n{"label": "POSITIVE"}\n```',)], "raw string")
    out = df.select(an.parse_annotation(F.col("raw")).alias("p")).select("p.*").collect()
    assert (out[0]["label"], out[0]["confidence"]) == ("NEUTRAL", "HIGH")
    assert (out[1]["label"], out[1]["confidence"], out[1]["rule_applied"]) == ("UNCERTAIN", "LOW", "Parse failure")
    assert out[2]["label"] == "POSITIVE" and out[2]["confidence"] is None


def test_routing(spark):
    rows = [("NEUTRAL", "LOW"), ("ERROR", "HIGH"), ("POSITIVE", None), (None, "HIGH")]
    df = spark.createDataFrame(rows, "ai_label string, ai_confidence string")
    assert [r["route"] for r in an.route(df).collect()] == ["review", "review", "unrouted", "confirmed"]


def test_exclusion_reason_precedence(spark):
    raw = spark.createDataFrame([("A", 1, "  "), ("B", 2, "text"), ("B", 3, "text"), ("C", 4, "x")],
                                "_doc_id string, doc_id long, text string")
    model = spark.createDataFrame([("C",)], "_doc_id string")
    elig = spark.createDataFrame([("A",), ("B",)], "_doc_id string")
    out = {r["_doc_id"]: r for r in audit.unused_audit(raw, model, elig).collect()}
    assert out["A"]["exclusion_reason"] == "no_usable_comment_text"
    assert out["B"]["exclusion_reason"] == "keyword_eligible_not_in_final_corpus"
    assert out["B"]["raw_occurrences"] == 2 and out["B"]["doc_id"] == 2
    assert "C" not in out


def test_zero_division(spark):
    c = spark.createDataFrame([("m", "NEGATIVE", "NEUTRAL", 3)],
                              "model string, true_label string, predicted_label string, n long")
    rep = {r["row"]: r for r in ev.classification_report(c, ["NEGATIVE", "NEUTRAL", "POSITIVE"]).collect()}
    assert rep["NEGATIVE"]["precision"] == 0.0 and rep["NEGATIVE"]["f1"] == 0.0
    assert rep["POSITIVE"]["support"] == 0


def test_faceted_dates(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 3)), ("a", None)], "sentiment string, date_parsed timestamp")
    on = ex.Facets(sentiments=["a"], date_from="2024-01-01", date_to="2024-01-31")
    off = ex.Facets(sentiments=["a"])
    assert ex.faceted_filter(df, on).count() == 1
    assert ex.faceted_filter(df, off).count() == 2


def test_week_start(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 12), "x")], "ts timestamp, s string")
    w = ex.weekly_volume(df, "ts", "s").first()["week"]
    assert w == dt.datetime(2024, 1, 1)


def test_doc_vector_in_vocab_mean(spark):
    from murmur.operators.models import mean_vectors
    from pyspark.ml.linalg import Vectors, VectorUDT
    docs = spark.createDataFrame([(1, ["known", "unknown"]), (2, ["unknown"])], "id int, toks array<string>")
    vecs = spark.createDataFrame([("known", Vectors.dense([2.0, 4.0]))],
                                 T.StructType([T.StructField("word", T.StringType()), T.StructField("vector", VectorUDT())]))
    out = {r["id"]: r["doc_vector"] for r in mean_vectors(docs, "id", "toks", vecs, 2).collect()}
    assert out[1] == [2.0, 4.0] and out[2] == [0.0, 0.0]


def test_argmax_tie_and_softmax(spark):
    df = spark.createDataFrame([([0.5, 0.5],)], "p array<double>")
    assert tp.dominant_topic(df, "p").first()["dominant_topic"] == 0
    s = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<double>").select(fx.softmax(F.col("x")).alias("p")).first()["p"]
    assert sum(s) == pytest.approx(1.0) and s[2] > s[1] > s[0]


def test_padding(spark):
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "term string, word_id long")
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "a", "b", "zz"]), (3, [])],
                                 "id int, t array<string>")
    out = {r["id"]: r["sequence"] for r in fx.pad_sequences(docs, "id", "t", vocab, 4).collect()}
    assert out[1] == [5, 6, 0, 0] and out[2] == [5, 6, 5, 6] and out[3] == [0, 0, 0, 0]


def test_class_weights(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "l string")
    w = {r["l"]: r["weight"] for r in ev.class_weights(df, "l").collect()}
    assert w["a"] == pytest.approx(4 / 3) and w["c"] == pytest.approx(2 / 3)


def test_sample_exact_and_partition_independent(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    a = sorted(r["doc_id"] for r in sm.exact_sample(df.repartition(1), "doc_id", n=37).collect())
    b = sorted(r["doc_id"] for r in sm.exact_sample(df.repartition(17), "doc_id", n=37).collect())
    assert a == b and len(a) == 37
    with pytest.raises(Exception):
        sm.exact_sample(df, "doc_id", n=5000).collect()


def test_rank_equals_plain_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).withColumn("g", (F.col("id") % 3).cast("string")).withColumnRenamed("id", "doc_id")
    fast = sm.stratified_rank(df, "doc_id", ["g"]).select("doc_id", "sample_rank")
    w = Window.partitionBy("g").orderBy(sm.hash_key("doc_id"), "doc_id")
    plain = df.select("doc_id", F.row_number().over(w).alias("r"))
    assert fast.join(plain, "doc_id").filter(F.col("sample_rank") != F.col("r")).count() == 0


def test_top_k_rank_matches_sort(spark):
    rows = [(f"t{i:03d}", (i * 7) % 13) for i in range(300)]
    df = spark.createDataFrame(rows, "term string, n long")
    got = [r["term"] for r in fx.top_k_rank(df, "term", "n", 50).orderBy("rank").collect()]
    exp = [t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:50]]
    assert got == exp


def test_schema_contracts(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    with pytest.raises(MissingColumnsError, match=r"\['label', 'zz'\]"):
        require_columns(df, {"zz", "label", "id"})
    assert first_present(df, ["text_original", "text"]) == "text"
    assert select_present(df, ["text", "nope", "id"]).columns == ["text", "id"]


def test_lexicon_rules(spark):
    df = spark.createDataFrame([(1, "this is a dangerous and repressive law for all of us"),
                                (2, "long overdue"), (3, "hi"),
                                (4, "the act defines the terms used here today")], "id int, text string")
    out = {r["id"]: (r["ai_label"], r["ai_confidence"]) for r in an.lexicon_annotate(df).collect()}
    assert out[1] == ("NEGATIVE", "HIGH")
    assert out[2] == ("POSITIVE", "MEDIUM")
    assert out[3] == ("UNCERTAIN", "LOW")
    assert out[4] == ("NEUTRAL", "MEDIUM")


def test_stopword_algebra():
    from murmur.functions.presets import BASIC_STOPWORDS, NEGATORS
    stop = set(tx.default_stopwords())
    assert "not" not in stop and "no" not in stop and "the" in stop
    assert stop == set(BASIC_STOPWORDS) - set(NEGATORS)


def test_read_first_existing(spark, tmp_path):
    from murmur.sources.files import read_first_existing
    good = str(tmp_path / "named")
    spark.range(3).write.parquet(good)
    assert read_first_existing(spark, [str(tmp_path / "missing"), good]).count() == 3
    assert read_first_existing(spark, [str(tmp_path / "missing")]) is None


def test_json_corpus_array_and_lines(spark, tmp_path):
    from murmur.sources.files import read_json_corpus
    arr = tmp_path / "a.json"
    arr.write_text('[{"text": "é un", "commentId": "1"},\n {"text": "b", "commentId": "2"}]', encoding="utf-8")
    lines = tmp_path / "l.json"
    lines.write_text('{"text": "x", "commentId": "1"}\n{"text": "y"}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("commentId", T.StringType()), T.StructField("text", T.StringType())])
    a = read_json_corpus(spark, str(arr), schema)
    b = read_json_corpus(spark, str(lines), schema)
    assert sorted(r["text"] for r in a.collect()) == ["b", "é un"]
    assert b.count() == 2


def test_plugin_annotator_errors_become_rows(spark):
    def fn(rec):
        if rec["text"] == "boom":
            raise ConnectionError("server down " * 20)
        return {"label": "NEUTRAL", "confidence": "HIGH", "rationale": "r", "rule_applied": "x"}
    df = spark.createDataFrame([(1, "fine"), (2, "boom")], "id long, text string")
    out = {r["id"]: r for r in an.annotate_with(df, fn, "id").collect()}
    assert out[1]["ai_label"] == "NEUTRAL"
    assert out[2]["ai_label"] == "ERROR" and len(out[2]["ai_rationale"]) == 100


def test_scorer_registry(spark):
    from murmur.operators.models import ScorerRegistry
    reg = ScorerRegistry().register("echo", lambda: (lambda d: d)).register("missing", lambda: None)
    assert reg.available() == ["echo"]
    df = spark.range(2)
    assert reg.score("echo", df).count() == 2
    with pytest.raises(RuntimeError):
        reg.score("missing", df)


def test_population_sd(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [3.0])], "id int, v array<double>")
    samp = {r["id"]: r["z"] for r in fx.standardise_long(df, "id", "v").collect()}
    pop = {r["id"]: r["z"] for r in fx.standardise_long(df, "id", "v", population=True).collect()}
    assert pop[2] == pytest.approx(1.0) and samp[2] == pytest.approx(2 ** -0.5)


def test_tfidf_matches_formula(spark):
    import math
    docs = [(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["d"]), (4, [])]
    df = spark.createDataFrame(docs, "id int, t array<string>")
    got = {(r["id"], r["term"]): r["tfidf"] for r in fx.tfidf(df, "id", "t", min_df=1).collect()}
    n = len(docs)
    dfreq = {"a": 2, "b": 1, "c": 1, "d": 1}
    for doc_id, toks in docs:
        w = {t: (1 + math.log(toks.count(t))) * (math.log((1 + n) / (1 + dfreq[t])) + 1) for t in set(toks)}
        norm = math.sqrt(sum(v * v for v in w.values())) or 1
        for t, v in w.items():
            assert got[(doc_id, t)] == pytest.approx(v / norm, abs=1e-12)
    # min_df=2 keeps only 'a'; max_features=1 keeps the most frequent term
    assert {k[1] for k in [(r["id"], r["term"]) for r in fx.tfidf(df, "id", "t", min_df=2).collect()]} == {"a"}
    top1 = {r["term"] for r in fx.tfidf(df, "id", "t", min_df=1, max_features=1).collect()}
    assert top1 == {"a"} or top1 == {"b"}


def test_window_cooccurrence_brute_force(spark):
    from murmur.operators.models import window_cooccurrence
    import random
    rnd = random.Random(7)
    vocab = ["w%d" % i for i in range(8)]
    docs = [[rnd.choice(vocab + ["x", "y", "z"]) for _ in range(rnd.randint(0, 40))] for _ in range(30)]
    words = vocab[:5]
    window = 6
    exp = {}
    total = 0
    for toks in docs:
        spans = [toks[i:i + window] for i in range(max(len(toks) - window + 1, 1))]
        total += len(spans)
        for s in spans:
            present = sorted(set(s) & set(words))
            for i, a in enumerate(present):
                for b in present[i:]:
                    exp[(a, b)] = exp.get((a, b), 0) + 1
    df = spark.createDataFrame([(d,) for d in docs], "tokens array<string>")
    got = {(r["w1"], r["w2"]): r["n"] for r in window_cooccurrence(df, "tokens", words, window).collect()}
    assert got.pop(("", "")) == total
    assert got == exp


def test_hot_stratum_is_ranked_in_parallel(spark):
    # Every row in one stratum: the plain window would run in one task.
    df = spark.range(0, 40000).withColumn("g", F.lit("hot")).withColumnRenamed("id", "doc_id")
    ranked = sm.stratified_rank(df, "doc_id", ["g"])
    per_part = [r["count"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(per_part) > 1 and max(per_part) < 40000
    assert ranked.agg(F.min("sample_rank"), F.max("sample_rank"), F.countDistinct("sample_rank")).first()[:] == (1, 40000, 40000)


def test_embedding_matrix_zero_fill(spark):
    from murmur.operators.models import embedding_matrix
    from pyspark.ml.linalg import Vectors, VectorUDT
    vocab = spark.createDataFrame([(2, "a"), (3, "b")], "word_id long, term string")
    vecs = spark.createDataFrame([("a", Vectors.dense([1.0, 2.0]))],
                                 T.StructType([T.StructField("word", T.StringType()), T.StructField("vector", VectorUDT())]))
    m = {r["term"]: (r["vector"], r["found"]) for r in embedding_matrix(vocab, vecs, 2).collect()}
    assert m == {"a": ([1.0, 2.0], True), "b": ([0.0, 0.0], False)}


def test_bucket_width_does_not_change_ranks(spark):
    df = spark.range(0, 2000).withColumn("g", (F.col("id") % 2).cast("string")).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: r["split"] for r in sm.stratified_split(df, "doc_id", "g", bucket_hex=2).collect()}
    b = {r["doc_id"]: r["split"] for r in sm.stratified_split(df, "doc_id", "g", bucket_hex=5).collect()}
    assert a == b
