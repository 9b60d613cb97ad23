"""Golden checks: the published artefacts cross-check each other (G1-G8)."""

import pytest
from pyspark.sql import functions as F

from murmur.functions.presets import LABELS
from murmur.operators import evaluate as ev
from murmur.operators import sampling as sm
from murmur.operators import topics as tp

# G1: confusion matrices (rows = true NEG, NEU, POS) and their published metrics.
G1 = {
    "TF-IDF + SVM": ([[117, 40, 20], [37, 146, 26], [12, 24, 99]],
                     (0.6948176583493282, 0.6954186584282538, 0.6822157434402333, 0.6968973747016707,
                      0.7071428571428572)),
    "DistilBERT": ([[110, 36, 31], [43, 135, 31], [10, 22, 103]],
                   (0.6679462571976967, 0.6684557604136182, 0.6470588235294118, 0.6716417910447762,
                    0.6866666666666666)),
    "Word2Vec + SVM": ([[118, 31, 28], [60, 119, 30], [15, 17, 103]],
                       (0.6525911708253359, 0.655587502396013, 0.6378378378378379, 0.6329787234042553,
                        0.6959459459459459)),
    "CNN-LSTM + SVM": ([[64, 85, 28], [29, 150, 30], [4, 36, 95]],
                       (0.5930902111324377, 0.5839585022979183, 0.46715328467153283, 0.625,
                        0.6597222222222222)),
}


def _counts(spark):
    rows = [(m, LABELS[i], LABELS[j], n) for m, (cm, _) in G1.items()
            for i in range(3) for j in range(3) for n in [cm[i][j]]]
    return spark.createDataFrame(rows, "model string, true_label string, predicted_label string, n long")


def test_g1_comparison_metrics(spark):
    got = {r["model"]: r for r in ev.compare_models(_counts(spark), LABELS).collect()}
    for m, (_, exp) in G1.items():
        r = got[m]
        vals = (r["accuracy"], r["macro_f1"], r["f1_negative"], r["f1_neutral"], r["f1_positive"])
        assert vals == pytest.approx(exp, abs=1e-12)


def test_g1_from_expanded_rows(spark):
    # The same metrics from one row per prediction (as a real prediction table).
    rows = _counts(spark).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "i")
    got = {r["model"]: r["macro_f1"] for r in ev.compare_models(ev.confusion_counts(rows), LABELS).collect()}
    assert got["DistilBERT"] == pytest.approx(0.6684557604136182, abs=1e-12)


def test_g2_classification_report(spark):
    c = _counts(spark).filter(F.col("model") == "DistilBERT")
    rep = {r["row"]: r for r in ev.classification_report(c, LABELS).collect()}
    assert rep["NEGATIVE"]["precision"] == pytest.approx(0.6748466257668712, abs=1e-12)
    assert rep["NEUTRAL"]["recall"] == pytest.approx(0.645933014354067, abs=1e-12)
    assert rep["POSITIVE"]["f1"] == pytest.approx(0.6866666666666666, abs=1e-12)
    assert rep["macro avg"]["precision"] == pytest.approx(0.6661903050980899, abs=1e-12)
    assert rep["macro avg"]["recall"] == pytest.approx(0.6767883012902342, abs=1e-12)
    assert rep["weighted avg"]["precision"] == pytest.approx(0.6716166792284513, abs=1e-12)
    assert rep["weighted avg"]["f1"] == pytest.approx(0.6671833898139427, abs=1e-12)
    assert rep["accuracy"]["f1"] == pytest.approx(0.6679462571976967, abs=1e-12)
    assert [rep[x]["support"] for x in LABELS] == [177, 209, 135]


def test_g2_confusion_matrix_zero_rows(spark):
    c = _counts(spark).filter(F.col("model") == "TF-IDF + SVM")
    m = {r["true_label"]: [r[x] for x in LABELS] for r in ev.confusion_matrix(c, LABELS).collect()}
    assert m["NEGATIVE"] == [117, 40, 20] and m["POSITIVE"] == [12, 24, 99]


G3 = {
    0: "year, upnd, next, never, jail, tell, vote, going, security, party, communication, way",
    1: "security, power, citizen, issue, apa, trust, protect, everything, support, parliament, dictatorship, digital",
    2: "social, president, citizen, move, security, against, insult, bad, opposition, use, information, become",
    3: "section, imprisonment, crime, someone, offence, phone, year, information, yr, mean, conversation, police",
    4: "prison, awe, ati, talk, guy, evidence, phone, lawyer, someone, money, without, year",
    5: "upnd, party, sir, life, president, today, problem, many, god, give, voted, politics",
    6: "freedom, right, social, others, speech, insult, done, insulting, sanity, expression, president, privacy",
}


def test_g3_topic_overlap(spark):
    rows = [(t, w) for t, ws in G3.items() for w in ws.split(", ")]
    top = spark.createDataFrame(rows, "topic int, term string")
    got = {(r["topic_a"], r["topic_b"]): r["shared_words"] for r in tp.topic_overlap(top).collect()}
    assert len(got) == 21
    assert got[(0, 5)] == "party, upnd"
    assert got[(2, 6)] == "insult, president, social"
    assert got[(3, 4)] == "phone, someone, year"
    assert sum(1 for v in got.values() if v == "") == 10


def test_g4_g5_percentages_and_names(spark):
    counts = [(0, 143, 203, 51), (1, 187, 142, 99), (2, 157, 141, 188), (3, 76, 87, 42), (4, 141, 197, 94),
              (5, 143, 170, 80), (6, 182, 199, 248)]
    ct = spark.createDataFrame(counts, "topic int, NEGATIVE long, NEUTRAL long, POSITIVE long")
    pct = {r["topic"]: r for r in tp.row_percentages(ct, "topic", LABELS).collect()}
    assert pct[0]["NEGATIVE"] == pytest.approx(36.02015113350126, abs=1e-9)
    assert pct[6]["POSITIVE"] == pytest.approx(39.42766295707472, abs=1e-9)
    assert sum(sum(c[1:]) for c in counts) == 2970
    names = spark.createDataFrame([(0, "Political consequences and party power")], "topic int, topic_name string")
    named = tp.name_topics(ct, names, "topic").filter("topic = 0").first()
    assert named["topic_name"] == "Political consequences and party power" and named["NEUTRAL"] == 203


def test_g6_best_k(spark):
    scores = [(3, 0.2593529401023484), (4, 0.35196132431344307), (5, 0.38779143752894923),
              (6, 0.3860254839198329), (7, 0.4199380938283898), (8, 0.35647140716754394),
              (9, 0.36658585384430764), (10, 0.3739524252111957)]
    t = spark.createDataFrame(scores, "topics int, coherence_cv double")
    assert ev.best_row(t, "coherence_cv", "topics").first()["topics"] == 7


def test_g7_funnel_arithmetic(spark):
    from murmur.operators.eligibility import funnel_long
    c = spark.createDataFrame([(24853, 24852, 24498, 12925, 11573, 3472)],
                              "raw_records long, valid_records long, non_empty_valid long, keyword_eligible long, "
                              "keyword_ineligible long, selected long")
    rows = {r["stage"]: r for r in funnel_long(c).collect()}
    assert rows["keyword_eligible"]["n"] + rows["keyword_ineligible"]["n"] == rows["non_empty_valid"]["n"]
    assert rows["raw_records"]["pct_of_raw"] == 100.0


def test_g8_split_sizes(spark):
    # 3,472 labelled rows -> 2,430 train / 521 val / 521 test, whatever the class mix.
    n = {"NEGATIVE": 1180, "NEUTRAL": 1393, "POSITIVE": 899}
    rows = [(f"{lab}-{i}", lab) for lab, k in n.items() for i in range(k)]
    df = spark.createDataFrame(rows, "id string, label string")
    out = sm.stratified_split(df, "id", "label")
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 2430, "val": 521, "test": 521}
    per = {(r["split"], r["label"]): r["count"] for r in out.groupBy("split", "label").count().collect()}
    for lab, k in n.items():
        assert abs(per[("train", lab)] - 0.7 * k) <= 1
