"""The codebook's rules, tested from its wording; selection exports; dates; CSV; large classes."""

import json

import pytest
from pyspark.sql import functions as F

from murmur.operators import annotate as an
from murmur.operators import sampling as sm
from murmur.operators.explore import parse_mixed_timestamp


@pytest.mark.parametrize("text, label, confidence, rule", [
    ("this law is not safe for anyone here", "NEGATIVE", "MEDIUM", "Rule 3"),
    ("this law is not dangerous for anyone here", "POSITIVE", "MEDIUM", "Rule 3"),
    ("it isn't a threat to any of us", "POSITIVE", "MEDIUM", "Rule 3"),
    ("we live in a surveillance state these days", "NEGATIVE", "MEDIUM", "Rule 6"),
    ("the bill will have a chilling effect on all", "NEGATIVE", "MEDIUM", "Rule 6"),
    ("a long overdue step for the whole country", "POSITIVE", "MEDIUM", "Rule 6"),
    ("a good move, well done to the drafters", "POSITIVE", "HIGH", "Rule 6"),
    ("I am worried this will affect journalists", "NEGATIVE", "MEDIUM", "Rule 2"),
    ("vague in part but a welcome first step", "NEUTRAL", "LOW", "Rule 2: balanced"),
    ("the act was signed into law on monday morning", "NEUTRAL", "MEDIUM", "NEUTRAL"),
    ("section 5 is about fees and more fees", "NEUTRAL", "LOW", "NEUTRAL"),
    ("ok then", "UNCERTAIN", "LOW", "Rule 8"), ("", "UNCERTAIN", "LOW", "Rule 8"), (None, "UNCERTAIN", "LOW", "Rule 8"),
    ("safe secure", "POSITIVE", "HIGH", "Rule 2"),
])
def test_codebook_rules(spark, text, label, confidence, rule):
    r = an.lexicon_annotate(spark.createDataFrame([(text,)], "text string")).first()
    assert (r.ai_label, r.ai_confidence) == (label, confidence) and r.ai_rule_applied.startswith(rule)


def test_annotator_failures_are_told_apart(spark):
    def annotator(rec):
        if rec["id"] == 1:
            return json.loads("no json")
        if rec["id"] == 2:
            raise ConnectionError("refused")
        raise KeyError("x" * 300)
    got = {r.id: r for r in an.annotate_with(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, text string"), annotator, "id").collect()}
    assert [got[i].ai_label for i in (1, 2, 3)] == ["UNCERTAIN", "ERROR", "ERROR"]
    assert [got[i].ai_rule_applied for i in (1, 2, 3)] == ["Parse failure", "Connection error", "API error"]
    assert len(got[3].ai_rationale) == 100


@pytest.mark.parametrize("raw, want", [
    ("2025-04-10T12:34:56.000Z", "2025-04-10 12:34:56"), ("2025-04-10T12:34:56+02:00", "2025-04-10 10:34:56"),
    ("2025-04-10 12:34:56.123", "2025-04-10 12:34:56"), ("2025-04-10", "2025-04-10 00:00:00"), ("2025/04/10 07:08", "2025-04-10 07:08:00"),
    ("12:30", None), ("2025", None), ("soon", None), (None, None), ("2025-13-40", None),
])
def test_mixed_dates(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "d string")
    assert df.select(F.date_format(parse_mixed_timestamp("d", ["yyyy/MM/dd HH:mm"]), "yyyy-MM-dd HH:mm:ss").alias("x")).first().x == want


def test_csv_keeps_every_text(spark, tmp_path):
    from murmur.sources import files
    rows = [(1, "  lead and trail  "), (2, ""), (3, None), (4, "tab\tend\n"), (5, 'q "x", y'), (6, "a\r\nb"), (7, "\\N"), (8, '""'), (9, " ")]
    df = spark.createDataFrame(rows, "id long, t string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in files.read_csv_corpus(spark, str(tmp_path / "c"), df.schema).collect()) == rows


def test_exports_are_sorted_nulls_last(spark, tmp_path):
    from murmur.sources import files
    df = spark.createDataFrame([(2, "b"), (None, "z"), (3, None), (3, "a"), (1, "c")], "n int, t string").repartition(3)
    assert [tuple(r) for r in files.sorted_export(df, ["-n", "t"]).collect()] == [(3, "a"), (3, None), (2, "b"), (1, "c"), (None, "z")]


def test_split_of_huge_classes(spark):
    counts = spark.createDataFrame([("a", 10 ** 10), ("b", 5 * 10 ** 9), ("c", 1)], "lang string, n_c long")
    q = {r.lang: r for r in sm.split_quotas(counts, "lang").collect()}
    total = 15 * 10 ** 9 + 1
    assert sum(r.train_c for r in q.values()) == total - -(-total * 3 // 10) and all(r.train_c + r.val_c + r.test_c == r.n_c for r in q.values())


def test_rows_without_label_are_in_no_split(spark):
    df = spark.range(40).withColumn("lang", F.when(F.col("id") < 30, F.concat(F.lit("l"), F.col("id") % 2)))
    got = sm.stratified_split(df, "id", "lang")
    assert got.count() == 30 and got.groupBy("split").count().count() == 3


def test_no_text_in_any_exchange_of_a_split(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    plan = sm.stratified_split(df, "doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange" in line:
            assert "text#" not in line and "text#" not in lines[i + 1]


def test_alignment_guards_name_their_cause(spark):
    from murmur.operators.evaluate import align
    one = spark.createDataFrame([(1, "x")], "id int, predicted_label string")
    two = spark.createDataFrame([(1, "x"), (1, "y")], "id int, predicted_label string")
    for truth, pred, message in ((one.select("id"), two, "predictions contain duplicated"), (two.select("id"), one, "truth contains duplicated"),
                                 (spark.range(2, 3).select(F.col("id").cast("int").alias("id")), one, "missing test records")):
        with pytest.raises(Exception, match=message):
            align(truth, pred, "id").collect()


def test_engine_session_leaves_the_callers_time_zone(spark):
    from murmur.session import engine_session
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    own = engine_session(other)
    assert own.conf.get("spark.sql.session.timeZone") == "UTC" and other.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    assert engine_session(spark) is spark


def test_excluded_rows_are_counted(spark):
    from pyspark.sql import Observation

    from murmur.operators.textops import min_token_filter
    counter = Observation("short")
    df = spark.createDataFrame([(["a"],), (["a", "b", "c"],), ([],)], "tokens array<string>")
    assert min_token_filter(df, "tokens", 3, counter).count() == 1 and counter.get["excluded_short_docs"] == 2
