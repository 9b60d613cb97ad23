"""Streaming jobs resume from their checkpoint without duplicating output."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_stream_annotate_restart_is_exactly_once(spark, tmp_path):
    from murmur.sources.tables import read_table
    from murmur.streaming import jobs
    schema = read_table(spark, SF, "documents").schema
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    n = read_table(spark, SF, "documents").count()
    jobs.stream_annotate(jobs.file_stream(spark, f"{SF}/documents.parquet*", schema), out, ckpt)
    first = spark.read.parquet(out).count()
    # A restarted job with the same checkpoint finds no new input and writes nothing again.
    jobs.stream_annotate(jobs.file_stream(spark, f"{SF}/documents.parquet*", schema), out, ckpt)
    assert first == n == spark.read.parquet(out).count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_stream_weekly_volume_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from murmur.operators.explore import weekly_volume
    from murmur.sources.tables import read_table
    from murmur.streaming import jobs
    ev = read_table(spark, SF, "events")
    out, ckpt = str(tmp_path / "w"), str(tmp_path / "c")
    jobs.stream_weekly_volume(jobs.file_stream(spark, f"{SF}/events.parquet*", ev.schema), out, ckpt)
    got = {(r["week"].date().isoformat(), r["event_type"], r["comments"])
           for r in jobs.read_weekly_volume(spark, out).collect()}
    batch = weekly_volume(ev, "ts", "event_type").select(
        F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "comments")
    assert got == {(r["week"], r["event_type"], r["comments"]) for r in batch.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_weekly_volume_upsert_over_several_epochs(spark, tmp_path):
    from pyspark.sql import functions as F

    from murmur.operators.explore import weekly_volume
    from murmur.sources.tables import read_table
    from murmur.streaming import jobs
    ev = read_table(spark, SF, "events")
    src = str(tmp_path / "src")
    # Three arrival files (earliest events first), streamed one file per micro-batch.
    ev.repartitionByRange(3, "ts").write.parquet(src)
    out, ckpt = str(tmp_path / "w"), str(tmp_path / "c")
    jobs.stream_weekly_volume(jobs.file_stream(spark, src, ev.schema, max_files=1), out, ckpt)
    assert spark.read.parquet(out).select("epoch").distinct().count() >= 2
    got = {(r["week"].date().isoformat(), r["event_type"], r["comments"])
           for r in jobs.read_weekly_volume(spark, out).collect()}
    batch = weekly_volume(ev, "ts", "event_type").select(
        F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "comments")
    assert got == {(r["week"], r["event_type"], r["comments"]) for r in batch.collect()}


def test_late_rows_are_counted(spark, tmp_path):
    """Three files whose dates go back in time: every row counts."""
    import datetime as dt

    from murmur.streaming import jobs
    src = str(tmp_path / "src")
    for i, day in enumerate((dt.datetime(2025, 3, 1), dt.datetime(2025, 3, 20), dt.datetime(2025, 1, 2))):
        spark.createDataFrame([(day, "click")] * 5, "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    out = str(tmp_path / "w")
    jobs.stream_weekly_volume(jobs.file_stream(spark, src, schema, max_files=1), out, str(tmp_path / "c"))
    assert sum(r["comments"] for r in jobs.read_weekly_volume(spark, out).collect()) == 15
    compacted = jobs.compact_weekly_volume(spark, out, str(tmp_path / "k"))
    assert sorted(r["comments"] for r in compacted.collect()) == [5, 5, 5]


def test_stream_of_many_files_is_drained(spark, tmp_path):
    from pyspark.sql import functions as F

    from murmur.streaming import jobs
    src = str(tmp_path / "src")
    spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a safe law").alias("text")).repartition(60, "doc_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = str(tmp_path / "o")
    jobs.stream_annotate(jobs.file_stream(spark, src, schema, max_files=7), out, str(tmp_path / "c"))
    assert spark.read.parquet(out).count() == 60
