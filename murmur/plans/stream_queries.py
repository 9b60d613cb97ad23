"""Streaming queries: the table file is replayed as a file stream, processed
with ``availableNow``, and the sink is read back. Their oracles are the batch
queries' SQL, so stream == batch is checked directly."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.plans.annotation_queries import LEXICON_CTE
from murmur.plans.registry import ORACLE_SQL, query
from murmur.session import scratch_dir
from murmur.sources.tables import read_table
from murmur.streaming import jobs


def _stream(spark, base, name: str):
    schema = read_table(spark, base, name).schema
    return jobs.file_stream(spark, f"{base.rstrip('/')}/{name}.parquet*", schema)


@query("stream_annotate", LEXICON_CTE + " SELECT doc_id, ai_label, ai_confidence, ai_rationale, ai_rule_applied FROM lex")
def stream_annotate(spark, base):
    out, ckpt = scratch_dir(spark, "stream-annotate"), scratch_dir(spark, "ckpt")
    jobs.stream_annotate(_stream(spark, base, "documents"), out, ckpt)
    return spark.read.parquet(out).select("doc_id", "ai_label", "ai_confidence", "ai_rationale", "ai_rule_applied")


@query("stream_weekly_volume", ORACLE_SQL["weekly_volume"])
def stream_weekly_volume(spark, base):
    out, ckpt = scratch_dir(spark, "stream-weekly"), scratch_dir(spark, "ckpt")
    jobs.stream_weekly_volume(_stream(spark, base, "events"), out, ckpt)
    return jobs.read_weekly_volume(spark, out).select(F.date_format("week", "yyyy-MM-dd").alias("week"),
                                                      "event_type", "comments")


@query("stream_score")
def stream_score(spark, base):
    from murmur.plans.model_queries import _text_model
    model = _text_model(spark, base)

    def score(batch):
        return model.predict(batch.select("doc_id", "text"), "doc_id", "text")

    out, ckpt = scratch_dir(spark, "stream-score"), scratch_dir(spark, "ckpt")
    jobs.stream_score(_stream(spark, base, "documents"), score, out, ckpt)
    return spark.read.parquet(out).select("doc_id", "predicted_label")
