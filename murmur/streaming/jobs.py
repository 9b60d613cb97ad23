"""Structured Streaming jobs: incremental annotation, scoring, weekly volume.

Sources are Parquet file streams (``maxFilesPerTrigger`` bounds each batch);
sinks are exactly-once: the file sink (append) or ``foreachBatch`` writing
an idempotent per-epoch result. Every job keeps its checkpoint in the shared
checkpoint folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.annotate import lexicon_annotate


def file_stream(spark: SparkSession, path_glob: str, schema, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path_glob)


def run_available(writer) -> None:
    """Process everything available now, then stop (batch-style run of a stream). Waits for the end; a failed
    stream raises."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream_annotate(stream: DataFrame, out_path: str, checkpoint: str, key: str = "doc_id",
                    text_col: str = "text") -> None:
    """Annotate comments as they arrive; append to a Parquet table exactly once."""
    ann = lexicon_annotate(stream.select(key, text_col)).drop(text_col)
    run_available(ann.writeStream.format("parquet").option("path", out_path)
                  .option("checkpointLocation", checkpoint).outputMode("append"))


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out_path: str,
                 checkpoint: str) -> None:
    """Score each micro-batch with a fitted model (``foreachBatch``); each epoch
    is written to its own folder, so a replayed epoch overwrites itself."""
    def sink(batch: DataFrame, epoch: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    run_available(stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint))


def stream_weekly_volume(stream: DataFrame, out_path: str, checkpoint: str, ts_col: str = "ts",
                         label_col: str = "event_type") -> None:
    """Weekly (Monday-start, UTC) counts per label, exact however late events arrive.

    Every micro-batch writes its own counts to a folder of its epoch (a
    replayed epoch overwrites itself), and ``read_weekly_volume`` adds the
    epochs. Counts are additive, so neither state nor a watermark is needed and
    no late row is lost. ``compact_weekly_volume`` keeps the folders few.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        ts = F.col(ts_col).cast("timestamp")
        counts = (batch.filter(ts.isNotNull())
                  .groupBy(F.window(ts, "7 days", startTime="4 days").alias("w"), F.col(label_col))
                  .agg(F.count(F.lit(1)).alias("comments")))
        (counts.select(F.col("w.start").alias("week"), label_col, "comments")
               .write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}"))

    run_available(stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint))


def read_weekly_volume(spark: SparkSession, out_path: str, label_col: str = "event_type") -> DataFrame:
    """The current table: the sum of all epochs' counts."""
    return spark.read.parquet(out_path).groupBy("week", label_col).agg(F.sum("comments").alias("comments"))


def compact_weekly_volume(spark: SparkSession, out_path: str, compacted_path: str, label_col: str = "event_type") -> DataFrame:
    """Write the sum of all epochs of a stopped stream as epoch -1 below a new folder, which a stream with a new
    checkpoint may go on filling."""
    read_weekly_volume(spark, out_path, label_col).write.mode("overwrite").parquet(f"{compacted_path}/epoch=-1")
    return read_weekly_volume(spark, compacted_path, label_col)
