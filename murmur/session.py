"""Session construction and the shared scratch location.

On a cluster the scratch location is the shared folder named by
``spark.checkpoint.dir``; where that is unset, a local master (tests) gets a
temporary folder and any other master is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every murmur job relies on: UTC wall clock (weekly buckets and date
# facets are defined in UTC), ANSI arithmetic (so coercions are explicit
# ``try_*`` calls), AQE for runtime coalescing and skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark runs a Python worker per core: numpy's own threads would only contend.
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "murmur", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("MURMUR_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def engine_session(spark: SparkSession) -> SparkSession:
    """A session for the queries: the caller's own if its time zone is UTC, else a sibling with the caller's
    settings and UTC (weeks and dates are defined in UTC). The caller's session is never changed."""
    if spark.conf.get("spark.sql.session.timeZone", None) in ("UTC", "Etc/UTC"):
        return spark
    sibling = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if sibling.conf.isModifiable(k):
            sibling.conf.set(k, v)
    sibling.conf.set("spark.sql.session.timeZone", "UTC")
    return sibling


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared folder. Only a local master gets a temporary one where none is set: on a cluster each
    host would write its own."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="murmur-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder and read back, so that it is computed once."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
