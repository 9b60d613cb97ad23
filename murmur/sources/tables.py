"""Reading the Parquet tables a job runs over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


SPREAD_CONF = "spark.murmur.spreadPartitions"


def read_table(spark: SparkSession, base_dir: str, name: str,
               spread_key: str | Sequence[str] | None = None) -> DataFrame:
    """``base_dir/name.parquet`` as a DataFrame.

    Nothing is selected here on purpose: callers project the columns they need
    and Catalyst prunes the scan (``ReadSchema``) and pushes filters into it.
    With ``spread_key`` and the session setting ``SPREAD_CONF`` the rows are
    hash-partitioned by that key into as many partitions as the setting says:
    an explicit choice for tables that lie in one unsplittable file (the bench
    makes it). Without the setting the scan is left as it is.
    """
    df = spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(SPREAD_CONF, None)
    if not spread_key or not n:
        return df
    return df.repartition(int(n), *([spread_key] if isinstance(spread_key, str) else spread_key))
