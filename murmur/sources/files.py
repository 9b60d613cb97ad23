"""File sources and sinks: JSON array / JSON Lines corpora, quoted multi-line
CSV, optional inputs, and writers (UTF-8, no index, Parquet by default)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COL = "_corrupt_record"


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_json_array(spark: SparkSession, path: str) -> bool:
    """Sniff the first non-blank character of the input: '[' means a JSON array."""
    first = (spark.read.text(path).selectExpr("left(ltrim(value), 1) AS v").filter("v <> ''").limit(1).collect())
    return bool(first) and first[0]["v"] == "["


def read_json_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     multi_line: bool | None = None) -> DataFrame:
    """Read a JSON array or a JSON Lines corpus with an explicit schema.

    JSON Lines is splittable; an array file is parsed as one record stream per
    file (``multiLine``), so large arrays should be converted to Parquet once.
    Malformed records are kept with their raw text in ``_corrupt_record``.
    """
    if multi_line is None:
        multi_line = is_json_array(spark, path)
    reader = spark.read.option("multiLine", multi_line).option("mode", "PERMISSIVE")
    if schema is not None:
        s = schema if CORRUPT_COL in schema.fieldNames() else T.StructType(
            list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType())])
        reader = reader.schema(s).option("columnNameOfCorruptRecord", CORRUPT_COL)
    return reader.json(path)


# White space is data. A null is written as nothing and an empty string as ""; when reading, what is unquoted and
# empty becomes a marker that no text holds, and so null.
_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false"}
_CSV_WRITE = _CSV | {"nullValue": "", "emptyValue": '""'}
_CSV_READ = _CSV | {"nullValue": "\u0000", "emptyValue": "", "mode": "PERMISSIVE"}


def read_csv_corpus(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Header CSV with quoted text fields (``"`` escapes ``"``).

    Quoted line breaks need ``multi_line``, which makes a file one task: write
    many files of bounded size. Files without them split with ``multi_line=False``.
    """
    return spark.read.schema(schema).options(**_CSV_READ).option("multiLine", multi_line).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", order_by: Sequence[str] = ()) -> None:
    """Quoted CSV, in the order of ``sorted_export``."""
    sorted_export(df, order_by).write.mode(mode).options(**_CSV_WRITE).csv(path)


def sorted_export(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Rows in export order: each key ascending, or descending with a leading ``-``; nulls last either way."""
    if not order_by:
        return df
    return df.orderBy(*[F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in order_by])


def write_json(df: DataFrame, path: str, mode: str = "overwrite", order_by: Sequence[str] = ()) -> None:
    """JSON Lines, non-ASCII characters kept as they are, in the order of ``sorted_export``."""
    sorted_export(df, order_by).write.mode(mode).option("encoding", "UTF-8").json(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_first_existing(spark: SparkSession, paths: Sequence[str], reader=None) -> DataFrame | None:
    """The first path that exists (e.g. the named result before the unnamed one), or None."""
    for p in paths:
        if _fs_exists(spark, p):
            return (reader or (lambda s, x: s.read.parquet(x)))(spark, p)
    return None
