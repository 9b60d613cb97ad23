"""Round trips through the file sinks and sources, into the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.plans.registry import query
from murmur.session import scratch_dir
from murmur.sources import files
from murmur.sources.tables import read_table

_DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()),
                            T.StructField("source", T.StringType()), T.StructField("text", T.StringType())])
_DOC_SQL = "SELECT doc_id, lang, source, text FROM documents"


@query("read_json_corpus", _DOC_SQL)
def read_json_corpus(spark, base):
    path = scratch_dir(spark, "jsonl")
    files.write_json(read_table(spark, base, "documents").select("doc_id", "lang", "source", "text"), path)
    back = files.read_json_corpus(spark, path, _DOC_SCHEMA)
    return back.select("doc_id", "lang", "source", "text")


@query("csv_roundtrip", _DOC_SQL)
def csv_roundtrip(spark, base):
    path = scratch_dir(spark, "csv")
    files.write_csv(read_table(spark, base, "documents").select("doc_id", "lang", "source", "text"), path)
    return files.read_csv_corpus(spark, path, _DOC_SCHEMA).select("doc_id", "lang", "source", "text")


@query("partitioned_eligibility", """
SELECT keyword_eligible, count(*) AS n FROM (
""" + __import__("murmur.plans.corpus_queries", fromlist=["_ELIG_SQL"])._ELIG_SQL + """
) GROUP BY keyword_eligible
""")
def partitioned_eligibility(spark, base):
    """Eligible / ineligible comments written in one pass, partitioned by the flag,
    then counted from the written partitions (partition pruning on read)."""
    from murmur.plans.corpus_queries import keyword_eligibility
    path = scratch_dir(spark, "eligibility")
    files.write_table(keyword_eligibility(spark, base), path, partition_by=["keyword_eligible"])
    back = spark.read.parquet(path).withColumn("keyword_eligible", F.col("keyword_eligible").cast("boolean"))
    return back.groupBy("keyword_eligible").agg(F.count(F.lit(1)).alias("n"))


_EXPORT_SQL = __import__("murmur.plans.corpus_queries", fromlist=["_EXPORT_ROWS_SQL"])._EXPORT_ROWS_SQL


@query("selection_outputs", _EXPORT_SQL)
def selection_outputs(spark, base):
    """Eligible / ineligible / selected CSVs and the JSON manifest, written and read back: one row per exported line."""
    from murmur.functions import presets
    from murmur.operators import eligibility as el
    from murmur.plans.corpus_queries import KW, SELECT_FRACTION, _RULE, _flagged_comments
    flagged = _flagged_comments(spark, base).withColumn("_doc_id", F.col("_id")).persist()
    counts = el.funnel_counts(flagged)
    size = counts.first()["selected"]
    out = scratch_dir(spark, "selection")
    el.write_selection_outputs(flagged, counts, out, sample_size=size, seed=presets.SEED, keyword_count=len(KW),
                               rule=_RULE + f" fraction={SELECT_FRACTION}", raw_path=f"{base}/conversations.parquet")
    flagged.unpersist()
    manifest = spark.read.json(f"{out}/selection_manifest_{size}_seed{presets.SEED}").first()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in
                           ("_doc_id", "text", "keyword_match_source", "comment_keyword_match", "post_title_keyword_match")])
    back = None
    for name in ("eligible", "ineligible", "selected"):
        rows = files.read_csv_corpus(spark, manifest["outputs"][name], schema).select(F.lit(name).alias("output"), "*")
        back = rows if back is None else back.unionByName(rows)
    return back.select("output", "_doc_id", "text", F.coalesce("keyword_match_source", F.lit("")).alias("keyword_match_source"),
                       F.col("comment_keyword_match").cast("boolean").alias("comment_keyword_match"),
                       F.lit(manifest["selected_comments"]).cast("long").alias("selected_comments"))


_SPLIT_COUNTS = __import__("murmur.plans.sampling_queries", fromlist=["SPLIT_CTE"]).SPLIT_CTE + """
SELECT split, lang, count(*) AS n FROM split WHERE split IN ('train', 'val') GROUP BY split, lang
"""


@query("development_rows", _SPLIT_COUNTS)
def development_rows(spark, base):
    """The split table stored partitioned by ``split``; reading train + val back
    prunes the test partition instead of filtering rows."""
    from murmur.plans.sampling_queries import doc_split
    path = scratch_dir(spark, "split")
    files.write_table(doc_split(spark, base), path, partition_by=["split"])
    dev = spark.read.parquet(path).filter(F.col("split").isin("train", "val"))
    return dev.groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))
