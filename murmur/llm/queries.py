"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (ann, decontaminate, html_text, langid, lexical, minhash, mixing, passages, pii, quality, sharding, warc,
                        whiten)
from murmur.llm.common import scratch_path, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return run
    return wrap


@query("op1_html_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages)


@query("op2_warc", """
WITH e AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), k AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM e
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM k
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(spark, table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return out.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _shard_sql(n: int) -> str:
    costs = ", ".join(f"{{'cost': -ln((CAST(CAST('0x' || substr(md5(k || '/{i}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)"
                      f" / 4503599627370496.0), 's': {i}}}" for i in range(n))
    return f"CAST((list_min([{costs}])).s AS INTEGER)"


# CRC-32 from its polynomial: the table of 256 bytes, then the bytes of the text one after another.
_OP5_SQL = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), c AS (
  SELECT doc_id, k, CAST(length(h) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(
      regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))),
      lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, t
), s AS (
  SELECT *, {_shard_sql(8)} AS shard, {_shard_sql(9)} AS grown_shard, md5(k || ':' || CAST(text_crc32 AS VARCHAR)) AS o FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY o, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard
FROM s
"""


@query("op5_sharding", _OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w
  FROM s
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lvl
  FROM f WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN ratio > rest THEN rest * w ELSE cap END AS target
  FROM (SELECT *, (SELECT lvl FROM l WHERE ratio > lvl ORDER BY ratio, lvl DESC LIMIT 1) AS rest FROM l)
), r AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS repeats FROM t
), b AS (
  SELECT source, source_size, target, repeats, target - repeats * source_size AS budget FROM r
), h AS (
  SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.repeats, b.budget,
    substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || md5(coalesce(d.text, ''))), 1, 9) AS hash
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
), c AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY hash) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY source, hash) AS BIGINT) AS words
  FROM h
)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (repeats + CASE WHEN upto <= budget OR (upto - words <= budget AND upto - budget <= budget - upto + words)
                              THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


@query("op9_mixing", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op4_contamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_near_duplicates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


@query("op8_nearest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_quality")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_OP13_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')""".replace("\\\\", "\\")

_OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_OP13_TERMS} AS words FROM documents
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS total FROM d WHERE len(words) > 0
), i AS (
  SELECT row_number() OVER () AS item, item_id, {_OP13_TERMS} AS words FROM (SELECT DISTINCT item_id, text FROM benchmark)
), q AS (
  SELECT item, item_id, term, count(*) AS n FROM (SELECT item, item_id, unnest(words) AS term FROM i) GROUP BY ALL
), tf AS (
  SELECT row, doc_id, length, term, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS length, unnest(words) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf GROUP BY term
), p AS (
  SELECT item, item_id, row, doc_id, CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op13_lexical_search", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
