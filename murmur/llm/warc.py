"""WARC archives written and read as a chunked record table.

A payload never travels as one record. The writer cuts it into chunks of at
most ``CHUNK_BYTES`` and makes rows (record, chunk number, bytes), each with
the SHA-1 of the payload up to that chunk, carried on from chunk to chunk.
Chunk 1 becomes the ``response`` record, each later chunk a ``continuation``
record (WARC 1.1 segmentation: ``WARC-Segment-Number`` and
``WARC-Segment-Origin-ID``), so an archive holds only small records.

Archives are gzipped files of Spark's text writer, one a writing task: a row is
one record and the line separator is the blank line that ends a record. They
are read by splitting at ``WARC/1.1``; the writer also cuts chunks inside any
such mark in a payload, so a mark in the file always begins a record. Each
reading task carries the incremental digest over the chunks of a record in
order and checks it against every record's header; a damaged archive fails
loudly.

Defined results: a null payload is an empty one; repeated rows are records of
their own; equal ids with different payloads are kept apart; an empty table
gives an empty archive. Other columns are not touched, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 64 * 1024
REVISIT_BYTES = 1000
SALTS = 16
MARK = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"

_RECORD = "record string, record_id long, uri string, kind string, refers_to long, segment int, segments int, " \
          "data binary, running string, payload_bytes long, payload_digest string"


def chunks(payload: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes (at least one piece), none holding a whole ``MARK``.

    Pieces end on UTF-8 character borders where the payload is UTF-8.
    """
    at, n = 0, len(payload)
    view = memoryview(payload)
    while True:
        end = min(n, at + size)
        mark = payload.find(MARK, at, end)
        if mark >= 0:
            end = mark + 4
        elif end < n:
            back = end
            while back > max(at + 1, end - 4) and payload[back] & 0xC0 == 0x80:
                back -= 1
            end = back if payload[back] & 0xC0 != 0x80 else end
        yield bytes(view[at:end])
        at = end
        if at >= n:
            return


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, uri_col: str,
                  least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(record_id, uri, html, refers_to): of equal payloads of at least ``least_bytes`` bytes the one
    with the largest id keeps its payload, the others refer to it.

    Groups are counted by digest with map-side combining; only digests met
    twice are joined back, spread over ``SALTS`` copies so that a payload held
    by a third of all rows is no single task.
    """
    rows = pages.select(pages[f"`{id_col}`"].cast("long").alias("record_id"),
                        pages[f"`{uri_col}`"].cast("string").alias("uri"),
                        F.coalesce(pages[f"`{payload_col}`"], F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary")))
    groups = (rows.select(digest.alias("digest"), "record_id").filter(F.col("digest").isNotNull())
              .groupBy("digest").agg(F.max("record_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("digest", "keeper")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    left = rows.withColumn("digest", digest).withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    joined = left.join(groups.hint("shuffle_hash"), ["digest", "salt"], "left")
    return joined.select("record_id", "uri", "html",
                         F.when(F.col("keeper") != F.col("record_id"), F.col("keeper")).alias("refers_to"))


def record_chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: one row per record and chunk; revisits have one chunk without data."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record_id, uri, html, refers in zip(batch["record_id"], batch["uri"], batch["html"], batch["refers_to"],
                                                    strict=True):
                payload = html.encode("utf-8")
                pieces = list(chunks(payload, chunk_bytes))
                has_id = not pd.isna(record_id)
                name = hashlib.sha1(f"{record_id if has_id else ''}:".encode()
                                    + hashlib.sha1(payload).digest()).hexdigest()
                state, running = hashlib.sha1(), []
                for piece in pieces:
                    state.update(piece)
                    running.append(state.hexdigest())
                revisit = not pd.isna(refers)
                if revisit:
                    pieces, running = [b""], [running[-1]]
                for k, piece in enumerate(pieces):
                    out.append((name, int(record_id) if has_id else None, uri, "revisit" if revisit else "response",
                                int(refers) if revisit else None, k + 1, len(pieces), piece, running[k],
                                len(payload), state.hexdigest()))
                    if len(out) >= 256:
                        yield pd.DataFrame(out, columns=_names()).astype({"record_id": "Int64", "refers_to": "Int64"})
                        out = []
            if out:
                yield pd.DataFrame(out, columns=_names()).astype({"record_id": "Int64", "refers_to": "Int64"})
    return rows.mapInPandas(run, _RECORD)


def _names() -> list[str]:
    return [f.split()[0] for f in _RECORD.split(", ")]


def _line(name: str, value) -> F.Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(chunk_rows: DataFrame, path: str) -> None:
    """Write the chunk table as WARC 1.1 files below ``path``, a record per row."""
    c = F.col
    later = c("segment") > 1
    urn = F.concat(F.lit("<urn:sha1:"), c("record"), F.lit(">"))
    http = F.when(later, F.lit("")).otherwise(F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        c("payload_bytes").cast("string"), F.lit("\r\n\r\n")))
    block = F.concat(http.cast("binary"), c("data"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(later, F.lit("continuation")).otherwise(c("kind"))),
        _line("WARC-Record-ID", F.when(later, F.concat(F.lit("<urn:sha1:"), c("record"), F.lit(":"),
                                                       c("segment").cast("string"), F.lit(">"))).otherwise(urn)),
        _line("WARC-Segment-Origin-ID", F.when(later, urn)),
        _line("WARC-Segment-Number", F.when(c("segments") > 1, c("segment"))),
        _line("WARC-Segment-Total", c("segments")),
        _line("WARC-Target-URI", F.regexp_replace("uri", "[\\r\\n]", "")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Source-ID", c("record_id")),
        _line("WARC-Refers-To-Source-ID", c("refers_to")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("payload_digest"))),
        _line("WARC-Running-Digest", F.concat(F.lit("sha1:"), c("running"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)), F.lit("\r\n"))
    rows = chunk_rows.select(F.concat(header.cast("binary"), block).cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Archive records as a chunk table, parsed by Spark expressions; a wrong Content-Length raises."""
    raw = spark.read.schema("value string").option("lineSep", MARK.decode()).text(path).filter("value <> ''")
    split = F.instr("value", "\r\n\r\n")
    head = F.substring_index("value", "\r\n\r\n", 1)
    bytes_ = F.col("value").cast("binary")
    size = F.octet_length("head") + 4

    def field(name: str):
        return F.nullif(F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r\n]*)", 1), F.lit(""))

    rows = raw.select(head.alias("head"), bytes_.alias("raw"), split.alias("split"))
    rows = rows.withColumn("length", field("Content-Length").cast("long"))
    whole = F.octet_length("raw") == size + F.col("length") + 4
    block = F.when(whole & (F.col("split") > 0), F.expr("substring(raw, octet_length(head) + 5, int(length))")).otherwise(
        F.raise_error(F.concat(F.lit("damaged WARC record: "), F.substring("head", 1, 200))).cast("binary"))
    rows = rows.withColumn("block", block)
    kind = field("WARC-Type")
    http = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    first = kind != "continuation"
    origin = F.when(first, field("WARC-Record-ID")).otherwise(field("WARC-Segment-Origin-ID"))
    return rows.select(
        F.regexp_extract(origin, "sha1:([0-9a-f]+)", 1).alias("record"),
        field("WARC-Source-ID").cast("long").alias("record_id"), field("WARC-Target-URI").alias("uri"),
        kind.alias("kind"), field("WARC-Refers-To-Source-ID").cast("long").alias("refers_to"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("segment"),
        field("WARC-Segment-Total").cast("int").alias("segments"),
        F.when(first, F.expr("substring(block, octet_length(substring_index(cast(block AS string), '\\r\\n\\r\\n', 1)) + 5,"
                             " octet_length(block))")).otherwise(F.col("block")).alias("data"),
        F.substring(field("WARC-Running-Digest"), 6, 40).alias("running"),
        F.when(first, F.regexp_extract(http, "Content-Length: ([0-9]+)", 1).cast("long")).alias("payload_bytes"),
        F.substring(field("WARC-Payload-Digest"), 6, 40).alias("payload_digest"))


_READ = "record_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived record: id, uri, type, reference, and the payload's length and SHA-1.

    Records of one chunk are digested where they are read. The chunks of
    larger records are brought together by record and read in chunk order; a
    task holds one chunk and the digest's state, never a whole payload.
    """
    rows = read_records(spark, path)
    single = rows.filter("segments = 1")
    digest = F.when(F.col("kind") == "revisit", F.col("payload_digest")).otherwise(F.sha1("data"))
    length = F.when(F.col("kind") == "revisit", F.col("payload_bytes")).otherwise(F.octet_length("data").cast("long"))
    good = (digest == F.col("payload_digest")) & (length == F.col("payload_bytes"))
    single = single.select("record_id", "uri", F.col("kind").alias("record_type"), "refers_to",
                           F.when(good, length).otherwise(F.raise_error(F.lit("payload differs from its digest"))
                                                          .cast("long")).alias("payload_bytes"),
                           digest.alias("payload_digest"))

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, size, want, first = None, 0, 1, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if want == 1:
                    state, size, first = hashlib.sha1(), 0, r
                if r.segment != want or r.record != first.record:
                    raise ValueError(f"record {first.record}: chunk {want} is missing")
                state.update(r.data)
                size += len(r.data)
                if state.hexdigest() != r.running:
                    raise ValueError(f"record {r.record}: chunk {want} differs from its digest")
                want += 1
                if r.segment == r.segments:
                    if size != first.payload_bytes or state.hexdigest() != first.payload_digest:
                        raise ValueError(f"record {r.record}: payload differs from its digest")
                    out.append((first.record_id, first.uri, first.kind, None, size, state.hexdigest()))
                    want = 1
            if out:
                yield pd.DataFrame(out, columns=[f.split()[0] for f in _READ.split(", ")]).astype(
                    {"record_id": "Int64", "refers_to": "Int64"})
        if want != 1:
            raise ValueError(f"record {first.record}: chunk {want} is missing")

    several = rows.filter("segments > 1")
    # Repeated rows are equal records: each copy of a chunk gets a number, so copies are read one after another.
    n = several.sparkSession.conf.get("spark.sql.shuffle.partitions")
    copy = F.row_number().over(_by("record", "segment"))
    several = (several.withColumn("copy", copy).repartition(int(n), "record", "copy")
               .sortWithinPartitions("record", "copy", "segment").drop("copy"))
    return single.unionByName(several.mapInPandas(joined, _READ))


def _by(*cols: str):
    from pyspark.sql import Window
    return Window.partitionBy(*cols).orderBy(F.lit(1))


def round_trip(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html",
               uri_col: str = "url", chunk_bytes: int = CHUNK_BYTES, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Archive ``pages`` below ``path`` and return what the archives hold."""
    write_archives(record_chunks(with_revisits(pages, id_col, payload_col, uri_col, least_bytes), chunk_bytes), path)
    return read_payloads(spark, path)


