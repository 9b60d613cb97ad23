"""Ranked lexical search: accumulators from short lists inside document-at-a-time skipping over long lists.

Terms are maximal runs of ASCII letters and digits and of all characters past
ASCII, with A-Z lower-cased. In UTF-8 such a run is a run of bytes, so texts
are cut as bytes and terms are compared whole, not by hash.

*Index.* One pass over the texts. A task gathers documents into shards of about
``SHARD_HITS`` occurrences of query terms and writes each shard as one row of
flat inverted lists (documents in order of their ids). The corpus counts (N, L,
df) are sums over the shards, so the texts are read once per pass of items.

*Search.* In a shard, the lists of an item that are shorter than one in
``LONG_SHARE`` documents are summed term at a time into accumulators, which
then behave as one more iterator with a bound of its own (their largest sum in
a window of documents). The long lists and this iterator are gone through
document at a time, window by window: iterators whose bounds together cannot
reach the tenth best score so far give no candidates; the others' documents
are the candidates, and the rest is only looked up for candidates that can
still reach it, most promising list first, skipping everything between.
Windows whose bounds cannot reach the score are skipped whole. Every skip
compares an upper bound with a score that ten documents have, so the result is
exact. A shard returns ten documents an item; a window function merges them.

Items are the stated queries. They are dealt by hash into passes of about
``PASS_BYTES`` of text, which bounds the vocabulary that the workers hold.

Defined results: null and empty texts have no terms; rows of items equal in id
and text are one item; items without terms have no rows; documents equal in id
are ranked each on its own; null ids come last among equal scores; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import stored

K = 10
SHARD_HITS = 1 << 20
LONG_SHARE = 64
WINDOW = 8192
PASS_BYTES = 4 << 20

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
Item = tuple[int | None, list[tuple[int, int]]]


def terms(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return raw.translate(_TERM_BYTES).split() if raw else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_terms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with these numbers of terms."""
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 1 << 63:  # beyond 64 bits: python's integers
        return np.array([25 + 75 * int(n) * n_docs // n_terms for n in lengths], dtype=np.int64)
    return 25 + 75 * lengths * n_docs // n_terms


class Shard:
    """Flat inverted lists of some documents, with what each occurrence adds to a score before its weight."""

    def __init__(self, lengths: np.ndarray, present: np.ndarray, sizes: np.ndarray, docs: np.ndarray, tfs: np.ndarray,
                 n_docs: int, n_terms: int, window: int = WINDOW, long_share: int = LONG_SHARE):
        self.rows, self.docs, self.window, self.long_share = len(lengths), docs, window, long_share
        m = length_terms(lengths, n_docs, n_terms)
        tf = tfs.astype(np.int64)
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m[docs])
        ends = np.cumsum(sizes)
        self.span = {int(t): (int(e - s), int(e)) for t, s, e in zip(present, sizes, ends, strict=True)}
        self._edges: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _windows(self, docs: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window starts in a list, and the list's largest part in each window."""
        edges = np.searchsorted(docs, np.arange(0, self.rows + self.window, self.window))
        top = np.zeros(len(edges) - 1, dtype=np.int64)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        if len(some):
            top[some] = np.maximum.reduceat(part, edges[:-1][some])
        return edges, top

    def top(self, query: list[tuple[int, int]], k: int = K) -> list[tuple[int, int]]:
        """(place, score) of the ``k`` best documents for (term, weight) pairs, best first, ties by place."""
        own = [(t, w) for t, w in query if w > 0 and t in self.span]
        is_long = {t: (self.span[t][1] - self.span[t][0]) * self.long_share > self.rows for t, _ in own}
        iterators = []  # (documents, parts, weight, window starts, window bounds)
        short = [(t, w) for t, w in own if not is_long[t]]
        floor = 1
        if short:
            docs = np.concatenate([self.docs[slice(*self.span[t])] for t, _ in short])
            part = np.concatenate([self.part[slice(*self.span[t])] * w for t, w in short])
            order = np.argsort(docs, kind="stable")
            docs, part = docs[order], part[order]
            first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
            docs, part = docs[first], np.add.reduceat(part, first)
            iterators.append((docs, part, 1, *self._windows(docs, part)))
            if len(part) >= k:
                floor = max(floor, int(np.partition(part, len(part) - k)[len(part) - k]))
        for t, w in own:
            if is_long[t]:
                docs, part = self.docs[slice(*self.span[t])], self.part[slice(*self.span[t])]
                if t not in self._edges:
                    self._edges[t] = self._windows(docs, part)
                iterators.append((docs, part, w, *self._edges[t]))
        if not iterators:
            return []
        best_docs, best = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        bounds = np.stack([top * w for _, _, w, _, top in iterators])
        for j in np.flatnonzero(bounds.sum(axis=0) >= floor):
            if bounds[:, j].sum() < floor:
                continue
            docs, score = self._window(iterators, bounds[:, j], j, floor)
            best_docs, best = np.concatenate((best_docs, docs)), np.concatenate((best, score))
            if len(best) > k:
                keep = np.lexsort((best_docs, -best))[:k]
                best_docs, best = best_docs[keep], best[keep]
            if len(best) == k:
                floor = max(floor, int(best.min()))
        keep = np.lexsort((best_docs, -best))[:k]
        return [(int(d), int(s)) for d, s in zip(best_docs[keep], best[keep], strict=True) if s > 0]

    @staticmethod
    def _window(iterators: list[tuple], bounds: np.ndarray, j: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of window ``j`` that score ``floor`` or more, and their scores."""
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])  # what the iterators up to each one can add together
        split = int(np.searchsorted(reach, floor))  # below: cannot reach the floor without the others
        slices = [(it[0][it[3][j]:it[3][j + 1]], it[1][it[3][j]:it[3][j + 1]], it[2]) for it in iterators]
        docs = np.concatenate([slices[i][0] for i in order[split:]])
        score = np.concatenate([slices[i][1] * slices[i][2] for i in order[split:]])
        if not len(docs):
            return docs.astype(np.int64), score
        by = np.argsort(docs, kind="stable")
        docs, score = docs[by], score[by]
        first = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        docs, score = docs[first].astype(np.int64), np.add.reduceat(score, first)
        for i in range(split - 1, -1, -1):
            can = score + reach[i] >= floor
            docs, score = docs[can], score[can]
            if not len(docs):
                return docs, score
            listed, part, w = slices[order[i]]
            if len(listed):
                at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
                score = score + np.where(listed[at] == docs, part[at] * w, 0)
        can = score >= floor
        return docs[can], score[can]


# --- Spark ----------------------------------------------------------------------

_SHARD = ("ids array<long>, lengths binary, n_docs long, n_terms long, present array<int>, sizes array<int>, docs binary, tfs binary")
_NAMES = [x.split()[0] for x in _SHARD.split(", ")]


def _shard_row(ids: list, lengths: list[int], n_docs: int, n_terms: int, hits: list[np.ndarray]) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    owner = np.repeat(place, [len(h) for h in hits])
    flat = np.concatenate(hits) if hits else np.empty(0, dtype=np.int64)
    cells, tfs = np.unique(flat * max(len(ids), 1) + owner, return_counts=True)
    found, docs = np.divmod(cells, max(len(ids), 1))
    present, sizes = np.unique(found, return_counts=True)
    values = [[ids[i] for i in order], np.array(lengths, dtype=np.int64)[order].tobytes(), n_docs, n_terms, present.astype(np.int32),
              sizes.astype(np.int32), docs.astype(np.int32).tobytes(), tfs.astype(np.int32).tobytes()]
    types = [pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=_NAMES)


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], shard_hits: int = SHARD_HITS) -> DataFrame:
    """One row per shard of (id, raw) documents: lists of the vocabulary's terms, ids, lengths and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        ids, lengths, hits, n_docs, n_terms, held = [], [], [], 0, 0, 0
        for batch in batches:
            for key, raw in zip(batch.column("id"), batch.column("raw"), strict=True):
                words = terms(raw.as_py())
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                own = [t for t in map(known, words) if t is not None]
                if own:
                    ids.append(key.as_py())
                    lengths.append(len(words))
                    hits.append(np.array(own, dtype=np.int64))
                    held += len(own)
                if held >= shard_hits:
                    yield _shard_row(ids, lengths, n_docs, n_terms, hits)
                    ids, lengths, hits, n_docs, n_terms, held = [], [], [], 0, 0, 0
        if n_docs:
            yield _shard_row(ids, lengths, n_docs, n_terms, hits)
    return docs.mapInArrow(run, _SHARD)


def search_index(index: DataFrame, items: list[Item], n_docs: int, n_terms: int, weights: dict[int, int], k: int = K) -> DataFrame:
    """(item, item_id, doc_id, score): the ``k`` best documents of every shard for each item."""
    shared = index.sparkSession.sparkContext.broadcast(
        [(i, item_id, [(t, weights[t] * n) for t, n in own if t in weights]) for i, (item_id, own) in enumerate(items)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {name: batch.column(name)[row] for name in _NAMES}
                flat = {c: np.frombuffer(cell[c].as_buffer(), t) for c, t in (("lengths", np.int64), ("docs", np.int32), ("tfs", np.int32))}
                ids = cell["ids"].values
                shard = Shard(flat["lengths"], np.array(cell["present"].values), np.array(cell["sizes"].values, dtype=np.int64),
                              flat["docs"], flat["tfs"], n_docs, n_terms)
                out = [(i, item_id, d, s) for i, item_id, query in shared.value for d, s in shard.top(query, k)]
                if out:
                    number, item_id, places, score = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(item_id, pa.int64()),
                                                      ids.take(pa.array(places, pa.int64())), pa.array(score, pa.int64())],
                                                     names=["item", "item_id", "doc_id", "score"])
    return index.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def _passes(items: DataFrame, pass_bytes: int) -> Iterator[list[pd.Series]]:
    """The items in passes of about ``pass_bytes`` of text, dealt by a hash."""
    total = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-total // pass_bytes))
    for p in range(n):
        own = items.filter(F.pmod(F.xxhash64("id", "raw"), F.lit(n)) == p).collect()
        yield sorted(own, key=lambda r: (r["id"] is None, r["id"] or 0, bytes(r["raw"])))


def search(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = K, pass_bytes: int = PASS_BYTES, shard_hits: int = SHARD_HITS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item."""
    rows = docs.select(docs[f"`{doc_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("binary").alias("raw"))
    asked = items.select(items[f"`{item_col}`"].cast("long").alias("id"), items[f"`{item_text_col}`"].cast("binary").alias("raw"))
    asked = asked.filter("octet_length(raw) > 0").distinct()
    found = None
    for n_pass, own in enumerate(_passes(asked, pass_bytes)):
        vocabulary: dict[bytes, int] = {}
        queries = [(r["id"], [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in Counter(terms(bytes(r["raw"]))).items()])
                   for r in own]
        index = stored(build_index(rows.filter("raw IS NOT NULL"), vocabulary, shard_hits), "lists")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        counts = index.select(F.explode(F.arrays_zip("present", "sizes")).alias("x")).groupBy("x.present").agg(F.sum("x.sizes").alias("df"))
        weights = {r["present"]: weight(n_docs, r["df"]) for r in counts.collect()}  # at most the pass's vocabulary
        part = search_index(index, queries, n_docs or 0, n_terms or 0, weights, k).withColumn("pass", F.lit(n_pass))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("pass", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
