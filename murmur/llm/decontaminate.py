"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

The index holds the test items; every training passage is a query. A passage
is a window of ``2 S`` words every ``S`` words, where ``S`` is the longest item
of the item's length class (a power of two), so that every item that occurs in
a document lies whole in some passage. Whole documents are read.

A query counts each of its words once (BM25 with k3 = 0: passages are long, and
repeating a word makes them no more like an item). An item's threshold is the
least score that a passage can have which contains the share ``SIMILARITY`` of
the item's five-word shingles: its score against itself, less the words that a
passage may lack, dearest first. So retrieval above the threshold loses no
passage that verification would keep.

Search of a block of documents: the block-max bounds of every passage for every
block of ``BLOCK_ITEMS`` items are one gather and one segmented sum; only
passages whose bound reaches a block's lowest threshold go on to WAND, which
walks the postings with pivots and skips by the same block maxima. Found items
are verified by the overlap of question and answer shingles with the passage.

The index is gathered in passes of at most ``PASS_ITEMS`` items and about
``PASS_BYTES`` of text, whatever the benchmark's size; term statistics cover
all items. A pass is broadcast, so its size is bounded.

Defined results: null or empty texts match nothing and items without words are
not indexed; items shorter than five words must occur word for word; equal
items are all reported; repeated documents are reported each; empty tables
give empty results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import SHINGLE_WORDS, SIMILARITY, Words, blocks, shingles

K1, B = 1.2, 0.75
BLOCK_ITEMS = 4
LEAST_CLASS = 32
PART_SIMILARITY = 0.5
PASS_ITEMS = 20_000
PASS_BYTES = 32 << 20
COLUMNS = 64

_HIT = "array<struct<item_id: long, first_word: int, score: double, question: double, answer: double, overlap: double>>"


def answer_begin(text: str) -> int:
    """Where an item's answer begins: after its last question mark, else its last line, else its last sentence."""
    body = text.rstrip()
    for mark in ("?", "\n", ". "):
        at = body.rfind(mark, 0, max(len(body) - 1, 0))
        if at >= 0:
            return at + len(mark)
    return len(text)


class LengthClass:
    """Items of up to ``width`` words: postings, block maxima and thresholds (items numbered in order)."""

    def __init__(self, width: int, items: list[tuple], idf: dict[int, float], average: float):
        self.width, self.items = width, items
        postings: dict[int, list[tuple[int, float]]] = {}
        self.threshold = np.zeros(len(items))
        for i, (_, words, grams, _) in enumerate(items):
            tf = Counter(words.tolist())
            norm = K1 * (1 - B + B * len(words) / average)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
            for t, w in impact.items():
                postings.setdefault(t, []).append((i, w))
            dear = sorted(impact.values(), reverse=True)
            lack = math.floor((1 - SIMILARITY) * len(grams) + 1e-9) if len(words) >= SHINGLE_WORDS else 0
            self.threshold[i] = sum(dear[lack:]) * (1 - 1e-9)
        self.terms = np.array(sorted(postings), dtype=np.uint64)
        self.postings = [(np.array([i for i, _ in postings[t]]), np.array([w for _, w in postings[t]]))
                         for t in self.terms.tolist()]
        self.n_blocks = -(-len(items) // BLOCK_ITEMS)
        self.block_max = np.zeros((len(self.terms), self.n_blocks), dtype=np.float32)
        for k, (ids, weights) in enumerate(self.postings):
            np.maximum.at(self.block_max[k], ids // BLOCK_ITEMS, np.nextafter(weights.astype(np.float32), np.float32(np.inf)))
        self.term_max = self.block_max.max(axis=1) if len(self.terms) else np.zeros(0)
        self.block_low = np.array([self.threshold[b * BLOCK_ITEMS:(b + 1) * BLOCK_ITEMS].min()
                                   for b in range(self.n_blocks)])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words in no item."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def passages(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, first word, end) of the passages whose block-max bound reaches some block's lowest threshold."""
        counts = np.diff(offsets)
        halves = -(-counts // self.width)  # passage h holds the halves h and h + 1 of its document
        base = np.concatenate(([0], np.cumsum(halves)))
        known = np.flatnonzero(ids >= 0)
        if not len(known):
            return
        doc = np.searchsorted(offsets, known, side="right") - 1
        half = base[doc] + (known - offsets[doc]) // self.width
        back = half > base[doc]
        n = len(self.terms)
        pairs = np.unique(np.concatenate((half * n + ids[known], (half[back] - 1) * n + ids[known[back]])))
        passage, term = pairs // n, pairs % n
        cut = np.flatnonzero(np.diff(passage, prepend=-1))
        hot = np.zeros(base[-1], dtype=bool)
        for b in range(0, self.n_blocks, COLUMNS):
            bound = np.add.reduceat(self.block_max[term, b:b + COLUMNS], cut, axis=0)
            hot[passage[cut]] |= (bound >= self.block_low[b:b + COLUMNS] * (1 - 1e-4)).any(axis=1)
        for h in np.flatnonzero(hot):
            d = int(np.searchsorted(base, h, side="right")) - 1
            begin = int(offsets[d] + (h - base[d]) * self.width)
            yield d, begin, int(min(offsets[d + 1], begin + 2 * self.width))

    def wand(self, query: np.ndarray) -> Iterator[tuple[int, float]]:
        """Block-max WAND: all items whose BM25 score for the passage reaches their threshold."""
        cursors = [[int(self.postings[t][0][0]), t, 0] for t in np.unique(query[query >= 0]).tolist()]
        low = float(self.threshold.min())
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += float(self.term_max[t])
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                return
            item = cursors[pivot][0]
            block = item // BLOCK_ITEMS
            inside = [c for c in cursors if c[0] <= item]
            block_bound = sum(float(self.block_max[t, block]) for _, t, _ in inside)
            if block_bound < self.block_low[block]:
                # No item of this block up to the next cursor can pass: go on behind it.
                later = [c[0] for c in cursors if c[0] > item]
                target = min([(block + 1) * BLOCK_ITEMS, *later])
                self._advance(cursors, inside, target)
            elif cursors[0][0] == item:
                score = sum(float(self.postings[t][1][p]) for _, t, p in inside)
                if score >= self.threshold[item]:
                    yield item, score
                self._advance(cursors, inside, item + 1)
            else:
                self._advance(cursors, [c for c in cursors if c[0] < item], item)

    def _advance(self, cursors: list, moved: list, target: int) -> None:
        for c in moved:
            ids = self.postings[c[1]][0]
            c[2] = int(np.searchsorted(ids, target))
            c[0] = int(ids[c[2]]) if c[2] < len(ids) else -1
        cursors[:] = [c for c in cursors if c[0] >= 0]


class Index:
    """The items of one pass, by length class."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[int, int], n_items: int, average: float):
        idf = {t: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for t, n in frequency.items()}
        classes: dict[int, list[tuple]] = {}
        for item_id, text in items:
            words = Words([text])
            grams, _ = shingles(words)
            n = len(words.hashes)
            if not n:
                continue
            ends = words.begin[np.minimum(np.arange(len(grams)) + SHINGLE_WORDS - 1, n - 1)]
            width = LEAST_CLASS
            while width < n:
                width *= 2
            classes.setdefault(width, []).append((item_id, words.hashes, grams, ends >= answer_begin(text)))
        self.classes = [LengthClass(w, classes[w], idf, average) for w in sorted(classes)]

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        found: list[dict] = [{} for _ in texts]
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            for group in self.classes:
                ids = group.ids(words.hashes)
                for d, begin, end in group.passages(ids, words.offsets):
                    for item, score in group.wand(ids[begin:end]):
                        item_id, own, grams, in_answer = group.items[item]
                        overlaps = _overlaps(words.hashes[begin:end], own, grams, in_answer)
                        if overlaps is None:
                            continue
                        hit = (item_id, int(begin - words.offsets[d]), float(score), *overlaps)
                        best = found[a + d].get((group.width, item))
                        if best is None or score > best[2]:
                            found[a + d][(group.width, item)] = hit
        return [list(f.values()) for f in found]


def _overlaps(passage: np.ndarray, own: np.ndarray, grams: np.ndarray, in_answer: np.ndarray) -> tuple | None:
    """Shares of the question's, the answer's and all shingles found in the passage; None if they do not suffice."""
    if len(own) < SHINGLE_WORDS:
        n = len(own)
        if len(passage) < n or not (np.lib.stride_tricks.sliding_window_view(passage, n) == own).all(axis=1).any():
            return None
        return 1.0, 1.0, 1.0
    there = np.isin(grams, _grams(passage))
    share = float(there.mean())
    question = float(there[~in_answer].mean()) if (~in_answer).any() else share
    answer = float(there[in_answer].mean()) if in_answer.any() else share
    if share < SIMILARITY or min(question, answer) < PART_SIMILARITY:
        return None
    return question, answer, share


def _grams(hashes: np.ndarray) -> np.ndarray:
    view = Words.__new__(Words)
    view.hashes, view.offsets = hashes, np.array([0, len(hashes)])
    return shingles(view)[0]


def build_passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index in passes of bounded size; document frequencies and lengths are those of all items."""
    items = benchmark.select(benchmark[f"`{id_col}`"].cast("long").alias("item_id"),
                             benchmark[f"`{text_col}`"].alias("text")).filter("text IS NOT NULL AND text <> ''")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x, y in blocks(batch["text"].tolist()):
                words = Words(batch["text"].tolist()[x:y])
                owner = np.repeat(np.arange(y - x), words.counts())
                pairs = np.unique(np.stack([owner.astype(np.uint64), words.hashes]), axis=1)
                yield pd.DataFrame({"term": pairs[1].view(np.int64), "n": 1, "words": 0, "items": 0})
                counts = words.counts()
                yield pd.DataFrame({"term": [0], "n": [0], "words": [int(counts.sum())], "items": [int((counts > 0).sum())]})

    stats = items.select("text").mapInPandas(terms, "term long, n long, words long, items long")
    frequency = stats.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.sum("items").alias("items"))
    frequency = frequency.cache()
    total = frequency.agg(F.sum("words").alias("words"), F.sum("items").alias("items")).collect()[0]
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).collect()[0]
    if not total["items"]:
        frequency.unpersist()
        return
    n_passes = max(1, -(-size["n"] // PASS_ITEMS), -(-size["b"] // PASS_BYTES))
    for p in range(n_passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_passes)) == p)
        own = rows.select("text").mapInPandas(terms, "term long, n long, words long, items long").filter("n > 0")
        known = frequency.join(own.select("term").distinct(), "term").select("term", "n").collect()
        yield Index([(r["item_id"], r["text"]) for r in sorted(rows.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))],
                    {r["term"] & ((1 << 64) - 1): r["n"] for r in known}, total["items"], total["words"] / total["items"])
    frequency.unpersist()


def hits(index, text: Column) -> Column:
    """The verified items in each text (``index``: a broadcast ``Index``)."""
    @F.pandas_udf(_HIT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "first_word", "score", "question", "answer", "overlap")
        for batch in texts:
            yield pd.Series([[dict(zip(names, h, strict=True)) for h in found] for found in index.value.search(batch.tolist())],
                            dtype=object)
    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item that it contains, with the passage, its score and its overlaps."""
    spark, out = docs.sparkSession, None
    for index in build_passes(benchmark):
        found = docs.select(docs[f"`{key_col}`"].alias("doc_id"),
                            F.explode(hits(spark.sparkContext.broadcast(index), docs[f"`{text_col}`"])).alias("h"))
        found = found.select("doc_id", "h.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, first_word int, score double, question double, "
                                        "answer double, overlap double")
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that contain no test item, all columns; decided row by row, without a shuffle."""
    out = docs
    for index in build_passes(benchmark):
        out = out.filter(F.size(hits(docs.sparkSession.sparkContext.broadcast(index), docs[f"`{text_col}`"])) == 0)
    return out
