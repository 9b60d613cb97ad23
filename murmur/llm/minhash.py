"""Near-duplicate documents by Order MinHash.

K-mers are runs of five words, labelled with their occurrence number in the
document, so a document is a sequence of distinct labelled k-mers. Each of
``SKETCHES`` hash functions samples the ``SAMPLED`` least k-mers and hashes
them *in the order of the text*: two documents share a sketch only if they
share those k-mers and their order. At similarity 0.8 a sketch is shared with
probability 0.8^3, and no sketch of 16 with probability 1e-5.

Candidates are verified by a banded alignment: the longest common subsequence
of the two k-mer sequences within the widest band that 0.8 allows. Labelled
k-mers are distinct, so it is the longest increasing run of matched positions.
The similarity is the aligned k-mers over all k-mers of both; 0.8 links.

Groups are never paired out. Texts of equal word sequence are one node. In the
buckets of the first four sketches (documents sharing the sketch) every
document is verified against the bucket's least node. What is left are buckets
of any sketch whose documents lie in several components: mostly texts that have
a frequent line or passage in common and little else. They are settled by their
rare k-mers. Of a node's k-mers only those count that some node of *another*
component has too; ordered rarest first, two nodes of 0.8 must share one of
their first (usable - 0.8 size + 1), and that k-mer bounds what they can have in
common. Nodes with fewer usable k-mers than 0.8 of their size are out at once.
In ``CENTRE_ROUNDS`` rounds the nodes that share such a k-mer are verified
against the one with most left after it, which links copies with what they were
copied from; components grow and k-mers that only one component has drop out.
Then all pairs across components that the bound admits are verified. So no link
between different texts is lost, and the work follows real overlap: neither a
passage that thousands of texts share nor a large group of copies is paired out.
Components are found by joins; every round is written to the shared folder.

Defined results: a null text is a class of its own; texts without words (empty
ones too) are alike if equal; documents of fewer than five words have one
k-mer, their word sequence; repeated rows belong to one class; a class's id is
its least doc_id. Node ids are 64-bit hashes: at 10^9 different texts about
0.03 wrong merges are to be expected.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from murmur.llm.common import SIMILARITY, Words, blocks, mix, packed, seeds, shingles, signed, stored, text_keys

SKETCHES = 16
SAMPLED = 3
FIRST_SKETCHES = 4
CENTRE_ROUNDS = 2
_U = np.uint64


def labelled_kmers(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Five-word k-mers, hashed with their occurrence number in the text, and each text's offsets."""
    grams, offsets = shingles(words)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=_U), np.diff(offsets))
    own = mix(grams + owner * _U(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    run = np.concatenate(([True], own[order][1:] != own[order][:-1])) if len(own) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(run, np.arange(len(own)), 0)) if len(own) else np.empty(0, np.int64)
    occurrence = np.empty(len(own), dtype=_U)
    occurrence[order] = (np.arange(len(own)) - first).astype(_U)
    return mix(grams + occurrence * _U(0xBF58476D1CE4E5B9)), offsets


def order_sketches(kmers: np.ndarray, offsets: np.ndarray, sketches: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """(texts with k-mers) x sketches: the least k-mers of each hash function, hashed in text order."""
    some = np.flatnonzero(np.diff(offsets) > 0)
    starts, n = offsets[:-1][some], np.diff(offsets)[some]
    if not len(some):
        return np.empty((0, sketches), dtype=_U)
    bits = _U(24 if n.max() < 1 << 24 else 32)
    low = (_U(1) << bits) - _U(1)
    place = (np.arange(len(kmers)) - np.repeat(starts, n)).astype(_U)
    top = ~_U(0)
    out = np.empty((len(some), sketches), dtype=_U)
    for j, (a, b) in enumerate(zip(seeds(sketches, 11), seeds(sketches, 29), strict=True)):
        value = ((((kmers ^ a) * b) & ~low) | place)
        at = np.empty((len(some), sampled), dtype=np.int64)
        for k in range(sampled):
            least = np.minimum.reduceat(value, starts)
            at[:, k] = np.where(k < n, (least & low).astype(np.int64), np.iinfo(np.int64).max)
            value[(starts + at[:, k])[k < n]] = top
        at.sort(axis=1)
        code = np.full(len(some), j + 1, dtype=_U)
        for k in range(sampled):
            there = k < n
            code = np.where(there, mix(code * _U(0x9E3779B97F4A7C15) + kmers[starts + np.where(there, at[:, k], 0)]), code)
        out[:, j] = code
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned k-mers over all k-mers of two sequences of distinct k-mers; 0 where ``least`` cannot be reached."""
    total = len(a) + len(b)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not total or len(at_a) < least * (total - len(at_a)) - 1e-9:
        return 0.0
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    band = int(total * (1 - least) / (1 + least) + 1e-9) + 1
    at_b = at_b[np.abs(at_a - at_b) <= band]
    if (at_b[1:] > at_b[:-1]).all():
        common = len(at_b)
    else:
        tails: list[int] = []
        for x in at_b.tolist():
            k = bisect_left(tails, x)
            tails[k:k + 1] = [x]
        common = len(tails)
    return common / (total - common)


# --- Spark -------------------------------------------------------------------

_SKETCHED = "doc_id long, raw long, node long, sketch array<long>"


def sketched(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw hash of the text, node, sketches) of every document with a text."""
    rows = docs.select(docs[f"`{key_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = rows.filter("text IS NOT NULL").withColumn("raw", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, raw = batch["text"].tolist(), batch["raw"].to_numpy()
            for x, y in blocks(texts):
                words = Words(texts[x:y])
                own = text_keys(words)
                kmers, offsets = labelled_kmers(words)
                rows = iter(signed(order_sketches(kmers, offsets)))
                some = np.diff(offsets) > 0
                own = np.where(some, own, mix(raw[x:y].astype(np.int64).view(_U) + _U(1)))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[x:y].astype("Int64"), "raw": raw[x:y], "node": signed(own),
                                    "sketch": [next(rows) if s else np.empty(0, np.int64) for s in some]})
    return rows.mapInPandas(run, _SKETCHED)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of (a, b) edges.

    Each round gives a node the least label among its own and its neighbours';
    from the fourth round on also the label of that label, so that stars take
    one or two rounds and long paths a logarithmic number. Every round is one
    job, written out; only the number of changes reaches the driver.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("own"))
        step = (heard.unionByName(labels.select("node", "label", F.col("label").alias("own")))
                .groupBy("node").agg(F.min("label").alias("label"), F.max("own").alias("own")))
        if turn > 3:
            step = stored(step, "labels")
            jump = step.select(F.col("node").alias("via"), F.col("label").alias("next"))
            step = step.join(jump, step["label"] == jump["via"]).select("node", F.least("label", "next").alias("label"), "own")
        changes = Observation()
        labels = stored(step.observe(changes, F.count_if(F.col("label") != F.col("own")).alias("n")), "labels").select("node", "label")
        if not changes.get["n"]:
            return labels


def _kmer_table(docs: DataFrame, wanted: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(node, kmers): the labelled k-mers (32 bits each) of one document of each wanted node."""
    rows = docs.select(docs[f"`{key_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    rows = rows.filter("text IS NOT NULL").withColumn("raw", F.xxhash64("text"))
    w = wanted.select(F.col("first.doc_id").alias("w_id"), F.col("first.raw").alias("w_raw"), "node")
    rows = rows.join(w, rows["doc_id"].eqNullSafe(w["w_id"]) & (rows["raw"] == w["w_raw"])).select("node", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for x, y in blocks(texts):
                kmers, offsets = labelled_kmers(Words(texts[x:y]))
                short = (kmers >> _U(32)).astype(np.uint32)
                yield pd.DataFrame({"node": batch["node"].iloc[x:y],
                                    "kmers": [_distinct(short[offsets[i]:offsets[i + 1]]).tobytes() for i in range(y - x)]})
    return rows.mapInPandas(run, "node long, kmers binary").dropDuplicates(["node"])


def _similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            out.append(aligned_similarity(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)))
        return pd.Series(out, dtype="float64")
    return run(a, b)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The k-mers without repeats (32 bits: a chance collision in a long text), in text order."""
    first = np.unique(x, return_index=True)[1]
    return x if len(first) == len(x) else x[np.sort(first)]


def _verified(pairs: DataFrame, kmers: DataFrame) -> DataFrame:
    """The (a, b, similarity) pairs that the alignment confirms."""
    x = kmers.select(F.col("node").alias("a"), F.col("kmers").alias("x"))
    y = kmers.select(F.col("node").alias("b"), F.col("kmers").alias("y"))
    out = pairs.join(y, "b").join(x, "a").select("a", "b", _similarity(F.col("x"), F.col("y")).alias("similarity"))
    return stored(out.filter(F.col("similarity") >= SIMILARITY), "links")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _split(own: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one label."""
    split = own.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    return own.join(split.select("bucket"), "bucket", "left_semi")


def _postings(own: DataFrame, kmers: DataFrame) -> DataFrame:
    """(kmer, node, label, size, rest): the rare k-mers of (node, label) by which a node can be linked across labels.

    ``rest`` counts the node's usable k-mers that are more frequent than this one. A k-mer with fewer than 0.8 of the
    node's size in it and the rest is no part of the prefix.
    """
    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in range(0, len(batch), 256):
                part = batch.iloc[x:x + 256]
                sizes = np.array([len(d) // 4 for d in part["kmers"]], dtype=np.int32)
                yield pd.DataFrame({"kmer": np.frombuffer(b"".join(part["kmers"]), np.int32), "size": np.repeat(sizes, sizes),
                                    "node": np.repeat(part["node"].to_numpy(), sizes), "label": np.repeat(part["label"].to_numpy(), sizes)})
    cells = kmers.join(own, "node").mapInPandas(exploded, "kmer int, size int, node long, label long")
    common = cells.groupBy("kmer").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"))
    cells = cells.join(common.filter("lo <> hi").select("kmer", "n"), "kmer")
    frequent_first = Window.partitionBy("node").orderBy(F.desc("n"), "kmer")
    cells = cells.withColumn("rest", F.row_number().over(frequent_first) - 1).filter(F.col("rest") + 1 >= SIMILARITY * F.col("size") - 1e-9)
    return stored(cells.select("kmer", "node", "label", "size", "rest"), "postings")


def _admitted() -> Column:
    """Can two nodes (columns and a_ columns) that share a k-mer, and no rarer one, be linked across labels?"""
    most = F.least("rest", "a_rest") + 1
    return (F.col("a_label") != F.col("label")) & (most >= SIMILARITY * (F.col("size") + F.col("a_size") - most) - 1e-9)


def _as_a(rows: DataFrame) -> DataFrame:
    return rows.select("kmer", *[F.col(c).alias(f"a_{c}") for c in ("node", "label", "size", "rest")])


def _centre_pairs(postings: DataFrame) -> DataFrame:
    """Pairs of each k-mer's nodes with the one that has most of its size left after it."""
    first = F.struct(F.col("rest") / F.col("size"), "node", "label", "size", "rest")
    centre = postings.groupBy("kmer").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(first).alias("c"))
    centre = _as_a(centre.filter("lo <> hi").select("kmer", "c.node", "c.label", "c.size", "c.rest"))
    return postings.join(centre, "kmer").filter(_admitted())


def _all_pairs(postings: DataFrame) -> DataFrame:
    """All admitted pairs across labels. A k-mer's most frequent label is never joined with itself."""
    per = postings.groupBy("kmer", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("kmer").agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.count(F.lit(1)).alias("labels"))
    rows = stored(postings.join(per.filter("labels > 1").select("kmer", "major"), "kmer"), "open")
    others = _as_a(rows.filter("label <> major"))
    return rows.join(others, "kmer").filter(((F.col("label") == F.col("major")) | (F.col("a_node") < F.col("node"))) & _admitted())


def linked_classes(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their node, one row per node with its label, verified links between nodes)."""
    rows = stored(sketched(docs, key_col, text_col), "sketches")
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.min("doc_id").alias("least"),
                                            F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")), "nodes")
    cells = nodes.select("node", F.posexplode("sketch").alias("turn", "bucket"))
    sizes = cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("rep")).filter("n > 1")
    members = stored(cells.join(sizes, "bucket"), "buckets")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    kmers = stored(_kmer_table(docs, wanted, key_col, text_col), "kmers")

    # The first sketches' buckets: every member against the least one.
    first = F.col("turn") < FIRST_SKETCHES
    links = _verified(members.filter(first & (F.col("node") != F.col("rep")))
                      .select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), kmers)
    labels = components(links)

    # Buckets of several components: by rare k-mers, first against centres, then all that can still be linked.
    left = members.select("bucket", "node", "n", F.when(first, F.col("rep")).alias("rep"))
    left = _split(_labelled(left.filter("rep IS NULL OR n > 2"), labels)).select("node").distinct()
    for turn in range(CENTRE_ROUNDS + 1):
        postings = _postings(_labelled(left, labels), kmers)
        pairs = _centre_pairs(postings) if turn < CENTRE_ROUNDS else _all_pairs(postings)
        more = _verified(pairs.select(F.least("a_node", "node").alias("a"), F.greatest("a_node", "node").alias("b")).distinct(), kmers)
        left = postings.select("node").distinct()
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links)
    classes = nodes.join(labels, "node", "left").select("node", "first", "least", "copies",
                                                        F.coalesce("label", "node").alias("label"))
    return rows, classes, links


def near_duplicates(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size, verified_links) of every document: its class, the class's documents, and the
    verified pairs its text is part of (enough to connect its class, not all pairs of similar texts)."""
    rows, classes, links = linked_classes(docs, key_col, text_col)
    per_class = classes.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    degree = (links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
              .groupBy("node").agg(F.count(F.lit(1)).alias("verified_links")))
    by_node = (classes.join(per_class, "label").join(degree, "node", "left")
               .select("node", "class_id", "class_size", F.coalesce("verified_links", F.lit(0).cast("long")).alias("verified_links")))
    found = rows.select("doc_id", "node").join(by_node, "node").select("doc_id", "class_id", "class_size", "verified_links")
    text, key = docs[f"`{text_col}`"], docs[f"`{key_col}`"].cast("long")
    none = docs.filter(text.isNull()).select(key.alias("doc_id"), key.alias("class_id"), F.lit(1).cast("long").alias("class_size"),
                                             F.lit(0).cast("long").alias("verified_links"))
    return found.unionByName(none)


def one_of_each(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every class (that with the least key), all columns; null texts stay."""
    _, classes, _ = linked_classes(docs, key_col, text_col)
    kept = classes.groupBy("label").agg(F.min("first").alias("kept")).select(
        F.col("kept.doc_id").alias("k_id"), F.col("kept.raw").alias("k_raw"))
    rows = packed(docs.filter(docs[f"`{text_col}`"].isNotNull()))
    rows = rows.withColumn("d_id", F.col(f"row.`{key_col}`").cast("long")).withColumn("d_raw", F.xxhash64(F.col(f"row.`{text_col}`")))
    same = rows["d_id"].eqNullSafe(kept["k_id"]) & (rows["d_raw"] == kept["k_raw"])
    # Rows equal in key and text are one group: the first of them stays.
    order = Window.partitionBy("d_id", "d_raw").orderBy(F.lit(1))
    rows = rows.join(kept, same, "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return rows.select("row.*").unionByName(docs.filter(docs[f"`{text_col}`"].isNull()))
