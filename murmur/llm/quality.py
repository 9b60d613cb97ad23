"""Quality classifier: supervised subword embeddings.

A text's features are its words (runs without white space, in their case), its
pairs of neighbouring words and its runs of ``GRAMS`` characters, each hashed
into ``BUCKETS`` rows of an embedding table. A pair's hash is the exclusive or
of its words' hashes: it does not know their order, and a word that follows
itself is the same feature whatever the word. A text is the mean of its
features' vectors (repeats counted); a softmax over two outputs follows. Table
and output layer are learned together by stochastic gradient descent, one
document a step, in a drawn order that a fixed seed repeats, with a rate that
falls linearly to 0.

Training takes at most ``ROWS_PER_CLASS`` labelled rows of each class, chosen
by a hash of the key, of whole texts; at most 2 x ``ROWS_PER_CLASS`` x
``BUCKETS`` counts reach the driver, in practice about 1,000 a text. The sample
has other class shares than the labels, so the classes' log odds in the labels
replace those of the sample.

Scoring folds the output layer into the table: the difference of the two
outputs is linear in the mean, so a feature is one number, and a text's score
is the logistic function of the mean of its features' numbers.

Defined results: null and empty texts have no features and score the prior;
without any usable label every score is 0.5; with labels of one class only
nothing is learned and every score is the smoothed share of that class; labels
other than 0 and 1, null labels and null keys are not learned from; a key with
both labels takes the greater; of several texts under a labelled key the least
is learned from; repeated rows each get a row; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import blocks, code_points, mix, powers

BUCKETS = 1 << 16
GRAMS = (2, 3)
DIM = 16
EPOCHS = 12
RATE = 0.5
ROWS_PER_CLASS = 1500
SEED = 7

_U = np.uint64
_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[0, *(i for i in range(0x3001) if chr(i).isspace())]] = True


def feature_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(slots, owners): the bucket of every feature of the texts, and the text it belongs to."""
    flat, starts = code_points(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    code = flat.astype(_U) + _U(1)
    slots, owners = [], []
    # Characters: runs of n within a text; the 0 that closes a text is in none.
    body = flat != 0
    gram = code
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * _U(0x9E3779B97F4A7C15) + code[n - 1:]
        if n in GRAMS:
            size = len(gram)
            inside = (text_of[n - 1:] == text_of[:size]) & body[n - 1:]
            slots.append(mix(gram[inside] + _U(n)))
            owners.append(text_of[:size][inside])
    # Words, and pairs of neighbours.
    word = ~_SPACE[flat]
    edge = np.flatnonzero(np.concatenate(([word[:1].any()], word[1:] != word[:-1])))
    first, last = edge[0::2], edge[1::2]  # the closing 0 ends every word
    if len(first):
        size = last - first
        at = np.flatnonzero(word)
        place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        hashes = mix(np.add.reduceat(code[at] * powers(int(size.max()))[place], np.cumsum(size) - size) ^ size.astype(_U))
        own = text_of[first]
        same = own[1:] == own[:-1]
        slots += [hashes, mix((hashes[1:] ^ hashes[:-1])[same] + _U(0x5BF03635))]
        owners += [own, own[1:][same]]
    return (np.concatenate(slots) & _U(BUCKETS - 1)).astype(np.int64), np.concatenate(owners)


def feature_counts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    for a, b in blocks(texts):
        slots, owners = feature_slots(texts[a:b])
        cells, counts = np.unique(owners * BUCKETS + slots, return_counts=True)
        bounds = np.searchsorted(cells, np.arange(b - a + 1) * BUCKETS)
        for i in range(b - a):
            own = slice(bounds[i], bounds[i + 1])
            yield cells[own] % BUCKETS, counts[own]


@dataclass
class Model:
    """The folded classifier: a number per bucket, and the log odds of a text without features."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in blocks(texts):
            slots, owners = feature_slots(texts[a:b])
            n = np.bincount(owners, minlength=b - a)
            total = np.bincount(owners, weights=self.table[slots], minlength=b - a)
            odds = np.clip(total / np.maximum(n, 1) + self.bias, -700, 700)
            out[a:b] = 1.0 / (1.0 + np.exp(-odds))
        return out


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], shares: tuple[int, int], epochs: int = EPOCHS, rate: float = RATE,
          dim: int = DIM, seed: int = SEED) -> Model:
    """Embeddings and output layer from (label, buckets, counts) rows; ``shares`` are the numbers of labels 0 and 1."""
    prior = math.log((shares[1] + 1) / (shares[0] + 1))
    ones = sum(label for label, _, _ in rows)
    if not 0 < ones < len(rows):
        return Model(np.zeros(BUCKETS), prior)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (BUCKETS, dim))
    output, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, buckets, counts = rows[i]
            lr = rate * (1.0 - step / steps)
            step += 1
            share = counts / max(counts.sum(), 1)
            own = table[buckets]
            hidden = share @ own
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1.0
            back = output @ p
            output -= lr * np.outer(hidden, p)
            bias -= lr * p
            # Steps on a feature in proportion to its share, scaled so that a text of many features moves as far as one of few.
            table[buckets] = own - (lr / max(float(share @ share), 1e-12)) * share[:, None] * back
    sample = math.log(ones / (len(rows) - ones))
    return Model(table @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]) + prior - sample)


# --- Spark ----------------------------------------------------------------------

def held_out(key: Column) -> Column:
    """Rows never learned from: the CRC-32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_key: str = "doc_id",
                  label_col: str = "quality", per_class: int = ROWS_PER_CLASS) -> tuple[DataFrame, tuple[int, int]]:
    """((label, buckets, counts) of the sampled rows, numbers of usable labels 0 and 1).

    The labels alone are counted and sampled; only the sample, of at most 2 x ``per_class`` keys, is broadcast to the
    texts.
    """
    key = labels[f"`{label_key}`"]
    own = labels.select(key.cast("string").alias("k"), labels[f"`{label_col}`"].cast("int").alias("y"))
    own = own.filter(key.isNotNull() & F.col("y").isin(0, 1) & ~held_out(key)).groupBy("k").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The share of the hash range that holds about twice the wanted rows of a class, then the exact rank in it: a rank
    # over all labels would meet in one task.
    spread = {y: min(1.0, (2.0 * per_class + 100) / n) for y, n in counts.items()}
    h = F.xxhash64("k")
    share = F.create_map(*[F.lit(x) for y in sorted(spread) for x in (y, spread[y])])[F.col("y")] if spread else F.lit(0.0)
    order = Window.partitionBy("y").orderBy(h, "k")
    sample = own.filter(h / F.lit(2.0 ** 64) + 0.5 <= share).withColumn("place", F.row_number().over(order))
    sample = sample.filter(F.col("place") <= per_class)
    rows = docs.select(docs[f"`{key_col}`"].cast("string").alias("k"), docs[f"`{text_col}`"].alias("t")).filter("t IS NOT NULL")
    rows = rows.join(F.broadcast(sample), "k").groupBy("k", "y").agg(F.min("t").alias("t"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(feature_counts(batch["t"].tolist()))
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "buckets": [b.astype(np.int32).tobytes() for b, _ in found],
                                "counts": [c.astype(np.int32).tobytes() for _, c in found]})
    return rows.mapInPandas(features, "k string, y int, buckets binary, counts binary"), (counts.get(0, 0), counts.get(1, 0))


def fit(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    rows, shares = training_rows(docs, labels, **columns)
    own = sorted(rows.collect(), key=lambda r: r["k"])
    return train([(r["y"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in own], shares)


def scored(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()))
    return run(text)


def score_quality(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_key: str = "doc_id",
                  label_col: str = "quality", per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learns from the labels that are not held out."""
    model = fit(docs, labels, key_col=key_col, text_col=text_col, label_key=label_key, label_col=label_col, per_class=per_class)
    key = docs[f"`{key_col}`"]
    out = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), scored(model, docs[f"`{text_col}`"]).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
