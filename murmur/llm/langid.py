"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (``ORDERS``,
blended) that occur in both, normalised by the numbers that occur in each.
Letters are lower-cased, every run of other characters is one space. A text is
a presence vector of ``BITS`` hashed n-grams, whatever its length.

Training takes at most ``ROWS_PER_LANGUAGE`` labelled rows of each language
(chosen by a hash of the key) and at most ``MAX_LANGUAGES`` languages (more
raise), which bounds what the driver gathers. ``LANDMARKS`` of them, dealt
evenly over the languages, are the Nystroem landmarks: a text's features are
its kernels with the landmarks times the inverse root of the landmarks' own
kernel matrix, and a ridge regression per language against the rest is solved
on those features. Both steps fold into one matrix, so a block of texts is
scored by one matrix product.

Defined results: null text, and text without a letter, is ``und`` with score
0; so is everything if no labelled row exists; ties go to the first language
by code point; empty tables give empty results. Scores are the winner's share
of the positive scores, from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import blocks, code_points, letter_table, lower_table

ORDERS = (2, 3, 4)
BITS = 1 << 16
ROWS_PER_LANGUAGE = 128
MAX_LANGUAGES = 256
LANDMARKS = 64
RIDGE = 0.1
UNKNOWN = "und"
# A text is of a known language if the best one has this many times its share by chance.
LEAST_LIFT = 1.2
BLOCK_TEXTS = 128


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram presence of each text (rows of 64-bit words), and whether it has a letter."""
    flat, starts = code_points(texts)
    letters = letter_table()[flat]
    has_letter = np.add.reduceat(letters.astype(np.int64), starts[:-1]) > 0
    code = np.where(letters, lower_table()[flat], np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    keep = np.ones(len(flat), dtype=bool)  # one space for a run, and one before each text's first letter
    keep[1:] = letters[1:] | letters[:-1] | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    seen = np.zeros(len(texts) * BITS, dtype=bool)
    gram = code
    for n in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(n)
        if n in ORDERS:
            same = owner[n - 1:] == owner[:len(gram)]
            slot = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
            seen[(owner[:len(gram)] * BITS + slot.astype(np.int64))[same]] = True
    packed = np.packbits(seen.reshape(len(texts), BITS), axis=1)
    return packed.view(np.uint64), has_letter


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of every row of ``a`` with every row of ``b``."""
    own_a = np.bitwise_count(a).sum(axis=1, dtype=np.int64)
    own_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    both = np.empty((len(a), len(b)))
    for j in range(len(b)):
        both[:, j] = np.bitwise_count(a & b[j]).sum(axis=1, dtype=np.int64)
    return both / np.sqrt(np.maximum(own_a[:, None], 1) * np.maximum(own_b[None, :], 1))


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray  # landmarks x languages

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        names, scores = [], []
        for a in range(0, len(texts), BLOCK_TEXTS):
            for x, y in blocks(texts[a:a + BLOCK_TEXTS]):
                bits, has_letter = presence(texts[a + x:a + y])
                out = np.maximum(kernel(bits, self.landmarks) @ self.weights, 0)
                best = out.argmax(axis=1)
                share = out[np.arange(len(out)), best] / np.maximum(out.sum(axis=1), 1e-12)
                names += [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, has_letter, strict=True)]
                scores += np.where(has_letter, np.clip(share, 0, 1), 0.0).tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})


def fit_rows(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem landmarks and one-versus-rest kernel ridge regression from presence rows."""
    languages = sorted(set(labels))
    own = {k: [i for i, x in enumerate(labels) if x == k] for k in languages}
    turn = sorted((place, k) for k in languages for place in range(len(own[k])))
    marks = bits[[own[k][place] for place, k in turn[:max(landmarks, len(languages))]]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-8 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel(bits, marks) @ root
    target = np.array([[1.0 if x == k else 0.0 for k in languages] for x in labels])
    weight = np.array([1.0 / len(own[x]) for x in labels])[:, None]
    weight = weight * len(labels) / weight.sum()
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
    return Model(languages, marks, root @ np.linalg.solve(gram, features.T @ (target * weight)))


def training_rows(docs: DataFrame, key: Column, text: Column, lang: Column, usable: Column,
                  per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` (lang, bits) rows of each language.

    A first pass over the labels alone counts them; a second takes from each
    language the share of rows, by hash, that holds the wanted number twice
    over, and cuts that small sample by rank.
    """
    labelled = docs.select(key.cast("string").alias("k"), text.alias("t"), lang.cast("string").alias("lang"),
                           usable.alias("u")).filter("u AND lang IS NOT NULL")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    spark = docs.sparkSession
    rates = spark.createDataFrame([(r["lang"], min(1.0, 2.0 * per_language / r["n"])) for r in counts] or [("", 0.0)],
                                  "lang string, rate double")
    h = F.xxhash64("k")
    sample = labelled.join(F.broadcast(rates), "lang").filter(F.pmod(h, F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    @F.pandas_udf("binary")
    def bits(texts: pd.Series) -> pd.Series:
        own = texts.tolist()
        out = []
        for i in range(0, len(own), BLOCK_TEXTS):
            for x, y in blocks(own[i:i + BLOCK_TEXTS]):
                rows, ok = presence(own[i + x:i + y])
                out += [r.tobytes() if good else None for r, good in zip(rows, ok, strict=True)]
        return pd.Series(out, dtype=object)

    order = Window.partitionBy("lang").orderBy(F.xxhash64("k", F.lit(1)), "k")
    return (sample.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_language)
            .select("lang", "place", bits("t").alias("bits")).filter("bits IS NOT NULL"))


def fit(docs: DataFrame, key: Column, text: Column, lang: Column, usable: Column, **params) -> Model | None:
    rows = sorted(training_rows(docs, key, text, lang, usable).collect(), key=lambda r: (r["lang"], r["place"]))
    if not rows:
        return None
    bits = np.stack([np.frombuffer(r["bits"], dtype=np.uint64) for r in rows])
    return fit_rows(bits, [r["lang"] for r in rows], **params)


def predicted(model: Model | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            if model is None:
                yield pd.DataFrame({"lang_pred": [UNKNOWN] * len(batch), "score": [0.0] * len(batch)})
            else:
                yield model.predict(batch.tolist())
    return run(text)


def held_out(key: Column) -> Column:
    """Rows never learned from: the CRC-32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; learns from the rows that are not held out."""
    key, text, lang = docs[f"`{key_col}`"], docs[f"`{text_col}`"], docs[f"`{lang_col}`"]
    model = fit(docs, key, text, lang, ~held_out(key))
    out = docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), predicted(model, text).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def known_language(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang", least_lift: float = LEAST_LIFT) -> DataFrame:
    """The documents that resemble a learned language, all columns.

    Texts without a letter go, and texts whose best language has no more than ``least_lift`` / number of languages of
    the positive scores: they share (nearly) no n-gram with any language, or the same few with all. Where no row is
    labelled nothing can be told apart and every text with a letter stays.
    """
    key, text, lang = docs[f"`{key_col}`"], docs[f"`{text_col}`"], docs[f"`{lang_col}`"]
    model = fit(docs, key, text, lang, ~held_out(key))
    if model is None:
        return docs.filter(text.rlike(r"\p{L}"))
    least = least_lift / len(model.languages) if len(model.languages) > 1 else 0.0

    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            p = model.predict(batch.tolist())
            yield (p["lang_pred"] != UNKNOWN) & (p["score"] > least)
    return docs.filter(accepted(text))
