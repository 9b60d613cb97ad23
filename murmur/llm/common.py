"""Helpers shared by the training-data operators.

Text work runs on *blocks*: a few hundred texts joined into one flat array of
code points, so that tokenising, hashing and window minima are numpy passes
over the block instead of loops over words. A block holds about
``BLOCK_CHARS`` code points (or one longer text), which bounds a worker's
memory whatever the Arrow batch size is; no text is ever cut.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_CHARS = 1 << 18
SHINGLE_WORDS = 5
SIMILARITY = 0.8

_U64 = np.uint64
_MASK64 = (1 << 64) - 1


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the folder all executors share.

    The setting is read from the session. Where it is unset, a local master
    (tests) gets a temporary folder; any other master is an error, because a
    machine-local folder would not be seen by the other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile
        base = tempfile.mkdtemp(prefix="murmur-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns of ``df`` inside one struct, so that no derived column can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- hashing -----------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): every input bit reaches every output bit."""
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U64(32))
    x = x * _U64(0xD6E8FEB86659FD93)
    return x ^ (x >> _U64(32))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers derived from ``salt``."""
    return mix(np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(salt)) | _U64(1)


@functools.lru_cache(maxsize=1)
def _code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: is it a letter, is it a letter or digit, its one-character lower case."""
    n = 0x110000
    letter, word, lower = np.zeros(n, bool), np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for i in range(n):
        c = chr(i)
        if c.isalnum():
            word[i] = True
            letter[i] = c.isalpha()
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
    return letter, word, lower


def letter_table() -> np.ndarray:
    return _code_tables()[0]


def lower_table() -> np.ndarray:
    return _code_tables()[2]


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U64)
    out[1:] = np.multiply.accumulate(np.full(n - 1, 0x9E3779B97F4A7C15, dtype=_U64)) if n > 1 else 1
    return out


def powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64 (at least ``n`` of them)."""
    size = 64
    while size < n:
        size *= 2
    return _powers(size)


# --- blocks of texts ---------------------------------------------------------

def blocks(texts: Sequence[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of ``texts`` holding about ``limit`` characters each (one longer text alone)."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


def code_points(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Flat code points of the texts, each followed by one 0, and the start of each text."""
    own = [t or "" for t in texts]
    flat = np.frombuffer(("\0".join(own) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter((len(t) + 1 for t in own), dtype=np.int64, count=len(own))
    starts = np.zeros(len(own) + 1, dtype=np.int64)
    np.cumsum(lens, out=starts[1:])
    return flat, starts


class Words:
    """The words of a block of texts: maximal runs of letters and digits, lower-cased.

    ``hashes`` (64 bit) of all words in order; text ``i`` owns words
    ``offsets[i]:offsets[i+1]``; ``begin`` and ``end`` are code points in the
    text. Null and empty texts own no words.
    """

    def __init__(self, texts: Sequence[str | None]):
        flat, starts = code_points(texts)
        _, word, lower = _code_tables()
        inside = word[flat]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        first, last = edge[0::2], edge[1::2]  # the closing 0 ends every run
        if len(first):
            at = np.flatnonzero(inside)
            size = last - first
            place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            terms = (lower[flat[at]].astype(_U64) + _U64(1)) * powers(int(size.max()))[place]
            self.hashes = mix(np.add.reduceat(terms, np.cumsum(size) - size) ^ size.astype(_U64))
        else:
            self.hashes = np.empty(0, dtype=_U64)
        self.offsets = np.searchsorted(first, starts)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.begin, self.end = first - starts[owner], last - starts[owner]

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def shingles(words: Words, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and each text's offsets into them.

    A text of 1 to n-1 words has one shingle, its whole word sequence; a text
    without words has none.
    """
    counts = words.counts()
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    offsets = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    start = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(words.offsets[:-1], sizes)
    width = np.repeat(np.minimum(counts, n), sizes)
    pad = np.concatenate((words.hashes, np.zeros(n, dtype=_U64)))
    out = width.astype(_U64)
    for j in range(n):
        out = mix(out * _U64(0x9E3779B97F4A7C15) + np.where(j < width, pad[start + j], _U64(0)))
    return out, offsets


def text_keys(words: Words) -> np.ndarray:
    """A 64-bit hash of each text's word sequence (0 for a text without words)."""
    counts = words.counts()
    out = np.zeros(len(counts), dtype=_U64)
    if len(words.hashes):
        place = np.arange(len(words.hashes)) - np.repeat(words.offsets[:-1], counts)
        terms = words.hashes * powers(int(counts.max()))[place]
        some = counts > 0
        out[some] = mix(np.add.reduceat(terms, words.offsets[:-1][some]) ^ counts[some].astype(_U64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark longs (same bits)."""
    return x.view(np.int64)


# --- code on the executors ---------------------------------------------------

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per application), as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import pathlib
    import shutil
    import tempfile

    import murmur
    root = pathlib.Path(murmur.__file__).resolve().parent
    folder = pathlib.Path(tempfile.mkdtemp(prefix="murmur-code-"))
    shutil.copytree(root, folder / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "murmur-code"), "zip", folder / "src"))
    _SHIPPED.add(app)
