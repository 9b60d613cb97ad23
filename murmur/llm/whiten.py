"""Embedding whitening from the triangular factor of the scatter.

Vectors are put on a grid: x = floor(256 c) for every entry c, as longs. The
*fit list* is each different x vector once. Its sums are exact (decimals), its
scatter is summed from rows centred before multiplying, in tasks and then in
two rounds of additions. The scatter of one vector length (dims x dims
numbers, the only thing that grows on the driver, with the square of the
length and not with the rows) is factorised there:

1. Cholesky with diagonal pivots: scatter = P L L' P', stopped where the
   remaining diagonal is rounding noise, so that L has as many columns as the
   scatter has rank;
2. one-sided Jacobi on L itself: its columns are rotated pairwise until they
   are orthogonal. L L' does not change. The squared column norms are then the
   eigenvalues of the scatter, the columns over their norms its eigenvectors.

The covariance is never formed from uncentred products and the scatter is never
squared, so small eigenvalues keep their relative accuracy.

``whitened`` is (x - mean) on a component over the root of its eigenvalue. The
covariance of the whitened fit list is measured, centred, over the whole list;
``identity_error`` is its largest departure from the identity.

Defined results: vectors that are null, or hold a null or non-finite entry or
one whose x is no long, take no part. Vectors without entries have no
components and no rows. Vectors of different lengths are whitened apart (more
than ``MAX_LENGTHS`` different lengths raise). Components of no variance (equal
vectors, fewer vectors than components) are not returned, so one lone vector
gives no rows. ``deviation`` is exact, and null where it is no long. Equal rows
each get their rows; a null id is kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import stored

COMPONENTS = 4
SCALE = 256.0
MAX_LENGTHS = 64
# Parts of a sum are added in this many groups first, then the groups.
GROUPS = 64
_LONG = 2.0 ** 63


# --- linear algebra of one vector length --------------------------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): a[order][:, order] = L L', L lower trapezoidal with one column per unit of rank."""
    n = len(a)
    order, left = np.arange(n), a.diagonal().astype(np.float64).copy()
    lower = np.zeros((n, n))
    noise = n * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(left[k:].argmax())
        if left[p] <= noise:
            return lower[:, :k], order
        for x in (order, left, lower):
            x[[k, p]] = x[[p, k]]
        lower[k, k] = np.sqrt(left[k])
        lower[k + 1:, k] = (a[order[k + 1:], order[k]] - lower[k + 1:, :k] @ lower[k, :k]) / lower[k, k]
        left[k + 1:] -= lower[k + 1:, k] ** 2
    return lower, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of 0..n-1 (n even) once, in n - 1 rounds of disjoint pairs."""
    ring = np.arange(1, n)
    for k in range(n - 1):
        seats = np.concatenate(([0], np.roll(ring, k)))
        yield seats[:n // 2], seats[n // 2:][::-1]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated until they are orthogonal, longest first."""
    u = np.array(factor, dtype=np.float64)
    width = u.shape[1]
    if width % 2:
        u = np.concatenate((u, np.zeros((len(u), 1))), axis=1)
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(u.shape[1]):
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            turn = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (bb - aa) / (2.0 * ab)
                tan = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1.0 + zeta * zeta))
            tan = np.where(turn, tan, 0.0)
            cos = 1.0 / np.sqrt(1.0 + tan * tan)
            sin = cos * tan
            u[:, p], u[:, q] = cos * a - sin * b, sin * a + cos * b
        if not turned:
            break
    norms = (u * u).sum(axis=0)
    return u[:, np.argsort(-norms, kind="stable")[:width]]


@dataclass
class Whitening:
    """The fitted transformation of one vector length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray  # dims x components
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @classmethod
    def of(cls, n: int, sums: list[int], scatter: np.ndarray, components: int) -> Whitening:
        lower, order = pivoted_cholesky(scatter)
        u = one_sided_jacobi(lower)
        norms = (u * u).sum(axis=0)
        u, norms = u[:, norms > 0], norms[norms > 0]
        axes = np.empty((len(scatter), len(norms)))
        axes[order] = u / np.sqrt(norms)
        total = float(scatter.trace())
        return cls(n, sums, np.array([s / n for s in sums]), axes[:, :components], norms[:components] / n,
                   norms[:components] / total if total > 0 else norms[:components])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.axes) / np.sqrt(self.eigenvalues)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row: exact modulo 2^64, hence exact wherever it is a long."""
        wrap = (1 << 64) - 1
        gap = x.view(np.uint64) * np.uint64(self.n & wrap) - np.array([s & wrap for s in self.sums], dtype=np.uint64)
        exact = (gap * gap).sum(axis=1, dtype=np.uint64).view(np.int64)
        about = (((x - self.mean) * float(self.n)) ** 2).sum(axis=1)
        return [int(e) if a < _LONG * (1 - 1e-9) else None for e, a in zip(exact, about, strict=True)]


# --- Spark ----------------------------------------------------------------------

def usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * SCALE < _LONG))
    return F.coalesce((F.size(vector) > 0) & fits, F.lit(False))


def grid(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x as a matrix of longs) of the batch's vectors, one for each length."""
    lists = batch.column(column)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        rows = np.flatnonzero(sizes == dims)
        own = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
        values = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(dims))
        yield int(dims), rows, np.floor(values * SCALE).astype(np.int64)


def _codes(x: np.ndarray) -> list[bytes]:
    """Each row of longs in the least whole number of bytes per entry that holds it: equal rows, equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    size = np.full(len(x), 8)
    for width, top in ((4, 1 << 31), (2, 1 << 15)):
        size[(low >= -top) & (high < top)] = width
    return [row.astype(f"<i{width}").tobytes() for row, width in zip(x, size, strict=True)]


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    codes, dims = batch.column("code"), batch.column("dims").to_numpy(zero_copy_only=False)
    sizes = pc.binary_length(codes).to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        for width in (2, 4, 8):
            rows = np.flatnonzero((dims == d) & (sizes == d * width))
            if len(rows):
                raw = b"".join(codes.take(pa.array(rows)).to_pylist())
                yield int(d), np.frombuffer(raw, f"<i{width}").reshape(len(rows), int(d)).astype(np.int64)


def fit_list(vectors: DataFrame) -> DataFrame:
    """(dims, code): every different x vector once. Copies meet in their tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, _, x in grid(batch, "vec"):
                yield pa.RecordBatch.from_arrays([pa.array([dims] * len(x), pa.int32()), pa.array(_codes(x), pa.binary())],
                                                 names=["dims", "code"])
    return vectors.select("vec").mapInArrow(run, "dims int, code binary").distinct()


def _sums(fitted: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dims: (n, exact sums)}."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, x in _decoded(batch):
                safe = float(np.abs(x.astype(np.float64)).max()) * len(x) < _LONG / 2
                total = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dims], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))],
                    names=["dims", "n", "sums"])
    parts = fitted.mapInArrow(run, "dims int, n long, sums array<string>")
    cells = parts.select("dims", "n", F.posexplode("sums").alias("place", "part"))
    rows = cells.groupBy("dims", "place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["dims"], r["place"])):
        out.setdefault(r["dims"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _added(parts: DataFrame) -> DataFrame:
    """(dims, row, values): the parts' values added entry by entry, in two rounds."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part", kind="stable")
        total = np.sum(np.stack(rows["values"].tolist()), axis=0)
        return pd.DataFrame({"dims": rows["dims"].iloc[:1], "row": rows["row"].iloc[:1],
                             "part": [int(rows["part"].iloc[0]) % GROUPS], "values": [total]})
    schema = "dims int, row int, part int, values array<double>"
    once = parts.groupBy("dims", "row", F.pmod("part", F.lit(GROUPS)).alias("g")).applyInPandas(add, schema)
    return once.groupBy("dims", "row").applyInPandas(add, schema)


def _scatters(fitted: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    means = {d: np.array([s / n for s in own]) for d, (n, own) in sums.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, x in _decoded(batch):
                gap = x - means[dims]
                total[dims] = total.get(dims, 0.0) + gap.T @ gap
        part = TaskContext.get().partitionId()
        for dims, values in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array([part] * dims, pa.int32()),
                 pa.array(list(values), pa.list_(pa.float64()))], names=["dims", "row", "part", "values"])
    out = {d: np.zeros((d, d)) for d in sums}
    for r in _added(fitted.mapInArrow(run, "dims int, row int, part int, values array<double>")).collect():
        out[r["dims"]][r["row"]] = r["values"]
    return {d: (m + m.T) / 2 for d, m in out.items()}


def _merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, centred products) of two sets of rows from those of each."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_errors(fitted: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """{dims: largest entry of |covariance of the whitened fit list - identity|}."""
    def row(dims: int, part: int, own: tuple) -> pd.DataFrame:
        return pd.DataFrame({"dims": [dims], "part": [part], "n": [own[0]], "mean": [own[1]], "products": [own[2].ravel()]})

    schema = "dims int, part int, n long, mean array<double>, products array<double>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for dims, x in _decoded(batch):
                if dims in models:
                    w = models[dims].whitened(x)
                    mean = w.mean(axis=0)
                    own = (len(w), mean, (w - mean).T @ (w - mean))
                    total[dims] = _merged(total[dims], own) if dims in total else own
        for dims, own in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own[0]], pa.int64()),
                 pa.array([own[1]], pa.list_(pa.float64())), pa.array([own[2].ravel()], pa.list_(pa.float64()))],
                names=["dims", "part", "n", "mean", "products"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in rows.sort_values("part", kind="stable").itertuples():
            mean = np.asarray(r.mean)
            own = (int(r.n), mean, np.asarray(r.products).reshape(len(mean), len(mean)))
            total = own if total is None else _merged(total, own)
        return row(int(rows["dims"].iloc[0]), int(rows["part"].iloc[0]) % GROUPS, total)

    parts = fitted.mapInArrow(measure, schema)
    once = parts.groupBy("dims", F.pmod("part", F.lit(GROUPS)).alias("g")).applyInPandas(merge, schema)
    out = {}
    for r in once.groupBy("dims").applyInPandas(merge, schema).collect():
        k = len(r["mean"])
        out[r["dims"]] = float(np.abs(np.array(r["products"]).reshape(k, k) / r["n"] - np.eye(k)).max())
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """{length: fitted whitening} of a (vec) table of usable vectors; lengths without variance are left out."""
    fitted = stored(fit_list(vectors), "fit-list")
    lengths = [r[0] for r in fitted.select("dims").distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} different lengths")
    if not lengths:
        return {}
    sums = _sums(fitted)
    models = {d: Whitening.of(*sums[d], scatter, components) for d, scatter in _scatters(fitted, sums).items()}
    models = {d: m for d, m in models.items() if len(m.eigenvalues)}
    for dims, error in (_identity_errors(fitted, models) if models else {}).items():
        models[dims].identity_error = error
    return models


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for every usable row and component."""
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), vectors[f"`{vector_col}`"].alias("vec"))
    rows = rows.filter(usable(F.col("vec")))
    models = fit(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x in grid(batch, "vec"):
                if dims not in models:
                    continue
                m = models[dims]
                k, size = len(m.eigenvalues), len(x)
                ids = batch.column("id").take(pa.array(np.repeat(at, k)))
                deviation = pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(size), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n, dtype=np.int64)),
                     deviation, pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.explained, size)),
                     pa.array(np.full(size * k, m.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
                                "identity_error double")
