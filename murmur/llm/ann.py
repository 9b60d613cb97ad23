"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt by a hash into shards of about ``SHARD_ROWS``. A task builds
one shard's graph by insertion: a vector's level is drawn geometrically from
its hash, upper levels are descended greedily, and on each of its levels the
vector is linked with up to ``M`` of the nearest ``EF_BUILD`` found, chosen so
that no chosen neighbour is nearer to another chosen one (spare places are
filled with the nearest left out). The graph is stored as flat arrays: a row
of ``2 M`` neighbour places per vector for level 0 and of ``M`` for each upper
level, -1 where free. Every query is searched in every shard, in blocks of
``QUERY_BLOCK`` queries, and the shards' results are merged by exact distance
in double precision.

Equal vectors are one graph node that carries the ``k + 1`` least ids of its
copies (more can never be among a query's ``k`` nearest, itself left out), so
no graph fills with copies and every row is indexed.

Defined results: vectors that are null, empty, zero, or hold a null, NaN or
infinite component take no part, as rows or as queries; vectors of different
lengths are never compared; ties go to the smaller id; a query with fewer than
``k`` candidates gets them all; repeated rows (id and vector) are one row; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.llm.common import mix, stored

K = 10
M = 12
EF_BUILD = 64
EF_SEARCH = 96
SHARD_ROWS = 4096
QUERY_BLOCK = 4096


class Graph:
    """A small-world graph over the rows of ``data`` (float64)."""

    def __init__(self, data: np.ndarray, levels: np.ndarray, flat: list[np.ndarray] | None = None, entry: int = -1):
        self.data, self.levels, self.entry = data, levels, entry
        top = int(levels.max()) if len(levels) else 0
        self.flat = flat or [np.full((len(data), 2 * M if level == 0 else M), -1, dtype=np.int32) for level in range(top + 1)]

    @classmethod
    def build(cls, data: np.ndarray, keys: np.ndarray) -> Graph:
        """Insert all rows; ``keys`` are hashes that draw the levels."""
        draw = (mix(keys.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
        levels = np.minimum((-np.log(np.maximum(draw, 1e-15)) / math.log(M)).astype(np.int64), 8)
        graph = cls(data, levels)
        graph._links: list[list[list[int]]] = [[[] for _ in range(len(data))] for _ in graph.flat]
        square = (data * data).sum(axis=1)
        for i in range(len(data)):
            # All distances to the new vector in one matrix-vector product: cheaper than many small ones.
            near = square[:i] - 2.0 * (data[:i] @ data[i]) + square[i]
            graph._insert(i, near.tolist())
        for level, links in enumerate(graph._links):
            for i, own in enumerate(links):
                graph.flat[level][i, :len(own)] = own
        del graph._links
        return graph

    def _insert(self, i: int, near: list[float]) -> None:
        level = int(self.levels[i])
        if self.entry < 0:
            self.entry = i
            return
        at, top = self.entry, int(self.levels[self.entry])
        for k in range(top, level, -1):
            moved = True
            while moved:
                moved = False
                for x in self._links[k][at]:
                    if near[x] < near[at]:
                        at, moved = x, True
        entries = [at]
        for k in range(min(level, top), -1, -1):
            found = self._explore(entries, EF_BUILD, near.__getitem__, self._links[k].__getitem__)
            chosen = self._choose([x for _, x in found], np.array([d for d, _ in found]), M)
            self._links[k][i] = chosen
            room = 2 * M if k == 0 else M
            for x in chosen:
                back = self._links[k][x]
                back.append(i)
                if len(back) > room:
                    delta = self.data[back] - self.data[x]
                    far = (delta * delta).sum(axis=1)
                    order = np.argsort(far, kind="stable")
                    self._links[k][x] = self._choose([back[j] for j in order], far[order], room)
            entries = [x for _, x in found]
        if level > top:
            self.entry = i

    def _choose(self, rows: list[int], far: np.ndarray, room: int) -> list[int]:
        """Up to ``room`` of the rows (nearest first), each nearer to the vector than to any chosen before it."""
        if len(rows) <= room // 2:
            return list(rows)
        own = self.data[rows]
        square = (own * own).sum(axis=1)
        between = square[:, None] + square[None, :] - 2.0 * (own @ own.T)
        kept, free = [], np.ones(len(rows), dtype=bool)
        for j in range(len(rows)):
            if free[j]:
                kept.append(j)
                if len(kept) == room:
                    break
                free &= between[j] >= far
        if len(kept) < room:
            have = set(kept)
            kept += [j for j in range(len(rows)) if j not in have][:room - len(kept)]
        return [rows[j] for j in kept]

    @staticmethod
    def _explore(entries: list[int], ef: int, distance, neighbours) -> list[tuple[float, int]]:
        """Best-first search of one level: the ``ef`` nearest found, nearest first."""
        seen = set(entries)
        todo = [(distance(x), x) for x in entries]
        best = [(-d, x) for d, x in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > ef:
            heapq.heappop(best)
        while todo:
            d, x = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= ef:
                break
            for y in neighbours(x):
                if y not in seen:
                    seen.add(y)
                    dy = distance(y)
                    if len(best) < ef:
                        heapq.heappush(best, (-dy, y))
                        heapq.heappush(todo, (dy, y))
                    elif dy < -best[0][0]:
                        heapq.heapreplace(best, (-dy, y))
                        heapq.heappush(todo, (dy, y))
        return sorted((-d, x) for d, x in best)

    def search(self, query: np.ndarray, k: int, ef: int = EF_SEARCH) -> list[int]:
        """The places of about the ``k`` nearest rows; only visited rows are measured."""
        if not len(self.data):
            return []
        known: dict[int, float] = {}

        def distance(x: int) -> float:
            if x not in known:
                delta = self.data[x] - query
                known[x] = float(delta @ delta)
            return known[x]

        def neighbours(level: int):
            flat = self.flat[level]

            def of(x: int) -> list[int]:
                own = flat[x]
                own = own[own >= 0]
                new = [y for y in own.tolist() if y not in known]
                if new:
                    delta = self.data[new] - query
                    known.update(zip(new, np.einsum("ij,ij->i", delta, delta).tolist(), strict=True))
                return own.tolist()
            return of

        at = self.entry
        for level in range(int(self.levels[at]), 0, -1):
            of, moved = neighbours(level), True
            while moved:
                moved = False
                for x in of(at):
                    if known[x] < distance(at):
                        at, moved = x, True
        return [x for _, x in self._explore([at], max(ef, k), distance, neighbours(0))[:k]]


# --- Spark -------------------------------------------------------------------

def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, k: int = K) -> DataFrame:
    """(vec, ids): each different vector with the ``k + 1`` least ids of its rows.

    The rank keeps k + 1 rows of a vector in every task before the shuffle, so a vector of a third of all rows
    does not meet in one task.
    """
    order = Window.partitionBy("vec").orderBy("id")
    near = vectors.select("vec", "id").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    return near.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))


_SHARD = "shard string, dims int, rows int, vectors binary, levels binary, entry int, neighbours array<binary>, ids array<array<long>>"


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: its vectors, levels, entry point, flat neighbour arrays and ids."""
    n_shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.concat_ws(":", F.size("vec"), F.pmod(F.xxhash64(F.element_at("ids", 1)), F.lit(n_shards))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(first=[int(x[0]) for x in rows["ids"]]).sort_values("first", kind="stable")
        data = np.stack(rows["vec"].tolist()).astype(np.float64)
        keys = rows["first"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(mix(keys), kind="stable")  # insert in hash order: ids may be sorted by cluster
        data, ids = data[order], [[int(x) for x in rows["ids"].iloc[i]] for i in order]
        graph = Graph.build(data, keys[order] ^ np.uint64(0x5DEECE66D))
        return pd.DataFrame({"shard": [key[0]], "dims": [data.shape[1]], "rows": [len(data)], "vectors": [data.tobytes()],
                             "levels": [graph.levels.tobytes()], "entry": [graph.entry],
                             "neighbours": [[x.tobytes() for x in graph.flat]], "ids": [ids]})
    return dealt.groupBy("shard").applyInPandas(run, _SHARD)


def search_index(index: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the merged ``k`` nearest of each (id, vec) query, its own row left out."""
    shards = index.select(F.col("shard").alias("to_shard"), "dims")
    n_blocks = max(1, -(-queries.count() // query_block))
    asked = queries.withColumn("to_block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    # The stated queries go to every shard of their length, in blocks.
    asked = asked.join(shards, F.size("vec") == F.col("dims")).select("to_shard", "to_block", "id", "vec")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(graph) and len(asked):
            g = graph.iloc[0]
            data = np.frombuffer(g["vectors"], np.float64).reshape(int(g["rows"]), int(g["dims"]))
            flat = [np.frombuffer(x, np.int32).reshape(len(data), -1) for x in g["neighbours"]]
            own = Graph(data, np.frombuffer(g["levels"], np.int64), flat, int(g["entry"]))
            for query_id, vec in zip(asked["id"], asked["vec"], strict=True):
                query = np.asarray(vec, dtype=np.float64)
                near: list[tuple[float, int]] = []
                for x in own.search(query, k + 1):
                    delta = data[x] - query
                    far = math.sqrt(float((delta * delta).sum()))
                    near += [(far, int(i)) for i in g["ids"][x] if i != query_id]
                out += [(int(query_id), i, far) for far, i in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (graphs.groupBy("shard", "block").cogroup(asked.groupBy("to_shard", "to_block"))
             .applyInPandas(run, "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K,
            shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest rows of each row whose id is divisible by ``every``, against all rows."""
    rows = vectors.select(vectors[f"`{id_col}`"].cast("long").alias("id"), vectors[f"`{vector_col}`"].alias("vec"))
    rows = rows.filter(usable(F.col("vec")) & F.col("id").isNotNull())
    nodes = stored(distinct_vectors(rows, k), "vectors")
    index = stored(build_index(nodes, shard_rows), "graphs")
    asked = rows.filter(F.col("id") % every == 0).distinct()
    return search_index(index, asked, k)
