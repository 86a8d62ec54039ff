"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(256 x), and are grouped by length into geometric buckets, large buckets into blocks of
about BLOCK rows. Queries are gathered in blocks too. Query blocks and vector blocks meet in the cells of a grid; the
grid is a stated query set against all rows, block by block. A vector block is sent to those rows of the grid only where
some query may still take a vector as long as its longest. In a cell, a query block visits vector blocks from the
longest down and keeps its k best. Its k-th score, first taken from the block with the longest vectors of all, gives
each query a local cosine threshold t = score / (|q| |v| at most) for a block:

* t > 1: the block is skipped;
* t >= COORDINATE: coordinate pruning, rows whose largest-query coordinates lie outside what cosine t admits are left out;
* else: length pruning, only the rows long enough are multiplied.

What is left is verified by whole inner products, so the result is exact.

Defined results: null vectors, null or non-finite components and null ids take no part; vectors meet vectors of their own
dimension only; rows that share an id count once, by their smallest vector; ties go to the smaller id; a query with fewer
than k candidates returns them all; scores outside 64 bits are held at the ends; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treesum.llm.common import stage

BLOCK, QUERIES, RATIO = 4096, 512, 1.05
#: Blocks of a grid cell at most, of vectors and of queries: what is sent is each side once for every so many of the other.
CELL_BLOCKS, CELL_QUERIES = 32, 32
COORDINATE, FOCUS = 0.75, 4
_SLACK = 1e-9


def valid(embedding: str = "embedding") -> F.Column:
    return F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _packed(df: DataFrame, rows: int, ratio: float) -> DataFrame:
    """df(vec_id, embedding) to blocks (dim, id, n, longest, ids, data) of about `rows` rows each, by length."""
    # lengths of the integer vectors, as doubles: they only choose the bucket
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x * 65536.0))
    d = df.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.floor(F.log(norm + 1) / float(np.log(ratio))).alias("bucket"))
    counts = d.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / rows).alias("parts"))
    # one row per dimension and bucket of a geometric scale: bounded by the range of numbers, not by the rows
    d = d.join(F.broadcast(counts), ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids = g["vec_id"].to_numpy(np.int64)
        v = np.floor(256.0 * np.array(g["embedding"].tolist(), np.float64).reshape(len(g), int(key[0])))
        length = np.sqrt((v * v).sum(1))
        order = np.lexsort((ids, -length))
        small = not v.size or np.abs(v).max() < 32_000
        data = v[order].astype(np.int16 if small else np.float64)
        return pd.DataFrame({"dim": [key[0]], "id": [f"{key[1]}.{key[2]}"], "n": [len(g)], "longest": [float(length.max())], "small": [small], "ids": [ids[order].tobytes()], "data": [data.tobytes()]})

    return d.groupBy("dim", "bucket", "part").applyInPandas(pack, "dim int, id string, n int, longest double, small boolean, ids binary, data binary")


def _unpacked(r) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(r.ids, np.int64)
    return ids, np.frombuffer(r.data, np.int16 if r.small else np.float64).reshape(len(ids), -1).astype(np.float64)


class Best:
    """The k best (score, id) of each query so far, and the least score that can still enter."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.length = np.sqrt((q * q).sum(1))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.copy()
        self.top: list[list[tuple]] = [[] for _ in ids]

    def visit(self, ids: np.ndarray, v: np.ndarray) -> None:
        """v by descending length."""
        length = np.sqrt((v * v).sum(1))
        reach = self.length * length[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(reach > 0, self.floor / reach, np.where(self.floor > 0, np.inf, -np.inf))
        live = np.flatnonzero(t <= 1 + _SLACK)
        exact = reach.max(initial=0.0) < 2.0**52
        sharp = live[t[live] >= COORDINATE] if exact else live[:0]
        broad = live[t[live] < COORDINATE] if exact else live
        if len(sharp):
            unit = v / np.maximum(length, 1e-300)[:, None]
            for i in sharp:
                u = self.q[i] / self.length[i]
                rows = np.flatnonzero(self.length[i] * length >= self.floor[i] * (1 - _SLACK))
                for c in np.argsort(-np.abs(u))[:FOCUS]:
                    # cosine >= t leaves this range for a unit vector's coordinate c
                    w = np.sqrt(max(0.0, 1 - t[i] ** 2) * max(0.0, 1 - u[c] ** 2))
                    x = unit[rows, c]
                    if u[c] < 0:
                        x = -x
                    a = abs(u[c])
                    rows = rows[(x >= t[i] * a - w - 1e-6) & (x <= (1.0 if a >= t[i] else t[i] * a + w) + 1e-6)]
                if len(rows):
                    self._enter(i, v[rows] @ self.q[i], ids[rows])
        if not exact:
            for i in broad:
                whole = [[int(x) for x in r] for r in v]
                own = [int(x) for x in self.q[i]]
                s = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(r, own, strict=True)))) for r in whole], object)
                self._enter(i, s, ids)
        elif len(broad):
            need = np.where(self.length[broad] > 0, self.floor[broad] / np.maximum(self.length[broad], 1e-300), -np.inf) * (1 - _SLACK)
            rows = len(length) if (need <= 0).any() else int((length >= need.min()).sum())
            s = self.q[broad] @ v[:rows].T
            for j, i in enumerate(broad):
                self._enter(i, s[j], ids[:rows])

    def _enter(self, i: int, s: np.ndarray, ids: np.ndarray) -> None:
        ok = np.flatnonzero((s >= self.floor[i]) & (ids != self.ids[i]))
        if len(ok) > 4 * self.k:
            kth = np.partition(s[ok], len(ok) - self.k)[len(ok) - self.k]
            ok = ok[s[ok] >= kth]
        if not len(ok):
            return
        top = sorted([*self.top[i], *((-int(s[j]), int(ids[j])) for j in ok)])[: self.k]
        self.top[i] = top
        if len(top) == self.k:
            self.floor[i] = max(self.floor[i], float(-top[-1][0]))

    def rows(self) -> pd.DataFrame:
        flat = [(int(q), v, -s) for q, top in zip(self.ids, self.top, strict=True) for s, v in top]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"]).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors and queries (vec_id, embedding) to (query_id, rank, vec_id, score): the k largest integer inner products."""
    once = lambda df: df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(valid() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    v = stage(_packed(once(vectors), BLOCK, RATIO), "vectors")
    q = _packed(once(queries), QUERIES, 1e6)
    # the longest block of each dimension, at most BLOCK rows or so, gives the first thresholds
    longest = v.groupBy("dim").agg(F.max(F.struct("longest", "id")).alias("m")).select("dim", F.col("m.id").alias("id"))
    first = F.broadcast(v.join(F.broadcast(longest), ["dim", "id"]).select("dim", F.struct("small", "ids", "data").alias("v")))

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            rows, least = [], []
            for r in g.itertuples():
                best = Best(*_unpacked(r), k)
                if isinstance(r.v, dict):
                    best.visit(*_unpacked(pd.Series(r.v)))
                rows.append(best.floor.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    least.append(float(np.where(best.length > 0, best.floor / best.length, -np.inf).min(initial=np.inf)))
            yield g.drop(columns="v").assign(floor=rows, need=least)

    fields = "dim int, id string, n int, longest double, small boolean, ids binary, data binary"
    q = stage(q.join(first, "dim", "left").mapInPandas(begin, fields + ", floor binary, need double"), "queries")
    tasks = v.sparkSession.sparkContext.defaultParallelism

    def size(blocks: int, per: int) -> int:
        """Cells no larger than `per` blocks, and smaller ones while there are fewer cells than tasks."""
        return max(1, -(-blocks // per), min(blocks // 4, tasks))

    across, down = size(v.count(), CELL_BLOCKS), size(q.count(), CELL_QUERIES)
    spread = lambda n: F.pmod(F.xxhash64("dim", "id"), F.lit(n)).cast("int")
    q = q.withColumn("y", spread(down)).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    # one row per row of the grid
    wanted = q.groupBy("dim", F.col("y").alias("row")).agg(F.min("need").alias("need"))
    v = v.withColumn("x", spread(across)).join(F.broadcast(wanted), "dim").where(F.col("longest") >= F.col("need") * (1 - 1e-6)).withColumn("y", F.col("row") + 0).drop("need", "row")

    def cell(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        vs = vs.sort_values("longest", ascending=False)
        for r in qs.itertuples():
            best = Best(*_unpacked(r), k, np.frombuffer(r.floor))
            for b in vs[vs["dim"] == r.dim].itertuples():
                best.visit(*_unpacked(b))
            out.append(best.rows())
        return pd.concat(out)

    found = q.groupBy("x", "y").cogroup(v.groupBy("x", "y")).applyInPandas(cell, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(e, e.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
