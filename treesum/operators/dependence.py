"""Partial dependence: the average forest with a column, or two, held at each level over all rows.

A leaf gives its mean at the levels that its path admits to as many rows as meet the rest of the path. So the rows are
read once, to count for each leaf those that meet what its path asks of the other variables; levels are then held against
the leaves' intervals, without the rows. Probabilities of binary responses are no sums of leaves: there the rows are scored
at every level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesum.functions.scalar import phi
from treesum.operators.forest import KEY, _matrix, packed, structure
from treesum.sources.staging import staged

#: Probabilities of the levels where a column has many values (fixed values).
LEVELS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def levels(df: DataFrame, column: str, probs: tuple = LEVELS, two_way: bool = False) -> list[float]:
    """Sorted distinct values where there are fewer than probs (as few, in two-way), else distinct quantiles. The distinct
    values are looked at only up to that number."""
    few = df.select(F.col(column).cast("double").alias("v")).where("v is not null").distinct().limit(len(probs) + 1).collect()
    if len(few) < len(probs) or (two_way and len(few) == len(probs)):
        return sorted(r["v"] for r in few)
    q = df.agg(F.percentile(F.col(column).cast("double"), F.array(*map(F.lit, probs))).alias("q")).first()["q"]
    return sorted(set(q))


def positions(names: list[str], which: int | str | list[int | str] | None = None) -> list[int]:
    """Places of predictors among names: by number, by name, by the term that gave several of them ("flag" for "flag.A"
    and "flag.B"), all of them for None."""
    if which is None:
        return list(range(len(names)))
    out: list[int] = []
    for w in [which] if isinstance(which, (int, str)) else which:
        if isinstance(w, int):
            found = [w] if 0 <= w < len(names) else []
        else:
            found = [i for i, n in enumerate(names) if n == w] or [i for i, n in enumerate(names) if n.startswith(f"{w}.")]
        if not found:
            raise ValueError(f"no predictor {w!r}")
        out += [i for i in found if i not in out]
    return out


def partial_by_name(trees: DataFrame, rows: DataFrame, names: list[str], which: int | str | list | None, values: dict[str, list[float]], lo: float = -0.5, span: float = 1.0, binary: bool = False) -> DataFrame:
    """One-way dependence of several predictors in one table: (name, chain, sample, level1, value)."""
    out = None
    for i in positions(names, which):
        one = partial(trees, rows, [i], [values[names[i]]], lo, span, binary).withColumn("name", F.lit(names[i]))
        out = one if out is None else out.unionByName(one)
    return out


def partial(trees: DataFrame, rows: DataFrame, variables: list[int], values: list[list[float]], lo: float = -0.5, span: float = 1.0, binary: bool = False) -> DataFrame:
    """(chain, sample, level1[, level2], value): for each level, or pair of levels, the average over rows(row_id, x, offset)
    of the forest with the variables held there."""
    return scored(trees, rows, variables, values, lo, span, True) if binary else by_occupancy(trees, rows, variables, values, lo, span)


def occupancy(trees: DataFrame, rows: DataFrame, free: list[int]) -> DataFrame:
    """(chain, sample, tree, node, k, s): the rows(x, offset) that meet what the path to each leaf asks of all variables but
    the free ones; and a row of -1s with the number of rows and the sum of offsets. A task sends a row for a leaf at most."""
    f = packed(trees)
    open_ = np.isin(f.var, free)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n, s = np.zeros(len(f.var), np.int64), 0, 0.0
        for batch in batches:
            x = _matrix(batch.column(0))
            n, s = n + len(x), s + float(batch.column(1).to_numpy(zero_copy_only=False).sum())
            for root in f.start:
                todo = [(root, np.arange(len(x)))]
                while todo:
                    i, at = todo.pop()
                    a, b = f.child[i]
                    if f.var[i] < 0 or not len(at):
                        k[i] += len(at)
                    elif open_[i]:
                        todo += [(a, at), (b, at)]
                    else:
                        right = x[at, f.var[i]] > f.value[i]
                        todo += [(a, at[~right]), (b, at[right])]
        there = np.flatnonzero(k)
        tree = np.searchsorted(f.start, there, side="right") - 1
        keys = [np.append(f.keys[c].to_numpy()[tree], -1).astype(np.int32) for c in KEY]
        yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(np.append(there - f.start[tree], -1).astype(np.int32)), pa.array(np.append(k[there], n)), pa.array(np.append(np.zeros(len(there)), s))], [*KEY, "node", "k", "s"])

    d = rows.select("x", F.col("offset").cast("double")).mapInArrow(run, "chain int, sample int, tree int, node int, k long, s double")
    return d.groupBy(*KEY, "node").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))


def by_occupancy(trees: DataFrame, rows: DataFrame, variables: list[int], values: list[list[float]], lo: float, span: float) -> DataFrame:
    two = len(variables) == 2
    found = staged(occupancy(trees, rows, variables), "occupancy")
    whole = found.where("node = -1").agg(F.sum("k"), F.sum("s")).first()
    n, offset = whole[0] or 0, whole[1] or 0.0
    levels = [np.array(v, float) for v in values]

    def admits(level: np.ndarray, low: float, high: float) -> np.ndarray:
        return ((level > low) | (low == -np.inf)) & ~(level > high)

    def draw(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        """One draw: leaves' means times their rows, at the levels they admit."""
        g = g.sort_values(["tree", "node"])
        total = np.zeros([len(v) for v in levels])
        var, value, k = g["var"].to_numpy(), g["value"].to_numpy(), g["k"].to_numpy()
        first = np.flatnonzero(g["node"].to_numpy() == 0)
        for a, e in zip(first, [*first[1:], len(g)], strict=True):
            left, _, parent, _ = structure(var[a:e])
            low, high = np.full((e - a, len(levels)), -np.inf), np.full((e - a, len(levels)), np.inf)
            for i in range(e - a):
                p = parent[i]
                if p >= 0:
                    low[i], high[i] = low[p], high[p]
                    for j, v in enumerate(variables):
                        if var[a + p] == v and left[p] == i:
                            high[i, j] = min(high[i, j], value[a + p])
                        elif var[a + p] == v:
                            low[i, j] = max(low[i, j], value[a + p])
                if var[a + i] < 0 and k[a + i]:
                    sides = [admits(v, low[i, j], high[i, j]) for j, v in enumerate(levels)]
                    total += value[a + i] * k[a + i] * (np.outer(*sides) if two else sides[0])
        out = lo + span * (total / n + 0.5) + offset / n
        at = np.meshgrid(*levels, indexing="ij")
        d = {"chain": int(key[0]), "sample": int(key[1]), **{f"level{j + 1}": x.ravel() for j, x in enumerate(at)}, "value": out.ravel()}
        return pd.DataFrame(d)

    leaves = trees.select(*KEY, "node", "var", "value").join(found.drop("s"), [*KEY, "node"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    if not n:
        leaves = leaves.limit(0)
    return leaves.groupBy("chain", "sample").applyInPandas(draw, "chain int, sample int, level1 double" + ", level2 double" * two + ", value double")


def scored(trees: DataFrame, rows: DataFrame, variables: list[int], values: list[list[float]], lo: float = -0.5, span: float = 1.0, binary: bool = False) -> DataFrame:
    """The same by scoring all rows at every level. Tasks send sums per draw and level, not rows x levels."""
    f = packed(trees)
    draws = f.keys.groupby(["chain", "sample"], sort=True).indices
    points = [(v,) for v in values[0]] if len(variables) == 1 else [(a, b) for a in values[0] for b in values[1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(draws), len(points)))
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, offset = _matrix(part.column(0)).copy(), part.column(1).to_numpy(zero_copy_only=False)
                n += len(x)
                for j, point in enumerate(points):
                    for v, p in zip(variables, point, strict=True):
                        x[:, v] = p
                    for i, ks in enumerate(draws.values()):
                        s = lo + span * (sum(f.value[f.leaves(x, k)] for k in ks) + 0.5) + offset
                        sums[i, j] += (phi(s) if binary else s).sum()
        if n:
            i, j = np.meshgrid(np.arange(len(draws)), np.arange(len(points)), indexing="ij")
            keys = np.array(list(draws), np.int32)
            pts = np.array([p if len(p) == 2 else (p[0], np.nan) for p in points])
            yield pa.RecordBatch.from_arrays([pa.array(keys[i.ravel(), 0]), pa.array(keys[i.ravel(), 1]), pa.array(pts[j.ravel(), 0]), pa.array(pts[j.ravel(), 1]), pa.array(sums.ravel()), pa.array(np.full(sums.size, n, np.int64))], ["chain", "sample", "level1", "level2", "s", "n"])

    d = rows.select("x", "offset").mapInArrow(run, "chain int, sample int, level1 double, level2 double, s double, n long")
    by = ["chain", "sample", "level1", *(["level2"] if len(variables) == 2 else [])]
    return d.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias("value"))
