"""Forest tables under other rows or other cuts: empty sides collapse, rules move to new cuts, for all chains and samples at once.

A node of a tree in pre-order covers the interval of nodes from itself to the last of its subtree, so what lies below a
node, and which collapse is topmost, are questions about intervals: windows over the few nodes of a tree, all with one
partitioning. Rows never meet trees one by one: tasks add up rows and weights by leaf, and only those sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from treesum.operators.forest import KEY, SCHEMA, _matrix, packed, structure


def _along() -> WindowSpec:
    """The nodes of a tree in order."""
    return Window.partitionBy(*KEY).orderBy("node")


def _on() -> WindowSpec:
    return _along().rowsBetween(0, Window.unboundedFollowing)


def intervals(trees: DataFrame) -> DataFrame:
    """trees with last, the last node of the subtree: where leaves first outnumber splits, counted from the node on."""
    step = F.when(F.col("var") >= 0, 1).otherwise(-1)
    sums = F.sum(step).over(_along().rowsBetween(Window.unboundedPreceding, 0))
    t = trees.withColumn("_sum", sums).withColumn("_step", step)
    ahead = F.collect_list("_sum").over(_on())
    return t.withColumn("last", (F.col("node") + F.array_position(ahead, F.col("_sum") - F.col("_step") - 1) - 1).cast("int")).drop("_sum", "_step")


def _below(column: str) -> F.Column:
    """Values of a column over the nodes of the subtree, in order; nulls are no values of it, so it must have none."""
    return F.slice(F.collect_list(column).over(_on()), F.lit(1), F.col("last") - F.col("node") + 1)


def _total(values: F.Column, kind: str) -> F.Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def leaf_sums(trees: DataFrame, rows: DataFrame) -> DataFrame:
    """(chain, sample, tree, node, k, w): rows(x[, weight]) that come to each leaf, and their weights; leaves without rows
    are left out. A task sends a row for a leaf at most."""
    f = packed(trees)
    ends = [*f.start[1:], len(f.var)]
    weighted = "weight" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, w = np.zeros(len(f.var), np.int64), np.zeros(len(f.var))
        for b in batches:
            x, own = _matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False) if weighted else None
            for t, (a, e) in enumerate(zip(f.start, ends, strict=True)):
                at = f.leaves(x, t) - a
                k[a:e] += np.bincount(at, minlength=e - a)
                if weighted:
                    w[a:e] += np.bincount(at, own, e - a)
        there = np.flatnonzero(k)
        tree = np.searchsorted(f.start, there, side="right") - 1
        keys = [pa.array(f.keys[c].to_numpy()[tree].astype(np.int32)) for c in KEY]
        yield pa.RecordBatch.from_arrays([*keys, pa.array((there - f.start[tree]).astype(np.int32)), pa.array(k[there]), pa.array((w if weighted else k.astype(float))[there])], names=[*KEY, "node", "k", "w"])

    d = rows.select("x", F.col("weight").cast("double")) if weighted else rows.select("x")
    return d.mapInArrow(run, "chain int, sample int, tree int, node int, k long, w double").groupBy(*KEY, "node").agg(F.sum("k").alias("k"), F.sum("w").alias("w"))


def collapsed(nodes: DataFrame) -> DataFrame:
    """nodes(trees' columns, last, bad, w): splits marked bad become leaves, the topmost of nested ones, with the mean of the
    leaves below weighted by w (their plain mean, if the weights are 0), and nodes are numbered anew."""
    covered = lambda mark: F.coalesce(F.max(F.when(F.col(mark), F.col("last"))).over(_along().rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) >= F.col("node")
    d = nodes.withColumn("_top", F.col("bad") & ~covered("bad"))
    # leaves below as (weight, mean), (0, null) in the place of a split
    d = d.withColumn("_leaf", F.struct(F.when(F.col("var") < 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0).alias("w"), F.when(F.col("var") < 0, F.col("value")).alias("m")))
    d = d.withColumn("_leaves", F.filter(_below("_leaf"), lambda x: x["m"].isNotNull()))
    weights = _total(F.transform("_leaves", lambda x: x["w"]), "double")
    mean = F.when(weights > 0, _total(F.transform("_leaves", lambda x: x["w"] * x["m"]), "double") / weights).otherwise(_total(F.transform("_leaves", lambda x: x["m"]), "double") / F.size("_leaves"))
    d = d.withColumn("_mean", F.when(F.col("_top"), mean)).withColumn("_gone", covered("_top")).where(~F.col("_gone"))
    d = d.withColumns({"value": F.coalesce("_mean", "value"), "var": F.when(F.col("_top"), F.lit(-1)).otherwise(F.col("var")), "node": (F.row_number().over(_along()) - 1).cast("int")})
    return d.select(*[f"{c.split()[0]}" for c in SCHEMA.split(", ")])


def prune(trees: DataFrame, rows: DataFrame) -> DataFrame:
    """trees under rows(x[, weight]): nodes count the rows that pass them, and splits with an empty side go."""
    d = trees.drop("n").join(leaf_sums(trees, rows), [*KEY, "node"], "left").withColumns({"k": F.coalesce("k", F.lit(0)), "w": F.coalesce("w", F.lit(0.0))})
    d = intervals(d).withColumn("n", _total(_below("k"), "long"))
    left = F.lead("n").over(_along())
    d = d.withColumn("bad", (F.col("var") >= 0) & ((left == 0) | (left == F.col("n"))))
    return collapsed(d)


def map_cuts(trees: DataFrame, cuts: dict[int, list[float]]) -> DataFrame:
    """Rules move to the nearest of the new cuts (ascending, by variable; the higher of two equally near) within what their
    ancestors leave; where nothing is left the split goes, and what stays has the plain mean of its leaves. Counts stay."""
    grid = {v: np.asarray(c, float) for v, c in cuts.items()}

    def move(g: pd.DataFrame) -> pd.DataFrame:
        """The trees of one draw."""
        g = g.sort_values(["tree", "node"]).reset_index(drop=True)
        var, value, bad = g["var"].to_numpy(), g["value"].to_numpy(float).copy(), np.zeros(len(g), bool)
        first = np.flatnonzero(g["node"].to_numpy() == 0)
        for a, e in zip(first, [*first[1:], len(g)], strict=True):
            left, right, _, _ = structure(var[a:e])
            lo, hi = {}, {}

            def go(i: int) -> None:
                v = int(var[a + i])  # noqa: B023
                if v < 0:
                    return
                new = grid.get(v, np.zeros(0))
                low, high = lo.get(v, 0), hi.get(v, len(new))  # noqa: B023
                if low >= high:
                    bad[a + i] = True  # noqa: B023
                    return
                away = np.abs(new[low:high] - value[a + i])  # noqa: B023
                at = high - 1 - int(away[::-1].argmin())
                value[a + i] = new[at]  # noqa: B023
                hi[v] = at  # noqa: B023
                go(left[i])  # noqa: B023
                hi[v], lo[v] = high, at + 1  # noqa: B023
                go(right[i])  # noqa: B023
                lo[v] = low  # noqa: B023

            go(0)
        return g.assign(value=value, bad=bad)

    moved = trees.select(*[c.split()[0] for c in SCHEMA.split(", ")]).groupBy("chain", "sample").applyInPandas(move, SCHEMA + ", bad boolean")
    return collapsed(intervals(moved).withColumn("w", F.lit(0.0)))


def adapt(trees: DataFrame, rows: DataFrame, cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """A saved forest under other data: rules move to new cuts, if there are any, then splits without rows on a side go."""
    return prune(trees if cuts is None else map_cuts(trees, cuts), rows)
