"""Row-wise predictor updates of partitioned rows under saved or current forests.

Rows take new predictors one by one in an order by a keyed hash; a row that would leave a leaf of any tree empty keeps its
old ones, in all trees. The outcome is that of the scan, without one:

* a row on its way out of a leaf finds there, besides itself, all rows of the leaf that come later in the order. So only the
  leaf's last row can find it empty, and only if all rows of the leaf are on their way out: such a leaf is tight;
* all other rows move. So at most one row for each leaf of the forests is contested, whatever the number of rows;
* a contested row stays if, in a tight leaf of which it is the last, no row has arrived before it and no contested row has
  stayed. First arrivals of rows that move for sure come from one more pass; contested rows, as few as leaves, are settled
  in order from what is then known of them.

Two passes in which tasks send a row for a leaf at most, and a flag for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesum.functions.scalar import u01
from treesum.operators.forest import Packed, _matrix, packed


class _Leaves:
    """Leaves of several forests, each with predictors of its own, as places in one range."""

    def __init__(self, forests: list[Packed]):
        self.forests = forests
        self.first = np.cumsum([0, *(len(f.var) for f in forests)])

    def moves(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaf now and leaf after of each row, tree by tree. Columns: h, row_id, then x and new of each forest."""
        for i, f in enumerate(self.forests):
            x, new = _matrix(batch.column(2 + 2 * i)), _matrix(batch.column(3 + 2 * i))
            for k in range(len(f.start)):
                yield self.first[i] + f.leaves(x, k), self.first[i] + f.leaves(new, k)


def _keyed(rows: DataFrame, pairs: list[tuple[str, str]], seed: int) -> DataFrame:
    return rows.select(u01(F.lit(seed), F.col("row_id")).alias("h"), F.col("row_id").cast("long").alias("row_id"), *(F.col(c).cast("array<double>").alias(f"_{i}{j}") for i, p in enumerate(pairs) for j, c in enumerate(p)))


def _tight(d: DataFrame, leaves: _Leaves) -> dict[int, tuple]:
    """The last row (h, row_id) of each leaf that all of its rows are to leave."""
    n = int(leaves.first[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, out = np.zeros(n, np.int64), np.zeros(n, np.int64)
        last_h, last_id = np.full(n, -1.0), np.zeros(n, np.int64)
        for b in batches:
            h, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((ids, h))
            for old, new in leaves.moves(b):
                there += np.bincount(old, minlength=n)
                out += np.bincount(old[old != new], minlength=n)
                # of rows in order, the last of a leaf is the one that stays written
                top = np.full(n, -1)
                top[old[order]] = order
                at = np.flatnonzero(top >= 0)
                later = (h[top[at]] > last_h[at]) | ((h[top[at]] == last_h[at]) & (ids[top[at]] > last_id[at]))
                at = at[later]
                last_h[at], last_id[at] = h[top[at]], ids[top[at]]
        at = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, there[at], out[at], last_h[at], last_id[at])], names=["leaf", "there", "out", "h", "row_id"])

    sums = d.mapInArrow(run, "leaf long, there long, out long, h double, row_id long").groupBy("leaf").agg(F.sum("there").alias("there"), F.sum("out").alias("out"), F.max(F.struct("h", "row_id")).alias("last"))
    # a row for a leaf at most
    return {r["leaf"]: (r["last"]["h"], r["last"]["row_id"]) for r in sums.where("there = out").select("leaf", "last").collect()}


def _arrivals(d: DataFrame, leaves: _Leaves, tight: dict[int, tuple]) -> tuple[dict[int, tuple], dict[tuple, dict]]:
    """The first row that surely moves into each tight leaf, and for each contested row the tight leaves it is in, leaves
    and comes to."""
    contested = np.array(sorted({i for _, i in tight.values()}), np.int64)
    is_tight = np.zeros(int(leaves.first[-1]), bool)
    is_tight[list(tight)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple] = {}
        for b in batches:
            h, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.lexsort((ids, h))[::-1]
            unsure = np.isin(ids, contested)
            told = []
            for old, new in leaves.moves(b):
                come = order[(old != new)[order] & is_tight[new[order]] & ~unsure[order]]
                top = dict(zip(new[come].tolist(), come.tolist(), strict=True))
                for leaf, i in top.items():
                    key = (float(h[i]), int(ids[i]))
                    first[leaf] = min(first.get(leaf, key), key)
                for i in np.flatnonzero(unsure):
                    if is_tight[old[i]] or old[i] != new[i] and is_tight[new[i]]:
                        told.append((int(old[i]), int(new[i]), float(h[i]), int(ids[i])))
            yield _rows(told)
        yield _rows([(-1, leaf, *key) for leaf, key in first.items()])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["old", "new", "h", "row_id"])

    found = d.mapInArrow(run, "old long, new long, h double, row_id long")
    sure = found.where("old < 0").groupBy("new").agg(F.min(F.struct("h", "row_id")).alias("k")).select(F.lit(-1).cast("long").alias("old"), "new", "k.h", "k.row_id")
    first, rows = {}, {}
    for r in found.where("old >= 0").unionByName(sure).collect():
        key = (r["h"], r["row_id"])
        if r["old"] < 0:
            first[r["new"]] = key
            continue
        own = rows.setdefault(key, {"in": set(), "out": set(), "to": set()})
        if r["old"] in tight:
            own["in"].add(r["old"])
            if r["old"] != r["new"]:
                own["out"].add(r["old"])
        if r["new"] in tight and r["old"] != r["new"]:
            own["to"].add(r["new"])
    return first, rows


def refused(rows: DataFrame, forests: list[DataFrame], pairs: list[tuple[str, str]], seed: int = 1) -> list[int]:
    """Ids of the rows that keep their predictors, at most one for a leaf. rows(row_id, and for each forest the columns
    `pairs` names: predictors now and after); row ids are different."""
    leaves = _Leaves([packed(t) for t in forests])
    d = _keyed(rows, pairs, seed)
    tight = _tight(d, leaves)
    if not tight:
        return []
    first, contested = _arrivals(d, leaves, tight)
    filled = {leaf for leaf in tight if leaf in first and first[leaf] < tight[leaf]}
    stay = []
    for key in sorted(contested):
        own = contested[key]
        if any(tight[leaf] == key and leaf not in filled for leaf in own["out"]):
            stay.append(key[1])
            filled |= own["in"]
        else:
            filled |= own["to"]
    return stay


def partial_update(rows: DataFrame, forests: list[DataFrame], pairs: list[tuple[str, str]], seed: int = 1) -> DataFrame:
    """rows with ok: whether the row takes its new predictors, in all forests or in none."""
    stay = refused(rows, forests, pairs, seed)
    if not stay:
        return rows.withColumn("ok", F.lit(True))
    # as few as leaves
    few = rows.sparkSession.createDataFrame([(i,) for i in stay], "_id long")
    return rows.join(F.broadcast(few), F.col("row_id") == F.col("_id"), "left").withColumn("ok", F.col("_id").isNull()).drop("_id")
