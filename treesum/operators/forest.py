"""Forests as tables: routing, scoring, replay and structure.

trees(chain int, sample int, tree int, node int, n long, var int, value double): nodes in pre-order from 0; var -1 marks
a leaf, whose value is its mean; else value is the cut, and rows with x[var] > value go right. All others go left, in every
plan: ties, nulls, and NaN, which Spark's own order would put above all numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "chain int, sample int, tree int, node int, n long, var int, value double"
KEY = ["chain", "sample", "tree"]
#: Nodes up to which a forest is scored as generated code, without leaving the JVM.
CASE_NODES = 256


def literal(spark, trees: list[list[tuple]]) -> DataFrame:
    """A forest of chain 0 and sample 0 from nested lists of (var, value) in pre-order, one list per tree; a list may start
    with a (chain, sample) pair given as a dict {'chain': c, 'sample': s}."""
    rows = []
    for t, nodes in enumerate(trees):
        at = {"chain": 0, "sample": 0, "tree": t}
        if isinstance(nodes[0], dict):
            at |= nodes[0]
            nodes = nodes[1:]
        rows += [(at["chain"], at["sample"], at["tree"], i, None, v, float(x)) for i, (v, x) in enumerate(nodes)]
    return spark.createDataFrame(rows, SCHEMA)


def structure(var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, parent, depth) of a tree in pre-order; -1 where there is none."""
    n = len(var)
    left, right, parent, depth = (np.full(n, -1, np.int64) for _ in range(4))
    depth[0] = 0
    open_: list[int] = []
    for i in range(n):
        if i:
            p = open_[-1]
            parent[i], depth[i] = p, depth[p] + 1
            if left[p] < 0:
                left[p] = i
            else:
                right[p] = i
                open_.pop()
        if var[i] >= 0:
            open_.append(i)
    if open_:
        raise ValueError("a tree's rows are not a whole pre-order")
    return left, right, parent, depth


def annotated(trees: DataFrame) -> DataFrame:
    """trees with parent, depth, size (nodes in the subtree), and the path as two arrays: ancestors and whether it goes right."""
    schema = SCHEMA + ", parent int, depth int, size int, ancestors array<int>, rights array<boolean>"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node").reset_index(drop=True)
        left, right, parent, depth = structure(g["var"].to_numpy())
        size, up, goes = np.ones(len(g), np.int64), [[] for _ in range(len(g))], [[] for _ in range(len(g))]
        for i in range(1, len(g)):
            p = parent[i]
            up[i], goes[i] = [*up[p], int(p)], [*goes[p], bool(right[p] == i)]
        for i in range(len(g) - 1, 0, -1):
            size[parent[i]] += size[i]
        return g.assign(parent=parent, depth=depth, size=size, ancestors=up, rights=goes)

    return trees.groupBy(*KEY).applyInPandas(run, schema)


def boxes(trees: DataFrame) -> DataFrame:
    """A row per node with lo and hi arrays over the variables that its path tests: lo < x <= hi, as (var, lo, hi) structs."""
    a = annotated(trees)
    p = a.select(*KEY, F.col("node").alias("_a"), F.col("var").alias("_v"), F.col("value").alias("_c"))
    steps = a.select(*KEY, "node", F.explode(F.arrays_zip(F.col("ancestors").alias("a"), F.col("rights").alias("r"))).alias("s")).select(*KEY, "node", F.col("s.a").alias("_a"), F.col("s.r").alias("r")).join(p, [*KEY, "_a"])
    per = steps.groupBy(*KEY, "node", "_v").agg(F.max(F.when(F.col("r"), F.col("_c"))).alias("lo"), F.min(F.when(~F.col("r"), F.col("_c"))).alias("hi"))
    box = per.groupBy(*KEY, "node").agg(F.collect_list(F.struct(F.col("_v").alias("var"), "lo", "hi")).alias("box"))
    return a.join(box, [*KEY, "node"], "left").withColumn("box", F.coalesce("box", F.expr("array()").cast("array<struct<var:int,lo:double,hi:double>>")))


def inside(x: str, box: str) -> Column:
    """Whether array column x lies in array-of-struct column box."""
    right = lambda b, c: F.coalesce(F.nanvl(F.get(F.col(x), b["var"]), F.lit(None).cast("double")) > b[c], F.lit(False))
    return F.forall(F.col(box), lambda b: (b["lo"].isNull() | right(b, "lo")) & (b["hi"].isNull() | ~right(b, "hi")))


def case_sql(nodes: list[tuple], columns: list[str], leaf: bool = False) -> str:
    """A tree in pre-order as nested CASE, the value of its leaf or the leaf's node number; for small trees."""
    at = iter(range(len(nodes)))

    def go() -> str:
        i = next(at)
        var, value = nodes[i]
        if var < 0:
            return str(i) if leaf else f"CAST({value!r} AS DOUBLE)"
        a, b = go(), go()
        return f"CASE WHEN {columns[var]} > {value!r} THEN {b} ELSE {a} END"

    return go()


class Packed:
    """A forest as flat arrays, for routing in numpy; this is what gets broadcast, so its size is checked.

    A node's children are 2 places in one array; leaves point to themselves, so all rows take the depth's steps."""

    MOST_MB = 512

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values([*KEY, "node"])
        self.var = nodes["var"].to_numpy(np.int64)
        self.value = nodes["value"].to_numpy(float)
        first = np.flatnonzero(nodes["node"].to_numpy() == 0)
        self.start = first
        self.keys = nodes.iloc[first][KEY].reset_index(drop=True)
        self.child = np.empty((len(nodes), 2), np.int64)
        self.depth = np.empty(len(first), np.int64)
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(nodes)], strict=True)):
            left, right, _, depth = structure(self.var[a:b])
            own = np.arange(a, b)
            leaf = self.var[a:b] < 0
            self.child[a:b, 0] = np.where(leaf, own, a + left)
            self.child[a:b, 1] = np.where(leaf, own, a + right)
            self.depth[k] = depth.max()
        size = (self.var.nbytes + self.value.nbytes + self.child.nbytes) / 1e6
        if size > self.MOST_MB:
            raise ValueError(f"a forest of {size:.0f} MB is not broadcast; score it in parts by chain or sample")

    def leaves(self, x: np.ndarray, k: int) -> np.ndarray:
        """The leaf of tree k that each row of x (rows, variables) comes to, as a place in the flat arrays."""
        at = np.full(len(x), self.start[k], np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth[k]):
            v = self.var[at]
            right = (v >= 0) & (x[rows, np.maximum(v, 0)] > self.value[at])
            at = self.child[at, right.astype(np.int64)]
        return at


def packed(trees: DataFrame) -> Packed:
    nodes = trees.count()
    if nodes * 32 > Packed.MOST_MB * 1e6:
        raise ValueError(f"a forest of {nodes} nodes is not gathered; score it in parts by chain or sample")
    return Packed(trees.select(*KEY, "node", "var", "value").toPandas())


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def predict(trees: DataFrame, rows: DataFrame, lo: float = -0.5, span: float = 1.0, keep: list[str] = [], case_nodes: int = CASE_NODES) -> DataFrame:  # noqa: B006
    """rows(row_id, x, offset) to (row_id, chain, sample, value) and the columns of rows to keep: trees summed, put back on the scale of the response
    (lo + span * (sum + 0.5), which is the sum itself by default) and the offset added. A narrow transformation."""
    # one row more than generated code is made for
    few = trees.select(*KEY, "node", "var", "value").limit(case_nodes + 1).toPandas()
    if 0 < len(few) <= case_nodes:
        return _predict_by_case(few, rows, lo, span, keep)
    f = packed(trees)
    draws = f.keys.groupby(["chain", "sample"], sort=True).indices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, offset = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                for (chain, sample), ks in draws.items():
                    s = sum(f.value[f.leaves(x, k)] for k in ks)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, chain, np.int32)), pa.array(np.full(n, sample, np.int32)), pa.array(lo + span * (s + 0.5) + offset), *part.columns[3:]], ["row_id", "chain", "sample", "value", *keep])

    schema = "row_id long, chain int, sample int, value double" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("row_id", "x", "offset", *keep).mapInArrow(run, schema)


def _predict_by_case(nodes: pd.DataFrame, rows: DataFrame, lo: float, span: float, keep: list[str]) -> DataFrame:
    width = max(1, int(nodes["var"].max()) + 1)
    # NaN as null: neither goes right
    columns, draws = [f"nanvl(CAST(x[{i}] AS DOUBLE), CAST(NULL AS DOUBLE))" for i in range(width)], []
    for (chain, sample), g in nodes.sort_values([*KEY, "node"]).groupby(["chain", "sample"]):
        total = " + ".join(f"({case_sql([(int(v), float(c)) for v, c in zip(t['var'], t['value'], strict=True)], columns)})" for _, t in g.groupby("tree"))
        value = (F.expr(total) + F.lit(0.5)) * F.lit(float(span)) + F.lit(float(lo)) + F.col("offset")
        draws.append(F.struct(F.lit(int(chain)).cast("int").alias("chain"), F.lit(int(sample)).cast("int").alias("sample"), value.alias("value")))
    d = rows.select(F.col("row_id").cast("long").alias("row_id"), F.explode(F.array(*draws)).alias("_d"), *keep)
    return d.select("row_id", "_d.chain", "_d.sample", "_d.value", *keep)


def recover_means(leaves: DataFrame, fits: DataFrame) -> DataFrame:
    """Means of leaves (chain, sample, tree, node, value) from the leaf of each row, as leaf_of gives, and each tree's fits
    (row_id, chain, sample, tree, value): all rows of a leaf have its mean."""
    return leaves.join(fits, ["row_id", *KEY]).groupBy(*KEY, "node").agg(F.max("value").alias("value"))


def nested(trees: DataFrame) -> DataFrame:
    """(chain, sample, tree, json): each tree as nested objects, {var, cut, left, right} or {mean}."""
    import json

    def build(g: pd.DataFrame) -> pd.DataFrame:
        def at(i: int) -> dict:
            if g["var"][i] < 0:
                return {"mean": float(g["value"][i])}
            return {"var": int(g["var"][i]), "cut": float(g["value"][i]), "left": at(int(g["left"][i])), "right": at(int(g["right"][i]))}

        return pd.DataFrame({**{k: [g[k][0]] for k in KEY}, "json": [json.dumps(at(0), separators=(",", ":"))]})

    return map_trees(trees, build, "chain int, sample int, tree int, json string")


def predict_summary(trees: DataFrame, rows: DataFrame, lo: float = -0.5, span: float = 1.0, quantiles: tuple = (0.05, 0.5, 0.95), binary: bool = False) -> DataFrame:
    """(row_id, mean, quantiles array) per row over all draws. All draws of a row are made where the row is, so nothing of
    rows x draws is kept or shuffled."""
    from treesum.functions.scalar import phi

    f = packed(trees)
    draws = [*f.keys.groupby(["chain", "sample"], sort=True).indices.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, offset = _matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False)
                s = np.stack([sum(f.value[f.leaves(x, k)] for k in ks) for ks in draws])
                s = lo + span * (s + 0.5) + offset
                s = phi(s) if binary else s
                q = np.quantile(s, quantiles, axis=0).T
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.mean(0)), pa.array(q.tolist(), pa.list_(pa.float64()))], ["row_id", "mean", "quantiles"])

    return rows.select("row_id", "x", "offset").mapInArrow(run, "row_id long, mean double, quantiles array<double>")


def leaf_of(trees: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, chain, sample, tree, node): the leaf of every tree, by broadcast arrays."""
    f = packed(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for k, key in enumerate(f.keys.itertuples(index=False)):
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.full(n, v, np.int32)) for v in key), pa.array((f.leaves(x, k) - f.start[k]).astype(np.int32))], ["row_id", *KEY, "node"])

    return rows.select("row_id", "x").mapInArrow(run, "row_id long, chain int, sample int, tree int, node int")


def leaf_of_boxes(trees: DataFrame, rows: DataFrame) -> DataFrame:
    """The same by a range join with the leaves' boxes, for small forests: rows x leaves comparisons."""
    b = boxes(trees).where("var = -1").select(*KEY, "node", "box")
    return rows.select("row_id", "x").join(F.broadcast(b), inside("x", "box")).select("row_id", *KEY, "node")


def replay(trees: DataFrame, rows: DataFrame) -> DataFrame:
    """trees with n counted anew: rows that pass each node, 0 where none does. Counts of leaves are gathered per task
    before the shuffle and added up the tree."""
    leaf = leaf_of(trees, rows).groupBy(*KEY, "node").agg(F.count(F.lit(1)).alias("k"))
    a = annotated(trees)
    up = a.where("var = -1").join(leaf, [*KEY, "node"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    up = up.select(*KEY, "k", F.explode(F.concat("ancestors", F.array("node"))).alias("node")).groupBy(*KEY, "node").agg(F.sum("k").alias("n"))
    return trees.drop("n").join(up, [*KEY, "node"]).select(*KEY, "node", "n", "var", "value")


def variable_counts(trees: DataFrame) -> DataFrame:
    return trees.where("var >= 0").groupBy("chain", "sample", "var").agg(F.count(F.lit(1)).alias("n"))


def shape(trees: DataFrame) -> DataFrame:
    """(chain, sample, tree, depth, size)."""
    return annotated(trees).groupBy(*KEY).agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("size"))


def interactions(trees: DataFrame) -> DataFrame:
    """(chain, sample, a, b, n): pairs of different variables of which one splits below the other on a path."""
    a = annotated(trees).where("var >= 0")
    down = a.select(*KEY, F.col("var").alias("low"), F.explode("ancestors").alias("node"))
    pairs = down.join(a.select(*KEY, "node", F.col("var").alias("high")), [*KEY, "node"]).where("low <> high")
    return pairs.groupBy("chain", "sample", F.least("low", "high").alias("a"), F.greatest("low", "high").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def select_trees(trees: DataFrame, chains: list | None = None, samples: list | None = None, numbers: list | None = None) -> DataFrame:
    for c, v in (("chain", chains), ("sample", samples), ("tree", numbers)):
        if v is not None:
            trees = trees.where(F.col(c).isin(list(v)))
    return trees


def valid(trees: DataFrame) -> DataFrame:
    """(chain, sample, tree, valid): no leaf without rows."""
    return trees.groupBy(*KEY).agg(F.bool_and((F.col("var") >= 0) | (F.col("n") > 0)).alias("valid"))


def enumerated(trees: DataFrame) -> DataFrame:
    """Per node: leaf, internal, without grandchildren (both children are leaves), swappable (internal with an internal child)."""
    a = annotated(trees)
    kids = a.where("parent >= 0").groupBy(*KEY, F.col("parent").alias("node")).agg(F.sum((F.col("var") >= 0).cast("int")).alias("inner"))
    j = a.join(kids, [*KEY, "node"], "left")
    return j.select(*KEY, "node", "depth", "size", (F.col("var") < 0).alias("leaf"), (F.col("var") >= 0).alias("internal"), F.coalesce(F.col("inner") == 0, F.lit(False)).alias("no_grandchildren"), F.coalesce(F.col("inner") > 0, F.lit(False)).alias("swappable"))


def map_trees(trees: DataFrame, f, schema: str) -> DataFrame:
    """f(DataFrame of one tree in pre-order with parent and depth) to rows; one task call per tree."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node").reset_index(drop=True)
        left, right, parent, depth = structure(g["var"].to_numpy())
        return f(g.assign(left=left, right=right, parent=parent, depth=depth))

    return trees.groupBy(*KEY).applyInPandas(run, schema)


def layout(trees: DataFrame) -> DataFrame:
    """Where a drawing puts nodes: leaves at whole places from the left, parents midway, y the depth below."""

    def place(g: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(len(g))
        leaf = g["var"].to_numpy() < 0
        x[leaf] = np.arange(leaf.sum())
        for i in range(len(g) - 1, -1, -1):
            if not leaf[i]:
                x[i] = (x[g["left"][i]] + x[g["right"][i]]) / 2
        label = [f"{v:.4g}" if k < 0 else f"x{k} <= {v:.4g}" for k, v in zip(g["var"], g["value"], strict=True)]
        return pd.DataFrame({**{k: g[k] for k in KEY}, "node": g["node"], "x": x, "y": -g["depth"].astype(float), "label": label})

    return map_trees(trees, place, "chain int, sample int, tree int, node int, x double, y double, label string")


def thin(draws: DataFrame, every: int) -> DataFrame:
    """Draws (sample from 0) kept by thinning, numbered anew."""
    return draws.where((F.col("sample") + 1) % every == 0).withColumn("sample", (F.expr(f"(sample + 1) div {every}") - 1).cast("int"))


def ring(trees: DataFrame, samples: int) -> DataFrame:
    """Samples beyond the room there is overwrite the oldest: slot = sample mod samples, the latest in each slot stays."""
    last = trees.groupBy("chain").agg(F.max("sample").alias("_last"))
    return trees.join(F.broadcast(last), "chain").where(F.col("sample") > F.col("_last") - samples).drop("_last").withColumn("sample", F.pmod("sample", F.lit(samples)))


def resize_samples(trees: DataFrame, old: int, new: int) -> DataFrame:
    """Shrinking keeps the latest samples; growing leaves the front empty."""
    return trees.withColumn("sample", F.col("sample") + (new - old)).where("sample >= 0")


def resize_trees(trees: DataFrame, old: int, new: int) -> DataFrame:
    """Surplus trees go; new ones are single leaves of value 0."""
    kept = trees.where(F.col("tree") < new)
    if new <= old:
        return kept
    fresh = trees.select("chain", "sample").distinct().withColumn("tree", F.explode(F.sequence(F.lit(old), F.lit(new - 1))))
    return kept.unionByName(fresh.select("chain", "sample", "tree", F.lit(0).alias("node"), F.lit(None).cast("long").alias("n"), F.lit(-1).alias("var"), F.lit(0.0).alias("value")))
