"""Queries of fits whose rows stay in their partitions."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from treesum.functions.scalar import u01_sql
from treesum.operators import resident, sampler, validation
from treesum.operators.kernel import Proposal, Settings
from treesum.plans.registry import r, rows_of, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _frame(spark, sf_dir):
    return rows_of(spark, sf_dir).select("row_id", "y", "weight", "offset", "x")


CONTROL = sampler.Control(trees=10, draws=5, burn=5, chains=2)


@query("resident_fit")
def resident_fit(spark, sf_dir):
    return resident.fit(_frame(spark, sf_dir).withColumn("weight", F.lit(1.0)), CONTROL).params


@query("resident_leaf_rows", "SELECT CAST(chain AS INTEGER) AS chain, CAST(sample AS INTEGER) AS sample, CAST(tree AS INTEGER) AS tree, count(*) AS n FROM lineitem, generate_series(0, 1) a(chain), generate_series(0, 4) b(sample), generate_series(0, 9) c(tree) GROUP BY ALL")
def resident_leaf_rows(spark, sf_dir):
    """In every draw, each tree's leaves hold every row once."""
    trees = resident.fit(_frame(spark, sf_dir).withColumn("weight", F.lit(1.0)), CONTROL).trees
    return trees.where("var = -1").groupBy("chain", "sample", "tree").agg(F.sum("n").alias("n"))


#: Cuts of quantity, discount and tax; two trees of (variable, number of a cut or mean) in pre-order.
_CUTS = [np.array([10.0, 20.0, 30.0, 40.0]), np.array([0.02, 0.05]), np.array([0.04])]
_A = [(0, 1), (-1, 0.1), (1, 1), (-1, -0.2), (-1, 0.3)]
_B = [(2, 0), (-1, -0.05), (-1, 0.05)]

_PASS = """WITH d AS (SELECT l_quantity AS w, l_quantity * (1 - l_discount) * (1 + l_tax) / 100 - 0.5 AS y, l_quantity AS q, l_discount AS c, l_tax AS t FROM lineitem),
e AS (SELECT w, y - CASE WHEN q <= 20 THEN 0.1 WHEN c <= 0.05 THEN -0.2 ELSE 0.3 END - CASE WHEN t <= 0.04 THEN -0.05 ELSE 0.05 END AS e,
  CASE WHEN q <= 20 THEN 0 WHEN c <= 0.05 THEN 1 ELSE 2 END AS old_a, CASE WHEN q <= 20 AND t <= 0.04 THEN 0 WHEN q <= 20 THEN 1 WHEN c <= 0.05 THEN 2 ELSE 3 END AS new_a,
  CASE WHEN t <= 0.04 THEN 0 ELSE 1 END AS old_b, CASE WHEN q <= 30 THEN 0 ELSE 1 END AS new_b FROM d)"""


def _pass(spark, sf_dir):
    """The sums of one pass for two trees: one that splits its first leaf by tax, one that changes its rule to quantity."""
    p = sampler.Prepared(_CUTS, 0.0, 100.0, 1.0, Settings(trees=2), False)
    rows = resident.blocks(_frame(spark, sf_dir), p)
    c = resident.Driven(0, np.array([4, 2, 1]), replace(p.settings), 1.0, 1, 0)
    c.restore([(t, i, 0, v, x) for t, tree in enumerate((_A, _B)) for i, (v, x) in enumerate(tree)], 1.0, 2.0, 0)
    a, b = c.roots
    birth = Proposal(a.left, [(a.left, 2, 0, resident.Node(parent=a.left), resident.Node(parent=a.left))])
    change = Proposal(b, [(b, 0, 2, b.left, b.right)])
    one = resident.step(a, birth, c.r, 0)
    steps = [one, resident.step(b, change, c.r, len(one.cells))]
    return steps, resident.measured(rows, [c.forest(steps)])[0]


@query("resident_pass_sums", _PASS + " SELECT tree, old, new, count(*) AS n, round(sum(w), 4) AS w, round(sum(w * e), 4) AS we FROM (SELECT 0 AS tree, old_a AS old, new_a AS new, w, e FROM e UNION ALL SELECT 1, old_b, new_b, w, e FROM e) GROUP BY ALL")
def resident_pass_sums(spark, sf_dir):
    steps, (g, b, n, *_) = _pass(spark, sf_dir)
    rows = [(t, i, j, round(n[x.base + k]), float(g[x.base + k, x.base + k]), float(b[x.base + k])) for t, x in enumerate(steps) for k, (i, j) in enumerate(x.cells) if n[x.base + k]]
    return spark.createDataFrame(rows, "tree int, old int, new int, n long, w double, we double").select("tree", "old", "new", "n", r("w", 4).alias("w"), r("we", 4).alias("we"))


@query("resident_pass_weights", _PASS + " SELECT new_a, old_b, new_b, round(sum(w), 4) AS w, round((SELECT sum(w * e * e) FROM e), 3) AS squares FROM e GROUP BY new_a, old_b, new_b")
def resident_pass_weights(spark, sf_dir):
    """Weights that cells of the two trees share, and the squares of all residuals."""
    (a, b), (g, _, _, squares, _) = _pass(spark, sf_dir)
    rows = [(j, s, t, float(g[a.base + k, b.base + m]), squares) for k, (_, j) in enumerate(a.cells) for m, (s, t) in enumerate(b.cells) if g[a.base + k, b.base + m]]
    return spark.createDataFrame(rows, "new_a int, old_b int, new_b int, w double, squares double").select("new_a", "old_b", "new_b", r("w", 4).alias("w"), r("squares", 3).alias("squares"))


GRID = {"n_trees": [5, 7], "k": [1.0, 2.0], "reps": 2, "control": sampler.Control(draws=5, burn=5, chains=1)}


def _place_sql(rep: int) -> str:
    return f"SELECT {rep} AS rep, w, row_number() OVER (ORDER BY {u01_sql('1', str(rep), 'row_id')}, row_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS row_id, l_quantity AS w FROM lineitem)"


@query("grid_fit_resident")
def grid_fit_resident(spark, sf_dir):
    return validation.cross_validate_resident(_frame(spark, sf_dir), **GRID)


@query("grid_held_rows", f"SELECT rep, CAST(CASE WHEN place < (n % 5) * (n // 5 + 1) THEN place // (n // 5 + 1) ELSE n % 5 + (place - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold, count(*) AS n, round(sum(w), 2) AS w FROM ({_place_sql(0)} UNION ALL {_place_sql(1)}) GROUP BY ALL")
def grid_held_rows(spark, sf_dir):
    """The rows that chains of a grid leave out and are scored on."""
    f = rows_of(spark, sf_dir, "l_partkey").select((F.col("row_id") * 1_000_000 + F.col("l_partkey")).alias("row_id"), "y", "weight", "offset", "x")
    d = validation.cross_validate_resident(f, **GRID | {"n_trees": [2], "k": [2.0], "control": sampler.Control(draws=1, burn=0, chains=1)}, sizes=True)
    return d.select("rep", "fold", "n", r("w", 2).alias("w"))


# groups

#: Sigma and tau on the scale of the trees.
_SIGMA, _TAU = 0.25, 0.125


def _orders(spark, sf_dir):
    """Orders in thousands by customer, of which some have many orders and some one."""
    o = table(spark, sf_dir, "orders")
    x = F.array((F.col("o_orderkey") % 50).cast("double"), (F.col("o_custkey") % 7).cast("double"))
    return o.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).cast("double").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("offset"), x.alias("x"), F.col("o_custkey").alias("g"))


def _posteriors(rows: str) -> str:
    """Of rows (g, e), e the residuals."""
    v = f"(1 / (count(*) / {_SIGMA**2} + 1 / {_TAU**2}))"
    return f"SELECT g, count(*) AS n, round({v} / {_SIGMA**2} * sum(e), 6) AS mean, round(sqrt({v}), 6) AS sd FROM ({rows}) GROUP BY g"


def _posterior_rows(frame, cuts, trees):
    p = sampler.Prepared(cuts, 0.0, 100.0, 1.0, Settings(trees=len(trees)), False)
    rows, _, _ = resident.grouped_blocks(frame, p)
    d = resident.group_posteriors(rows, trees, _SIGMA, _TAU)
    return d.select("g", "n", r("mean", 6).alias("mean"), r("sd", 6).alias("sd"))


@query("resident_group_posteriors", _posteriors("SELECT CAST(o_custkey AS VARCHAR) AS g, CAST(o_totalprice / 1000 AS DOUBLE) / 100 - 0.5 - CASE WHEN o_orderkey % 50 <= 20 THEN 0.1 WHEN o_custkey % 7 <= 3 THEN -0.2 ELSE 0.3 END AS e FROM orders"))
def resident_group_posteriors(spark, sf_dir):
    """Intercepts of customers given a tree, over all orders."""
    return _posterior_rows(_orders(spark, sf_dir), [np.array([10.0, 20.0]), np.array([3.0])], [(0, 1, 0.1, (1, 0, -0.2, 0.3))])


@query("resident_large_groups", _posteriors("SELECT l_returnflag AS g, l_quantity * (1 - l_discount) * (1 + l_tax) / 100 - 0.5 - CASE WHEN l_quantity <= 20 THEN 0.1 WHEN l_discount <= 0.05 THEN -0.2 ELSE 0.3 END - CASE WHEN l_tax <= 0.04 THEN -0.05 ELSE 0.05 END AS e FROM lineitem"))
def resident_large_groups(spark, sf_dir):
    """Three groups that hold all line items."""
    f = rows_of(spark, sf_dir).withColumnRenamed("l_returnflag", "g").select("row_id", "y", "weight", "offset", "x", "g")
    return _posterior_rows(f, _CUTS, [(0, 1, 0.1, (1, 1, -0.2, 0.3)), (2, 0, -0.05, 0.05)])


@query("resident_grouped_fit")
def resident_grouped_fit(spark, sf_dir):
    return resident.fit(_orders(spark, sf_dir), CONTROL, group=True).ranef_mean()


@query("resident_grouped_draws", "SELECT CAST(chain AS INTEGER) AS chain, CAST(sample AS INTEGER) AS sample, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS keys FROM orders, generate_series(0, 1) a(chain), generate_series(0, 4) b(sample) GROUP BY ALL")
def resident_grouped_draws(spark, sf_dir):
    """Every draw has an intercept for each customer with orders, once."""
    b = resident.fit(_orders(spark, sf_dir), CONTROL, group=True).ranef.where("not isnan(value)")
    return b.groupBy("chain", "sample").agg(F.count("g").alias("n"), F.sum(F.col("g").cast("long")).alias("keys"))
