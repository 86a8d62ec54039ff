"""Queries whose deterministic part is what sessions and priors do: literal trees are installed, data changed, and the
result held against SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesum.operators import dependence, forest, sampler, stats
from treesum.sources import design

QUERIES: dict = {}
ORACLES: dict = {}

#: Cuts of the two predictors of part, and three trees on them.
CUTS = {0: [10.0, 20.0, 30.0, 40.0], 1: [905.0, 910.0, 915.0]}
TREES = [
    [(0, 20.0), (1, 910.0), (-1, -0.2), (-1, -0.1), (0, 40.0), (-1, 0.1), (-1, 0.2)],
    [(1, 905.0), (-1, 0.05), (-1, -0.05)],
    [(-1, 0.01)],
]
X = ["p_size", "p_retailprice"]
SUM = " + ".join(f"({forest.case_sql(t, X)})" for t in TREES)
_E = "(SELECT min(p_retailprice) AS lo, max(p_retailprice) - min(p_retailprice) AS span FROM part)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by size and price itself, so that the scale of the response is that of the price."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("row_id"), F.col("p_retailprice").cast("double").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("offset"), F.array(*[F.col(c).cast("double") for c in X]).alias("x"))


def session(spark: SparkSession, sf_dir: str, **more) -> sampler.Session:
    s = sampler.Session(parts(spark, sf_dir), sampler.Control(trees=3, chains=1, draws=1, burn=0), **more)
    for v, c in CUTS.items():
        s.set_cuts(c, v)
    s.set_trees(TREES)
    return s


def tree_rows(spark: SparkSession, s: sampler.Session) -> DataFrame:
    t = s.trees()
    return spark.createDataFrame([(int(r.tree), int(r.node), int(r.n), int(r.var), round(float(r.value), 6)) for r in t.itertuples()], "tree int, node int, n long, var int, value double")


def values(spark: SparkSession, ids: np.ndarray, v: np.ndarray, name: str = "value") -> DataFrame:
    """The result of a session, whose size is checked, as a table."""
    return spark.createDataFrame([(int(i), float(x)) for i, x in zip(ids, v, strict=True)], f"row_id long, {name} double")


def counted_sql(trees: list[list[tuple]], source: str = "part", columns: list[str] = X) -> str:
    """Rows that pass each node, by the conditions on the way to it."""
    out = []
    for t, nodes in enumerate(trees):
        at = iter(range(len(nodes)))

        def go(path: list[str], t=t, nodes=nodes, at=at) -> None:
            i = next(at)
            var, value = nodes[i]
            out.append(f"SELECT {t} AS tree, {i} AS node, count(*) AS n, {var} AS var, round({value!r}, 6) AS value FROM {source}" + (" WHERE " + " AND ".join(path) if path else ""))
            if var >= 0:
                go([*path, f"{columns[var]} <= {value!r}"])
                go([*path, f"{columns[var]} > {value!r}"])

        go([])
    return "SELECT tree, node, n, var, CAST(value AS DOUBLE) AS value FROM (" + " UNION ALL ".join(out) + ")"


@query("session_trees", counted_sql(TREES))
def session_trees(spark, sf_dir):
    return tree_rows(spark, session(spark, sf_dir))


@query("session_fits", f"SELECT p_partkey AS row_id, round(lo + span * ({SUM} + 0.5), 6) AS value FROM part, {_E}")
def session_fits(spark, sf_dir):
    s = session(spark, sf_dir)
    return values(spark, s.row_id, np.round(s.fits(), 6))


@query("session_predict", f"SELECT p_partkey AS row_id, round(lo + span * ({SUM} + 0.5) + 2.5, 6) AS value FROM part, {_E}")
def session_predict(spark, sf_dir):
    s = session(spark, sf_dir)
    return values(spark, s.row_id, np.round(s.predict(s.x, 2.5), 6))


@query("session_test_fits", f"SELECT p_partkey AS row_id, round(lo + span * ({SUM} + 0.5), 6) AS value FROM (SELECT p_partkey, p_size + 7 AS p_size, p_retailprice - 4 AS p_retailprice FROM part), {_E}")
def session_test_fits(spark, sf_dir):
    moved = parts(spark, sf_dir).withColumn("x", F.array(F.col("x")[0] + 7, F.col("x")[1] - 4))
    s = session(spark, sf_dir, test=moved)
    return values(spark, s.test_id, np.round(s.test_fits(), 6))


@query("session_test_updates", f"SELECT p_partkey AS row_id, round(lo + span * ({SUM} + 0.5) + p_partkey % 3, 6) AS value FROM (SELECT p_partkey, 51 - p_size AS p_size, p_retailprice FROM part), {_E}")
def session_test_updates(spark, sf_dir):
    s = session(spark, sf_dir, test=parts(spark, sf_dir))
    s.set_test_predictor(51 - s.test_x[:, 0], column=0)
    s.set_test_offset((s.test_id % 3).astype(float))
    return values(spark, s.test_id, np.round(s.test_fits(), 6))


@query("session_test_draws", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(2 AS BIGINT) AS draws FROM part")
def session_test_draws(spark, sf_dir):
    s = session(spark, sf_dir, test=parts(spark, sf_dir))
    out = s.run(1, 2, callback=lambda train, test, sigma, k: float(np.abs(train - test).max()))
    # test rows that equal the training rows have their fits, draw by draw
    assert out["callback"].max() < 1e-6 and np.allclose(out["train"], out["test"])
    return spark.createDataFrame([(out["test"].shape[1], out["test"].shape[0])], "n long, draws long")


#: What the trees become when the cuts of the first predictor are 22 and 38: 20 goes to 22; below it on the right 40 goes to 38.
MAPPED = [[(0, 22.0), *TREES[0][1:4], (0, 38.0), *TREES[0][5:]], TREES[1], TREES[2]]


@query("session_set_cuts", counted_sql(MAPPED))
def session_set_cuts(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_cuts([22.0, 38.0], 0)
    return tree_rows(spark, s)


#: With one cut nothing is left for the lower rule, which goes; the plain mean of its leaves stays.
PRUNED = [[(0, 25.0), *TREES[0][1:4], (-1, 0.15)], TREES[1], TREES[2]]


@query("session_prune", counted_sql(PRUNED))
def session_prune(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_cuts([25.0], 0)
    return tree_rows(spark, s)


_BIG = "(SELECT * FROM part WHERE p_size > 20)"
_W = f"(SELECT CAST(count(*) FILTER (p_retailprice <= 910) AS DOUBLE) AS a, CAST(count(*) FILTER (p_retailprice > 910) AS DOUBLE) AS b FROM part)"


@query("session_collapse", f"SELECT 0 AS tree, 0 AS node, count(*) AS n, -1 AS var, round((SELECT (-0.2 * a - 0.1 * b) / (a + b) FROM {_W}), 6) AS value FROM part")
def session_collapse(spark, sf_dir):
    """All sizes become small: the root loses its right side, and the weighted mean of what is left stays."""
    s = session(spark, sf_dir)
    s.set_trees(TREES[:1])
    x = s.x.copy()
    x[:, 0] = 1.0
    s.set_predictor(x, mode="force")
    # the root goes with all that is below, of which only the left leaves have rows
    return tree_rows(spark, s)


@query("session_reject", "SELECT false AS took, count(*) AS n FROM part")
def session_reject(spark, sf_dir):
    s = session(spark, sf_dir)
    x = s.x.copy()
    x[:, 0] = 1.0
    before = s.trees()
    took = s.set_predictor(x, mode="reject")
    assert before.equals(s.trees())
    return spark.createDataFrame([(bool(took), len(s.y))], "took boolean, n long")


@query("session_set_data", f"WITH c AS (SELECT min(p_size) + (k + 1) * (max(p_size) - min(p_size)) / 30.0 AS cut FROM {_BIG}, generate_series(0, 28) s(k) GROUP BY k), n AS (SELECT arg_min(cut, abs(cut - 30.2)) AS cut FROM c) SELECT 0 AS node, count(*) AS n, round(any_value(cut), 6) AS value FROM {_BIG}, n UNION ALL SELECT 1, count(*), -0.1 FROM {_BIG}, n WHERE p_size <= cut UNION ALL SELECT 2, count(*), 0.1 FROM {_BIG}, n WHERE p_size > cut")
def session_set_data(spark, sf_dir):
    """Other rows under the same trees: the rule goes to the nearest of the new cuts, counts are those of the new rows. The
    response is the size, whose range is the same at the new rows' offset."""
    big = parts(spark, sf_dir).where("x[0] > 20").withColumn("y", F.col("x")[0])
    s = sampler.Session(big, sampler.Control(trees=1, chains=1, cuts=29))
    s.set_cuts([30.2], 0)
    s.set_trees([[(0, 30.2), (-1, -0.1), (-1, 0.1)]])
    s.set_data(big)
    return tree_rows(spark, s).select("node", "n", "value")


@query("session_set_data_fits", f"SELECT p_partkey AS row_id, round(lo + span * ({SUM} + 0.5), 4) AS value FROM part, {_E}")
def session_set_data_fits(spark, sf_dir):
    """Twice the response is installed and then the old one: cuts and fits are those of before."""
    s = session(spark, sf_dir)
    s.set_data(parts(spark, sf_dir).withColumn("y", F.col("y") * 2))
    for v, c in CUTS.items():
        s.set_cuts(c, v)
    s.set_data(parts(spark, sf_dir))
    for v, c in CUTS.items():
        s.set_cuts(c, v)
    s.set_trees(TREES)
    return values(spark, s.row_id, np.round(s.fits(), 4))


@query("session_ssr", f"SELECT round(sum((2 + p_partkey % 2) * pow(p_retailprice - (lo + span * ({SUM} + 0.5)), 2)), 0) AS ssr FROM part, {_E}")
def session_ssr(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_weights(2.0 + s.row_id % 2)
    return spark.createDataFrame([(float(np.round(s.ssr(), 0)),)], "ssr double")


@query("session_response", f"SELECT round(sum(pow(p_retailprice + 100 - (lo + span * ({SUM} + 0.5)), 2)), 0) AS ssr FROM part, {_E}")
def session_response(spark, sf_dir):
    """Another response: fits keep their meaning on its scale."""
    s = session(spark, sf_dir)
    s.set_response(s.y + 100)
    return spark.createDataFrame([(float(np.round(s.ssr(), 0)),)], "ssr double")


@query("session_offset", f"SELECT round(sum(pow(p_retailprice - 40 - (lo + span * ({SUM} + 0.5)), 2)), 0) AS ssr FROM part, {_E}")
def session_offset(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_offset(40.0)
    return spark.createDataFrame([(float(np.round(s.ssr(), 0)),)], "ssr double")


@query("session_sigma", "SELECT 12.5 AS sigma, 3.0 AS k")
def session_sigma(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_sigma(12.5)
    s.set_k(3.0)
    return spark.createDataFrame([(round(s.sigma(), 9), s.chain.k)], "sigma double, k double").select(F.col("sigma").cast("decimal(3,1)").alias("sigma"), F.col("k").cast("decimal(2,1)").alias("k"))


@query("session_control", counted_sql([*TREES, [(-1, 0.0)], [(-1, 0.0)]]))
def session_control(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_control(sampler.Control(trees=5, chains=1, thin=2))
    return tree_rows(spark, s)


@query("session_control_fewer", counted_sql(TREES[:2]))
def session_control_fewer(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_control(sampler.Control(trees=2, chains=1))
    return tree_rows(spark, s)


@query("session_model", "SELECT 7.0 AS sigma, 4.0 AS k, round(0.8 / pow(2, 1.5), 8) AS grows")
def session_model(spark, sf_dir):
    s = session(spark, sf_dir)
    s.set_model(stats.TreePrior(0.8, 1.5), stats.NormalPrior(4.0), stats.FixedVariance(49.0))
    # the left child of the first root has depth 1 and room to grow
    g = s.chain.grow_probability(s.chain.roots[0].left)
    return spark.createDataFrame([(round(s.sigma(), 9), s.chain.k, round(g, 8))], "sigma double, k double, grows double").select(F.col("sigma").cast("decimal(2,1)").alias("sigma"), F.col("k").cast("decimal(2,1)").alias("k"), "grows")


@query("session_state", counted_sql(TREES))
def session_state(spark, sf_dir):
    """Stored, restored, copied: the same trees, and the copy's draws leave them alone."""
    s = sampler.Session.restore(session(spark, sf_dir).store())
    s.copy().run(3, 1)
    return tree_rows(spark, s)


@query("session_varcount", "SELECT * FROM (VALUES (0, 2), (1, 2)) t(var, n)")
def session_varcount(spark, sf_dir):
    c = session(spark, sf_dir).chain.counts()
    return spark.createDataFrame([(i, int(n)) for i, n in enumerate(c)], "var int, n int")


@query("session_log_prior", f"SELECT * FROM (VALUES (0, round({math.log(0.95) - math.log(2) - math.log(4)} + {math.log(0.95 / 4) - math.log(2) - math.log(3)} + 2 * {math.log(1 - 0.95 / 9)} + {math.log(0.95 / 4) - math.log(2) - math.log(2)} + 2 * {math.log(1 - 0.95 / 9)}, 8)), (1, round({math.log(0.95) - math.log(2) - math.log(3)} + 2 * {math.log(1 - 0.95 / 4)}, 8)), (2, round({math.log(1 - 0.95)}, 8))) t(tree, log_prior)")
def session_log_prior(spark, sf_dir):
    c = session(spark, sf_dir).chain
    return spark.createDataFrame([(i, round(c.log_prior(x), 8)) for i, x in enumerate(c.roots)], "tree int, log_prior double")


@query("recover_means", "SELECT * FROM (VALUES " + ", ".join(f"({t}, {i}, CAST({x!r} AS DOUBLE))" for t, nodes in enumerate(TREES) for i, (v, x) in enumerate(nodes) if v < 0) + ") t(tree, node, value)")
def recover_means(spark, sf_dir):
    rows = parts(spark, sf_dir)
    t = forest.literal(spark, TREES)
    fits = None
    for k in range(len(TREES)):
        one = forest.predict(forest.select_trees(t, numbers=[k]), rows).withColumn("tree", F.lit(k))
        fits = one if fits is None else fits.unionByName(one)
    return forest.recover_means(forest.leaf_of(t, rows), fits).select("tree", "node", F.round("value", 9).alias("value"))


@query("tree_nested", """SELECT * FROM (VALUES (0, '{"var":0,"cut":20.0,"left":{"var":1,"cut":910.0,"left":{"mean":-0.2},"right":{"mean":-0.1}},"right":{"var":0,"cut":40.0,"left":{"mean":0.1},"right":{"mean":0.2}}}'), (1, '{"var":1,"cut":905.0,"left":{"mean":0.05},"right":{"mean":-0.05}}'), (2, '{"mean":0.01}')) t(tree, json)""")
def tree_nested(spark, sf_dir):
    return forest.nested(forest.literal(spark, TREES)).select("tree", "json")


# priors and scales


@query("prior_scale", "SELECT round(-2 * ln(0.9) / 2 * 2.25, 8) AS scale")
def prior_scale(spark, sf_dir):
    """With two degrees of freedom the quantile of chi-squared is -2 ln(1 - p)."""
    return spark.createDataFrame([(round(stats.ChiSquaredPrior(2.0, 0.9).scale(1.5), 8),)], "scale double")


@query("start_values", "SELECT min(o_totalprice) AS lo, max(o_totalprice) - min(o_totalprice) AS span, round(sqrt((regr_syy(o_totalprice, o_custkey) - pow(regr_sxy(o_totalprice, o_custkey), 2) / regr_sxx(o_totalprice, o_custkey)) / (count(*) - 2)) / (max(o_totalprice) - min(o_totalprice)), 6) AS sigma, round(2.0 / (max(o_totalprice) - min(o_totalprice)), 9) AS fixed FROM orders")
def start_values(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    f = design.model_frame(o, "o_totalprice", design.resolve(o, ["o_custkey"]), "o_orderkey")
    free = sampler.prepare(f, sampler.Control(), stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    held = sampler.prepare(f, sampler.Control(), stats.TreePrior(), stats.NormalPrior(), stats.FixedVariance(4.0))
    return spark.createDataFrame([(free.lo, free.span, round(free.sigma, 6), round(held.sigma, 9))], "lo double, span double, sigma double, fixed double")


@query("leaf_prior_sd", "SELECT * FROM (VALUES ('binary', round(3 / (2.0 * sqrt(50)), 8)), ('continuous', round(0.5 / (2.0 * sqrt(50)), 8))) t(kind, sd)")
def leaf_prior_sd(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = design.resolve(li, ["o_custkey"])
    out = []
    for kind, y in (("continuous", F.col("o_totalprice")), ("binary", (F.col("o_orderstatus") == "F").cast("double"))):
        p = sampler.prepare(design.model_frame(li, y, d, "o_orderkey"), sampler.Control(trees=50), stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
        out.append((kind, round(p.settings.node_scale / (p.settings.k * math.sqrt(p.settings.trees)), 8)))
    return spark.createDataFrame(out, "kind string, sd double")


@query("variance_known_mean", "SELECT l_returnflag, round(sum(pow(l_quantity - 25, 2)) / (count(*) - 1), 5) AS plain, round(sum(l_tax * pow(l_quantity - 25, 2)) / (count(*) - 1), 5) AS weighted FROM lineitem GROUP BY 1")
def variance_known_mean(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    y, m = F.col("l_quantity"), F.lit(25.0)
    return li.groupBy("l_returnflag").agg(F.round(stats.variance_about(y, m), 5).alias("plain"), F.round(stats.variance_about(y, m, F.col("l_tax")), 5).alias("weighted"))


@query("matrix_positions", "SELECT vec_id AS row_id, CAST(embedding[1] AS DOUBLE) AS V1, CAST(embedding[-1] AS DOUBLE) AS last, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def matrix_positions(spark, sf_dir):
    d, names = design.by_position(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return d.select("row_id", "V1", F.col(names[-1]).alias("last"), F.lit(len(names)).alias("width"))


@query("encode_reordered", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, " + ", ".join(f"CAST(o_orderstatus = '{v}' AS INTEGER)::DOUBLE AS s_{v}" for v in "FOP") + " FROM orders")
def encode_reordered(spark, sf_dir):
    """A design of training columns applied to a table that has them in another order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    d = design.resolve(o, ["o_custkey", "o_orderstatus"])
    return d.matrix(o.select("o_orderstatus", "o_orderkey", "o_custkey"), "o_orderkey").toDF("o_orderkey", "a", "s_F", "s_O", "s_P")


@query("make_indicators", "SELECT CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"sum(CAST(c_mktsegment = '{v}' AS INTEGER))::DOUBLE AS s{i}" for i, v in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])) + " FROM customer")
def make_indicators(spark, sf_dir):
    m = design.make_indicators(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment"))
    return m.toDF(*[f"s{i}" for i in range(5)]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(5)])


_PART_TREE = [[(0, 25.0), (1, 910.0), (-1, 1.0), (-1, 2.0), (-1, 3.0)]]


@query("pd_by_name", " UNION ALL ".join(f"SELECT '{n}' AS name, level1, round(avg({forest.case_sql(_PART_TREE[0], [('level1' if n == c else c) for c in X])}), 6) AS value FROM part, (SELECT CAST(unnest({lv}) AS DOUBLE) AS level1) GROUP BY ALL" for n, lv in (("p_retailprice", [900, 930]), ("p_size", [10, 30]))))
def pd_by_name(spark, sf_dir):
    d = dependence.partial_by_name(forest.literal(spark, _PART_TREE), parts(spark, sf_dir), X, ["p_retailprice", 0], {"p_size": [10.0, 30.0], "p_retailprice": [900.0, 930.0]})
    return d.select("name", "level1", F.round("value", 6).alias("value"))


@query("pd_positions", "SELECT * FROM (VALUES (0, 0), (1, 2), (2, 3), (3, 1)) t(i, place)")
def pd_positions(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(dependence.positions(["size", "price", "flag.A", "flag.B"], [0, "flag", "price"]))), "i int, place int")
