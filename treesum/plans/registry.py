"""Named queries over the star-schema tables, and the DuckDB SQL each is held against.

Queries run the library's operators over whole tables. Forests given as literals let both engines score the same trees.
Results are rounded, since engines add in different orders."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesum.functions.scalar import phi_column, phi_sql, u01_sql
from treesum.operators import chains, cuts, dependence, forest, sampler, stats, summaries, validation
from treesum.sources import design

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, digits: int = 6):
    return F.round(c, digits)


X = ["l_quantity", "l_discount", "l_tax"]
#: Three trees, each as (variable, cut or mean) in pre-order.
TREES = [
    [(0, 25.0), (1, 0.05), (-1, -0.2), (-1, -0.3), (2, 0.04), (-1, 0.15), (0, 40.0), (-1, 0.2), (-1, 0.3)],
    [(1, 0.03), (-1, 0.05), (0, 10.0), (-1, -0.1), (-1, 0.02)],
    [(-1, 0.01)],
]
#: Draws: (chain, sample) of three forests of one or two trees.
DRAWS = [({"chain": c, "sample": s}, t) for c in (0, 1) for s in (0, 1, 2) for t in (0, 1)]


def draws_forest() -> list[list]:
    out = []
    for at, t in DRAWS:
        shift = 0.01 * at["sample"] - 0.02 * at["chain"]
        out.append([{**at, "tree": t}, *[(v, x + shift if v < 0 else x) for v, x in TREES[t]]])
    return out


def rows_of(spark, sf_dir: str, *more: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array(*X).alias("x"), F.lit(0.0).alias("offset"), *X, "l_returnflag", *more, (F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("y"), F.col("l_quantity").alias("weight"))


CHARGE = "l_quantity * (1 - l_discount) * (1 + l_tax)"
SUM = " + ".join(f"({forest.case_sql(t, X)})" for t in TREES)
LEAF0 = forest.case_sql(TREES[0], X, leaf=True)


# encoding

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("onehot_priority", "SELECT o_orderkey, " + ", ".join(f"CAST(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS DOUBLE) AS p{i}" for i, p in enumerate(PRIORITIES)) + ", " + ", ".join(f"CAST(CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS DOUBLE) AS s_{s}" for s in "FOP") + " FROM orders")
def onehot_priority(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = design.resolve(o, ["o_orderpriority", "o_orderstatus"])
    m = d.matrix(o, "o_orderkey")
    return m.toDF("o_orderkey", *[f"p{i}" for i in range(5)], "s_F", "s_O", "s_P")


@query("two_level_factor", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS DOUBLE) AS l_linestatus_o FROM lineitem")
def two_level_factor(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return design.resolve(li, ["l_linestatus"]).matrix(li, "l_orderkey", "l_linenumber").toDF("l_orderkey", "l_linenumber", "l_linestatus_o")


@query("const_column_drop", "SELECT 'p_partkey' AS name, min(p_partkey) = max(p_partkey) AS constant FROM part UNION ALL SELECT 'p_size', min(p_size) = max(p_size) FROM part UNION ALL SELECT 'p_retailprice', min(p_retailprice) = max(p_retailprice) FROM part UNION ALL SELECT 'one', true")
def const_column_drop(spark, sf_dir):
    return design.constant_columns(table(spark, sf_dir, "part").withColumn("one", F.lit(1)), ["p_partkey", "p_size", "p_retailprice", "one"])


@query("design_names", "SELECT * FROM (VALUES (0, 'l_quantity'), (1, 'l_returnflag.A'), (2, 'l_returnflag.N'), (3, 'l_returnflag.R'), (4, 'l_linestatus.O')) t(i, name)")
def design_names(spark, sf_dir):
    d = design.resolve(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(i, n) for i, n in enumerate(d.names)], "i int, name string")


@query("formula_scan", "SELECT o_orderkey AS row_id, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x0 FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
def formula_scan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    y, terms = design.parse_formula("o_totalprice ~ . - o_orderkey - o_orderstatus - o_orderdate - o_orderpriority", o.columns)
    f = design.model_frame(o, y, design.resolve(o, terms), "o_orderkey")
    return f.select("row_id", "y", F.col("x")[0].alias("x0"))


@query("factor_table", "SELECT c_mktsegment, count(*) AS count FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def factor_table(spark, sf_dir):
    return design.factor_table(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("na_drop", "SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL")
def na_drop(spark, sf_dir):
    return design.complete(table(spark, sf_dir, "events"), ["user_id", "value", "event_type"]).agg(F.count(F.lit(1)).alias("n"))


@query("subset_filter", "SELECT event_id, value FROM events WHERE event_type = 'error' AND value > 5")
def subset_filter(spark, sf_dir):
    return design.subset(table(spark, sf_dir, "events"), (F.col("event_type") == "error") & (F.col("value") > 5)).select("event_id", "value")


@query("test_offset", "SELECT o_orderkey AS row_id, o_totalprice - 2 * 100 AS y FROM orders")
def test_offset(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = design.model_frame(o, "o_totalprice", design.resolve(o, ["o_custkey"]), "o_orderkey", offset=F.lit(100.0))
    return design.offset_response(f, 2).select("row_id", "y")


@query("split_probs", "SELECT * FROM (VALUES ('l_quantity', 0.4), ('l_returnflag.A', 0.1), ('l_returnflag.N', 0.1), ('l_returnflag.R', 0.1), ('l_linestatus.O', 0.3)) t(name, p)")
def split_probs(spark, sf_dir):
    d = design.resolve(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_returnflag", "l_linestatus"])
    p = design.split_probabilities(d, {"l_quantity": 4, "l_returnflag": 1, ".default": 3})
    return spark.createDataFrame(list(zip(d.names, [round(v, 10) for v in p], strict=True)), "name string, p double").select("name", F.col("p").cast("decimal(2,1)").alias("p"))


@query("response_rescale", f"WITH e AS (SELECT min({CHARGE}) AS lo, max({CHARGE}) AS hi FROM lineitem) SELECT l_returnflag, round(avg(({CHARGE} - lo) / (hi - lo) - 0.5), 6) AS mean, round(min(({CHARGE} - lo) / (hi - lo) - 0.5), 6) AS low, round(max(({CHARGE} - lo) / (hi - lo) - 0.5), 6) AS high FROM lineitem, e GROUP BY 1")
def response_rescale(spark, sf_dir):
    f, _, _ = stats.rescaled(rows_of(spark, sf_dir))
    return f.groupBy("l_returnflag").agg(r(F.avg("y")).alias("mean"), r(F.min("y")).alias("low"), r(F.max("y")).alias("high"))


@query("latent_start", "SELECT doc_id, 2.0 * quality - 1 AS z FROM labels")
def latent_start(spark, sf_dir):
    f = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return design.latent_start(f).select("doc_id", "z")


# cuts and bins


@query("cuts_uniform", "WITH e AS (" + " UNION ALL ".join(f"SELECT {i} AS var, min({c}) AS lo, max({c}) AS hi FROM lineitem" for i, c in enumerate(X)) + ") SELECT var, CAST(k AS INTEGER) AS cut_idx, round(lo + (k + 1) * (hi - lo) / 101, 8) AS cut FROM e, generate_series(0, 99) s(k)")
def cuts_uniform(spark, sf_dir):
    return cuts.uniform(table(spark, sf_dir, "lineitem"), X, 100).select("var", "cut_idx", r("cut", 8).alias("cut"))


def _quantile_sql(source: str, column: str, n: int) -> str:
    return f"""WITH d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS u, lead(v) OVER (ORDER BY v) AS w FROM (SELECT DISTINCT CAST({column} AS DOUBLE) AS v FROM {source} WHERE {column} IS NOT NULL)),
k AS (SELECT k, CASE WHEN u <= {n} + 1 THEN k ELSE least(k * (u // {n}) + (u // {n}) // 2, u - 2) END AS i FROM (SELECT max(u) AS u FROM d), generate_series(0, {n} - 1) s(k) WHERE u > {n} + 1 OR k < u - 1)
SELECT 0 AS var, CAST(k AS INTEGER) AS cut_idx, (v + w) * 0.5 AS cut FROM k JOIN d USING (i)"""


@query("cuts_quantile_all", _quantile_sql("lineitem", "l_quantity", 100))
def cuts_quantile_all(spark, sf_dir):
    return cuts.quantile(table(spark, sf_dir, "lineitem"), ["l_quantity"], 100)


@query("cuts_quantile_step", _quantile_sql("lineitem", "l_extendedprice", 100))
def cuts_quantile_step(spark, sf_dir):
    return cuts.quantile(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], 100)


@query("bin_codes", "WITH c AS (SELECT 1 + (k + 1) * 49.0 / 11 AS cut FROM generate_series(0, 9) s(k)) SELECT l_orderkey, l_linenumber, (SELECT CAST(count(*) AS INTEGER) FROM c WHERE cut < l_quantity) AS l_quantity_bin FROM lineitem")
def bin_codes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = {0: [1 + (k + 1) * 49.0 / 11 for k in range(10)]}
    return cuts.codes(li, ["l_quantity"], c).select("l_orderkey", "l_linenumber", "l_quantity_bin")


@query("bin_codes_many", "WITH c AS (SELECT k * 0.6 AS cut FROM generate_series(0, 99) s(k)) SELECT b, count(*) AS n FROM (SELECT (SELECT CAST(count(*) AS INTEGER) FROM c WHERE cut < q) AS b FROM (SELECT CAST(l_quantity AS DECIMAL(9,1)) AS q FROM lineitem)) GROUP BY b")
def bin_codes_many(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(cuts.code(F.col("l_quantity"), [round(k * 0.6, 1) for k in range(100)]).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))


# routing

LEAF_SQL = f"SELECT leaf, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM (SELECT {LEAF0} AS leaf, l_extendedprice FROM lineitem) GROUP BY leaf"


def _leaf_counts(spark, sf_dir, routed):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_extendedprice", *X)
    return routed(li).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_extendedprice"), 2).alias("price"))


@query("leaf_route_case", LEAF_SQL)
def leaf_route_case(spark, sf_dir):
    return _leaf_counts(spark, sf_dir, lambda li: li.withColumn("leaf", F.expr(LEAF0)))


@query("leaf_route_box", LEAF_SQL)
def leaf_route_box(spark, sf_dir):
    b = forest.boxes(forest.literal(spark, TREES[:1])).where("var = -1").select(F.col("node").alias("leaf"), "box")
    return _leaf_counts(spark, sf_dir, lambda li: li.withColumn("x", F.array(*X)).join(F.broadcast(b), forest.inside("x", "box")))


@query("leaf_route_map", f"SELECT l_orderkey * 10 + l_linenumber AS row_id, {LEAF0} AS node FROM lineitem")
def leaf_route_map(spark, sf_dir):
    return forest.leaf_of(forest.literal(spark, TREES[:1]), rows_of(spark, sf_dir)).select("row_id", "node")


@query("tree_ties_left", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 2 ELSE 1 END AS node FROM part")
def tree_ties_left(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(F.col("p_size").cast("double")).alias("x"))
    t = forest.literal(spark, [[(0, 25.0), (-1, 0.0), (-1, 1.0)]])
    return forest.leaf_of(t, p).select(F.col("row_id").alias("p_partkey"), "node")


REPLAYED = [[(0, 25.0), (0, 60.0), (-1, 0.0), (-1, 0.0), (1, 0.05), (-1, 0.0), (-1, 0.0)]]


@query("node_replay_counts", "SELECT * FROM (SELECT 0 AS node, count(*) AS n FROM lineitem UNION ALL SELECT 1, count(*) FROM lineitem WHERE l_quantity <= 25 UNION ALL SELECT 2, count(*) FROM lineitem WHERE l_quantity <= 25 UNION ALL SELECT 3, count(*) FROM lineitem WHERE l_quantity <= 25 AND l_quantity > 60 UNION ALL SELECT 4, count(*) FROM lineitem WHERE l_quantity > 25 UNION ALL SELECT 5, count(*) FROM lineitem WHERE l_quantity > 25 AND l_discount <= 0.05 UNION ALL SELECT 6, count(*) FROM lineitem WHERE l_quantity > 25 AND l_discount > 0.05)")
def node_replay_counts(spark, sf_dir):
    return forest.replay(forest.literal(spark, REPLAYED), rows_of(spark, sf_dir)).select("node", "n")


@query("forest_predict", f"SELECT l_orderkey * 10 + l_linenumber AS row_id, round(10 + 80 * ({SUM} + 0.5) + 1.5, 6) AS value FROM lineitem")
def forest_predict(spark, sf_dir):
    d = rows_of(spark, sf_dir).withColumn("offset", F.lit(1.5))
    return forest.predict(forest.literal(spark, TREES), d, 10.0, 80.0).select("row_id", r("value").alias("value"))


def _draw_sql(at: dict) -> str:
    shift = 0.01 * at["sample"] - 0.02 * at["chain"]
    trees = [[(v, x + shift if v < 0 else x) for v, x in TREES[t]] for t in (0, 1)]
    return " + ".join(f"({forest.case_sql(t, X)})" for t in trees)


PAIRS = [{"chain": c, "sample": s} for c in (0, 1) for s in (0, 1, 2)]
DRAW_ROWS = " UNION ALL ".join(f"SELECT l_orderkey * 10 + l_linenumber AS row_id, l_returnflag, {a['chain']} AS chain, {a['sample']} AS sample, {_draw_sql(a)} AS value FROM lineitem" for a in PAIRS)


DRAW_LIST = "SELECT l_orderkey * 10 + l_linenumber AS row_id, [" + ", ".join(_draw_sql(a) for a in PAIRS) + "] AS v FROM lineitem"


@query("forest_posterior_mean", f"SELECT row_id, round(list_avg(v), 6) AS mean FROM ({DRAW_LIST})")
def forest_posterior_mean(spark, sf_dir):
    return forest.predict_summary(forest.literal(spark, draws_forest()), rows_of(spark, sf_dir)).select("row_id", r("mean").alias("mean"))


@query("forest_posterior_quantile", "SELECT row_id, " + ", ".join(f"round(list_aggregate(v, 'quantile_cont', {q}), 6) AS {n}" for q, n in ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))) + f" FROM ({DRAW_LIST})")
def forest_posterior_quantile(spark, sf_dir):
    q = forest.predict_summary(forest.literal(spark, draws_forest()), rows_of(spark, sf_dir))
    return q.select("row_id", *[r(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q05", "q50", "q95"))])


@query("flag_interval", f"SELECT l_returnflag, round(quantile_cont(m, 0.05), 5) AS low, round(quantile_cont(m, 0.95), 5) AS high FROM (SELECT l_returnflag, chain, sample, avg(value) AS m FROM ({DRAW_ROWS}) GROUP BY ALL) GROUP BY 1")
def flag_interval(spark, sf_dir):
    d = rows_of(spark, sf_dir)
    p = forest.predict(forest.literal(spark, draws_forest()), d, keep=["l_returnflag"])
    m = p.groupBy("l_returnflag", "chain", "sample").agg(F.avg("value").alias("m"))
    return m.groupBy("l_returnflag").agg(r(F.percentile("m", F.lit(0.05)), 5).alias("low"), r(F.percentile("m", F.lit(0.95)), 5).alias("high"))


@query("probit_mean", f"SELECT l_returnflag, round(avg({phi_sql('s')}), 6) AS p FROM (SELECT l_returnflag, {SUM} AS s FROM lineitem) GROUP BY 1")
def probit_mean(spark, sf_dir):
    d = rows_of(spark, sf_dir)
    p = forest.predict(forest.literal(spark, TREES), d, keep=["l_returnflag"])
    return p.groupBy("l_returnflag").agg(r(F.avg(phi_column(F.col("value")))).alias("p"))


# structure

VALUES = "(VALUES " + ", ".join(f"({t}, {i}, {v}, CAST({x!r} AS DOUBLE))" for t, tree in enumerate(TREES) for i, (v, x) in enumerate(tree)) + ") f(tree, node, var, value)"
_STACK = f"""WITH RECURSIVE f AS (SELECT * FROM {VALUES}),
w(tree, node, var, depth, open) AS (SELECT tree, node, var, 0, CASE WHEN var >= 0 THEN [0, 0] ELSE CAST([] AS INTEGER[]) END FROM f WHERE node = 0
 UNION ALL SELECT f.tree, f.node, f.var, w.open[len(w.open)] + 1, CASE WHEN f.var >= 0 THEN list_concat(w.open[1 : len(w.open) - 1], [w.open[len(w.open)] + 1, w.open[len(w.open)] + 1]) ELSE w.open[1 : len(w.open) - 1] END FROM f JOIN w ON f.tree = w.tree AND f.node = w.node + 1)"""


@query("varcount", f"SELECT var, count(*) AS n FROM {VALUES} WHERE var >= 0 GROUP BY var")
def varcount(spark, sf_dir):
    return forest.variable_counts(forest.literal(spark, TREES)).select("var", "n")


@query("tree_depth_size", _STACK + " SELECT tree, CAST(max(depth) AS INTEGER) AS depth, count(*) AS size FROM w GROUP BY tree")
def tree_depth_size(spark, sf_dir):
    return forest.shape(forest.literal(spark, TREES)).select("tree", "depth", "size")


@query("interactions", "SELECT * FROM (VALUES (0, 1, 2), (0, 2, 2)) t(a, b, n)")
def interactions(spark, sf_dir):
    return forest.interactions(forest.literal(spark, TREES)).select("a", "b", F.col("n").cast("int").alias("n"))


@query("tree_subset", f"SELECT tree, node, var, value FROM {VALUES} WHERE tree IN (0, 2)")
def tree_subset(spark, sf_dir):
    return forest.select_trees(forest.literal(spark, TREES), numbers=[0, 2]).select("tree", "node", "var", "value")


@query("node_kinds", "SELECT * FROM (VALUES (0, 0, true, false, false, true), (0, 1, true, false, true, false), (0, 2, false, true, false, false), (0, 3, false, true, false, false), (0, 4, true, false, false, true), (0, 5, false, true, false, false), (0, 6, true, false, true, false), (0, 7, false, true, false, false), (0, 8, false, true, false, false), (1, 0, true, false, false, true), (1, 1, false, true, false, false), (1, 2, true, false, true, false), (1, 3, false, true, false, false), (1, 4, false, true, false, false), (2, 0, false, true, false, false)) t(tree, node, internal, leaf, no_grandchildren, swappable)")
def node_kinds(spark, sf_dir):
    return forest.enumerated(forest.literal(spark, TREES)).select("tree", "node", "internal", "leaf", "no_grandchildren", "swappable")


@query("tree_layout", "SELECT * FROM (VALUES (0, 1.25, 0.0), (1, 0.0, -1.0), (2, 2.5, -1.0)) t(node, x, y) WHERE false UNION ALL SELECT node, x, y FROM (VALUES (0, 0.75, 0.0), (1, 0.0, -1.0), (2, 1.5, -1.0), (3, 1.0, -2.0), (4, 2.0, -2.0)) u(node, x, y)")
def tree_layout(spark, sf_dir):
    return forest.layout(forest.literal(spark, TREES[1:2])).select("node", F.col("x").cast("decimal(3,2)").alias("x"), F.col("y").cast("decimal(2,1)").alias("y"))


@query("tree_valid", "SELECT true AS valid FROM lineitem HAVING min(l_quantity) <= 25 AND max(l_quantity) > 25 UNION ALL SELECT false")
def tree_valid(spark, sf_dir):
    t = forest.literal(spark, [[(0, 25.0), (-1, 0.0), (-1, 0.0)], REPLAYED[0]])
    return forest.valid(forest.replay(t, rows_of(spark, sf_dir))).select("valid")


@query("trees_resized", f"SELECT tree, node, var, value FROM {VALUES} WHERE tree < 3 UNION ALL SELECT 3, 0, -1, 0.0")
def trees_resized(spark, sf_dir):
    return forest.resize_trees(forest.literal(spark, TREES), 3, 4).select("tree", "node", "var", "value")


def _sample_means(spark, sf_dir):
    """Draws of a literal forest over all line items, averaged per draw: (chain, sample, value)."""
    p = forest.predict(forest.literal(spark, draws_forest()), rows_of(spark, sf_dir))
    return p.groupBy("chain", "sample").agg(r(F.avg("value"), 9).alias("value"))


_MEANS = f"(SELECT chain, sample, round(avg(value), 9) AS value FROM ({DRAW_ROWS}) GROUP BY ALL)"


@query("thin", f"SELECT chain, CAST((sample + 1) // 2 - 1 AS INTEGER) AS sample, value FROM {_MEANS} WHERE (sample + 1) % 2 = 0")
def thin(spark, sf_dir):
    return forest.thin(_sample_means(spark, sf_dir), 2).select("chain", "sample", "value")


@query("combine_chains", f"SELECT chain * 3 + sample AS draw, value FROM {_MEANS}")
def combine_chains(spark, sf_dir):
    return chains.combine(_sample_means(spark, sf_dir), 3).select("draw", "value")


@query("uncombine_chains", f"SELECT (chain * 3 + sample) // 2 AS chain, (chain * 3 + sample) % 2 AS sample, value FROM {_MEANS}")
def uncombine_chains(spark, sf_dir):
    return chains.uncombine(chains.combine(_sample_means(spark, sf_dir), 3), 2).select("chain", "sample", "value")


@query("ring_buffer", f"SELECT chain, sample % 2 AS sample, value FROM {_MEANS} WHERE sample > 0")
def ring_buffer(spark, sf_dir):
    return forest.ring(_sample_means(spark, sf_dir), 2).select("chain", "sample", "value")


@query("samples_resized", f"SELECT chain, sample - 1 AS sample, value FROM {_MEANS} WHERE sample >= 1")
def samples_resized(spark, sf_dir):
    return forest.resize_samples(_sample_means(spark, sf_dir), 3, 2).select("chain", "sample", "value")


@query("samples_grown", f"SELECT chain, sample + 2 AS sample, value FROM {_MEANS}")
def samples_grown(spark, sf_dir):
    return forest.resize_samples(_sample_means(spark, sf_dir), 3, 5).select("chain", "sample", "value")


# statistics and priors


@query("leaf_stats", f"SELECT leaf, count(*) AS n, round(avg(y), 6) AS mean, round(var_samp(y), 5) AS var FROM (SELECT {LEAF0} AS leaf, {CHARGE} AS y FROM lineitem) GROUP BY leaf")
def leaf_stats(spark, sf_dir):
    d = rows_of(spark, sf_dir).withColumn("leaf", F.expr(LEAF0)).withColumn("weight", F.lit(1.0))
    return stats.leaf_stats(d, "leaf").select("leaf", "n", r("mean").alias("mean"), r("var", 5).alias("var"))


@query("leaf_stats_weighted", f"SELECT leaf, n, w, round(wy / w, 6) AS mean, round((wyy - wy * wy / w) / (n - 1), 4) AS var FROM (SELECT leaf, count(*) AS n, sum(w) AS w, sum(w * y) AS wy, sum(w * y * y) AS wyy FROM (SELECT {LEAF0} AS leaf, {CHARGE} AS y, l_quantity AS w FROM lineitem) GROUP BY leaf)")
def leaf_stats_weighted(spark, sf_dir):
    d = rows_of(spark, sf_dir).withColumn("leaf", F.expr(LEAF0))
    return stats.leaf_stats(d, "leaf").select("leaf", "n", "w", r("mean").alias("mean"), r("var", 4).alias("var"))


@query("merged_stats", f"SELECT count(*) AS n, round(avg({CHARGE}), 6) AS mean, round(var_samp({CHARGE}), 5) AS var FROM lineitem")
def merged_stats(spark, sf_dir):
    d = rows_of(spark, sf_dir).withColumn("leaf", F.expr(LEAF0)).withColumn("weight", F.lit(1.0))
    m = stats.merged(stats.leaf_stats(d, "leaf").withColumn("all", F.lit(0)), "all")
    return m.select("n", r("mean").alias("mean"), r("var", 5).alias("var"))


@query("ssr_weighted", f"SELECT round(sum(l_quantity * pow({CHARGE} - (10 + 80 * ({SUM} + 0.5)), 2)), 0) AS ssr FROM lineitem")
def ssr_weighted(spark, sf_dir):
    return rows_of(spark, sf_dir).agg(r(stats.ssr(F.col("y"), F.expr(f"10 + 80 * ({SUM} + 0.5)"), F.col("weight")), 0).alias("ssr"))


@query("ols_sigma_1d", "SELECT round(sqrt((regr_syy(o_totalprice, o_custkey) - pow(regr_sxy(o_totalprice, o_custkey), 2) / regr_sxx(o_totalprice, o_custkey)) / (count(*) - 2)), 3) AS sigma FROM orders")
def ols_sigma_1d(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = stats.ols_sigma(design.model_frame(o, "o_totalprice", design.resolve(o, ["o_custkey"]), "o_orderkey"))
    return spark.createDataFrame([(round(s, 3),)], "sigma double")


S2, A = 0.04, 36.0
_LL = f"0.5 * ln({A} / ({A} + n / {S2})) - 0.5 * v * (n - 1) / {S2} - 0.5 * {A} * (n / {S2}) * m * m / ({A} + n / {S2})"
_SCALED = f"(WITH e AS (SELECT min({CHARGE}) AS lo, max({CHARGE}) AS hi FROM lineitem) SELECT *, ({CHARGE} - lo) / (hi - lo) - 0.5 AS ys FROM lineitem, e)"


@query("leaf_loglik", f"SELECT leaf, round({_LL}, 3) AS log_lik FROM (SELECT {LEAF0} AS leaf, count(*) AS n, avg(ys) AS m, var_samp(ys) AS v FROM {_SCALED} GROUP BY 1)")
def leaf_loglik(spark, sf_dir):
    f, _, _ = stats.rescaled(rows_of(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    s = stats.leaf_stats(f.withColumn("leaf", F.expr(LEAF0)), "leaf")
    return s.select("leaf", r(stats.leaf_log_likelihood(F.col("n"), F.col("w"), F.col("mean"), F.col("var"), S2, A), 3).alias("log_lik"))


@query("split_scan_loglik", f"WITH d AS (SELECT l_quantity AS q, ys FROM {_SCALED}), c AS (SELECT k, 1 + (k + 1) * 49.0 / 11 AS cut FROM generate_series(0, 9) s(k)), g AS (SELECT k, q > cut AS side, count(*) AS n, avg(ys) AS m, var_samp(ys) AS v FROM d, c GROUP BY ALL) SELECT CAST(k AS INTEGER) AS cut_idx, round(sum({_LL}), 2) AS log_lik FROM g GROUP BY k")
def split_scan_loglik(spark, sf_dir):
    f, _, _ = stats.rescaled(rows_of(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    return stats.split_scan(f, 0, [1 + (k + 1) * 49.0 / 11 for k in range(10)], S2, A).select("cut_idx", r("log_lik", 2).alias("log_lik"))


@query("leaf_posterior", f"SELECT leaf, round(n / {S2} * m / ({A} + n / {S2}), 8) AS mean, round(sqrt(1 / ({A} + n / {S2})), 8) AS sd FROM (SELECT {LEAF0} AS leaf, count(*) AS n, avg(ys) AS m FROM {_SCALED} GROUP BY 1)")
def leaf_posterior(spark, sf_dir):
    f, _, _ = stats.rescaled(rows_of(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    s = stats.leaf_stats(f.withColumn("leaf", F.expr(LEAF0)), "leaf")
    mean, sd = stats.leaf_posterior(F.col("w"), F.col("mean"), S2, A)
    return s.select("leaf", r(mean, 8).alias("mean"), r(sd, 8).alias("sd"))


@query("grow_prob", "SELECT CAST(d AS BIGINT) AS depth, round(0.95 / pow(1 + d, 2), 8) AS p FROM generate_series(0, 7) t(d)")
def grow_prob(spark, sf_dir):
    return spark.range(8).select(F.col("id").alias("depth"), r(stats.growth(F.col("id")), 8).alias("p"))


_G = lambda d: math.log(0.95 / (1 + d) ** 2)
_H = lambda d: math.log(1 - 0.95 / (1 + d) ** 2)
PRIOR_TREES = [[(0, 4.0), (0, 1.0), (-1, 0.0), (-1, 0.0), (1, 0.0), (-1, 0.0), (-1, 0.0)], [(-1, 0.0)], [(1, 0.0), (-1, 0.0), (-1, 0.0)]]


@query("tree_log_prior", f"SELECT * FROM (VALUES (0, round({_G(0)} - ln(2) - ln(10) + {_G(1)} - ln(2) - ln(4) + 2 * {_H(2)} + {_G(1)} - ln(2) - ln(1) + 2 * {_H(2)}, 8)), (1, round({_H(0)}, 8)), (2, round({_G(0)} - ln(2) - ln(1) + 2 * {_H(1)}, 8))) t(tree, log_prior)")
def tree_log_prior(spark, sf_dir):
    return stats.tree_log_prior(forest.literal(spark, PRIOR_TREES), {0: 10, 1: 1}).select("tree", r("log_prior", 8).alias("log_prior"))


@query("sigma_posterior_scale", f"SELECT round(3 * 0.25 + sum(l_quantity * pow({CHARGE} - (10 + 80 * ({SUM} + 0.5)), 2)), 0) AS numerator, 3.0 + count(*) AS degrees FROM lineitem")
def sigma_posterior_scale(spark, sf_dir):
    d = rows_of(spark, sf_dir).withColumn("fit", F.expr(f"10 + 80 * ({SUM} + 0.5)"))
    return stats.sigma_posterior(d, 3.0, 0.25).select(r("numerator", 0).alias("numerator"), F.col("degrees").cast("decimal(22,1)").alias("degrees"))


@query("k_posterior_shape_rate", f"SELECT 0.5 * (count(*) + 2 * 1.25 - 1) AS shape, round(0.5 * (3 / 0.25 * sum(value * value) + 1.0 / 4), 8) AS rate FROM {VALUES} WHERE var < 0")
def k_posterior_shape_rate(spark, sf_dir):
    leaves = forest.literal(spark, TREES).where("var < 0")
    return stats.k_posterior(leaves, 3, 0.5, 1.25, 2.0).select(F.col("shape").cast("decimal(24,3)").alias("shape"), r("rate", 8).alias("rate"))


@query("group_ranef_posterior", "SELECT CAST(c_nationkey AS VARCHAR) AS g, count(*) AS n, round(1 / (count(*) / 1e8 + 1 / 25e6) * count(*) / 1e8 * avg(o_totalprice - 150000), 4) AS mean, round(1 / (count(*) / 1e8 + 1 / 25e6), 4) AS variance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def group_ranef_posterior(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    f = j.select(F.col("c_nationkey").cast("string").alias("g"), (F.col("o_totalprice") - 150000).alias("residual"))
    return stats.group_posterior(f, 1e4, 5e3).select("g", "n", r("mean", 4).alias("mean"), r("variance", 4).alias("variance"))


@query("tau_log_posterior", f"SELECT CAST(i AS BIGINT) AS i, round(-25 * ln(t) - 3.5 / (2 * t * t) - ln({math.pi * 2.5} * (1 + t * t / 6.25)), 8) AS cauchy, round(-25 * ln(t) - 3.5 / (2 * t * t) + 1.5 * ln(t) - t / 2.5 - {math.lgamma(2.5) + 2.5 * math.log(2.5)}, 8) AS gamma FROM (SELECT i, i / 10.0 AS t FROM generate_series(1, 30) s(i))")
def tau_log_posterior(spark, sf_dir):
    t = F.col("id") / 10.0
    return spark.range(1, 31).select(F.col("id").alias("i"), r(stats.tau_log_posterior(t, 25, 3.5, "cauchy", 1.0), 8).alias("cauchy"), r(stats.tau_log_posterior(t, 25, 3.5, "gamma", 1.0), 8).alias("gamma"))


_RANEF = "(SELECT CAST(n_nationkey AS VARCHAR) AS g, CAST(c AS INTEGER) AS chain, CAST(s AS INTEGER) AS sample, (n_nationkey % 5) * 0.1 + s * 0.01 - c * 0.02 AS b FROM nation, generate_series(0, 1) a(c), generate_series(0, 2) d(s))"
ORDER_TREES = [[(0, 150000.0), (0, 80000.0), (-1, -0.3), (-1, -0.1), (-1, 0.25)], [(0, 220000.0), (-1, 0.02), (-1, 0.2)]]


def order_draws() -> list[list]:
    """Two chains of three draws over one predictor, the order's price."""
    return [[{"chain": c, "sample": s, "tree": t}, *[(v, x + 0.01 * s - 0.02 * c if v < 0 else x) for v, x in ORDER_TREES[t]]] for c in (0, 1) for s in (0, 1, 2) for t in (0, 1)]


def _order_sql(c: int, s: int) -> str:
    return " + ".join(f"({forest.case_sql([(v, x + 0.01 * s - 0.02 * c if v < 0 else x) for v, x in t], ['o_totalprice'])})" for t in ORDER_TREES)


ORDER_DRAWS = " UNION ALL ".join(f"SELECT o_orderkey AS row_id, CAST(c_nationkey AS VARCHAR) AS g, {c} AS chain, {s} AS sample, o_totalprice AS y, {_order_sql(c, s)} AS f FROM orders JOIN customer ON o_custkey = c_custkey" for c in (0, 1) for s in (0, 1, 2))


def order_rows(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("offset"), F.array("o_totalprice").alias("x"), F.col("c_nationkey").cast("string").alias("g"))


def ranef_of(spark, sf_dir) -> DataFrame:
    """Made-up intercepts of all nations: (g, chain, sample, value)."""
    draws = F.explode(F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(s).alias("sample")) for c in (0, 1) for s in (0, 1, 2)]))
    d = table(spark, sf_dir, "nation").select("n_nationkey", draws.alias("d"))
    return d.select(F.col("n_nationkey").cast("string").alias("g"), "d.chain", "d.sample", ((F.col("n_nationkey") % 5) * 0.1 + F.col("d.sample") * 0.01 - F.col("d.chain") * 0.02).alias("value"))


def grouped_model(spark, sf_dir, binary: bool, ranef: DataFrame | None = None, rows: DataFrame | None = None) -> sampler.Model:
    """A model with literal trees and made-up intercepts, as a fit with groups leaves it."""
    t = forest.literal(spark, order_draws()).withColumns({"kind": F.lit("tree"), "name": F.lit(None).cast("string")})
    b = (ranef if ranef is not None else ranef_of(spark, sf_dir)).withColumnRenamed("g", "name").withColumn("kind", F.lit("ranef"))
    tau = spark.createDataFrame([("keep", c, s, "tau", 0.1) for c in (0, 1) for s in (0, 1, 2)], "kind string, chain int, sample int, name string, value double")
    whole = t.unionByName(b, allowMissingColumns=True).unionByName(tau, allowMissingColumns=True)
    return sampler.Model(whole, -0.5, 1.0, binary, sampler.Control(trees=2, draws=3, burn=0, chains=2), rows)


@query("fitted_ranef", f"SELECT row_id, round(avg(f + b), 9) AS mean FROM ({ORDER_DRAWS}) JOIN {_RANEF} USING (g, chain, sample) GROUP BY 1")
def fitted_ranef(spark, sf_dir):
    return grouped_model(spark, sf_dir, False, rows=order_rows(spark, sf_dir)).fitted().select("row_id", r("mean", 9).alias("mean"))


@query("fitted_ranef_binary", f"SELECT row_id, round(avg({phi_sql('(f + b)')}), 6) AS mean FROM ({ORDER_DRAWS}) JOIN {_RANEF} USING (g, chain, sample) GROUP BY 1")
def fitted_ranef_binary(spark, sf_dir):
    return grouped_model(spark, sf_dir, True).fitted(order_rows(spark, sf_dir)).select("row_id", r("mean").alias("mean"))


@query("extract_grouped", f"SELECT g, chain * 3 + sample AS draw, round(avg(f + b), 9) AS value FROM ({ORDER_DRAWS}) JOIN {_RANEF} USING (g, chain, sample) GROUP BY ALL")
def extract_grouped(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    d = grouped_model(spark, sf_dir, False, rows=rows).extract("link")
    return d.join(rows.select("row_id", "g"), "row_id").groupBy("g", "draw").agg(r(F.avg("value"), 9).alias("value"))


@query("extract_chains", f"SELECT row_id, chain, sample, round(f, 9) AS value FROM ({ORDER_DRAWS})")
def extract_chains(spark, sf_dir):
    m = grouped_model(spark, sf_dir, False, rows=order_rows(spark, sf_dir).drop("g"))
    return m.extract("ev", combine=False).select("row_id", "chain", "sample", r("value", 9).alias("value"))


@query("model_residuals", f"SELECT row_id, round(any_value(y) - avg(f + b), 5) AS residual FROM ({ORDER_DRAWS}) JOIN {_RANEF} USING (g, chain, sample) GROUP BY 1")
def model_residuals(spark, sf_dir):
    return grouped_model(spark, sf_dir, False, rows=order_rows(spark, sf_dir)).residuals().select("row_id", r("residual", 5).alias("residual"))


@query("draws_by_row", f"SELECT row_id, round(list(f ORDER BY chain, sample)[1], 9) AS first, round(list(f ORDER BY chain, sample)[6], 9) AS last, CAST(count(*) AS INTEGER) AS n FROM ({ORDER_DRAWS}) GROUP BY 1")
def draws_by_row(spark, sf_dir):
    d = chains.combine(forest.predict(forest.literal(spark, order_draws()), order_rows(spark, sf_dir)), 3)
    return chains.by_row(d).select("row_id", r(F.col("values")[0], 9).alias("first"), r(F.element_at("values", -1), 9).alias("last"), F.size("values").alias("n"))


@query("draws_round_trip", f"SELECT g, chain * 3 + sample AS draw, round(avg(f), 9) AS value FROM ({ORDER_DRAWS}) GROUP BY ALL")
def draws_round_trip(spark, sf_dir):
    d = order_rows(spark, sf_dir)
    back = chains.by_draw(chains.by_row(chains.combine(forest.predict(forest.literal(spark, order_draws()), d), 3)))
    return back.join(d.select("row_id", "g"), "row_id").groupBy("g", "draw").agg(r(F.avg("value"), 9).alias("value"))


@query("ranef_mean", f"SELECT g, round(avg(b), 8) AS mean FROM {_RANEF} GROUP BY g")
def ranef_mean(spark, sf_dir):
    return grouped_model(spark, sf_dir, False).ranef_mean().select("g", r("mean", 8).alias("mean"))


@query("unseen_groups", "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS g FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def unseen_groups(spark, sf_dir):
    seen = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").cast("string").alias("g")).distinct()
    m = grouped_model(spark, sf_dir, False, ranef_of(spark, sf_dir).join(seen, "g", "left_semi"))
    return m.unseen(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g")))


@query("dense_groups", "SELECT o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def dense_groups(spark, sf_dir):
    return summaries.codes(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("model_round_trip", f"SELECT chain, sample, round(avg(f), 9) AS value FROM ({ORDER_DRAWS}) GROUP BY ALL")
def model_round_trip(spark, sf_dir):
    from treesum.sources.staging import folder

    path = folder(spark, "model")
    grouped_model(spark, sf_dir, False).save(path)
    p = sampler.Model.load(spark, path).predict(order_rows(spark, sf_dir).drop("g"))
    return p.groupBy("chain", "sample").agg(r(F.avg("value"), 9).alias("value"))


# tables behind plots


@query("trace", "SELECT CAST(n_regionkey % 2 AS INTEGER) AS chain, CASE WHEN n_nationkey < 12 THEN 'burn' ELSE 'keep' END AS phase, CAST(n_nationkey // 2 AS INTEGER) AS iteration, n_nationkey * 0.5 AS value FROM (SELECT n_nationkey, n_nationkey AS n_regionkey FROM nation WHERE n_nationkey < 24)")
def trace(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 24")
    sample = F.when(F.col("n_nationkey") < 12, F.expr("n_nationkey div 2")).otherwise(F.expr("(n_nationkey - 12) div 2")).cast("int")
    params = n.select((F.col("n_nationkey") % 2).cast("int").alias("chain"), F.when(F.col("n_nationkey") < 12, "burn").otherwise("keep").alias("phase"), sample.alias("sample"), F.lit("sigma").alias("name"), (F.col("n_nationkey") * 0.5).alias("value"))
    return summaries.trace(params).withColumn("value", F.col("value").cast("decimal(22,1)"))


@query("draw_intervals", f"SELECT row_id, y, round(quantile_cont(f, 0.05), 9) AS low, round(quantile_cont(f, 0.5), 9) AS mid, round(quantile_cont(f, 0.95), 9) AS high FROM ({ORDER_DRAWS}) GROUP BY ALL")
def draw_intervals(spark, sf_dir):
    rows = order_rows(spark, sf_dir)
    d = summaries.intervals(forest.predict(forest.literal(spark, order_draws()), rows), rows)
    return d.select("row_id", "y", *[r(c, 9).alias(c) for c in ("low", "mid", "high")])


_LEVELS = [60000.0, 120000.0, 180000.0, 300000.0]
_PD = " UNION ALL ".join(f"SELECT {c} AS chain, {s} AS sample, level1, avg({_order_sql(c, s).replace('o_totalprice', 'level1')}) AS value FROM orders, (SELECT unnest({_LEVELS}) AS level1) GROUP BY ALL" for c in (0, 1) for s in (0, 1, 2))


@query("pd_bands", f"SELECT CAST(level1 AS DOUBLE) AS level1, round(quantile_cont(value, 0.05), 9) AS low, round(quantile_cont(value, 0.5), 9) AS mid, round(quantile_cont(value, 0.95), 9) AS high FROM ({_PD}) GROUP BY 1")
def pd_bands(spark, sf_dir):
    d = dependence.partial(forest.literal(spark, order_draws()), order_rows(spark, sf_dir), [0], [_LEVELS])
    return summaries.bands(d).select("level1", *[r(c, 9).alias(c) for c in ("low", "mid", "high")])


@query("descending_places", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")
def descending_places(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return summaries.descending(o, F.col("o_totalprice")).select(F.col("row_id").alias("o_orderkey"), F.col("place").cast("long").alias("place"))


@query("residuals", f"SELECT l_orderkey * 10 + l_linenumber AS row_id, round({CHARGE} - (10 + 80 * ({SUM} + 0.5)), 6) AS residual FROM lineitem")
def residuals(spark, sf_dir):
    d = rows_of(spark, sf_dir)
    return forest.predict(forest.literal(spark, TREES), d, 10.0, 80.0, keep=["y"]).select("row_id", r(F.col("y") - F.col("value")).alias("residual"))


# dependence

PART_TREES = [[(0, 25.0), (1, 1200.0), (-1, 1.0), (-1, 2.0), (1, 1400.0), (-1, 3.0), (0, 40.0), (-1, 4.0), (-1, 5.0)]]
_PART = ["p_size", "p_retailprice"]


def _part_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(*[F.col(c).cast("double") for c in _PART]).alias("x"), F.lit(0.0).alias("offset"))


@query("pd_1d", f"SELECT level1, round(avg({forest.case_sql(PART_TREES[0], ['level1', 'p_retailprice'])}), 6) AS value FROM part, (SELECT CAST(10 * k AS DOUBLE) AS level1 FROM generate_series(0, 5) t(k)) GROUP BY 1")
def pd_1d(spark, sf_dir):
    return dependence.partial(forest.literal(spark, PART_TREES), _part_rows(spark, sf_dir), [0], [[10.0 * k for k in range(6)]]).select("level1", r("value").alias("value"))


@query("pd_2d", f"SELECT level1, level2, round(avg({forest.case_sql(PART_TREES[0], ['level1', 'level2'])}), 6) AS value FROM part, (SELECT CAST(10 * k AS DOUBLE) AS level1 FROM generate_series(0, 5) t(k)), (SELECT CAST(900 + 200 * k AS DOUBLE) AS level2 FROM generate_series(0, 5) t(k)) GROUP BY ALL")
def pd_2d(spark, sf_dir):
    return dependence.partial(forest.literal(spark, PART_TREES), _part_rows(spark, sf_dir), [0, 1], [[10.0 * k for k in range(6)], [900.0 + 200 * k for k in range(6)]]).select("level1", "level2", r("value").alias("value"))


@query("pd_levels", "SELECT DISTINCT round(v, 6) AS level FROM (SELECT unnest([" + ", ".join(f"quantile_cont(CAST(p_retailprice AS DOUBLE), {p})" for p in dependence.LEVELS) + "]) AS v FROM part)")
def pd_levels(spark, sf_dir):
    return spark.createDataFrame([(round(v, 6),) for v in dependence.levels(table(spark, sf_dir, "part"), "p_retailprice")], "level double")


@query("pd_levels_few", "SELECT DISTINCT CAST(n_regionkey AS DOUBLE) AS level FROM nation")
def pd_levels_few(spark, sf_dir):
    return spark.createDataFrame([(v,) for v in dependence.levels(table(spark, sf_dir, "nation"), "n_regionkey")], "level double")


# cross validation

_PLACED = f"SELECT row_id, row_number() OVER (ORDER BY u, row_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT o_orderkey AS row_id, {u01_sql('7', '3', 'o_orderkey')} AS u FROM orders)"
_FOLD = f"SELECT row_id, CAST(CASE WHEN place < (n % 7) * (n // 7 + 1) THEN place // (n // 7 + 1) ELSE n % 7 + (place - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM ({_PLACED})"


def _orders_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"))


@query("kfold_assign", _FOLD)
def kfold_assign(spark, sf_dir):
    return validation.folds(_orders_rows(spark, sf_dir), 7, rep=3, seed=7)


@query("kfold_sizes", f"SELECT fold, count(*) AS n FROM ({_FOLD}) GROUP BY fold")
def kfold_sizes(spark, sf_dir):
    return validation.folds(_orders_rows(spark, sf_dir), 7, rep=3, seed=7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("subsample_assign", f"SELECT row_id, place < floor(n * 0.2 + 0.5) AS test FROM ({_PLACED})")
def subsample_assign(spark, sf_dir):
    return validation.subsample(_orders_rows(spark, sf_dir), 0.2, rep=3, seed=7)


@query("cv_grid", "SELECT CAST(row_number() OVER (ORDER BY n_trees, k, power, base) - 1 AS INTEGER) AS cell, n_trees, k, power, base FROM (SELECT * FROM (VALUES (5), (7)) a(n_trees), (VALUES (1.0), (2.0), (4.0)) b(k), (VALUES (1.5), (2.0)) c(power), (VALUES (0.75), (0.8), (0.95)) d(base))")
def cv_grid(spark, sf_dir):
    g = validation.grid(spark, [5, 7], [1.0, 2.0, 4.0], [1.5, 2.0], [0.75, 0.8, 0.95], 1)
    return g.select("cell", "n_trees", F.col("k").cast("decimal(2,1)").alias("k"), F.col("power").cast("decimal(2,1)").alias("power"), F.col("base").cast("decimal(3,2)").alias("base"))


_LOSS = "SELECT o_orderkey AS row_id, 1 + o_orderkey % 3 AS w, o_totalprice / 500000 AS y, CAST(o_orderstatus = 'F' AS INTEGER) AS z, (o_custkey % 11) * 0.1 + s * 0.1 - 0.5 AS v FROM orders, generate_series(0, 3) t(s)"


def _loss_draws(spark, sf_dir, y):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), y.cast("double").alias("y"), (F.col("o_orderkey") % 3 + 1).alias("weight"), "o_custkey")
    return o.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("value", (F.col("o_custkey") % 11) * 0.1 + F.col("s") * 0.1 - 0.5)


@query("loss_rmse", f"SELECT round(sqrt(sum(w * pow(y - m, 2)) / sum(w)), 6) AS loss FROM (SELECT row_id, any_value(w) AS w, any_value(y) AS y, avg(v) AS m FROM ({_LOSS}) GROUP BY row_id)")
def loss_rmse(spark, sf_dir):
    return validation.rmse(_loss_draws(spark, sf_dir, F.col("o_totalprice") / 500000)).select(r("loss").alias("loss"))


_P = f"(SELECT row_id, any_value(w) AS w, any_value(z) AS z, avg({phi_sql('v')}) AS p FROM ({_LOSS}) GROUP BY row_id)"


@query("loss_log", f"SELECT round(-sum(w * CASE WHEN z = 1 THEN ln(p) ELSE ln(1 - p) END) / sum(w), 6) AS loss FROM {_P}")
def loss_log(spark, sf_dir):
    return validation.log_loss(_loss_draws(spark, sf_dir, F.col("o_orderstatus") == "F")).select(r("loss").alias("loss"))


@query("loss_mcr", f"SELECT round(sum(w * CASE WHEN (p > 0.5) <> (z = 1) THEN 1 ELSE 0 END) / sum(w), 6) AS loss FROM {_P}")
def loss_mcr(spark, sf_dir):
    return validation.misclassified(_loss_draws(spark, sf_dir, F.col("o_orderstatus") == "F")).select(r("loss").alias("loss"))


_PHI_PARTS = phi_sql(forest.case_sql(ORDER_TREES[0], ["o_totalprice"]))


@query("ppd_bernoulli", f"SELECT o_orderkey AS row_id, CAST({u01_sql('1', '0', '0', 'o_orderkey')} < {_PHI_PARTS} AS DOUBLE) AS value FROM orders")
def ppd_bernoulli(spark, sf_dir):
    t = forest.literal(spark, ORDER_TREES[:1]).withColumns({"kind": F.lit("tree"), "name": F.lit(None).cast("string")})
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.array("o_totalprice").alias("x"), F.lit(0.0).alias("offset"))
    return sampler.Model(t, -0.5, 1.0, True, sampler.Control(trees=1, draws=1, burn=0, chains=1)).predict(o, "ppd").select("row_id", "value")


# exact values of the distribution function, made by the error function of Python's library
_PHI = ", ".join(f"({q}, {math.erfc(-(q - 25) / 10 / math.sqrt(2)) / 2:.9f})" for q in range(1, 51))


@query("phi_values", f"SELECT l_quantity, count(*) AS n, round(any_value(p), 6) AS p FROM lineitem JOIN (VALUES {_PHI}) t(q, p) ON l_quantity = q GROUP BY 1")
def phi_values(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", phi_column((F.col("l_quantity") - 25) / 10).alias("p"))
    return li.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), r(F.max("p")).alias("p"))


# fits: draws are random, so only their shape is held against anything; tests hold the kernel against enumeration


def _charge_frame(spark, sf_dir):
    return rows_of(spark, sf_dir).select("row_id", "y", F.lit(1.0).alias("weight"), "offset", "x")


@query("chain_fit_continuous")
def chain_fit_continuous(spark, sf_dir):
    m = sampler.fit(_charge_frame(spark, sf_dir), sampler.Control(trees=10, draws=10, burn=10, chains=2))
    return m.params


@query("chain_fit_binary")
def chain_fit_binary(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = design.model_frame(o, (F.col("o_orderstatus") == "F").cast("double"), design.resolve(o, ["o_totalprice", "o_orderpriority"]), "o_orderkey")
    return sampler.fit(f, sampler.Control(trees=10, draws=10, burn=10, chains=2)).varcount()


@query("grouped_fit")
def grouped_fit(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = design.model_frame(c, "c_acctbal", design.resolve(c, ["c_custkey", "c_mktsegment"]), "c_custkey", group="c_nationkey")
    return sampler.fit(f, sampler.Control(trees=10, draws=10, burn=10, chains=2), group=True).ranef


@query("grid_fit")
def grid_fit(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    f = design.model_frame(c, "c_acctbal", design.resolve(c, ["c_custkey", "c_mktsegment"]), "c_custkey")
    return validation.cross_validate(f, n_trees=[5, 7], k=[1.0, 2.0], reps=2, control=sampler.Control(draws=10, burn=10, chains=1))


@query("partial_update")
def partial_update(spark, sf_dir):
    f = table(spark, sf_dir, "supplier")
    s = sampler.Session(design.model_frame(f, "s_acctbal", design.resolve(f, ["s_suppkey", "s_nationkey"]), "s_suppkey"), sampler.Control(trees=5, chains=1))
    s.run(20, 1)
    took = s.set_predictor(s.x[:, 1][::-1].copy(), column=1, mode="partial")
    return spark.createDataFrame([(int(i), bool(t)) for i, t in zip(s.row_id, took, strict=True)], "row_id long, ok boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected charge per return flag with a 90 % interval: fit on all rows, score all rows, average per draw. Rows of the same
    predictors have the same fits: they are scored once and count as many times as they are."""
    d = rows_of(spark, sf_dir).groupBy("l_returnflag", "x").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"), F.lit(0.0).alias("offset"))
    m = sampler.fit(_charge_frame(spark, sf_dir), sampler.Control(trees=10, draws=50, burn=50, chains=1))
    p = forest.predict(m.trees, d, m.lo, m.span, keep=["l_returnflag", "n"]).groupBy("l_returnflag", "chain", "sample").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("m"))
    return p.groupBy("l_returnflag").agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.5)).alias("median"), F.percentile("m", F.lit(0.95)).alias("high"))


QUERIES["charge_interval"] = flagship

# queries of further modules, which need what is above
from treesum.plans import forests, residents, sessions  # noqa: E402

for more in (sessions, residents, forests):
    QUERIES |= more.QUERIES
    ORACLES |= more.ORACLES
