"""Queries of saved forests under other rows and other cuts.

Their SQL holds nodes against rows by lists of conditions along paths, and finds intervals and topmost splits by comparing
nodes with nodes; it shares no text with the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from treesum.functions.scalar import u01_sql
from treesum.operators import cuts, forest, pruning, updates
from treesum.plans.registry import r, rows_of, table
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


KEY = "chain, sample, tree"


def values(trees: list[list]) -> str:
    """A literal forest as SQL rows f(chain, sample, tree, node, var, value)."""
    rows = []
    for t, (at, *nodes) in enumerate(trees):
        rows += [f"({at['chain']}, {at['sample']}, {at.get('tree', t)}, {i}, {v}, CAST({x!r} AS DOUBLE))" for i, (v, x) in enumerate(nodes)]
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") f(chain, sample, tree, node, var, value)"


def interval_sql(source: str, to: str) -> str:
    return f"""{to}_s AS (SELECT *, CASE WHEN var >= 0 THEN 1 ELSE -1 END AS step, sum(CASE WHEN var >= 0 THEN 1 ELSE -1 END) OVER (PARTITION BY {KEY} ORDER BY node) AS s FROM {source}),
{to} AS (SELECT a.* EXCLUDE (step, s), (SELECT min(b.node) FROM {to}_s b WHERE (b.chain, b.sample, b.tree) = (a.chain, a.sample, a.tree) AND b.node >= a.node AND b.s = a.s - a.step - 1) AS last FROM {to}_s a)"""


#: Pairs of a node and one above it, and the side.
PATHS = f"""p AS (SELECT i.chain, i.sample, i.tree, i.node, a.node AS above, a.var AS v, a.value AS c, i.node > l.last AS goes FROM g i JOIN g a USING ({KEY}) JOIN g l USING ({KEY}) WHERE a.node < i.node AND i.node <= a.last AND l.node = a.node + 1)"""

#: Splits marked bad in h go, the topmost ones; leaves have weights w.
COLLAPSE = f"""x AS (SELECT * FROM h WHERE bad),
q AS (SELECT h.*, bad AND NOT EXISTS (SELECT 1 FROM x WHERE (x.chain, x.sample, x.tree) = (h.chain, h.sample, h.tree) AND x.node < h.node AND h.node <= x.last) AS top FROM h),
y AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q t WHERE t.top AND (t.chain, t.sample, t.tree) = (q.chain, q.sample, q.tree) AND t.node < q.node AND q.node <= t.last)),
m AS (SELECT t.chain, t.sample, t.tree, t.node, CASE WHEN sum(b.w) > 0 THEN sum(b.w * b.value) / sum(b.w) ELSE avg(b.value) END AS mean FROM q t JOIN h b USING ({KEY}) WHERE t.top AND b.var < 0 AND t.node <= b.node AND b.node <= t.last GROUP BY ALL)
SELECT chain, sample, tree, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY node) - 1 AS INTEGER) AS node, n, CASE WHEN top THEN -1 ELSE var END AS var, round(coalesce(mean, value), 8) AS value FROM y LEFT JOIN m USING ({KEY}, node)"""


def prune_sql(nodes: str, rows: str) -> str:
    """nodes: (chain, sample, tree, node, var, value); rows: (x list, w)."""
    return f"""{interval_sql(nodes, "g")}, {PATHS},
c AS (SELECT g.chain, g.sample, g.tree, g.node, coalesce(list({{'v': p.v, 'c': p.c, 'r': p.goes}}) FILTER (p.v IS NOT NULL), []) AS path FROM g LEFT JOIN p USING ({KEY}, node) WHERE var < 0 GROUP BY ALL),
k AS (SELECT {KEY}, node, count(*) AS k, sum(w) AS w FROM ({rows}) d, c WHERE len(list_filter(path, lambda z: (d.x[z.v + 1] > z.c) <> z.r)) = 0 GROUP BY ALL),
e AS (SELECT g.*, coalesce(k, 0) AS k, coalesce(w, 0) AS w FROM g LEFT JOIN k USING ({KEY}, node)),
n AS (SELECT a.*, (SELECT CAST(sum(b.k) AS BIGINT) FROM e b WHERE (b.chain, b.sample, b.tree) = (a.chain, a.sample, a.tree) AND a.node <= b.node AND b.node <= a.last) AS n FROM e a),
h AS (SELECT a.*, a.var >= 0 AND coalesce(l.n = 0 OR l.n = a.n, false) AS bad FROM n a LEFT JOIN n l ON (l.chain, l.sample, l.tree, l.node) = (a.chain, a.sample, a.tree, a.node + 1)),
{COLLAPSE}"""


#: Draws of two trees over quantity, discount and tax; some rules leave a side without rows, some of them below each other.
PRUNED = [
    [{"chain": c, "sample": s, "tree": t}, *[(v, x + 0.01 * (s - c) if v < 0 else x + 0.5 * s * (v == 0)) for v, x in nodes]]
    for c in (0, 1)
    for s in (0, 1)
    for t, nodes in enumerate([
        [(0, 25.0), (0, 60.0), (1, 0.05), (-1, 0.1), (-1, 0.2), (-1, 0.9), (1, 0.03), (2, 0.04), (-1, 0.3), (-1, 0.4), (0, 0.0), (-1, 0.8), (0, 70.0), (-1, 0.5), (-1, 0.7)],
        [(0, 0.0), (1, 0.02), (-1, 0.1), (-1, 0.2), (2, 0.05), (0, 30.0), (-1, -0.1), (-1, -0.2), (-1, -0.3)],
    ])
]


def _tables(trees: list[list]) -> str:
    return f"f AS ({values(trees)})"


@query("forest_pruned", f"WITH {_tables(PRUNED)}, " + prune_sql("f", "SELECT [l_quantity, l_discount, l_tax] AS x, l_quantity AS w FROM lineitem"))
def forest_pruned(spark, sf_dir):
    d = pruning.prune(forest.literal(spark, PRUNED), rows_of(spark, sf_dir))
    return d.withColumn("value", r("value", 8))


PART = ["p_size", "p_retailprice"]
MAPPED = [
    [{"chain": 0, "sample": s, "tree": t}, *[(v, x if v < 0 else x + 3.0 * s) for v, x in nodes]]
    for s in (0, 1, 2)
    for t, nodes in enumerate([
        [(0, 24.0), (0, 11.0), (0, 4.0), (-1, 1.0), (-1, 2.0), (-1, 3.0), (0, 26.0), (1, 1000.0), (-1, 4.0), (-1, 5.0), (0, 45.0), (-1, 6.0), (-1, 7.0)],
        [(1, 1500.0), (1, 1490.0), (1, 1480.0), (-1, 1.5), (-1, 2.5), (0, 30.0), (-1, 3.5), (-1, 4.5), (1, 1700.0), (-1, 5.5), (-1, 6.5)],
    ])
]
N_CUTS = 3


def _map_sql() -> str:
    """CTEs up to h: rules moved to uniform cuts of part, level by level of the trees."""
    grid = " UNION ALL ".join(f"SELECT {i} AS v, k AS at, lo + (k + 1) * (hi - lo) / {N_CUTS + 1} AS c FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM part), generate_series(0, {N_CUTS - 1}) s(k)" for i, c in enumerate(PART))
    levels = []
    for depth in range(4):
        above = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth)) or "SELECT chain, sample, tree, node, 0 AS at FROM g WHERE false"
        levels.append(f"""
u{depth} AS ({above}),
r{depth} AS (SELECT o.chain, o.sample, o.tree, o.node, o.var, o.value, coalesce(max(u.at + 1) FILTER (p.goes AND p.v = o.var), 0) AS lo, coalesce(min(u.at) FILTER (NOT p.goes AND p.v = o.var), {N_CUTS}) AS hi
  FROM o LEFT JOIN p USING ({KEY}, node) LEFT JOIN u{depth} u ON (u.chain, u.sample, u.tree, u.node) = (p.chain, p.sample, p.tree, p.above) WHERE o.depth = {depth} AND o.var >= 0 GROUP BY ALL),
l{depth} AS (SELECT {KEY}, node, max_by(d.at, (-abs(d.c - value), d.at)) AS at FROM r{depth} JOIN d ON d.v = var AND lo <= d.at AND d.at < hi GROUP BY ALL)""")
    everything = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(4))
    return f"""d AS ({grid}), {interval_sql("f", "g")}, {PATHS},
o AS (SELECT g.*, count(p.above) AS depth FROM g LEFT JOIN p USING ({KEY}, node) GROUP BY ALL), {",".join(levels)},
z AS ({everything}),
h AS (SELECT g.chain, g.sample, g.tree, g.node, g.var, coalesce(d.c, g.value) AS value, g.last, g.var >= 0 AND z.at IS NULL AS bad, 0 AS w, CAST(NULL AS BIGINT) AS n FROM g LEFT JOIN z USING ({KEY}, node) LEFT JOIN d ON d.v = g.var AND d.at = z.at),
"""


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.array(*[F.col(c).cast("double") for c in PART]).alias("x"))


def _new_cuts(spark, sf_dir):
    return cuts.ragged(cuts.uniform(table(spark, sf_dir, "part"), PART, N_CUTS))


@query("forest_mapped", f"WITH {_tables(MAPPED)}, " + _map_sql() + COLLAPSE)
def forest_mapped(spark, sf_dir):
    d = pruning.map_cuts(forest.literal(spark, MAPPED), _new_cuts(spark, sf_dir))
    return d.withColumn("value", r("value", 8))


@query("forest_adapted", f"WITH b AS (WITH {_tables(MAPPED)}, " + _map_sql() + COLLAPSE.replace("round(coalesce(mean, value), 8)", "coalesce(mean, value)") + "), f AS (SELECT chain, sample, tree, node, var, value FROM b), " + prune_sql("f", "SELECT [greatest(p_size, 14), p_retailprice] AS x, 1 AS w FROM part"))
def forest_adapted(spark, sf_dir):
    """Other cuts and other rows: small sizes are raised, so that sides become empty."""
    rows = _part(spark, sf_dir).withColumn("x", F.array(F.greatest(F.col("x")[0], F.lit(14.0)), F.col("x")[1]))
    d = pruning.adapt(forest.literal(spark, MAPPED), rows, _new_cuts(spark, sf_dir))
    return d.withColumn("value", r("value", 8))


_SCAN = f"""WITH RECURSIVE d AS (SELECT p_partkey AS row_id, p_size AS a, p_retailprice AS b, least(p_size, 24) AS na, 2900 - p_retailprice AS nb FROM part),
o AS (SELECT row_id, CASE WHEN a <= 25 THEN 1 ELSE 2 END AS o1, CASE WHEN na <= 25 THEN 1 ELSE 2 END AS n1, CASE WHEN b > 1400 THEN 5 WHEN a <= 10 THEN 3 ELSE 4 END AS o2, CASE WHEN nb > 1400 THEN 5 WHEN na <= 10 THEN 3 ELSE 4 END AS n2,
  row_number() OVER (ORDER BY {u01_sql("7", "row_id")}, row_id) AS i FROM d),
s(i, row_id, c, ok) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), (SELECT list(n ORDER BY k) FROM (SELECT k, (SELECT count(*) FROM o WHERE k IN (o1, o2)) AS n FROM range(1, 6) r(k))), false
  UNION ALL SELECT o.i, o.row_id, CASE WHEN (o1 = n1 OR c[o1] > 1) AND (o2 = n2 OR c[o2] > 1) THEN list_transform(range(1, 6), lambda k: c[k] - (k = o1)::BIGINT + (k = n1)::BIGINT - (k = o2)::BIGINT + (k = n2)::BIGINT) ELSE c END,
    (o1 = n1 OR c[o1] > 1) AND (o2 = n2 OR c[o2] > 1) FROM s JOIN o ON o.i = s.i + 1)
SELECT row_id, ok FROM s WHERE i > 0"""


@query("updated_rows", _SCAN)
def updated_rows(spark, sf_dir):
    """Rows of part take smaller sizes and mirrored prices, one by one in the order of a hash, as far as no leaf empties."""
    trees = forest.literal(spark, [[(0, 25.0), (-1, 0.1), (-1, 0.2)], [(1, 1400.0), (0, 10.0), (-1, 0.1), (-1, 0.2), (-1, 0.3)]])
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.array(size, price).alias("x"), F.array(F.least(size, F.lit(24.0)), F.lit(2900.0) - price).alias("new"))
    return updates.partial_update(rows, [trees], [("x", "new")], 7).select("row_id", "ok")


#: A quantity that is NaN, null, infinite or a zero with a sign on some rows of each table.
_ODD = "CASE WHEN l_quantity = 25 THEN CAST('NaN' AS DOUBLE) WHEN l_quantity = 26 THEN NULL WHEN l_quantity = 27 THEN CAST('Infinity' AS DOUBLE) WHEN l_quantity = 28 THEN CAST('-Infinity' AS DOUBLE) WHEN l_quantity = 1 THEN CAST('-0' AS DOUBLE) ELSE l_quantity END"
_ODD_TREE = [(0, 20.0), (1, 0.05), (0, 0.0), (-1, 0.1), (-1, 0.2), (-1, 0.3), (0, 30.0), (-1, 0.4), (2, 0.04), (-1, 0.5), (-1, 0.6)]
_ODD_LEAF = "CASE WHEN q IS NOT NULL AND NOT isnan(q) AND q > 20 THEN (CASE WHEN q > 30 THEN (CASE WHEN l_tax > 0.04 THEN 10 ELSE 9 END) ELSE 7 END) ELSE (CASE WHEN l_discount > 0.05 THEN 5 WHEN q IS NOT NULL AND NOT isnan(q) AND q > 0 THEN 4 ELSE 3 END) END"
_ODD_COUNTS = f"SELECT leaf, count(*) AS n FROM (SELECT {_ODD_LEAF} AS leaf FROM (SELECT {_ODD} AS q, l_discount, l_tax FROM lineitem)) GROUP BY leaf"


@query("odd_values_route_alike", f"SELECT plan, leaf, n FROM ({_ODD_COUNTS}), (SELECT unnest(['arrays', 'boxes', 'code', 'leaves', 'sums']) AS plan)")
def odd_values_route_alike(spark, sf_dir):
    """The leaf of every row in all plans: rows that are no number, or none, go left everywhere."""
    rows = rows_of(spark, sf_dir).withColumn("x", F.array(F.expr(_ODD), "l_discount", "l_tax"))
    trees = forest.literal(spark, [_ODD_TREE])
    # the mean of a leaf tells which it is
    numbered = forest.literal(spark, [[(v, float(i) if v < 0 else c) for i, (v, c) in enumerate(_ODD_TREE)]])
    by_value = lambda k: forest.predict(numbered, rows, case_nodes=k).select(F.round("value").cast("int").alias("leaf"))
    plans = {"code": by_value(256), "arrays": by_value(0), "leaves": forest.leaf_of(trees, rows).select(F.col("node").alias("leaf")), "boxes": forest.leaf_of_boxes(trees, rows).select(F.col("node").alias("leaf"))}
    out = pruning.leaf_sums(trees, rows).select(F.lit("sums").alias("plan"), F.col("node").alias("leaf"), F.col("k").alias("n"))
    for name, d in plans.items():
        out = out.unionByName(d.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("plan", F.lit(name)))
    return out


_FLAGS = "ANR"


@query("formula_products", "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS y, round(l_tax, 6) AS offset, " + ", ".join([*(f"CASE WHEN l_returnflag = '{f}' THEN l_quantity ELSE 0 END AS q_{f}" for f in _FLAGS), "round(pow(l_discount, 2) + 1, 6) AS d2", "l_discount AS d", "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS o", "CASE WHEN l_linestatus = 'O' THEN l_discount ELSE 0.0 END AS d_o"]) + " FROM lineitem")
def formula_products(spark, sf_dir):
    """Products of a number and a factor, computed numbers and a computed response."""
    li = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey"))
    _, made = design.formula_frame(li, "log(l_extendedprice) ~ l_quantity:l_returnflag + I(l_discount^2 + 1) + l_discount*l_linestatus - 1 + offset(l_tax)", "id")
    x = made.matrix(li, "l_orderkey", "l_linenumber", "l_partkey", F.log("l_extendedprice").alias("y"), F.col("l_tax").alias("offset"))
    named = {**{f"q_{c}": f"l_quantity:l_returnflag.{c}" for c in _FLAGS}, "d2": "I(l_discount^2 + 1)", "d": "l_discount", "o": "l_linestatus.O", "d_o": "l_discount:l_linestatus.O"}
    return x.select("l_orderkey", "l_linenumber", "l_partkey", r("y").alias("y"), r("offset").alias("offset"), *(r(F.col(f"`{n}`")).alias(k) for k, n in named.items()))


@query("formula_frame", "SELECT l_orderkey AS row_id, count(*) AS n, round(sum(ln(l_extendedprice)), 4) AS y, round(sum(l_tax), 6) AS offset, round(sum(l_quantity * l_discount), 4) AS qd, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity * l_discount ELSE 0 END), 4) AS qdn FROM lineitem GROUP BY 1")
def formula_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    f, made = design.formula_frame(li, "log(l_extendedprice) ~ (l_quantity + l_discount + l_returnflag)^3 + offset(l_tax)", "l_orderkey")
    at = {n: i for i, n in enumerate(made.names)}
    return f.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("y"), 4).alias("y"), r(F.sum("offset")).alias("offset"), r(F.sum(F.col("x")[at["l_quantity:l_discount"]]), 4).alias("qd"), r(F.sum(F.col("x")[at["l_quantity:l_discount:l_returnflag.N"]]), 4).alias("qdn"))
