import numpy as np
from pyspark.sql import functions as F

from treesum.operators import forest, pruning
from treesum.operators.kernel import Chain, Settings, walk


def random_tree(r, cuts, depth=0):
    """(variable, cut or mean) in pre-order; rules need not be consistent with rows."""
    if depth > 4 or r.random() < 0.25 + 0.1 * depth:
        return [(-1, round(float(r.normal()), 3))]
    v = int(r.integers(len(cuts)))
    return [(v, float(r.choice(cuts[v]))), *random_tree(r, cuts, depth + 1), *random_tree(r, cuts, depth + 1)]


def consistent(trees, cuts):
    """Chains take trees by cut numbers."""
    return [[(v, float(cuts[v][int(np.abs(np.array(cuts[v]) - x).argmin())]) if v >= 0 else x) for v, x in t] for t in trees]


def setup(spark, seed=3, draws=4, trees=6):
    r = np.random.default_rng(seed)
    cuts = [np.linspace(1, 9, 9), np.linspace(0.5, 3.5, 4)]
    x = np.stack([r.integers(2, 7, 60), r.integers(0, 4, 60)], 1).astype(float)
    w = r.integers(0, 4, 60).astype(float)
    forests = [consistent([random_tree(r, cuts) for _ in range(trees)], cuts) for _ in range(draws)]
    rows = []
    for d, ts in enumerate(forests):
        for t, nodes in enumerate(ts):
            rows += [(d % 2, d // 2, t, i, 7, v, c) for i, (v, c) in enumerate(nodes)]
    table = spark.createDataFrame(rows, forest.SCHEMA).repartition(3)
    data = spark.createDataFrame([(i, [float(a) for a in v], float(u)) for i, (v, u) in enumerate(zip(x, w, strict=True))], "row_id long, x array<double>, weight double")
    return forests, cuts, x, w, table, data


def kernel(nodes, cuts, x, w):
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint16)
    c = Chain(bins, np.array([len(k) for k in cuts]), np.zeros(len(x)), w, Settings(trees=1), 1.0, 1, 0)
    c.install(nodes, cuts)
    return c


def listed(table):
    out = {}
    for r in table.collect():
        out.setdefault((r["chain"], r["sample"]), []).append((r["tree"], r["node"], r["n"], r["var"], round(r["value"], 9)))
    return {k: sorted(v) for k, v in out.items()}


def test_intervals(spark):
    _, _, _, _, table, _ = setup(spark)
    a = forest.annotated(table).select(*forest.KEY, "node", (F.col("node") + F.col("size") - 1).alias("last"))
    assert pruning.intervals(table).select(*forest.KEY, "node", "last").exceptAll(a).count() == 0


def test_prune_as_the_kernel_collapses(spark):
    forests, cuts, x, w, table, data = setup(spark)
    for weights, rows in ((w, data), (np.ones(len(x)), data.drop("weight"))):
        got = listed(pruning.prune(table, rows))
        fewer = 0
        for d, ts in enumerate(forests):
            c = kernel(ts, cuts, x, weights)
            fewer += sum(len(list(walk(t))) for t in c.roots)
            for root in c.roots:
                c.collapse(root)
            fewer -= sum(len(list(walk(t))) for t in c.roots)
            assert got[d % 2, d // 2] == sorted((t, i, n, v, round(y, 9)) for t, i, n, v, y in c.trees(cuts))
        assert fewer > 50
    assert listed(pruning.leaf_sums(table, data).select(*forest.KEY, "node", F.col("k").alias("n"), F.lit(-1).alias("var"), F.col("w").alias("value")))


def test_prune_without_rows_and_without_trees(spark):
    forests, _, _, _, table, data = setup(spark, draws=1)
    got = listed(pruning.prune(table, data.limit(0)))
    want = sorted((t, 0, 0, -1, round(float(np.mean([v for k, v in nodes if k < 0])), 9)) for t, nodes in enumerate(forests[0]))
    assert got[0, 0] == want


def test_map_cuts_as_the_kernel(spark):
    forests, cuts, x, w, table, data = setup(spark, seed=8)
    for new in ([np.array([2.0, 5.0, 8.0]), np.array([2.0])], [np.array([4.5]), np.linspace(0.6, 3.4, 9)], [np.array([]), np.array([1.0, 3.0])]):
        got = listed(pruning.map_cuts(table, dict(enumerate(map(list, new)))))
        both = listed(pruning.adapt(table, data, dict(enumerate(map(list, new)))))
        for d, ts in enumerate(forests):
            c = kernel(ts, cuts, x, w)
            c.map_cuts(cuts, new)
            assert [(t, i, v, y) for t, i, _, v, y in got[d % 2, d // 2]] == sorted((t, i, v, round(y, 9)) for t, i, _, v, y in c.trees(new))
            c.bins = np.stack([np.searchsorted(k, x[:, j], side="left") for j, k in enumerate(new)], 1).astype(np.uint16)
            c.place()
            for root in c.roots:
                c.collapse(root)
            assert both[d % 2, d // 2] == sorted((t, i, n, v, round(y, 9)) for t, i, n, v, y in c.trees(new))
