import numpy as np
import pytest
from pyspark.sql import functions as F

from treesum.operators import dependence, forest, pruning


def grown(r, depth=0):
    if depth > 3 or r.random() < 0.2:
        return [(-1, round(float(r.normal()), 3))]
    return [(int(r.integers(3)), round(float(r.random()), 1)), *grown(r, depth + 1), *grown(r, depth + 1)]


def setup(spark, n=200):
    r = np.random.default_rng(6)
    rows = [(c, s, t, i, None, v, x) for c in (0, 1) for s in (0, 1) for t in range(4) for i, (v, x) in enumerate(grown(r))]
    x = r.random((n, 3)).round(1)
    data = [(i, [float(a) for a in v], float(i % 5)) for i, v in enumerate(x)]
    data += [(n, [float("nan"), 0.5, 0.5], 1.0), (n + 1, [0.5, float("nan"), -0.0], 0.0), (n + 2, [float("inf"), float("-inf"), 0.3], 0.0)]
    return spark.createDataFrame(rows, forest.SCHEMA), spark.createDataFrame(data, "row_id long, x array<double>, offset double").repartition(3)


@pytest.mark.parametrize(("variables", "levels"), [([0], [[-1.0, 0.1, 0.3, 0.35, 0.9, 2.0, float("inf")]]), ([2], [[0.5]]), ([1, 0], [[0.2, 0.4, 0.6], [0.1, 0.5]])])
def test_occupancy_as_scoring(spark, variables, levels):
    trees, rows = setup(spark)
    key = lambda q: tuple(q)[:-1]
    a = sorted(map(tuple, dependence.partial(trees, rows, variables, levels, 3.0, 20.0).collect()), key=key)
    names = ["chain", "sample", "level1", *(["level2"] if len(levels) == 2 else []), "value"]
    b = sorted(map(tuple, dependence.scored(trees, rows, variables, levels, 3.0, 20.0).select(*names).collect()), key=key)
    assert len(a) == 4 * np.prod([len(v) for v in levels]) and [key(q) for q in a] == [key(q) for q in b]
    assert np.allclose([q[-1] for q in a], [q[-1] for q in b], atol=1e-9)


def test_occupancy_without_rows(spark):
    trees, rows = setup(spark)
    assert dependence.partial(trees, rows.limit(0), [0], [[0.1]]).count() == 0


def test_all_plans_route_alike(spark):
    """Ties, nulls, NaN, zeros of either sign and infinities, by generated code, arrays and boxes."""
    trees, rows = setup(spark)
    odd = [float("nan"), None, 0.0, -0.0, float("inf"), float("-inf"), 0.3, 0.5]
    more = spark.createDataFrame([(1000 + i * 8 + j, [a, b, 0.5], 0.0) for i, a in enumerate(odd) for j, b in enumerate(odd)], rows.schema)
    d = rows.unionByName(more)
    value = lambda q: (q["row_id"], q["chain"], q["sample"])
    a, b = ({value(q): q["value"] for q in forest.predict(trees, d, case_nodes=k).collect()} for k in (100_000, 0))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    leaf = forest.leaf_of(trees, d)
    assert leaf.exceptAll(forest.leaf_of_boxes(trees, d)).count() == 0 and leaf.count() == forest.leaf_of_boxes(trees, d).count()
    sums = pruning.leaf_sums(trees, d).select(*forest.KEY, "node", "k")
    assert sums.exceptAll(leaf.groupBy(*forest.KEY, "node").agg(F.count(F.lit(1)).alias("k"))).count() == 0
    one = forest.literal(spark, [[(0, 0.0), (-1, 1.0), (-1, 2.0)]])
    got = {q["row_id"]: q["value"] for q in forest.predict(one, more).collect()}
    assert [got[1000 + 8 * i] for i in range(8)] == [1.0, 1.0, 1.0, 1.0, 2.0, 1.0, 2.0, 2.0]
