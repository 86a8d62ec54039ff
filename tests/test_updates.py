import numpy as np
import pytest
from pyspark.sql import functions as F

from treesum.functions.scalar import u01
from treesum.operators import forest, updates
from treesum.operators.kernel import Chain, Settings, update_jointly

CUTS = [np.linspace(1, 9, 9), np.linspace(0.5, 3.5, 4)]


def grown(r, x, rows, depth=0):
    """A random tree in pre-order whose leaves all hold rows of x."""
    if depth < 4 and r.random() < 0.9:
        for _ in range(6):
            v = int(r.integers(2))
            c = float(r.choice(CUTS[v]))
            right = x[rows, v] > c
            if right.any() and not right.all():
                return [(v, c), *grown(r, x, rows[~right], depth + 1), *grown(r, x, rows[right], depth + 1)]
    return [(-1, 0.0)]


def kernel(nodes, x):
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(CUTS)], 1).astype(np.uint16)
    c = Chain(bins, np.array([9, 4]), np.zeros(len(x)), np.ones(len(x)), Settings(trees=1), 1.0, 1, 0)
    c.install(nodes, CUTS)
    return c, lambda y: np.stack([np.searchsorted(k, y[:, j], side="left") for j, k in enumerate(CUTS)], 1).astype(np.uint16)


def test_as_the_scan_does(spark):
    refused = 0
    for seed in range(12):
        r = np.random.default_rng(seed)
        n, many = int(r.integers(5, 60)), 1 + seed % 2
        xs = [np.stack([r.integers(0, 11, n), r.integers(0, 5, n)], 1).astype(float) for _ in range(many)]
        # one value for all empties leaves; a permutation refuses few rows
        news = [x[r.permutation(n)] if seed % 3 else np.tile([float(r.integers(0, 11)), 2.0], (n, 1)) for x in xs]
        forests = [[grown(r, x, np.arange(n)) for _ in range(4)] for x in xs]
        chains, bins = [], []
        for x, new, ts in zip(xs, news, forests, strict=True):
            c, code = kernel(ts, x)
            chains.append(c)
            bins.append(code(new))
        rows = spark.createDataFrame([(i * 3, *[[float(v) for v in m[i]] for x, new in zip(xs, news, strict=True) for m in (x, new)]) for i in range(n)], "row_id long" + "".join(f", x{k} array<double>, n{k} array<double>" for k in range(many))).repartition(3)
        h = {q["row_id"]: (q["h"], q["row_id"]) for q in rows.select("row_id", u01(F.lit(7), F.col("row_id")).alias("h")).collect()}
        order = np.array(sorted(range(n), key=lambda i: h[i * 3]))
        want = update_jointly(chains, bins, order)
        got = updates.partial_update(rows, [forest.literal(spark, ts) for ts in forests], [(f"x{k}", f"n{k}") for k in range(many)], 7)
        assert [q["ok"] for q in got.orderBy("row_id").collect()] == want.tolist()
        assert all(c.valid() for c in chains)
        refused += int((~want).sum())
    assert refused > 30


@pytest.mark.parametrize("rows", [0, 1])
def test_few_rows(spark, rows):
    d = spark.createDataFrame([(4, [1.0, 1.0], [9.5, 1.0])][:rows], "row_id long, x array<double>, n array<double>")
    got = updates.partial_update(d, [forest.literal(spark, [[(0, 5.0), (-1, 0.0), (-1, 1.0)]])], [("x", "n")])
    assert [q["ok"] for q in got.collect()] == [False] * rows
