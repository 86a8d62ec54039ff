import numpy as np

from treesum.operators import cuts, sampler


def test_quantile_cuts_are_those_of_columns_in_memory(spark):
    """Many distinct values and few, ties, nulls, a constant and a column without values; parts that a cut falls between."""
    r = np.random.default_rng(3)
    n = 700
    columns = [r.normal(size=n).round(2), r.integers(0, 6, n).astype(float), r.random(n), np.full(n, 2.0), np.full(n, np.nan)]
    missing = r.random((n, 5)) < 0.05
    rows = [tuple(None if missing[i, j] or np.isnan(c[i]) else float(c[i]) for j, c in enumerate(columns)) for i in range(n)]
    names = [f"c{j}" for j in range(5)]
    d = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(5)
    for k in (1, 7, 100, 1000):
        got = cuts.ragged(cuts.quantile(d, names, k))
        for j, c in enumerate(columns):
            v = c[~missing[:, j] & ~np.isnan(c)]
            want = sampler.cut_points(v, k, True) if len(v) else np.zeros(0)
            assert np.allclose(got.get(j, []), want) and len(got.get(j, [])) == len(want), (k, j)
    places = cuts.ranked_distinct(d, names[:2]).where("var = 1").orderBy("v").collect()
    assert [(x["v"], x["i"], x["u"]) for x in places] == [(float(i), i, 6) for i in range(6)]
