import numpy as np
import pytest
from pyspark.sql import functions as F

from treesum.operators import stats


@pytest.mark.parametrize(("n", "p", "parts"), [(300, 5, 1), (300, 40, 20), (30, 40, 3)])
def test_triangles_as_a_plain_solution(spark, monkeypatch, n, p, parts):
    monkeypatch.setattr(stats, "WIDE", 0)
    r = np.random.default_rng(n + p)
    x = r.normal(size=(n, p)) + 1000 * r.random(p)
    y = x[:, :3] @ [1.0, -2.0, 0.5] + r.normal(size=n)
    w = r.integers(1, 4, n).astype(float)
    d = spark.createDataFrame([(i, float(y[i]), float(w[i]), 0.5, [float(v) for v in x[i]]) for i in range(n)], "row_id long, y double, weight double, offset double, x array<double>").repartition(parts)
    a = np.sqrt(w)[:, None] * np.column_stack([np.ones(n), x])
    b = np.sqrt(w) * (y - 0.5)
    beta, _, rank, _ = np.linalg.lstsq(a, b, rcond=None)
    want = np.sqrt(((b - a @ beta) ** 2).sum() / max(1, n - rank))
    assert abs(stats.ols_sigma(d) - want) < 1e-6 * max(1.0, want)
    # a column twice and a constant one change nothing
    more = d.withColumn("x", F.concat("x", F.slice("x", 1, 1), F.array(F.lit(3.0))))
    assert abs(stats.ols_sigma(more) - want) < 1e-6 * max(1.0, want)
    if n > p:
        got = stats.ols_sigma(d)
        monkeypatch.setattr(stats, "WIDE", 64)
        assert abs(stats.ols_sigma(d) - got) < 1e-6


def test_all_components_of_the_embeddings(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("embedding is not null and label is not null")
    d = e.select(F.col("vec_id").alias("row_id"), F.col("label").cast("double").alias("y"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("offset"), F.col("embedding").cast("array<double>").alias("x"))
    g = d.toPandas()
    a = np.column_stack([np.ones(len(g)), np.array(g["x"].tolist())])
    b = g["y"].to_numpy()
    beta, _, rank, _ = np.linalg.lstsq(a, b, rcond=None)
    assert abs(stats.ols_sigma(d) - np.sqrt(((b - a @ beta) ** 2).sum() / (len(b) - rank))) < 1e-9
    r, n = stats.triangle(d)
    assert n == len(g) and r.shape[1] == 66 and np.allclose(np.abs(np.diag(r)), np.abs(np.diag(np.linalg.qr(np.column_stack([a, b]), mode="r"))))
