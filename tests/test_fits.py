import numpy as np
import pytest
from pyspark.sql import functions as F

from treesum.operators import cuts, forest, sampler, stats, validation
from treesum.sources import design
from treesum.streaming.scoring import score_stream

SMALL = sampler.Control(trees=12, draws=15, burn=25, chains=2, cuts=30)


def friedman(spark, n=150, seed=4, groups=False):
    r = np.random.default_rng(seed)
    x = r.random((n, 5))
    f = 10 * np.sin(np.pi * x[:, 0] * x[:, 1]) + 20 * (x[:, 2] - 0.5) ** 2 + 10 * x[:, 3] + 5 * x[:, 4]
    g = r.integers(0, 5, n)
    b = r.normal(size=5) * 3
    y = f + r.normal(size=n) + (b[g] if groups else 0)
    rows = [(i, float(y[i]), 1.0, 0.0, [float(v) for v in x[i]], str(g[i])) for i in range(n)]
    d = spark.createDataFrame(rows, "row_id long, y double, weight double, offset double, x array<double>, g string")
    return (d if groups else d.drop("g")), f, b


def test_fit_predict_save(spark, tmp_path):
    d, f, _ = friedman(spark)
    m = sampler.fit(d, SMALL)
    again = sampler.fit(d.repartition(7), SMALL)
    assert sorted(map(tuple, m.params.collect())) == sorted(map(tuple, again.params.collect()))
    assert m.params.where("phase = 'keep' and name = 'sigma'").count() == 30 and m.params.where("phase = 'burn' and name = 'k'").count() == 50
    mean = {r["row_id"]: r["mean"] for r in m.fitted(d).collect()}
    assert np.corrcoef([mean[i] for i in range(len(f))], f)[0, 1] > 0.85
    long = m.predict(d).groupBy("row_id").agg(F.avg("value").alias("v")).collect()
    assert all(abs(r["v"] - mean[r["row_id"]]) < 1e-9 for r in long)
    assert m.predict(d, "ppd").count() == 150 * 30
    # counts of training rows replayed equal those kept while fitting
    t = m.trees.where("sample = 3")
    assert sorted(map(tuple, forest.replay(t, d).collect())) == sorted(map(tuple, t.collect()))
    assert forest.valid(t).where("not valid").count() == 0
    leaves = forest.leaf_of(t, d).exceptAll(forest.leaf_of_boxes(t, d))
    assert leaves.count() == 0
    m.save(f"file://{tmp_path}/m")
    back = sampler.Model.load(spark, f"file://{tmp_path}/m")
    assert {r["row_id"]: r["mean"] for r in back.fitted(d).collect()} == mean
    with pytest.raises(ValueError):
        m.predict(d, "nothing")


def test_groups(spark):
    d, _, b = friedman(spark, groups=True)
    m = sampler.fit(d, sampler.Control(trees=12, draws=25, burn=40, chains=1, cuts=30), group=True, callback=lambda fits, ranef, sigma, tau: {"spread": float(np.std(fits)), "tau": tau})
    est = {r["g"]: r["m"] for r in m.ranef.groupBy("g").agg(F.avg("value").alias("m")).collect()}
    assert np.corrcoef([est[str(i)] for i in range(5)], b)[0, 1] > 0.9
    assert m.callbacks.count() == 50
    new = d.withColumn("g", F.lit("unseen"))
    p = m.predict(new).groupBy("sample").agg(F.count_distinct("row_id").alias("n"))
    assert p.count() == 25


def test_session(spark):
    d, f, _ = friedman(spark)
    s = sampler.Session(d, sampler.Control(trees=10, chains=1, cuts=20))
    out = s.run(20, 5)
    assert out["train"].shape == (5, 150) and s.run(2, 0) is None
    assert np.allclose(s.predict(s.x), s.fits())
    before = s.fits()
    s.set_offset(np.full(150, 2.0))
    assert np.allclose(s.fits(), before + 2)
    s.set_offset(0.0)
    s.set_response(s.y * 3)
    assert np.allclose(s.fits(), before, atol=1e-8)
    c = s.copy()
    s.run(3, 1)
    c.run(3, 1)
    assert np.array_equal(s.fits(), c.fits())
    took = s.set_predictor(s.x[::-1, 0].copy(), column=0, mode="partial")
    assert took.dtype == bool and s.chain.valid()
    assert s.set_predictor(np.zeros(150), column=1, mode="force") is True
    s.set_cuts([0.2, 0.4, 0.6], 2)
    s.run(3, 1)
    joint = sampler.update_predictor_jointly([s, c], np.random.default_rng(0).random(150), [3, 3])
    assert np.array_equal(s.x[joint, 3], c.x[joint, 3])
    with pytest.raises(ValueError):
        s.latents()
    with pytest.raises(ValueError):
        s.set_weights(np.full(150, -1.0))


def test_cross_validation(spark):
    d, _, _ = friedman(spark, 60)
    c = sampler.Control(draws=5, burn=5, chains=1, cuts=20)
    v = validation.cross_validate(d, n_trees=[3, 5], k=[2.0, 40.0], reps=2, control=c)
    assert v.count() == 8
    m = {r["k"]: r["l"] for r in v.groupBy("k").agg(F.avg("loss").alias("l")).collect()}
    assert m[2.0] < m[40.0]
    own = validation.cross_validate(d, n_trees=[3], reps=1, method="random subsample", n_test=0.2, loss=lambda y, draws, w: float(np.abs(y - draws.mean(1)).mean()), control=c)
    assert own.first()["loss"] > 0


def test_design(spark):
    rows = [(i, i % 2 == 0, "abc"[i % 3], [1.0, float(i)], 5) for i in range(9)]
    d = spark.createDataFrame(rows, "iv int, b boolean, f string, m array<double>, one int")
    s = design.resolve(d, ["iv", "b", "f", "m", "one"])
    assert s.names == ["iv", "b", "f.a", "f.b", "f.c", "m.2"]
    assert design.resolve(d.where("f <> 'c'"), ["f"]).names == ["f.b"]
    assert design.resolve(d.where("f = 'c'"), ["f"]).names == []
    with pytest.raises(design.DesignError):
        design.resolve(d.withColumn("t", F.current_timestamp()), ["t"])
    with pytest.raises(design.DesignError):
        design.parse_formula("y ~ nothing", ["y", "a"])
    assert design.parse_formula("y ~ . - b", ["y", "a", "b"]) == ("y", ["a"])
    with pytest.warns(UserWarning):
        assert s.matched(d.toDF("a", "b", "c", "d", "e")).columns == ["iv", "b", "f", "m", "one"]


def test_cuts_and_sigma(spark):
    with pytest.raises(ValueError):
        cuts.check_recut(5, 3)
    assert "ignored" in cuts.check_recut(3, 5)
    d, f, _ = friedman(spark, 300)
    g = np.array([r["x"] for r in d.orderBy("row_id").collect()])
    y = np.array([r["y"] for r in d.orderBy("row_id").collect()])
    a = np.column_stack([np.ones(300), g])
    beta, *_ = np.linalg.lstsq(a, y, rcond=None)
    want = np.sqrt(((y - a @ beta) ** 2).sum() / (300 - 6))
    assert abs(stats.ols_sigma(d) - want) < 1e-8
    # a column twice does not change the rank
    assert abs(stats.ols_sigma(d.withColumn("x", F.concat("x", F.slice("x", 1, 1)))) - want) < 1e-6


def test_stream(spark, tmp_path):
    d, _, _ = friedman(spark, 40)
    d.select("row_id", "x", "offset").write.parquet(f"{tmp_path}/in")
    t = forest.literal(spark, [[(0, 0.5), (-1, 1.0), (-1, 2.0)]])
    s = spark.readStream.schema("row_id long, x array<double>, offset double").parquet(f"{tmp_path}/in")
    q = score_stream(t, s).select("row_id", "mean").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r["row_id"]: r["mean"] for r in forest.predict_summary(t, d).collect()}
    assert {r["row_id"]: r["mean"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_shards_are_one_forest(spark):
    d, f, _ = friedman(spark, 400)
    m = sampler.fit(d, sampler.Control(trees=10, draws=10, burn=30, chains=2, cuts=30), shards=3)
    assert m.trees.select("tree").distinct().count() == 30 and m.params.where("phase = 'keep' and name = 'sigma'").count() == 20
    mean = {r["row_id"]: r["mean"] for r in m.fitted().collect()}
    assert np.corrcoef([mean[i] for i in range(len(f))], f)[0, 1] > 0.8
    with pytest.raises(ValueError):
        sampler.fit(d, SMALL, shards=2, callback=lambda *a: {})
    with pytest.raises(ValueError):
        sampler.prepare(d.where("false"), SMALL, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())


def test_extract(spark):
    d, _, _ = friedman(spark)
    m = sampler.fit(d, SMALL, test=d.where("row_id < 10"))
    assert m.extract("ev", "test").columns == ["row_id", "value", "draw"] and m.extract("ppd", "test").count() == 300
    assert m.extract("link", combine=False).count() == 150 * 30 and m.extract("trees").count() == m.trees.count()
    assert "sigma" in m.describe() and m.residuals().count() == 150
    with pytest.raises(ValueError):
        sampler.fit(d, SMALL).extract("ev", "test")


def test_warm_cross_validation(spark):
    d, _, _ = friedman(spark, 80)
    c = sampler.Control(draws=8, burn=10, chains=1, cuts=20)
    args = {"n_trees": [5, 8], "k": [2.0, 4.0], "reps": 2, "n_test": 4, "control": c}
    warm = validation.cross_validate(d, warm=(20, 5, 10), **args).collect()
    assert len(warm) == 8 and all(0 < r["loss"] < 12 for r in warm)
    again = validation.cross_validate(d, warm=(20, 5, 10), **args).collect()
    assert sorted(map(tuple, warm)) == sorted(map(tuple, again))
    cold = validation.cross_validate(d, **args).collect()
    assert abs(np.mean([r["loss"] for r in cold]) - np.mean([r["loss"] for r in warm])) < 2.5


def test_tasks_and_tables_agree_on_folds(spark):
    rows = spark.range(37).selectExpr("id * 7 AS row_id")
    ids = np.arange(37) * 7
    place = {int(ids[i]): k for k, i in enumerate(validation.places(ids, 2, 9))}
    assert {r["row_id"]: r["place"] for r in validation._ranked(rows, 2, 9).collect()} == place
    assert len({validation.stream(a, b, c) for a in range(4) for b in range(4) for c in range(200)}) == 3200


def test_mixture_of_two_lines(spark):
    """A larger sampler: latent classes are drawn given the forest, and installed as a predictor with its test set."""
    r = np.random.default_rng(3)
    n = 120
    x, z = r.uniform(-2, 2, n), r.integers(0, 2, n)
    y = np.where(z == 1, 3 + x, -3 - x) + 0.2 * r.normal(size=n)
    start = (y > 0).astype(float)
    frame = spark.createDataFrame([(i, float(y[i]), 1.0, 0.0, [float(x[i]), float(start[i])]) for i in range(n)], "row_id long, y double, weight double, offset double, x array<double>")
    s = sampler.Session(frame, sampler.Control(trees=20, chains=1, cuts=30), test=frame)
    s.run(30, 1)
    now, kept = start.copy(), []
    for it in range(30):
        s.set_test_predictor(1 - now, column=1)
        out = s.run(0, 1)
        a, b = out["train"][0], out["test"][0]
        ratio = np.exp(np.clip((-((y - b) ** 2) + (y - a) ** 2) / (2 * out["sigma"][0] ** 2), -50, 50))
        flip = r.random(n) < ratio / (1 + ratio)
        took = s.set_predictor(np.where(flip, 1 - now, now), column=1, mode="partial")
        now = s.x[:, 1]
        assert took.any()
        if it >= 10:
            kept.append(now)
    share = np.abs(np.mean(kept, axis=0) - z)
    assert min(share.mean(), 1 - share.mean()) < 0.15


def test_cuts_map_within_what_ancestors_leave(spark):
    d, _, _ = friedman(spark, 60)
    s = sampler.Session(d, sampler.Control(trees=1, chains=1))
    s.set_cuts([0.1, 0.3, 0.5, 0.7, 0.9], 0)
    s.set_trees([[(0, 0.5), (0, 0.3), (-1, 1.0), (-1, 2.0), (0, 0.7), (-1, 3.0), (-1, 5.0)]])
    s.set_cuts([0.45, 0.8], 0)
    # 0.5 goes to 0.45, below which nothing is left; 0.7 goes to 0.8
    assert [(v, round(c, 9)) for v, c in s.trees()[["var", "value"]].itertuples(index=False)] == [(0, 0.45), (-1, 1.5), (0, 0.8), (-1, 3.0), (-1, 5.0)]
    # of two cuts that are equally near the higher is taken
    s.set_trees([[(0, 0.45), (-1, 0.0), (-1, 1.0)]])
    s.set_cuts([0.35, 0.55], 0)
    assert abs(s.trees()["value"][0] - 0.55) < 1e-12
    with pytest.raises(ValueError):
        s.set_data(d.withColumn("x", F.slice("x", 1, 3)))
    with pytest.raises(ValueError):
        s.test_fits()


def test_ranking_and_names(spark):
    from treesum.operators import dependence, summaries

    d = spark.createDataFrame([(i, float(i * 37 % 50)) for i in range(200)] + [(300, None)], "row_id long, v double")
    got = {r["row_id"]: r["place"] for r in summaries.descending(d, F.col("v")).collect()}
    want = sorted(range(200), key=lambda i: (-(i * 37 % 50), i))
    assert [got[i] for i in want] == list(range(1, 201)) and got[300] == 201
    assert dependence.positions(["a", "f.x", "f.y"]) == [0, 1, 2] and dependence.positions(["a", "f.x", "f.y"], "f") == [1, 2]
    for bad in ("z", 3):
        with pytest.raises(ValueError):
            dependence.positions(["a"], bad)


def test_the_same_prior_twice_changes_nothing(spark):
    d, _, _ = friedman(spark)
    s = sampler.Session(d, sampler.Control(trees=5, chains=1, cuts=20))
    prior = stats.ChiSquaredPrior()
    scale = lambda: s.chain.s.scale * s.p.span**2
    s.set_model(variance=prior)
    first = scale()
    y = s.y.copy()
    y[3] += 500
    s.set_response(y)
    assert abs(scale() / first - 1) < 1e-9
    s.set_model(variance=prior)
    assert abs(scale() / first - 1) < 1e-9
    s.set_offset(np.linspace(0, 90, 150), update_scale=True)
    s.set_model(variance=prior)
    assert abs(scale() / first - 1) < 1e-9


def test_recut_keeps_the_kind_of_cuts(spark):
    d, _, _ = friedman(spark)
    s = sampler.Session(d, sampler.Control(trees=5, chains=1, cuts=20, quantile_cuts=True))
    x = s.x**3
    assert s.set_predictor(x, mode="force", recut=True)
    wide = d.select(F.pow(F.col("x")[0], 3).alias("a"))
    assert np.allclose(s.p.cuts[0], cuts.ragged(cuts.quantile(wide, ["a"], 20))[0])


def test_a_session_takes_a_binary_response(spark):
    d, f, _ = friedman(spark)
    s = sampler.Session(d.withColumn("y", (F.col("y") > 14).cast("double")), sampler.Control(trees=5, chains=1, cuts=20))
    s.run(2, 1)
    s.set_response(1 - s.y)
    assert ((s.latents() > 0) == (s.y == 1)).all()
