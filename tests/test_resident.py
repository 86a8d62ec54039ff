import numpy as np
import pytest
from pyspark.sql import functions as F

from treesum.operators import resident, sampler, stats, validation
from treesum.operators.kernel import Chain, walk
from treesum.sources.staging import staged

CONTROL = sampler.Control(trees=12, draws=6, burn=6, chains=2, cuts=25, seed=5)


def frame(spark, n=400, seed=4, binary=False, weights=False):
    r = np.random.default_rng(seed)
    x = r.random((n, 4)).round(2)
    f = 10 * np.sin(np.pi * x[:, 0] * x[:, 1]) + 8 * x[:, 2]
    y = (f + r.normal(size=n) * 3 > 7).astype(float) if binary else f + r.normal(size=n)
    w = r.integers(1, 4, n).astype(float) if weights else np.ones(n)
    rows = [(i * 7 - 50, float(y[i]), float(w[i]), 0.3 if binary else 1.0, [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y double, weight double, offset double, x array<double>")


def by_kernel(d, control, p, sweeps):
    """Chains of the one-task kernel over the same rows."""
    g = d.toPandas().sort_values("row_id")
    x, y, w, off = np.array(g["x"].tolist()), g["y"].to_numpy(), g["weight"].to_numpy(), g["offset"].to_numpy()
    y = y if p.binary else (y - off - p.lo) / p.span - 0.5
    out = []
    for i in range(control.chains):
        c = Chain(sampler.bins(x, p.cuts), np.array([len(k) for k in p.cuts]), y, w, p.settings, p.sigma, control.seed, i, off if p.binary else None, g["row_id"].to_numpy())
        for _ in range(sweeps):
            c.sweep()
        out.append(c)
    return out


def same(a, b, within=1e-9):
    assert a.accepted == b.accepted
    assert abs(a.sigma - b.sigma) < within and abs(a.k - b.k) < within
    for s, t in zip(a.roots, b.roots, strict=True):
        s, t = list(walk(s)), list(walk(t))
        assert [(x.var, x.cut) for x in s] == [(x.var, x.cut) for x in t]
        assert all(abs(x.mean - y.mean) < within for x, y in zip(s, t, strict=True) if x.leaf)


def driven(d, control, p, sweeps, batch):
    rows = resident.blocks(d, p).persist()
    n = rows.agg(F.sum("n")).first()[0]
    chains = [resident.Driven(n, np.array([len(c) for c in p.cuts]), p.settings, p.sigma, control.seed, i) for i in range(control.chains)]
    if p.settings.prior_trees:
        resident.begin(rows, chains)
    for _ in range(sweeps):
        resident.sweep(rows, chains, batch)
    rows.unpersist()
    return chains


@pytest.mark.parametrize(("parts", "batch", "binary", "weights", "preset"), [(1, 12, False, False, "modern"), (4, 5, False, True, "classic"), (16, 1, False, True, "modern"), (4, 5, True, False, "modern"), (3, 12, True, True, "classic")])
def test_draws_are_those_of_the_kernel(spark, parts, batch, binary, weights, preset):
    d = frame(spark, binary=binary, weights=weights)
    p = sampler.prepare(d, CONTROL, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior(), preset=preset)
    want = by_kernel(d, CONTROL, p, 8)
    got = driven(d.repartition(parts), CONTROL, p, 8, batch)
    for a, b in zip(got, want, strict=True):
        same(a, b)
    assert sum(c.accepted for c in want) > 10


def test_all_kinds_of_moves_are_settled(spark):
    """Deeper trees, in which rules with rules below them are changed and swapped."""
    d = frame(spark, 600)
    control = sampler.Control(trees=2, draws=1, burn=1, chains=1, cuts=40, seed=11)
    p = sampler.prepare(d, control, stats.TreePrior(base=0.99, power=0.3), stats.NormalPrior(), stats.ChiSquaredPrior(), preset="classic")
    want = by_kernel(d, control, p, 40)
    got = driven(d.repartition(2), control, p, 40, 2)
    same(got[0], want[0], 1e-8)
    assert max(len(list(walk(r))) for r in want[0].roots) >= 7


def test_sums_by_shuffle_equal_those_on_the_driver(spark, monkeypatch):
    d = frame(spark, weights=True)
    p = sampler.prepare(d, CONTROL, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    want = driven(d.repartition(6), CONTROL, p, 2, 5)
    monkeypatch.setattr(resident, "GATHER", 0)
    monkeypatch.setattr(resident, "SLICE", 50)
    for a, b in zip(driven(d.repartition(6), CONTROL, p, 2, 5), want, strict=True):
        same(a, b)


def test_fit_resumes(spark, tmp_path):
    d = frame(spark)
    whole = resident.fit(d, CONTROL, every=5, path=f"file://{tmp_path}/a")
    assert sorted(map(str, whole.params.select("chain", "phase", "sample", "name").collect())) == sorted(str(r) for r in sampler.fit(d, CONTROL).params.select("chain", "phase", "sample", "name").collect())
    half = sampler.Control(trees=12, draws=2, burn=6, chains=2, cuts=25, seed=5)
    resident.fit(d, half, every=5, path=f"file://{tmp_path}/b")
    # a run that broke off after it wrote draws and before it wrote their state
    spark.read.parquet(f"file://{tmp_path}/b/draws/upto=8").limit(3).write.parquet(f"file://{tmp_path}/b/draws/upto=11")
    with pytest.raises(ValueError, match="control"):
        resident.proceed(d, f"file://{tmp_path}/b", sampler.Control(trees=11, draws=6, burn=6, chains=2, cuts=25, seed=5))
    on = resident.proceed(d.repartition(5), f"file://{tmp_path}/b", CONTROL, every=4)
    key = lambda r: (r["kind"], r["chain"], r["sample"], r["tree"] or 0, r["node"] or 0, r["name"] or "")
    a, b = (sorted(m.table.collect(), key=key) for m in (whole, on))
    assert [(key(r), r["n"], r["var"]) for r in a] == [(key(r), r["n"], r["var"]) for r in b]
    assert all(abs(x["value"] - y["value"]) < 1e-8 for x, y in zip(a, b, strict=True))
    # trees count the rows that pass them
    from treesum.operators import forest

    t = whole.trees.where("sample = 5")
    assert sorted(map(tuple, forest.replay(t, d).collect())) == sorted(map(tuple, t.collect()))
    assert resident.proceed(d, f"file://{tmp_path}/b", half).params.where("phase = 'keep'").count() == 2 * 2 * 2


def test_fit_finds_the_signal(spark):
    d = frame(spark, 500)
    m = resident.fit(d, sampler.Control(trees=20, draws=20, burn=30, chains=1, cuts=30))
    fitted = {r["row_id"]: r["mean"] for r in m.fitted(d).collect()}
    y = {r["row_id"]: r["y"] for r in d.collect()}
    assert np.corrcoef([fitted[i] for i in y], [y[i] for i in y])[0, 1] > 0.9


@pytest.mark.parametrize(("binary", "method", "n_test"), [(False, "k-fold", 3), (True, "k-fold", 3), (False, "random subsample", 0.3)])
def test_cross_validation_as_in_tasks(spark, monkeypatch, binary, method, n_test):
    d = frame(spark, 120, binary=binary, weights=not binary)
    grid = {"n_trees": [3, 5], "k": [1.0, 3.0], "reps": 2, "method": method, "n_test": n_test, "control": sampler.Control(draws=4, burn=3, chains=1, cuts=20)}
    key = lambda r: (r["rep"], r["n_trees"], r["k"])
    want = sorted(validation.cross_validate(d, **grid).collect(), key=key)
    # in several waves, and taken where the block is too large to be broadcast
    monkeypatch.setattr(validation, "WAVE", 5)
    monkeypatch.setattr(validation, "MOST_MB", 0)
    got = sorted(validation.cross_validate(d, **grid).collect(), key=key)
    assert len(want) == 8 and [key(r) for r in got] == [key(r) for r in want]
    assert all(abs(a["loss"] - b["loss"]) < 1e-8 for a, b in zip(got, want, strict=True))


def grouped(spark, n=500, seed=8):
    """Half of the rows in one group, the others in many, of which one has no name."""
    d = frame(spark, n, seed)
    b = F.when(F.col("k") < n // 2, 0).otherwise(F.pmod(F.col("k"), F.lit(23)))
    d = d.withColumn("k", (F.col("row_id") + 50) / 7).withColumn("k", F.col("k").cast("int")).withColumn("b", b)
    d = d.withColumn("y", F.col("y") + 3 * F.sin(F.col("b") * 1.7)).withColumn("g", F.when(F.col("b") != 22, F.concat(F.lit("g"), F.col("b").cast("string"))))
    return d.drop("k", "b")


def values(m):
    return {tuple(r[c] for c in ("kind", "chain", "sample", "tree", "node", "var", "name")): r["value"] for r in m.table.collect()}


@pytest.mark.parametrize(("parts", "large", "block"), [(1, 1 << 18, 1 << 16), (6, 40, 60), (3, 1 << 18, 30)])
def test_group_intercepts_are_those_of_one_task(spark, monkeypatch, parts, large, block):
    """Groups whole in their blocks, and groups of more than LARGE rows in several."""
    d = grouped(spark)
    control = sampler.Control(trees=8, draws=4, burn=3, chains=2, thin=2, cuts=25, seed=3)
    want = values(sampler.fit(d, control, group=True))
    monkeypatch.setattr(resident, "LARGE", large)
    monkeypatch.setattr(resident, "BLOCK", block)
    got = values(resident.fit(d.repartition(parts), control, group=True, batch=5, every=4))
    assert got.keys() == want.keys() and sum(k[0] == "ranef" for k in want) == 2 * 4 * 23
    assert all(abs(v - got[k]) < 1e-8 for k, v in want.items())


def test_groups_stand_whole_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resident, "LARGE", 100)
    monkeypatch.setattr(resident, "BLOCK", 30)
    d = grouped(spark)
    p = sampler.prepare(d, CONTROL, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    b, large, many = resident.grouped_blocks(d, p)
    rows = b.collect()
    assert [g for g, _ in large] == ["g0"] and many == 23 and sum(r["n"] for r in rows) == 500
    ids = [i for r in rows for i in np.frombuffer(r["ids"], np.int64)]
    assert len(set(ids)) == 500
    names = [g for r in rows for g, k in zip(r["names"], np.frombuffer(r["large"], np.int32), strict=True) if k < 0]
    assert len(names) == len(set(names)) == 22 and "None" in names


def test_grouped_runs_go_on(spark, tmp_path):
    d = grouped(spark, 200)
    control = sampler.Control(trees=6, draws=4, burn=2, chains=1, cuts=20, seed=3)
    prior = lambda t: -t
    whole = resident.fit(d, control, group=True, tau_prior=prior)
    half = sampler.Control(trees=6, draws=2, burn=2, chains=1, cuts=20, seed=3)
    resident.fit(d, half, group=True, tau_prior=prior, path=f"file://{tmp_path}/a")
    with pytest.raises(ValueError, match="prior"):
        resident.proceed(d, f"file://{tmp_path}/a", control)
    a, b = values(whole), values(resident.proceed(d, f"file://{tmp_path}/a", control, tau_prior=prior))
    assert a.keys() == b.keys() and all(abs(v - b[k]) < 1e-8 for k, v in a.items())
    mean = {r["g"]: r["mean"] for r in whole.ranef_mean().collect()}
    assert len(mean) == 23 and all(map(np.isfinite, mean.values()))
    with pytest.raises(ValueError, match="binary"):
        resident.fit(frame(spark, 60, binary=True).withColumn("g", F.lit("a")), control, group=True)


def coarse(spark, n=400, seed=6, binary=False):
    """Few distinct predictors, among rows of different weights, some of them 0."""
    r = np.random.default_rng(seed)
    x = r.integers(0, [4, 3, 2], (n, 3)).astype(float)
    y = x @ [2.0, -1.0, 3.0] + (x[:, 0] > 1) * x[:, 2] * 4 + r.normal(size=n)
    rows = [(i * 3, float(y[i] > 4) if binary else float(y[i]), 1.0 if binary else float(r.integers(0, 4)), 0.5, [float(v) for v in x[i]], f"g{i % 7}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, y double, weight double, offset double, x array<double>, g string")


def test_rows_of_equal_codes_are_a_cell(spark):
    """Blocks hold no more lines than there are codes, and draws are those of the rows."""
    d = coarse(spark)
    p = sampler.prepare(d, CONTROL, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    b = resident.blocks(d.repartition(3), p).collect()
    assert sum(r["n"] for r in b) == 400 and sum(len(r["y"]) // 8 for r in b) == 24
    for got, want in zip(driven(d.repartition(3), CONTROL, p, 8, 5), by_kernel(d, CONTROL, p, 8), strict=True):
        same(got, want)


@pytest.mark.parametrize("binary", [False, True])
def test_fit_leaves_large_frames_where_they_are(spark, monkeypatch, binary):
    """What is too large for a task stays in its partitions, long before the most cells of a task."""
    d, used, fit = coarse(spark, 200, binary=binary), [], resident.fit
    control = sampler.Control(trees=4, draws=2, burn=2, chains=2, seed=3)
    want = values(sampler.fit(d, control))
    monkeypatch.setattr(sampler, "TASK_BYTES", 100_000)
    monkeypatch.setattr(resident, "fit", lambda *a, **k: used.append(1) or fit(*a, **k))
    got = values(sampler.fit(d, control))
    assert used and got.keys() == want.keys() and all(abs(v - got[k]) < 1e-8 for k, v in want.items())


def test_grids_of_middling_blocks_stay_in_partitions(spark, monkeypatch):
    """Blocks that could be broadcast are not, where they would fill tasks; rows of equal codes and folds are cells there."""
    d, used, resident_grid = coarse(spark, 600), [], validation.cross_validate_resident
    grid = {"n_trees": [3], "k": [1.0], "reps": 1, "n_test": 2, "control": sampler.Control(draws=2, burn=2, chains=1)}
    want = validation.cross_validate(d, **grid).first()["loss"]
    monkeypatch.setattr(validation, "TASK_MB", 0)
    monkeypatch.setattr(validation, "cross_validate_resident", lambda *a, **k: used.append(1) or resident_grid(*a, **k))
    got = validation.cross_validate(d, **grid).first()["loss"]
    assert used and abs(got - want) < 1e-8


@pytest.mark.parametrize("large", [1 << 18, 10])
def test_groups_of_cells(spark, monkeypatch, large):
    """Groups of more rows than stand in one block are whole where their cells fit one; intercepts are those of one task."""
    monkeypatch.setattr(resident, "LARGE", large)
    d = coarse(spark, 3000)
    control = sampler.Control(trees=5, draws=3, burn=2, chains=2, seed=3)
    p = sampler.prepare(d, control, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    b, found, many = resident.grouped_blocks(d, p)
    rows = b.collect()
    assert many == 7 and len(found) == (7 if large == 10 else 0) and sum(r["n"] for r in rows) == 3000
    # 24 codes, 7 groups
    assert sum(len(r["y"]) // 8 for r in rows) <= 24 * 7
    want, got = values(sampler.fit(d, control, group=True)), values(resident.fit(d, control, group=True))
    assert got.keys() == want.keys() and all(abs(v - got[k]) < 1e-8 for k, v in want.items())


@pytest.mark.parametrize("method, n_test, n", [("k-fold", 5, 1003), ("k-fold", 5, 3), ("random subsample", 0.3, 1003), ("random subsample", 0.01, 20), ("random subsample", 1.0, 20)])
def test_folds_are_dealt_where_rows_are(spark, monkeypatch, method, n_test, n):
    """Rows are neither sorted nor joined, and fall to folds as by their places; rows that repeat an id too, by their keys."""
    monkeypatch.setattr(validation, "RANGE", 40)
    ids = spark.range(0, n, 1, 3).selectExpr("id * 7 AS row_id", "id AS _key")
    got, rows = validation.dealt(ids, 2, method, n_test, 5)
    assert rows == n and not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Sort", "Exchange", "Window"))
    for rep in range(2):
        want = validation.folds(ids, n_test, rep, 5) if method == "k-fold" else validation.subsample(ids, n_test, rep, 5).selectExpr("row_id", "_key", "CAST(NOT test AS INT) AS fold")
        assert {tuple(r) for r in got.select("_key", f"fold{rep}").collect()} == {tuple(r) for r in want.select("_key", "fold").collect()}
        sizes = {r[f"fold{rep}"]: r["count"] for r in got.groupBy(f"fold{rep}").count().collect()}
        assert [sizes.get(i, 0) for i in range(len(validation.fold_sizes(n, method, n_test)))] == validation.fold_sizes(n, method, n_test)
    if method == "k-fold" and n > 5:
        again = validation.dealt(ids.withColumn("row_id", F.lit(1)), 1, method, n_test, 5)[0]
        assert {r["fold0"]: r["count"] for r in again.groupBy("fold0").count().collect()} == dict(enumerate(validation.fold_sizes(n, method, n_test)))


@pytest.mark.parametrize("method, n_test", [("k-fold", 5), ("random subsample", 0.3)])
def test_folds_hash_rows_once(spark, monkeypatch, method, n_test):
    """Hashes kept with the rows are not made again, neither to find folds nor to deal them, and leave with the folds known."""
    monkeypatch.setattr(validation, "RANGE", 40)
    ids = spark.range(0, 1003, 1, 3).selectExpr("id % 500 * 7 AS row_id", "id AS _key")
    kept = staged(validation.hashed(ids, 2, 5), "rows")
    monkeypatch.setattr(validation, "u01", None)
    got, rows = validation.dealt(kept, 2, method, n_test, 5)
    monkeypatch.undo()
    want, _ = validation.dealt(ids, 2, method, n_test, 5)
    assert rows == 1003 and got.columns == ["row_id", "_key", "fold0", "fold1"]
    assert "md5" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    for rep in range(2):
        whole = validation.folds(ids, n_test, rep, 5) if method == "k-fold" else validation.subsample(ids, n_test, rep, 5).selectExpr("_key", "CAST(NOT test AS INT) AS fold")
        # of rows that repeat an id either may stand first by its place
        assert {r["fold"]: r["count"] for r in whole.groupBy("fold").count().collect()} == {r[f"fold{rep}"]: r["count"] for r in got.groupBy(f"fold{rep}").count().collect()}
