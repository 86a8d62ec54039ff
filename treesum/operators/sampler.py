"""Fitting: chains as tasks, fitted forests as tables, and a session for forests inside larger samplers."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesum.functions.scalar import phi_column, u01
from treesum.operators import chains
from treesum.operators import cuts as cutting
from treesum.operators import forest, stats
from treesum.operators.kernel import Chain, Settings, group_ids, group_normals, update_jointly
from treesum.operators.slicing import slice_sample
from treesum.sources.staging import staged

VERSION = 1
#: A chain that needs all rows in one task holds rows x predictors of the block, in cells.
MOST_CELLS = 400_000_000
#: Bytes of rows that a task is given where it need not be; about what a row takes as it comes, beside its predictors and fits.
TASK_BYTES, ROW_BYTES = 512 << 20, 1000


@dataclass(frozen=True)
class Control:
    trees: int = 75
    draws: int = 500
    burn: int = 500
    chains: int = 4
    thin: int = 1
    cuts: int = 100
    quantile_cuts: bool = False
    keep_trees: bool = True
    seed: int = 1

    def __post_init__(self):
        for name in ("trees", "chains", "thin", "cuts"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.draws < 0 or self.burn < 0:
            raise ValueError("draws and burn must not be negative")


PRESETS = {"classic": Control(trees=200, draws=1000, burn=100, chains=1), "modern": Control(), "grouped": Control(draws=1500, burn=1500, thin=5)}


def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint16) if len(cuts) else np.zeros((len(x), 0), np.uint16)


def cut_points(x: np.ndarray, n: int, quantile: bool) -> np.ndarray:
    """The cuts of one column in memory, by the rules of cuts.uniform and cuts.quantile."""
    if not quantile:
        return np.linspace(x.min(), x.max(), n + 2)[1:-1]
    v = np.unique(x)
    if len(v) <= n + 1:
        return (v[:-1] + v[1:]) / 2
    step = len(v) // n
    at = np.minimum(np.arange(n) * step + step // 2, len(v) - 2)
    return (v[at] + v[at + 1]) / 2


_OUT = "kind string, chain int, sample int, tree int, node int, n long, var int, value double, name string"


@dataclass
class Prepared:
    """What all chains share: cuts, scale of the response, settings."""

    cuts: list[np.ndarray]
    lo: float
    span: float
    sigma: float
    settings: Settings
    binary: bool


def prepare(frame: DataFrame, control: Control, tree_prior: stats.TreePrior, leaf_prior: stats.NormalPrior, variance, hastings: str = "exact", binary: bool | None = None, preset: str = "modern") -> Prepared:
    from treesum.sources.design import is_binary

    binary = is_binary(frame) if binary is None else binary
    p = frame.select(F.size("x")).first()
    if p is None:
        raise ValueError("no complete rows to fit")
    p = p[0]
    wide = frame.select(*[F.get(F.col("x"), F.lit(i)).alias(f"x{i}") for i in range(p)])
    table = (cutting.quantile if control.quantile_cuts else cutting.uniform)(wide, wide.columns, control.cuts)
    of = cutting.ragged(table)
    cut = [np.array(of.get(i, []), float) for i in range(p)]
    lo, span = -0.5, 1.0
    sigma = 1.0
    if not binary:
        _, lo, span = stats.rescaled(frame)
        # rounded, so that the order of sums in partitions does not reach the draws
        sigma = float(f"{max(stats.ols_sigma(frame), 1e-10):.8g}") / span
    s = Settings(
        trees=control.trees, base=tree_prior.base, power=tree_prior.power, split_probs=None if tree_prior.split_probs is None else np.array(tree_prior.split_probs),
        k=leaf_prior.k, k_chi=leaf_prior.chi or ((1.25, math.inf) if binary and preset == "modern" and leaf_prior == stats.NormalPrior() else None), node_scale=3.0 if binary else 0.5, binary=binary, hastings=hastings, prior_trees=preset == "modern",
        fixed_sigma=isinstance(variance, stats.FixedVariance), df=getattr(variance, "df", 3.0), scale=variance.scale(sigma) if isinstance(variance, stats.ChiSquaredPrior) else 0.0,
    )
    if isinstance(variance, stats.FixedVariance):
        sigma = math.sqrt(variance.value) / span
    return Prepared(cut, lo, span, sigma, s, binary)


def tau_density(prior: str | Callable, scale: float) -> Callable:
    """Log density of the spread of group intercepts, on the scale of the trees; scale: that of the response there."""
    return prior if callable(prior) else {"cauchy": lambda t: -math.log1p((t / (2.5 * scale)) ** 2), "gamma": lambda t: 1.5 * math.log(t) - t / (2.5 * scale)}[prior]


def draw_tau(tau: float, groups: int, squares: float, prior: Callable, r: np.random.Generator) -> float:
    """The spread of group intercepts, from their number and sum of squares."""
    return slice_sample(lambda t: -math.inf if t <= 0 else -groups * math.log(t) - squares / (2 * t * t) + prior(t), tau, r)


def run_chain(g: pd.DataFrame, chain: int, control: Control, p: Prepared, tau_scale: float | None = None, tau_prior: str | Callable = "cauchy", callback: Callable | None = None) -> pd.DataFrame:
    """All draws of one chain over the rows of g(row_id, y, weight, offset, x[, g]); with tau_scale, group intercepts too."""
    g = g.sort_values("row_id")
    x, y0, w, off = np.array(g["x"].tolist(), float), g["y"].to_numpy(float), g["weight"].to_numpy(float), g["offset"].to_numpy(float)
    grouped = tau_scale is not None
    y = y0 if p.binary else (y0 - off - p.lo) / p.span - 0.5
    c = Chain(bins(x, p.cuts), np.array([len(k) for k in p.cuts]), y, w, p.settings, p.sigma, control.seed, chain, off if p.binary else None, g["row_id"].to_numpy(np.int64))
    out: list[tuple] = []
    if grouped:
        levels, code = np.unique(g["g"].astype(str).to_numpy(), return_inverse=True)
        tau, counts = tau_scale / 5, np.bincount(code)
        scale = tau_scale / (1 if p.binary else p.span)
        tau = tau / (1 if p.binary else p.span)
        prior, keys = tau_density(tau_prior, scale), group_ids(list(levels))
    for it in range(control.burn + control.draws * control.thin):
        if grouped:
            z = (c.z if p.binary else y) - (off if p.binary else 0)
            s2 = c.sigma**2
            v = 1 / (counts / s2 + 1 / tau**2)
            m = v / s2 * np.bincount(code, z - c.total)
            b = m + np.sqrt(v) * group_normals((c.seed, c.chain, c.sweeps + 1), keys)
            if p.binary:
                c.offset = off + b[code]
            else:
                c.y = c.z = y - b[code]
        c.sweep()
        if grouped:
            tau = draw_tau(tau, len(b), float(b @ b), prior, c.r)
        kept = it - control.burn
        k = kept // control.thin
        if kept < 0 or (kept + 1) % control.thin == 0:
            phase, at = ("burn", it) if kept < 0 else ("keep", k)
            out += [(phase, chain, at, None, None, None, None, c.sigma * p.span if not p.binary else 1.0, "sigma"), (phase, chain, at, None, None, None, None, c.k, "k")]
            if grouped:
                out.append((phase, chain, at, None, None, None, None, tau * (1 if p.binary else p.span), "tau"))
            if kept >= 0:
                if control.keep_trees:
                    out += [("tree", chain, k, *row, None) for row in c.trees(p.cuts)]
                if grouped:
                    out += [("ranef", chain, k, None, None, None, None, float(u) * (1 if p.binary else p.span), str(n)) for n, u in zip(levels, b, strict=True)]
                if callback is not None:
                    fits = c.total if p.binary else p.lo + p.span * (c.total + 0.5) + off
                    out += [("callback", chain, k, None, None, None, None, float(u), str(n)) for n, u in callback(fits, b if grouped else None, c.sigma * p.span, tau if grouped else None).items()]
    return pd.DataFrame(out, columns=[f.split()[0] for f in _OUT.split(", ")])


@dataclass
class Model:
    """A fitted forest: tables plus the scale of the response."""

    table: DataFrame
    lo: float
    span: float
    binary: bool
    control: Control
    train: DataFrame | None = None
    test: DataFrame | None = None

    @property
    def trees(self) -> DataFrame:
        return self.table.where("kind = 'tree'").select(*[f.split()[0] for f in forest.SCHEMA.split(", ")])

    @property
    def params(self) -> DataFrame:
        """(chain, phase, sample, name, value) of sigma, k and tau."""
        return self.table.where("kind in ('burn', 'keep')").select("chain", F.col("kind").alias("phase"), "sample", "name", "value")

    @property
    def ranef(self) -> DataFrame:
        return self.table.where("kind = 'ranef'").select("chain", "sample", F.col("name").alias("g"), "value")

    @property
    def callbacks(self) -> DataFrame:
        return self.table.where("kind = 'callback'").select("chain", "sample", "name", "value")

    def ranef_mean(self) -> DataFrame:
        """(g, mean) of the group intercepts over all draws."""
        return self.ranef.groupBy("g").agg(F.avg("value").alias("mean"))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """(g): groups of rows that the model was not fitted with, and for which predict draws intercepts."""
        return rows.select(F.col("g").cast("string").alias("g")).distinct().join(self.ranef.select("g").distinct(), "g", "left_anti")

    def varcount(self) -> DataFrame:
        return forest.variable_counts(self.trees)

    def predict(self, rows: DataFrame, type: str = "ev") -> DataFrame:
        """rows(row_id, x, offset[, weight, g]) to (row_id, chain, sample, value). ev: mean of the response; link: scale of
        the trees with offset; ppd: a draw of the response. Groups not seen in training get a draw of their own."""
        type = {"response": "ev"}.get(type, type)
        if type not in ("ev", "link", "ppd"):
            raise ValueError(f"no prediction of type {type!r}")
        d = forest.predict(self.trees, rows, self.lo, self.span)
        if "g" in rows.columns:
            d = self._with_groups(d, rows)
        if type == "link":
            return d
        if self.binary:
            d = d.withColumn("value", phi_column(F.col("value")))
            if type == "ppd":
                d = d.withColumn("value", (u01(F.lit(self.control.seed), F.col("chain"), F.col("sample"), F.col("row_id")) < F.col("value")).cast("double"))
            return d
        return self._noise(d, rows) if type == "ppd" else d

    def _with_groups(self, d: DataFrame, rows: DataFrame) -> DataFrame:
        d = d.join(rows.select("row_id", F.col("g").cast("string").alias("g")), "row_id")
        tau = self.params.where("phase = 'keep' and name = 'tau'").select("chain", "sample", F.col("value").alias("tau"))
        # one number per draw; and per draw and group seen
        d = d.join(self.ranef.withColumnRenamed("value", "_b"), ["chain", "sample", "g"], "left").join(F.broadcast(tau), ["chain", "sample"])
        return d.select("row_id", "chain", "sample", (F.col("value") + F.coalesce("_b", F.col("tau") * _normal(F.lit(self.control.seed), F.lit("g"), F.col("chain"), F.col("sample"), F.col("g")))).alias("value"))

    def _noise(self, d: DataFrame, rows: DataFrame) -> DataFrame:
        sigma = self.params.where("phase = 'keep' and name = 'sigma'").select("chain", "sample", F.col("value").alias("sigma"))
        d = d.join(F.broadcast(sigma), ["chain", "sample"])
        w = F.lit(1.0)
        if "weight" in rows.columns:
            d, w = d.join(rows.select("row_id", "weight"), "row_id"), F.col("weight")
        z = _normal(F.lit(self.control.seed), F.lit("y"), F.col("chain"), F.col("sample"), F.col("row_id"))
        return d.select("row_id", "chain", "sample", (F.col("value") + F.col("sigma") / F.sqrt(w) * z).alias("value"))

    def extract(self, type: str = "ev", sample: str = "train", combine: bool = True) -> DataFrame:
        """Draws of the rows the model was fitted with, or of its test rows: ev, link (also bart) or ppd as in predict, or
        the trees. combine numbers draws over all chains (row_id, draw, value); else (row_id, chain, sample, value)."""
        type = {"response": "ev", "bart": "link"}.get(type, type)
        if type == "trees":
            if not self.control.keep_trees:
                raise ValueError("trees were not kept")
            return self.trees
        if sample not in ("train", "test"):
            raise ValueError("sample must be 'train' or 'test'")
        rows = self.train if sample == "train" else self.test
        if rows is None:
            raise ValueError(f"the model has no {sample} rows; use predict")
        d = self.predict(rows, type)
        return chains.combine(d, self.control.draws) if combine else d

    def summary(self, rows: DataFrame, quantiles: tuple = (0.05, 0.5, 0.95)) -> DataFrame:
        """(row_id, mean, quantiles) without keeping draws."""
        return forest.predict_summary(self.trees, rows, self.lo, self.span, quantiles, self.binary)

    def fitted(self, rows: DataFrame | None = None) -> DataFrame:
        """(row_id, mean) of the response; of the training rows, if none are given."""
        rows = self.train if rows is None else rows
        if "g" in rows.columns:
            return self.predict(rows).groupBy("row_id").agg(F.avg("value").alias("mean"))
        return self.summary(rows).select("row_id", "mean")

    def residuals(self, frame: DataFrame | None = None) -> DataFrame:
        frame = self.train if frame is None else frame
        return frame.select("row_id", "y").join(self.fitted(frame), "row_id").select("row_id", (F.col("y") - F.col("mean")).alias("residual"))

    def save(self, path: str) -> None:
        self.table.write.parquet(f"{path}/table")
        meta = {"version": VERSION, "lo": self.lo, "span": self.span, "binary": self.binary, "control": asdict(self.control)}
        self.table.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["version"] != VERSION:
            raise ValueError(f"a model of version {meta['version']}; {VERSION} is read")
        return Model(spark.read.parquet(f"{path}/table"), meta["lo"], meta["span"], meta["binary"], Control(**meta["control"]))

    def describe(self) -> str:
        c = self.control
        lines = [f"{'probit' if self.binary else 'continuous'} sum of {c.trees} trees, {c.chains} chains of {c.draws} draws after {c.burn}, thinned by {c.thin}", f"cuts: {c.cuts} {'quantiles' if c.quantile_cuts else 'evenly spaced'}, seed {c.seed}"]
        means = self.params.where("phase = 'keep'").groupBy("name").agg(F.avg("value").alias("m")).orderBy("name").collect()
        return "\n".join([*lines, "posterior means: " + ", ".join(f"{r['name']} {r['m']:.4g}" for r in means)] if means else lines)


def _normal(*parts) -> F.Column:
    """A standard normal by Box and Muller from keyed uniforms."""
    a, b = u01(*parts, F.lit("a")), u01(*parts, F.lit("b"))
    return F.sqrt(F.log(F.lit(1.0) - a) * -2) * F.cos(b * (2 * math.pi))


def fit(frame: DataFrame, control: Control = PRESETS["modern"], tree_prior: stats.TreePrior = stats.TreePrior(), leaf_prior: stats.NormalPrior = stats.NormalPrior(), variance=stats.ChiSquaredPrior(), group: bool = False, tau_prior: str | Callable = "cauchy", callback: Callable | None = None, preset: str = "modern", hastings: str = "exact", test: DataFrame | None = None, shards: int | None = None) -> Model:
    """frame(row_id, y, weight, offset, x[, g]). Each chain is one task, which the frame's rows reach by shuffle and not by
    the driver. More rows than TASK_BYTES stay in their partitions (resident.fit: the same draws). Where a
    number of shards is given, rows are dealt to them by a hash of row_id instead, each chain is fitted
    to each shard, and a draw is the average of the shards' draws: the sum of all their trees with means divided by the
    number of shards, and the root of the mean of their squared sigmas. That is a consensus of subset posteriors, not the
    posterior of all rows; callbacks, and group intercepts of a binary response, need one task for all rows."""
    p = prepare(frame, control, tree_prior, leaf_prior, variance, hastings, preset=preset)
    n = frame.count()
    cells = n * max(1, len(p.cuts))
    size = n * (ROW_BYTES + 8 * control.trees + 32 * len(p.cuts))
    if shards is None and (size > TASK_BYTES or cells > MOST_CELLS) and not (group and p.binary) and callback is None:
        from treesum.operators import resident

        return resident.fit(frame, control, tree_prior, leaf_prior, variance, preset, hastings, test, group=group, tau_prior=tau_prior)
    shards = 1 if shards is None else shards
    if cells > shards * MOST_CELLS:
        raise ValueError(f"{n} rows of {len(p.cuts)} predictors do not fit the tasks of {shards} shards; {-(-cells // MOST_CELLS)} are needed")
    if shards > 1 and (group or callback is not None):
        raise ValueError("group intercepts and callbacks need all rows in one shard")
    scale = None
    if group:
        scale = spread_of(frame, p)
    # as many copies of the rows as chains, which is stated
    both = frame.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(control.chains - 1))))
    both = both.withColumn("shard", F.pmod(F.xxhash64(F.lit(control.seed), "row_id"), F.lit(shards)).cast("int"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        # chains of further shards have streams of their own
        out = run_chain(g, int(key[0]) + int(key[1]) * control.chains, control, p, scale, tau_prior, callback)
        return out.assign(chain=int(key[0]), shard=int(key[1]))

    table = staged(both.groupBy("chain", "shard").applyInPandas(run, _OUT + ", shard int"), "fit")
    return Model(_consensus(table, control.trees), p.lo, p.span, p.binary, control, frame, test)


def spread_of(frame: DataFrame, p: Prepared) -> float:
    """The scale that the prior of tau goes by: rounded, so that the order of sums does not reach the draws."""
    return 0.5 if p.binary else float(f"{frame.agg(F.stddev_samp('y')).first()[0] or 1.0:.8g}")


def _consensus(table: DataFrame, trees: int) -> DataFrame:
    """One forest of those of all shards."""
    shards = table.select(F.max("shard")).first()[0]
    names = [f.split()[0] for f in _OUT.split(", ")]
    if not shards:
        return table.select(*names)
    tree = table.where("kind = 'tree'").withColumns({"tree": F.col("shard") * trees + F.col("tree"), "value": F.when(F.col("var") < 0, F.col("value") / (shards + 1)).otherwise(F.col("value"))})
    rest = table.where("kind <> 'tree'").groupBy("kind", "chain", "sample", "name").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))
    return tree.select(*names).unionByName(rest, allowMissingColumns=True).select(*names)


class Session:
    """A chain that a larger sampler steps, with the data it conditions on replaced in between. State is on the driver: one
    block of rows of checked size."""

    def __init__(self, frame: DataFrame, control: Control = Control(chains=1), chain: int = 0, test: DataFrame | None = None, **priors):
        self.control = control
        self.priors = {"tree_prior": stats.TreePrior(), "leaf_prior": stats.NormalPrior(), "variance": stats.ChiSquaredPrior()} | priors
        self.p = prepare(frame, control, **self.priors)
        self._read(frame)
        self._read_test(test)
        self.chain = Chain(bins(self.x, self.p.cuts), np.array([len(c) for c in self.p.cuts]), self._scaled(), self.weight, self.p.settings, self.p.sigma, control.seed, chain, self.offset if self.p.binary else None)

    def _gathered(self, frame: DataFrame) -> pd.DataFrame:
        n = frame.count()
        if n * max(1, len(self.p.cuts)) > MOST_CELLS // 10:
            raise ValueError(f"a session of {n} rows is too large for the driver")
        return frame.toPandas().sort_values("row_id")

    def _read(self, frame: DataFrame) -> None:
        g = self._gathered(frame)
        self.x, self.row_id = np.array(g["x"].tolist(), float).reshape(len(g), -1), g["row_id"].to_numpy()
        self.y, self.weight, self.offset = (g[c].to_numpy(float) for c in ("y", "weight", "offset"))

    def _read_test(self, test: DataFrame | None) -> None:
        self.test_x = self.test_id = self.test_offset = None
        if test is not None:
            g = self._gathered(test)
            self.test_id = g["row_id"].to_numpy()
            self.set_test_predictor(np.array(g["x"].tolist(), float).reshape(len(g), -1))
            self.set_test_offset(g["offset"].to_numpy(float) if "offset" in g else 0.0)

    def _scaled(self) -> np.ndarray:
        return self.y if self.p.binary else (self.y - self.offset - self.p.lo) / self.p.span - 0.5

    def run(self, burn: int = 0, draws: int = 1, callback: Callable | None = None) -> dict[str, np.ndarray] | None:
        """Arrays over draws: train, sigma, k, varcount, test where there is a test set, and what the callback
        f(train fits, test fits or None, sigma, k) gives."""
        out = []
        for i in range(burn + draws * self.control.thin):
            self.chain.sweep()
            if i >= burn and (i - burn + 1) % self.control.thin == 0:
                one = {"train": self.fits(), "sigma": self.sigma(), "k": self.chain.k, "varcount": self.chain.counts()}
                if self.test_x is not None:
                    one["test"] = self.test_fits()
                if callback is not None:
                    one["callback"] = callback(one["train"], one.get("test"), one["sigma"], one["k"])
                out.append(one)
        if not out:
            return None
        return {k: np.stack([np.asarray(o[k]) for o in out]) for k in out[0]}

    def fits(self) -> np.ndarray:
        return self.chain.total + self.offset if self.p.binary else self.p.lo + self.p.span * (self.chain.total + 0.5) + self.offset

    def test_fits(self) -> np.ndarray:
        """The trees as they are, over the test set."""
        if self.test_x is None:
            raise ValueError("there is no test set")
        t = self.chain.score(bins(self.test_x, self.p.cuts))
        return t + self.test_offset if self.p.binary else self.p.lo + self.p.span * (t + 0.5) + self.test_offset

    def sigma(self) -> float:
        return 1.0 if self.p.binary else self.chain.sigma * self.p.span

    def ssr(self) -> float:
        """Weighted, on the scale of the response."""
        e = (self.chain.z - self.chain.total) if not self.p.binary else self.chain.z - self.offset - self.chain.total
        return float(self.chain.w @ (e * e)) * (1.0 if self.p.binary else self.p.span**2)

    def latents(self) -> np.ndarray:
        if not self.p.binary:
            raise ValueError("a continuous response has no latents")
        return self.chain.z.copy()

    def _rescale(self) -> None:
        """The scale follows the response; sigma, the estimate and prior of it, and the fits keep their meaning."""
        t = self.y - self.offset
        lo, span = t.min(), (t.max() - t.min()) or 1.0
        ratio = self.p.span / span
        shift = (self.p.lo + 0.5 * self.p.span - lo - 0.5 * span) / span / self.control.trees
        self.p = replace(self.p, lo=lo, span=span, sigma=self.p.sigma * ratio)
        self.chain.s.scale *= ratio**2
        self.chain.sigma *= ratio
        for root in self.chain.roots:
            from treesum.operators.kernel import walk

            for x in walk(root):
                x.mean = x.mean * ratio + (shift if x.leaf else 0.0)
        self.chain.refresh()

    def set_response(self, y: np.ndarray) -> None:
        self.y = np.asarray(y, float)
        if self.p.binary:
            self.chain.y = self.y
            self.chain.draw_latents()
            return
        self._rescale()
        self.chain.y = self.chain.z = self._scaled()

    def set_offset(self, offset: np.ndarray | float, update_scale: bool = False) -> None:
        self.offset = np.broadcast_to(np.asarray(offset, float), self.y.shape).copy()
        if self.p.binary:
            self.chain.offset = self.offset
            return
        if update_scale:
            self._rescale()
        self.chain.y = self.chain.z = self._scaled()

    def set_weights(self, w: np.ndarray) -> None:
        w = np.asarray(w, float)
        if (w < 0).any():
            raise ValueError("weights must not be negative")
        self.weight = self.chain.w = w
        self.chain.weighted = bool((w != 1).any())

    def set_sigma(self, sigma: float) -> None:
        self.chain.sigma = sigma / self.p.span

    def set_k(self, k: float) -> None:
        self.chain.k = k

    def set_predictor(self, x: np.ndarray, column: int | None = None, mode: str = "reject", recut: bool = False) -> bool | np.ndarray:
        """mode force: splits that lose all rows on a side go; reject: all or nothing; partial: row by row, which rows took."""
        new = np.asarray(x, float) if column is None else self.x.copy()
        if column is not None:
            new[:, column] = x
        old_cuts = self.p.cuts
        if recut:
            cuts = [cut_points(c, self.control.cuts, self.control.quantile_cuts) for c in new.T]
            for a, b in zip(old_cuts, cuts, strict=True):
                cutting.check_recut(len(a), len(b))
            self.p = replace(self.p, cuts=cuts)
        b = bins(new, self.p.cuts)
        if mode == "partial":
            took = self.chain.update_rows(b)
            self.x = np.where(took[:, None], new, self.x)
            return took
        ok = self.chain.set_bins(b, force=mode == "force")
        if ok:
            self.x = new
        else:
            self.p = replace(self.p, cuts=old_cuts)
        return ok

    def set_cuts(self, cuts: list[float], column: int) -> None:
        """Other cuts of one predictor: rules go to the nearest within what their ancestors leave, then splits with an empty
        side go."""
        own = list(self.p.cuts)
        if not 1 <= len(cuts) <= cutting.MOST_CUTS:
            raise ValueError(f"between 1 and {cutting.MOST_CUTS} cuts")
        own[column] = np.sort(np.asarray(cuts, float))
        old = self.p.cuts
        self.p = replace(self.p, cuts=own)
        self.chain.map_cuts(old, own)
        self.chain.set_bins(bins(self.x, own), force=True)

    def set_data(self, frame: DataFrame, test: DataFrame | None = None) -> None:
        """Other rows, with as many predictors, under the trees as they are: cuts are made anew and rules go to the nearest,
        splits with an empty side go, and means follow the scale of the new response. sigma and k stay."""
        p = prepare(frame, self.control, **self.priors, binary=self.p.binary)
        if len(p.cuts) != len(self.p.cuts):
            raise ValueError(f"{len(self.p.cuts)} predictors wanted, {len(p.cuts)} given")
        old = self.p.cuts
        self.p = replace(self.p, cuts=p.cuts)
        self._read(frame)
        self._read_test(test)
        self.chain.map_cuts(old, p.cuts)
        self.chain.replace_rows(bins(self.x, p.cuts), self._scaled(), self.weight, self.offset if self.p.binary else None)
        if self.p.binary:
            self.chain.draw_latents()
        else:
            self._rescale()
            self.chain.y = self.chain.z = self._scaled()

    def set_trees(self, trees: pd.DataFrame | list) -> None:
        """Trees from a table (tree, node, var, value) or a list of (variable, cut or mean) in pre-order."""
        if isinstance(trees, pd.DataFrame):
            trees = [list(zip(g["var"], g["value"], strict=True)) for _, g in trees.sort_values(["tree", "node"]).groupby("tree")]
        self.chain.install(trees, self.p.cuts)
        self.control = replace(self.control, trees=len(trees))

    def set_control(self, control: Control) -> None:
        """Number of trees (surplus ones go, new ones are single leaves), thinning and seed of what follows; cuts stay."""
        if control.trees != self.control.trees:
            self.chain.resize(control.trees)
        if control.seed != self.control.seed:
            self.chain.reseed(control.seed)
        self.control = replace(control, cuts=self.control.cuts, quantile_cuts=self.control.quantile_cuts, chains=1)

    def set_model(self, tree_prior: stats.TreePrior | None = None, leaf_prior: stats.NormalPrior | None = None, variance=None) -> None:
        """Other priors for what follows; a fixed variance and a fixed k take effect at once."""
        given = {"tree_prior": tree_prior, "leaf_prior": leaf_prior, "variance": variance}
        self.priors |= {k: v for k, v in given.items() if v is not None}
        s = self.chain.s
        if tree_prior is not None:
            s.base, s.power = tree_prior.base, tree_prior.power
            s.split_probs = None if tree_prior.split_probs is None else np.array(tree_prior.split_probs)
        if leaf_prior is not None:
            s.k_chi = leaf_prior.chi
            if leaf_prior.chi is None:
                s.k = self.chain.k = leaf_prior.k
        if variance is not None and not self.p.binary:
            s.fixed_sigma = isinstance(variance, stats.FixedVariance)
            if s.fixed_sigma:
                self.set_sigma(math.sqrt(variance.value))
            else:
                s.df, s.scale = variance.df, variance.scale(self.p.sigma)

    def set_test_predictor(self, x: np.ndarray | None, column: int | None = None) -> None:
        """The whole test set (None: none), or one column of it."""
        if column is None:
            if x is not None and np.asarray(x).shape[1] != self.x.shape[1]:
                raise ValueError(f"{self.x.shape[1]} predictors wanted, {np.asarray(x).shape[1]} given")
            self.test_x = None if x is None else np.asarray(x, float)
            if x is not None and (self.test_offset is None or len(self.test_offset) != len(self.test_x)):
                self.test_offset = np.zeros(len(self.test_x))
            return
        if self.test_x is None:
            raise ValueError("there is no test set")
        self.test_x = self.test_x.copy()
        self.test_x[:, column] = x

    def set_test_offset(self, offset: np.ndarray | float) -> None:
        if self.test_x is None:
            raise ValueError("there is no test set")
        self.test_offset = np.broadcast_to(np.asarray(offset, float), (len(self.test_x),)).copy()

    def set_test_predictor_and_offset(self, x: np.ndarray, offset: np.ndarray | float) -> None:
        self.set_test_predictor(x)
        self.set_test_offset(offset)

    def sample_trees_from_prior(self) -> None:
        self.chain.draw_trees_from_prior()

    def sample_means_from_prior(self) -> None:
        self.chain.draw_means_from_prior()

    def trees(self) -> pd.DataFrame:
        return pd.DataFrame([(0, 0, *r) for r in self.chain.trees(self.p.cuts)], columns=[f.split()[0] for f in forest.SCHEMA.split(", ")])

    def predict(self, x: np.ndarray, offset: np.ndarray | float = 0.0) -> np.ndarray:
        f = forest.Packed(self.trees())
        s = sum(f.value[f.leaves(np.asarray(x, float), k)] for k in range(len(f.start)))
        return s + offset if self.p.binary else self.p.lo + self.p.span * (s + 0.5) + offset

    def store(self) -> bytes:
        import pickle

        return pickle.dumps((VERSION, self.__dict__))

    @staticmethod
    def restore(state: bytes) -> Session:
        import pickle

        version, fields = pickle.loads(state)
        if version != VERSION:
            raise ValueError(f"state of version {version}; {VERSION} is read")
        s = Session.__new__(Session)
        s.__dict__.update(fields)
        return s

    def copy(self) -> Session:
        return Session.restore(self.store())


def update_predictor_jointly(sessions: list[Session], x: np.ndarray, columns: list[int]) -> np.ndarray:
    """One predictor shared by several sessions, at columns[i] of each: rows change in all of them or in none."""
    new = []
    for s, c in zip(sessions, columns, strict=True):
        v = s.x.copy()
        v[:, c] = x
        new.append(v)
    took = update_jointly([s.chain for s in sessions], [bins(v, s.p.cuts) for s, v in zip(sessions, new, strict=True)])
    for s, v in zip(sessions, new, strict=True):
        s.x = np.where(took[:, None], v, s.x)
    return took
