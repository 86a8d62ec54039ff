"""Sufficient statistics, priors and likelihoods as column expressions; sums are combined before they shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesum.functions.scalar import chi2_quantile


def weighted_mean(y: Column, w: Column) -> Column:
    return F.sum(w * y) / F.sum(w)


def variance_about(y: Column, mean: Column, w: Column | None = None) -> Column:
    """Variance about a known mean, with n - 1 below the line; weighted squares with w."""
    r = (y - mean) * (y - mean)
    return F.sum(r if w is None else w * r) / (F.count(y) - 1)


def centre(frame: DataFrame) -> float:
    """The mean of y, about which sums are taken, so that squares do not cancel; one pass."""
    return frame.agg(F.avg("y")).first()[0] or 0.0


def leaf_stats(routed: DataFrame, *by: str, around: float | None = None) -> DataFrame:
    """routed(y, weight, by...) to n, w, mean and var per group; var divides the weighted squares by n - 1, 0 for one row.
    Sums are taken about `around`, the mean of all rows if not given."""
    around = centre(routed) if around is None else around
    w, y = F.col("weight"), F.col("y") - F.lit(around)
    g = routed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))
    ss = F.greatest(F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"), F.lit(0.0))
    return g.select(*by, "n", "w", (F.col("wy") / F.col("w") + F.lit(around)).alias("mean"), F.when(F.col("n") > 1, ss / (F.col("n") - 1)).otherwise(0.0).alias("var"))


def merged(stats: DataFrame, *by: str) -> DataFrame:
    """Statistics of parents from those of their children, without the rows: squares inside the children and squares of
    the children's means about the parent's."""
    m = F.sum(F.col("w") * F.col("mean")).over(Window.partitionBy(*by)) / F.sum("w").over(Window.partitionBy(*by))
    away = F.col("mean") - F.col("_m")
    g = stats.withColumn("_m", m).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("_m").alias("mean"), F.sum(F.col("var") * F.greatest(F.col("n") - 1, F.lit(0)) + F.col("w") * away * away).alias("ss"))
    return g.select(*by, "n", "w", "mean", F.when(F.col("n") > 1, F.col("ss") / (F.col("n") - 1)).otherwise(0.0).alias("var"))


def ssr(y: Column, fit: Column, w: Column | None = None) -> Column:
    r = (y - fit) * (y - fit)
    return F.sum(r if w is None else w * r)


def rescaled(frame: DataFrame) -> tuple[DataFrame, float, float]:
    """frame with y on [-0.5, 0.5] after the offset, and (minimum, range); the range of a constant is 1."""
    lo, hi = frame.agg(F.min(F.col("y") - F.col("offset")), F.max(F.col("y") - F.col("offset"))).first()
    span = (hi - lo) or 1.0
    return frame.withColumn("y", (F.col("y") - F.col("offset") - lo) / span - 0.5), lo, span


#: Predictors up to which least squares add cross products, as generated code; wider ones go by triangles.
WIDE = 32
#: Triangles that meet in a task; rows that join one at once.
MEET, ROWS = 8, 4096


def triangle(frame: DataFrame) -> tuple[np.ndarray, int]:
    """The triangular factor of sqrt(weight) (1, x, y - offset) over all rows of frame, and the number of rows. Tasks reduce
    their rows to a factor each; factors are merged up a tree, MEET at a time, and the last few on the driver."""

    def reduced(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.vstack(parts), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = None, 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                y, w, off = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                rows = np.sqrt(w)[:, None] * np.column_stack([np.ones(len(y)), x, y - off])
                n += len(y)
                r = reduced([rows] if r is None else [r, rows])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary()), pa.array([n])], names=["r", "n"])

    def matrix(b: bytes, k: int) -> np.ndarray:
        return np.frombuffer(b).reshape(-1, k)

    k = frame.select(F.size("x")).first()[0] + 2

    def meet(table: pa.Table) -> pa.Table:
        r = reduced([matrix(x, k) for x in table["r"].to_pylist()])
        return pa.table({"g": table["g"][:1], "r": pa.array([r.tobytes()], pa.binary()), "n": pa.array([sum(table["n"].to_pylist())])})

    d = frame.select(F.col("x").cast("array<double>"), *(F.col(c).cast("double") for c in ("y", "weight", "offset")))
    many = d.rdd.getNumPartitions()
    d = d.mapInArrow(run, "r binary, n long").select(F.spark_partition_id().cast("long").alias("g"), "r", "n")
    while many > MEET:
        many = -(-many // MEET)
        d = d.withColumn("g", F.expr(f"g div {MEET}")).groupBy("g").applyInArrow(meet, "g long, r binary, n long")
    last = d.select("r", "n").collect()
    return reduced([matrix(x["r"], k) for x in last]) if last else np.zeros((0, k)), sum(x["n"] for x in last)


def _sigma_of_triangle(frame: DataFrame) -> float:
    r, n = triangle(frame)
    if not n:
        return 0.0
    k = r.shape[1]
    r = np.vstack([r, np.zeros((max(0, k - len(r)), k))])
    # what follows the row of the intercept is the factor of the columns about their means
    a, b, rest = r[1:-1, 1:-1], r[1:-1, -1], r[-1, -1]
    scale = np.sqrt((a * a).sum(0))
    # of a constant column only rounding is left
    scale = np.where(scale > 1e-10 * np.hypot(scale, r[0, 1:-1]), scale, np.inf)
    u, s, _ = np.linalg.svd(a / scale)
    # near-singular directions do not count for the rank
    ok = s > 1e-5 * s.max(initial=0.0)
    left = b - u[:, ok] @ (u[:, ok].T @ b)
    return math.sqrt((rest * rest + left @ left) / max(1, n - 1 - int(ok.sum())))


def ols_sigma(frame: DataFrame) -> float:
    """Residual standard deviation of the least-squares fit of y - offset on x with an intercept; near-singular directions do
    not count for the rank. A few predictors: from a pass of means and one of cross products; many: from a triangular factor
    of the rows."""
    p = frame.select(F.size("x")).first()[0]
    if p > WIDE:
        return _sigma_of_triangle(frame)
    cells = [*(F.get(F.col("x"), F.lit(i)) for i in range(p)), F.col("y") - F.col("offset")]
    # about the means, so that squares do not cancel
    means = frame.agg(*[F.avg(c) for c in cells]).first()
    cells = [F.lit(1.0), *(c - F.lit(m or 0.0) for c, m in zip(cells, means, strict=True))]
    k = len(cells)
    names = [(i, j) for i in range(k) for j in range(i, k)]
    row = frame.agg(F.count(F.lit(1)), *[F.sum(F.col("weight") * cells[i] * cells[j]) for i, j in names]).first()
    g = np.zeros((k, k))
    for (i, j), v in zip(names, row[1:], strict=True):
        g[i, j] = g[j, i] = v
    a, b, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    e, v = np.linalg.eigh(a / np.outer(scale, scale))
    ok = e > 1e-10 * e.max()
    beta = (v[:, ok] / e[ok]) @ (v[:, ok].T @ (b / scale))
    return math.sqrt(max(yy - beta @ (b / scale), 0.0) / max(1, row[0] - int(ok.sum())))


def growth(depth: Column, base: float = 0.95, power: float = 2.0) -> Column:
    return F.lit(base) / F.pow(F.lit(1.0) + depth, F.lit(power))


def leaf_log_likelihood(n: Column, w: Column, mean: Column, var: Column, sigma2: float, a: float) -> Column:
    """Integrated over the leaf's mean, whose prior precision is a."""
    b = w / F.lit(sigma2)
    return 0.5 * F.log(F.lit(a) / (a + b)) - 0.5 * var * (n - 1) / F.lit(sigma2) - 0.5 * a * b * mean * mean / (a + b)


def leaf_posterior(w: Column, mean: Column, sigma2: float, a: float) -> tuple[Column, Column]:
    b = w / F.lit(sigma2)
    return b * mean / (a + b), F.sqrt(F.lit(1.0) / (a + b))


def split_scan(frame: DataFrame, var: int, cuts: list[float], sigma2: float, a: float) -> DataFrame:
    """(cut_idx, log_lik) of splitting all rows at each cut: one aggregation by bin, then running sums over the bins."""
    from treesum.operators.cuts import code

    around = centre(frame)
    w, y = F.col("weight"), F.col("y") - F.lit(around)
    bins = frame.groupBy(code(F.get(F.col("x"), F.lit(var)), cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))
    grid = frame.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bin")).join(bins, "bin", "left").na.fill(0)
    # one row per bin: at most the number of cuts + 1
    upto, every = Window.orderBy("bin"), Window.partitionBy()
    s = grid.select("bin", *[F.sum(c).over(upto).alias(c + "0") for c in ("n", "w", "wy", "wyy")], *[F.sum(c).over(every).alias(c) for c in ("n", "w", "wy", "wyy")]).where(F.col("bin") < len(cuts))

    def side(n: Column, w: Column, wy: Column, wyy: Column) -> Column:
        mean = wy / F.when(w > 0, w)
        var_ = F.when(n > 1, F.greatest(wyy - wy * mean, F.lit(0.0)) / F.when(n > 1, n - 1)).otherwise(0.0)
        return F.when(n > 0, leaf_log_likelihood(n, w, mean + F.lit(around), var_, sigma2, a)).otherwise(F.lit(-1e7))

    left = side(*[F.col(c + "0") for c in ("n", "w", "wy", "wyy")])
    right = side(*[F.col(c) - F.col(c + "0") for c in ("n", "w", "wy", "wyy")])
    return s.select(F.col("bin").alias("cut_idx"), (left + right).alias("log_lik"))


@dataclass(frozen=True)
class TreePrior:
    base: float = 0.95
    power: float = 2.0
    split_probs: tuple | None = None

    def __post_init__(self):
        if not 0 < self.base < 1 or self.power <= 0:
            raise ValueError("base must be in (0, 1) and power above 0")


@dataclass(frozen=True)
class NormalPrior:
    """Leaf means: sd = scale / (k sqrt(trees)); k fixed, or with a chi hyperprior (degrees, scale)."""

    k: float = 2.0
    chi: tuple[float, float] | None = None

    def __post_init__(self):
        if self.k <= 0:
            raise ValueError("k must be positive")


@dataclass(frozen=True)
class ChiSquaredPrior:
    """Residual variance: df * scale / chi-squared(df); scale puts `quantile` of the prior below the given sigma."""

    df: float = 3.0
    quantile: float = 0.9

    def __post_init__(self):
        if self.df <= 0 or not 0 < self.quantile < 1:
            raise ValueError("df must be positive and quantile in (0, 1)")

    def scale(self, sigma: float = 1.0) -> float:
        return chi2_quantile(1 - self.quantile, self.df) / self.df * sigma * sigma


@dataclass(frozen=True)
class FixedVariance:
    value: float = 1.0


def sigma_posterior(routed: DataFrame, df: float, scale: float) -> DataFrame:
    """(numerator, degrees) of the scaled inverse chi-squared of the residual variance, for routed(y, fit, weight)."""
    return routed.agg((F.lit(df * scale) + ssr(F.col("y"), F.col("fit"), F.col("weight"))).alias("numerator"), (F.lit(df) + F.count(F.lit(1))).alias("degrees"))


def k_posterior(leaves: DataFrame, trees: int, node_scale: float, df: float, scale: float, derived: bool = False) -> DataFrame:
    """(shape, rate) of the Gamma of k squared, for leaves(value): shape (leaves + 2 df - 1) / 2, or with derived
    (leaves + df) / 2, which is what a chi prior with df degrees gives."""
    more = df if derived else 2 * df - 1
    return leaves.agg(((F.count(F.lit(1)) + more) * 0.5).alias("shape"), ((F.sum(F.col("value") * F.col("value")) * (trees / node_scale**2) + 1.0 / scale**2) * 0.5).alias("rate"))


def group_posterior(frame: DataFrame, sigma: float, tau: float, weighted: bool = False) -> DataFrame:
    """(g, n, mean, variance) of each group's intercept for frame(g, residual[, weight])."""
    w = F.col("weight") if weighted else F.lit(1.0)
    s = frame.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), (F.sum(w * F.col("residual")) / F.sum(w)).alias("_m"))
    v = F.lit(1.0) / (F.col("_w") / sigma**2 + 1.0 / tau**2)
    return s.select("g", "n", (v * F.col("_w") / sigma**2 * F.col("_m")).alias("mean"), v.alias("variance"))


def tau_log_posterior(tau: Column, groups: int, squares: float, prior: str, scale: float) -> Column:
    """Up to a constant: -q ln tau - sum b^2 / (2 tau^2) + the log prior, cauchy(scale) or gamma(2.5, scale)."""
    like = -groups * F.log(tau) - F.lit(squares) / (tau * tau * 2)
    if prior == "cauchy":
        c = 2.5 * scale
        return like - F.log(F.lit(math.pi * c) * (tau * tau / c**2 + 1))
    if prior == "gamma":
        return like + F.log(tau) * 1.5 - tau / (2.5 * scale) - (math.lgamma(2.5) + 2.5 * math.log(2.5 * scale))
    raise ValueError(f"no prior {prior!r}")


def tree_log_prior(trees: DataFrame, cuts: dict[int, int], base: float = 0.95, power: float = 2.0, split_probs: list[float] | None = None) -> DataFrame:
    """(chain, sample, tree, log_prior) of trees whose values are cut indices, for variables with cuts[var] cuts each.
    A node's interval of a variable follows from its ancestors; a variable with no cut left is not available."""
    import pandas as pd

    from treesum.operators.forest import map_trees

    def run(g: pd.DataFrame) -> pd.DataFrame:
        total, spans = 0.0, {}
        for i, r in enumerate(g.itertuples()):
            own = {v: (0, n - 1) for v, n in cuts.items()}
            if r.parent >= 0:
                p = g.iloc[r.parent]
                own = dict(spans[r.parent])
                lo, hi = own[p["var"]]
                own[p["var"]] = (lo, int(p["value"]) - 1) if p["left"] == i else (int(p["value"]) + 1, hi)
            spans[i] = own
            open_ = [v for v, (lo, hi) in own.items() if lo <= hi]
            grow = base / (1 + r.depth) ** power if open_ else 0.0
            if r.var < 0:
                total += math.log(1 - grow)
            else:
                lo, hi = own[r.var]
                pick = 1 / len(open_) if split_probs is None else split_probs[r.var] / sum(split_probs[v] for v in open_)
                total += math.log(grow) + math.log(pick) - math.log(hi - lo + 1)
        return pd.DataFrame({"chain": [g["chain"][0]], "sample": [g["sample"][0]], "tree": [g["tree"][0]], "log_prior": [total]})

    return map_trees(trees, run, "chain int, sample int, tree int, log_prior double")
