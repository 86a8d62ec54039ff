"""Cross validation: folds by keyed hash, losses as two-level aggregates, and a grid of fits as tasks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from hashlib import blake2b, md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treesum.functions.scalar import phi, phi_column, u01
from treesum.operators import stats
from treesum.operators.kernel import Chain
from treesum.operators.sampler import Control, Prepared, bins, prepare
from treesum.sources.staging import staged

#: A block that must be broadcast, one that is where it need not be, and rows of a hash range.
MOST_MB, TASK_MB, RANGE = 256, 32, 200_000


def places(row_id: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """The order of _ranked, in numpy: which row stands first, second, ..."""
    u = np.array([int(md5(f"{seed}|{rep}|{i}".encode()).hexdigest()[:8], 16) for i in row_id.tolist()], np.int64)
    return np.lexsort((row_id, u))


def stream(*key: int) -> int:
    """A number for the random stream of a task, of its own for each key."""
    return int.from_bytes(blake2b("|".join(map(str, key)).encode(), digest_size=8).digest(), "little")


def grid(spark, trees: list, ks: list, powers: list, bases: list, reps: int) -> DataFrame:
    """(cell, rep, n_trees, k, power, base): base changes fastest."""
    d = spark.range(1)
    for name, values, kind in (("n_trees", trees, "int"), ("k", ks, "double"), ("power", powers, "double"), ("base", bases, "double")):
        d = d.select("*", F.posexplode(F.array(*[F.lit(v).cast(kind) for v in values])).alias(f"_{name}", name))
    cell = ((F.col("_n_trees") * len(ks) + F.col("_k")) * len(powers) + F.col("_power")) * len(bases) + F.col("_base")
    return d.select(cell.alias("cell"), "n_trees", "k", "power", "base").select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))


def _ranked(rows: DataFrame, rep: int, seed: int) -> DataFrame:
    """rows(row_id) with place (from 0) in the order of a keyed hash and n: places are counted in hash ranges of about
    RANGE rows, so that no task sorts all rows."""
    parts = max(8, -(-rows.count() // RANGE))
    h = rows.withColumn("_u", u01(F.lit(seed), F.lit(rep), F.col("row_id"))).withColumn("_part", F.floor(F.col("_u") * parts).cast("int"))
    per = h.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    # `parts` rows
    per = per.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_total"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_u", "row_id")) - 1
    return h.withColumn("_i", inside).join(F.broadcast(per), "_part").withColumn("place", F.col("_before") + F.col("_i")).withColumn("n", F.col("_total")).drop("_u", "_part", "_i", "_before", "_total")


def folds(rows: DataFrame, k: int, rep: int = 0, seed: int = 1) -> DataFrame:
    """rows with fold: k contiguous stretches of the hashed order, the first n mod k one row longer."""
    r = _ranked(rows, rep, seed)
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    long = more * (size + 1)
    return r.withColumn("fold", F.when(F.col("place") < long, F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - long) / F.greatest(size, F.lit(1)))).cast("int")).drop("place", "n")


def subsample(rows: DataFrame, share: float, rep: int = 0, seed: int = 1) -> DataFrame:
    """rows with test: the first floor(n * share + .5) of the hashed order."""
    r = _ranked(rows, rep, seed)
    return r.withColumn("test", F.col("place") < F.floor(F.col("n") * share + 0.5)).drop("place", "n")


def rmse(draws: DataFrame) -> DataFrame:
    """draws(row_id, y, weight, value) to loss, of posterior means."""
    m = draws.groupBy("row_id").agg(F.first("y").alias("y"), F.first("weight").alias("w"), F.avg("value").alias("m"))
    return m.agg(F.sqrt(F.sum(F.col("w") * (F.col("y") - F.col("m")) ** 2) / F.sum("w")).alias("loss"))


def _mean_probability(draws: DataFrame) -> DataFrame:
    return draws.groupBy("row_id").agg(F.first("y").alias("y"), F.first("weight").alias("w"), F.avg(phi_column(F.col("value"))).alias("p"))


def log_loss(draws: DataFrame) -> DataFrame:
    m = _mean_probability(draws)
    return m.agg((-F.sum(F.col("w") * F.when(F.col("y") == 1, F.log("p")).otherwise(F.log1p(-F.col("p")))) / F.sum("w")).alias("loss"))


def misclassified(draws: DataFrame) -> DataFrame:
    m = _mean_probability(draws)
    return m.agg((F.sum(F.col("w") * ((F.col("p") > 0.5).cast("double") != F.col("y")).cast("double")) / F.sum("w")).alias("loss"))


def _np_rmse(y, draws, w):
    return float(np.sqrt((w * (y - draws.mean(1)) ** 2).sum() / w.sum()))


def _np_log(y, draws, w):
    p = np.clip(phi(draws).mean(1), 1e-300, 1 - 1e-16)
    return float(-(w * np.where(y == 1, np.log(p), np.log1p(-p))).sum() / w.sum())


def _np_mcr(y, draws, w):
    return float((w * ((phi(draws).mean(1) > 0.5) != (y == 1))).sum() / w.sum())


LOSSES = {"rmse": _np_rmse, "log": _np_log, "mcr": _np_mcr}


def cross_validate(frame: DataFrame, n_trees: list = (75,), k: list = (2.0,), power: list = (2.0,), base: list = (0.95,), method: str = "k-fold", n_test: float = 5, reps: int = 40, loss: str | Callable | None = None, control: Control = Control(draws=200, burn=200, chains=1), seed: int = 1, warm: tuple[int, int, int] | None = None) -> DataFrame:
    """(rep, n_trees, k, power, base, loss). Rows fall to folds as in `folds` and `subsample`. Each cell, repetition and
    fold starts cold, in a task of its own; or, with warm = (sweeps before the first cell, before each further cell, before
    each further repetition), one task a fold goes through all cells and repetitions with the trees it has. loss: a name,
    or f(y, draws (rows, draws), weights). The block of rows is broadcast once to each executor; its size is checked. Larger
    tables go by cross_validate_resident, which takes named losses and cold starts."""
    p0 = prepare(frame, control, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    name = loss or ("mcr" if p0.binary else "rmse")
    if name in ("log", "mcr") and not p0.binary:
        name = "rmse"
    f = name if callable(name) else LOSSES[name]
    if method not in ("k-fold", "random subsample"):
        raise ValueError(f"no method {method!r}")
    size = frame.count() * (len(p0.cuts) + 5) * 8 / 1e6
    if size > min(MOST_MB, TASK_MB) and warm is None and not callable(name):
        return cross_validate_resident(frame, n_trees, k, power, base, method, n_test, reps, name, control, seed)
    if size > MOST_MB:
        raise ValueError(f"a block of {size:.0f} MB is not broadcast to every cell; warm starts and losses of one's own need it")
    g = frame.toPandas().sort_values("row_id")
    arrays = np.array(g["x"].tolist(), float), *(g[c].to_numpy(float) for c in ("y", "weight", "offset")), g["row_id"].to_numpy()
    block = frame.sparkSession.sparkContext.broadcast(arrays)
    parts = int(n_test) if method == "k-fold" else 1
    todo = grid(frame.sparkSession, list(n_trees), list(k), list(power), list(base), reps).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("fold"))

    def split(row_id: np.ndarray, rep: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
        n, order = len(row_id), places(row_id, rep, seed)
        if method == "k-fold":
            sizes = np.full(parts, n // parts) + (np.arange(parts) < n % parts)
            a = int(sizes[:fold].sum())
            test = order[a : a + int(sizes[fold])]
        else:
            test = order[: int(np.floor(n * n_test + 0.5))]
        return np.setdiff1d(np.arange(n), test), test

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x, y, w, off, row_id = block.value
        b = bins(x, p0.cuts)
        yy = y if p0.binary else (y - off - p0.lo) / p0.span - 0.5
        c, last, out = None, None, []
        for r in rows.sort_values(["rep", "cell"]).itertuples():
            train, test = split(row_id, int(r.rep), int(r.fold))
            s = replace(p0.settings, trees=int(r.n_trees), k=float(r.k), power=float(r.power), base=float(r.base))
            burn = control.burn
            if warm is None or c is None:
                key = stream(r.cell, r.rep, r.fold) if warm is None else stream(-1, 0, r.fold)
                c = Chain(b[train], np.array([len(q) for q in p0.cuts]), yy[train], w[train], s, p0.sigma, seed, key, off[train] if p0.binary else None, row_id[train])
                burn = control.burn if warm is None else warm[0]
            else:
                c.s = replace(s, trees=c.s.trees)
                if not s.k_chi:
                    c.k = s.k
                if s.trees != c.s.trees:
                    c.resize(s.trees)
                burn = warm[1]
                if r.rep != last:
                    c.replace_rows(b[train], yy[train], w[train], off[train] if p0.binary else None)
                    burn = warm[2]
            last = r.rep
            draws = []
            for i in range(burn + control.draws):
                c.sweep()
                if i >= burn:
                    t = c.score(b[test])
                    draws.append(t + off[test] if p0.binary else p0.lo + p0.span * (t + 0.5) + off[test])
            out.append((r.cell, r.rep, r.n_trees, r.k, r.power, r.base, float(f(y[test], np.stack(draws, axis=1), w[test])), len(test)))
        return pd.DataFrame(out, columns=["cell", "rep", "n_trees", "k", "power", "base", "loss", "size"])

    each = todo.groupBy(*(["fold"] if warm else ["cell", "rep", "fold"])).applyInPandas(run, "cell int, rep int, n_trees int, k double, power double, base double, loss double, size int")
    return each.groupBy("rep", "n_trees", "k", "power", "base").agg((F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("loss"))


# over rows that stay in their partitions

#: Chains that go through the rows together, trees of a pass, and nodes of all draws of the chains that are scored together.
WAVE, TREES, NODES = 64, 8, 2_000_000


def fold_sizes(n: int, method: str, n_test: float) -> list[int]:
    """Rows of each fold, as `folds` and `subsample` deal n rows; of random subsamples, test rows and the others."""
    if method == "k-fold":
        k = int(n_test)
        return [n // k + (i < n % k) for i in range(k)]
    test = min(n, math.floor(n * n_test + 0.5))
    return [test, n - test]


def hashed(frame: DataFrame, reps: int, seed: int) -> DataFrame:
    """frame with _u0, _u1, ...: the keyed hash of a row's id in each repetition, as a number of 32 bits from -2^31. Kept with
    the rows, it is made once: a hash costs more than reading four bytes."""
    u = lambda rep: u01(F.lit(seed), F.lit(rep), F.col("row_id"))
    return frame.select("*", *((u(rep) * F.lit(2.0**32) - F.lit(2.0**31)).cast("int").alias(f"_u{rep}") for rep in range(reps)))


def dealt(frame: DataFrame, reps: int, method: str, n_test: float, seed: int) -> tuple[DataFrame, int]:
    """frame(_key, row_id, ...) with fold0, fold1, ...: the fold of each row in each repetition; in random subsamples, 0 for
    test rows, else 1. Beside it the number of rows. Hashes that frame has from `hashed` are used and left out.

    A fold is a stretch of the hashed order, so it is known by its first row. Two passes over hashes, keys and ids find those of
    all repetitions: one counts hash ranges of about RANGE rows, one ranks the ranges in which folds begin. Rows are then
    compared with them where they are, by their hashes and, where those are equal, by ids and keys; none is sorted or joined."""
    u = [f"_u{rep}" for rep in range(reps)]
    columns = [c for c in frame.columns if c not in u]
    if len(columns) + reps > len(frame.columns):
        frame = hashed(frame.select(*columns), reps, seed)
    n = frame.count()
    parts, ends = max(8, -(-n // RANGE)), np.cumsum(fold_sizes(n, method, n_test))[:-1]
    ids = frame.select("_key", F.col("row_id").cast("long").alias("row_id"), F.posexplode(F.array(*u)).alias("_rep", "_u"))
    ids = ids.withColumn("_part", F.floor((F.col("_u") + F.lit(2.0**31)) / F.lit(2.0**32) * parts).cast("int"))
    # a row for each range and repetition
    size = np.zeros((reps, parts), np.int64)
    for r in ids.groupBy("_rep", "_part").count().toLocalIterator():
        size[r["_rep"], r["_part"]] = r["count"]
    upto = size.cumsum(1)
    begin = [(rep, int(end)) for rep in range(reps) for end in ends if end < n]
    within = [(rep, int(np.searchsorted(upto[rep], end, "right"))) for rep, end in begin]
    wanted = [(*k, int(end - upto[k] + size[k])) for k, (_, end) in zip(within, begin, strict=True)]
    first: dict[int, list] = {rep: [] for rep in range(reps)}
    if wanted:
        asked = frame.sparkSession.createDataFrame(wanted, "_rep int, _part int, _at long")
        inside = ids.join(F.broadcast(asked.select("_rep", "_part").distinct()), ["_rep", "_part"], "left_semi")
        at = F.row_number().over(Window.partitionBy("_rep", "_part").orderBy("_u", "row_id", "_key")) - 1
        for r in inside.withColumn("_at", at.cast("long")).join(F.broadcast(asked), ["_rep", "_part", "_at"]).collect():
            first[r["_rep"]].append((r["_u"], r["row_id"], r["_key"]))
    own = F.struct(F.col("row_id").cast("long"), "_key")

    def after(rep: int, x: tuple):
        at, hash_ = F.struct(F.lit(x[1]).cast("long"), F.lit(x[2]).cast("long")), F.lit(x[0]).cast("int")
        return (F.col(u[rep]) > hash_) | ((F.col(u[rep]) == hash_) & (own >= at))

    return frame.select(*columns, *(sum((after(rep, x).cast("int") for x in first[rep]), F.lit(0)).alias(f"fold{rep}") for rep in range(reps))), n


def cross_validate_resident(frame: DataFrame, n_trees: list = (75,), k: list = (2.0,), power: list = (2.0,), base: list = (0.95,), method: str = "k-fold", n_test: float = 5, reps: int = 40, loss: str | None = None, control: Control = Control(draws=200, burn=200, chains=1), seed: int = 1, sizes: bool = False) -> DataFrame:
    """cross_validate with cold starts, over rows that stay in their partitions: no task and no driver holds them.

    Every cell, repetition and fold is a chain that leaves its fold out. WAVE of them at a time go through the rows together:
    in one pass each has its own trees and sums, and the rows are read once for all. At the end one more pass scores the rows
    that each chain left out, by the mean over its draws, and sends two sums a chain. With sizes, (rep, fold, n, w) of those
    rows instead of losses. Draws are those of cross_validate."""
    from treesum.operators import resident

    p0 = prepare(frame, control, stats.TreePrior(), stats.NormalPrior(), stats.ChiSquaredPrior())
    name = loss or ("mcr" if p0.binary else "rmse")
    name = "rmse" if not p0.binary else name
    if method not in ("k-fold", "random subsample"):
        raise ValueError(f"no method {method!r}")
    spark, columns = frame.sparkSession, [f"fold{i}" for i in range(reps)]
    # ids may repeat; keys, once written, do not
    frame = staged(hashed(frame.select("row_id", "y", "weight", "offset", "x").withColumn("_key", F.monotonically_increasing_id()), reps, seed), "rows")
    frame, total = dealt(frame, reps, method, n_test, seed)
    rows = staged(resident.blocks(frame, p0, columns), "blocks").persist(StorageLevel.MEMORY_AND_DISK)
    parts, counts = int(n_test) if method == "k-fold" else 1, fold_sizes(total, method, n_test)
    cells = grid(spark, list(n_trees), list(k), list(power), list(base), reps).orderBy("n_trees", "cell", "rep").collect()
    todo = [(r, fold) for r in cells for fold in range(parts)]
    many, out, at = np.array([len(c) for c in p0.cuts]), [], 0
    try:
        while at < len(todo):
            trees = todo[at][0]["n_trees"]
            most = max(1, min(WAVE, NODES // (control.draws * trees * 7 or 1)))
            wave = [x for x in todo[at : at + most] if x[0]["n_trees"] == trees]
            at += len(wave)
            chains = []
            for r, fold in wave:
                s = replace(p0.settings, trees=trees, k=float(r["k"]), power=float(r["power"]), base=float(r["base"]))
                chains.append(resident.Driven(total - counts[fold], many, s, p0.sigma, seed, stream(r["cell"], r["rep"], fold), (r["rep"], fold)))
            if p0.settings.prior_trees:
                resident.begin(rows, chains)
            draws: list[list] = [[] for _ in wave]
            for i in range(control.burn + control.draws):
                resident.sweep(rows, chains, TREES)
                if i >= control.burn:
                    for d, c in zip(draws, chains, strict=True):
                        d.append([resident.packed(root, lambda x: float(x.mean)) for root in c.roots])
            out += [(r["rep"], fold, trees, r["k"], r["power"], r["base"], *x) for (r, fold), x in zip(wave, _held_out(rows, [c.held for c in chains], draws, p0, name), strict=True)]
    finally:
        rows.unpersist()
    d = spark.createDataFrame(out, "rep int, fold int, n_trees int, k double, power double, base double, size long, w double, lost double")
    if sizes:
        return d.groupBy("rep", "fold").agg(F.first("size").alias("n"), F.first("w").alias("w"))
    value = F.col("lost") / F.col("w")
    each = d.withColumn("loss", F.sqrt(value) if name == "rmse" else value)
    return each.groupBy("rep", "n_trees", "k", "power", "base").agg((F.sum(F.col("loss") * F.col("size")) / F.sum("size")).alias("loss"))


def _held_out(rows: DataFrame, held: list[tuple], draws: list[list], p: Prepared, name: str) -> list[tuple]:
    """(rows, weight, weighted loss) of what each chain left out, by the mean over its draws."""
    from treesum.operators import resident

    # at most NODES nodes or one chain's
    sent = rows.sparkSession.sparkContext.broadcast(draws)
    lo, span, binary = p.lo, p.span, p.binary

    def lost(y: np.ndarray, s: list[np.ndarray], off: np.ndarray, w: np.ndarray) -> float:
        if not binary:
            # y is on the scale of the trees
            return float(w @ (span * (y - np.mean(s, axis=0))) ** 2)
        q = np.mean([phi(v + off) for v in s], axis=0)
        if name == "mcr":
            return float(w @ ((q > 0.5) != (y == 1)))
        q = np.clip(q, 1e-300, 1 - 1e-16)
        return float(-(w @ np.where(y == 1, np.log(q), np.log1p(-q))))

    def run(batches):
        sums = np.zeros((len(held), 3))
        for b in batches:
            for codes, _, y, w, off, fold, many, rest in resident.unpacked(b):
                for i, (rep, own) in enumerate(held):
                    at = np.flatnonzero(fold[rep] == own)
                    if len(at):
                        c = codes[:, at]
                        s = [sum(np.broadcast_to(resident.spread(t, c), len(at)) for t in forest) for forest in sent.value[i]]
                        # squares about the means of cells, which a continuous response alone has
                        more = span**2 * rest[at].sum() if len(rest) else 0.0
                        sums[i] += (many[at].sum() if len(many) else len(at), w[at].sum(), lost(y[at], s, off[at] if len(off) else 0.0, w[at]) + more)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), *(pa.array(sums[:, j]) for j in range(3))], names=["i", "n", "w", "lost"])

    found = rows.mapInArrow(run, "i int, n double, w double, lost double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "w", "lost"))).collect()
    sent.unpersist()
    by = {r["i"]: r for r in found}
    return [(round(by[i]["n"]), by[i]["w"], by[i]["lost"]) for i in range(len(held))]
