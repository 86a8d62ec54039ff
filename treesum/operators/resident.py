"""Back-fitting over rows that stay where they are: chains whose rows fill as many tasks as there are.

Rows are binned once into blocks (column-major codes, response, weight), written to the shared folder and kept in memory by
partition. What moves is the forest: a few kilobytes go out with each pass, and sums come back. No task holds a chain, and no
state of a row is ever written: a row's fit is its trees' sum, computed where the row is, so that a lost executor costs the
blocks it held and nothing else.

A continuous response meets the trees by sums alone, so rows of equal codes are one cell: their number, weight, mean and squares
about it. Where cells are half as many as rows or fewer, blocks are of cells, and a pass costs what the codes are, not the rows.

A move is proposed from the tree alone (kernel.Chain.proposal), so the moves of a batch of trees are drawn before the rows
are read. A tree's old and new leaves cut the rows into cells, a handful per tree. One pass over the rows gives, for the cells of
all trees of the batch, the matrix of weights G that two cells share, the sums b of weighted residuals and the counts. From
these the driver back-fits the batch tree by tree, exactly: once a tree's means move by d, the residual sums of all other
cells move by G d. Histograms of leaf x variable x bin would serve births and deaths only; the rows of a changed or swapped
rule pass other rules below it.

Random numbers come from streams keyed by (seed, chain, sweep, step), and probit latents from keys of the rows, so draws are
those of kernel.Chain, whatever the partitions, up to the rounding of sums.

Group intercepts are not stored either. Rows of a group stand in one block, and given the trees at the start of a sweep, sigma
and tau, a group's intercept is a function of its residuals and of a normal keyed by (seed, chain, sweep, group): each pass makes it
again where the group is. Groups of more than LARGE rows are dealt to several blocks; their sums, of which there are at most
rows / LARGE, come to the driver in a pass of their own. Tau is drawn from the number of groups and the sum of squares.

A run is a folder: draws, and every so many sweeps the state of its chains (trees, sigma, k, number of sweeps), from which a
run that was cut short, or one that is to be longer, goes on.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesum.llm.common import lean
from treesum.operators import sampler, stats
from treesum.operators.kernel import Chain, Node, Proposal, Settings, group_ids, group_normals, keyed_uniforms, latents, walk
from treesum.sources.staging import folder, staged

#: Rows of a block, rows a task works on at once, trees of a pass.
BLOCK, CHUNK, BATCH = 1 << 16, 1 << 13, 32
#: Bytes of all tasks' sums that the driver adds itself; more are added by a shuffle first. Doubles of a slice of that.
GATHER, SLICE = 32 << 20, 1 << 13
#: Rows or cells of a group that stand in one block at most.
LARGE = 1 << 18
#: Cells of a task at which it asks whether they save anything, and those it holds at most.
HELD, MOST_HELD = 1 << 18, 1 << 21


# rows


_CELLS = "key binary, g string, n long, w double, wy double, wyy double, y double"
_BLOCK = "n long, ids binary, codes binary, y binary, weight binary, offset binary, folds binary, many binary, rest binary, sums binary"
_GROUPED = _BLOCK + ", code binary, names array<string>, keys binary, sizes binary, large binary"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _typed(frame: DataFrame, folds: list[str], group: bool) -> DataFrame:
    """The columns that blocks are made of, in as many partitions as there are cores at least."""
    named = [F.coalesce(F.col("g").cast("string"), F.lit("None")).alias("g")] if group else []
    d = frame.select(F.col("row_id").cast("long"), *(F.col(c).cast("double") for c in ("y", "weight", "offset")), F.col("x").cast("array<double>"), *(F.col(c).cast("short").alias(f"_fold{i}") for i, c in enumerate(folds)), *named)
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def _read(t: pa.Table | pa.RecordBatch, p: sampler.Prepared, folds: int) -> tuple[np.ndarray, ...]:
    """(ids, codes, y, weight, offset, folds) of rows as _typed gives them, codes and folds with a line for each column."""
    column = lambda c: t.column(c).combine_chunks() if isinstance(t, pa.Table) else t.column(c)
    x = column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
    ids, y, w, off = (column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "y", "weight", "offset"))
    y = y if p.binary else (y - off - p.lo) / p.span - 0.5
    dealt = np.array([column(f"_fold{i}").to_numpy() for i in range(folds)], np.int16).reshape(folds, t.num_rows)
    return ids.astype(np.int64), np.ascontiguousarray(sampler.bins(x, p.cuts).T), y.astype(float), w.astype(float), off.astype(float) if p.binary else np.zeros(0), dealt


def _together(t: pa.Table, *more: str) -> pa.Table:
    """Cells of equal keys and groups as one, in the order in which they come first."""
    sums = ["n", "w", "wy", "wyy", "y"]
    d = t.group_by(["key", "g", *more], use_threads=False).aggregate([(c, "sum") for c in sums])
    return pa.table({c: d[c if c in d.column_names else f"{c}_sum"] for c in ("key", "g", *sums, *more)})


def cells(d: DataFrame, p: sampler.Prepared, folds: int) -> DataFrame | None:
    """Rows of equal codes, folds and group as one cell: (key, g, n, w, wy, wyy, y, part), key the codes and folds, w, wy and wyy
    weighted sums, y the plain one, a cell at most from each partition. None where cells of partitions are more than half as many
    as the rows, or the response is binary: its latents are the rows' own."""
    if p.binary or not p.cuts:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        seen, given_up = 0, False
        for b in batches:
            if given_up or not b.num_rows:
                continue
            _, codes, y, w, _, dealt = _read(b, p, folds)
            key = np.ascontiguousarray(np.vstack([codes, dealt.view(np.uint16)]).T)
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * key.shape[1]), len(y), [None, pa.py_buffer(key.tobytes())])
            g = b.column("g").cast(pa.string()) if "g" in b.schema.names else pa.nulls(len(y), pa.string())
            held.append(_together(pa.table({"key": key, "g": g, "n": np.ones(len(y), np.int64), "w": w, "wy": w * y, "wyy": w * y * y, "y": y})))
            seen += len(y)
            if sum(t.num_rows for t in held[1:]) >= max(BLOCK, held[0].num_rows):
                held = [_together(pa.concat_tables(held))]
                given_up = held[0].num_rows > HELD and 2 * held[0].num_rows > seen or held[0].num_rows > MOST_HELD
        if given_up:
            held = [held[0].slice(0, 1).set_column(2, "n", pa.array([-1]))]
        if held:
            t = _together(pa.concat_tables(held))
            yield from t.set_column(0, "key", t["key"].cast(pa.binary())).to_batches(max_chunksize=BLOCK)

    c = staged(d.mapInArrow(run, _CELLS).withColumn("part", F.spark_partition_id()), "cells")
    many, rows, least = c.agg(F.count(F.lit(1)), F.sum("n"), F.min("n")).first()
    return None if not many or least < 0 or 2 * many > rows else c


def _of_cells(t: pa.Table, p: sampler.Prepared) -> tuple[np.ndarray, ...]:
    """What a block of cells holds, from ids to sums."""
    key = np.frombuffer(b"".join(t["key"].to_pylist()), np.uint16).reshape(t.num_rows, -1).T
    n, w, wy, wyy, y = (t[c].to_numpy() for c in ("n", "w", "wy", "wyy", "y"))
    mean = np.divide(wy, w, out=np.zeros(len(w)), where=w > 0)
    v = len(p.cuts)
    return np.zeros(0, np.int64), np.ascontiguousarray(key[:v]), mean, w, np.zeros(0), np.ascontiguousarray(key[v:]).view(np.int16), n.astype(float), np.maximum(wyy - wy * mean, 0.0), y


def _line(rows: int, arrays: tuple[np.ndarray, ...]) -> list[pa.Array]:
    """A block's columns of _BLOCK; of rows, what only cells have is empty."""
    arrays += (np.zeros(0),) * (9 - len(arrays))
    return [pa.array([rows]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]


def _parts(c: DataFrame, rows: DataFrame, keys: int) -> int:
    """Partitions for that many cells: no more than they fill."""
    return max(1, min(max(rows.sparkSession.sparkContext.defaultParallelism, c.rdd.getNumPartitions()), -(-keys // CHUNK)))


def blocks(frame: DataFrame, p: sampler.Prepared, folds: list[str] = []) -> DataFrame:  # noqa: B006
    """frame(row_id, y, weight, offset, x) to (n, ids, codes, y, weight, offset, folds, many, rest, sums), a row per block; folds:
    columns of small numbers, by which chains may leave rows out. n: rows of the block. A block is of rows, with ids; or of
    cells, with weighted means as y, numbers of rows, weighted squares about the means and plain sums."""
    lean(frame.sparkSession)
    many, d = len(folds), _typed(frame, folds, False)
    c = cells(d, p, many)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                yield pa.RecordBatch.from_arrays(_line(part.num_rows, _read(part, p, many)), names=_names(_BLOCK))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def block(t: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_line(int(t["n"].to_numpy().sum()), _of_cells(t, p)), names=_names(_BLOCK))

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) >= BLOCK:
                # equal cells that meet no more are still right
                held = [_together(pa.concat_tables(held))]
                if held[0].num_rows >= BLOCK // 2:
                    yield block(held.pop())
        if sum(t.num_rows for t in held):
            yield block(_together(pa.concat_tables(held)))

    if c is None:
        return d.mapInArrow(pack, _BLOCK)
    keys = c.select("key").distinct().count()
    return c.repartition(_parts(c, d, keys), "key").sortWithinPartitions("key", "part").drop("part").mapInArrow(meet, _BLOCK)


def grouped_blocks(frame: DataFrame, p: sampler.Prepared) -> tuple[DataFrame, list[tuple[str, int]], int]:
    """frame(row_id, y, weight, offset, x, g) to blocks in which groups stand whole, with the group of each row or cell (its
    number in the block), names, keys of random numbers, sizes in rows, and the number of a group among the large ones, or -1.
    Beside them the large groups (name, rows), by name, and how many groups there are. Null is a group, named None."""
    lean(frame.sparkSession)
    d = _typed(frame, [], True)
    c = cells(d, p, 0)
    met = c is not None
    parts = max(frame.sparkSession.sparkContext.defaultParallelism, d.rdd.getNumPartitions())
    if c is None:
        sizes, by = d.groupBy("g").agg(F.count(F.lit(1)).alias("_rows"), F.count(F.lit(1)).alias("_lines")), ["row_id"]
    else:
        keys = c.groupBy("g", "key").agg(F.sum("n").alias("n"))
        parts, by = _parts(c, d, keys.count()), ["key", "part"]
        sizes, d = keys.groupBy("g").agg(F.sum("n").alias("_rows"), F.count(F.lit(1)).alias("_lines")), c
    # at most rows / LARGE of them
    large = sorted((r["g"], r["_rows"], r["_lines"]) for r in sizes.where(F.col("_lines") > LARGE).collect())
    many = sizes.count()
    if large:
        ways = frame.sparkSession.createDataFrame([(g, i, -(-n // LARGE)) for i, (g, _, n) in enumerate(large)], "g string, _large int, _ways long")
        d = d.join(F.broadcast(ways), "g", "left").withColumn("_way", F.when(F.col("_ways").isNotNull(), F.pmod(F.xxhash64(by[0]), F.col("_ways"))).otherwise(0)).withColumn("_large", F.coalesce("_large", F.lit(-1)))
    else:
        d = d.withColumns({"_large": F.lit(-1), "_way": F.lit(0)})
    d = d.repartition(parts, "g", "_way").sortWithinPartitions("g", "_way", *by)

    def block(t: pa.Table) -> pa.RecordBatch:
        t = _together(t, "_large") if met else t.combine_chunks()
        arrays = _of_cells(t, p) if met else _read(t, p, 0)
        g = t["g"].combine_chunks().dictionary_encode()
        names, code = g.dictionary.to_pylist(), g.indices.to_numpy().astype(np.int32)
        begin = np.searchsorted(code, np.arange(len(names)))
        sizes = np.bincount(code, arrays[6] if met else None, len(names)).astype(np.int64)
        more = (group_ids(names), sizes, t["_large"].to_numpy()[begin].astype(np.int32))
        out = [*_line(int(sizes.sum()), arrays), pa.array([code.tobytes()], pa.binary()), pa.array([names], pa.list_(pa.string())), *(pa.array([a.tobytes()], pa.binary()) for a in more)]
        return pa.RecordBatch.from_arrays(out, names=_names(_GROUPED))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < BLOCK:
                continue
            t = pa.Table.from_batches(held)
            g = t["g"].combine_chunks().dictionary_encode().indices.to_numpy()
            # the last group goes on, perhaps
            last = int(np.searchsorted(g, g[-1]))
            if t["_large"][t.num_rows - 1].as_py() >= 0:
                last = t.num_rows
            if last:
                yield block(t.slice(0, last))
                held = t.slice(last).to_batches()
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches(held))

    return d.mapInArrow(pack, _GROUPED), [(g, n) for g, n, _ in large], many


def intercepts(row: dict, f: dict) -> np.ndarray:
    """The intercepts of a block's groups in the sweep that f(start, sigma, tau, key, large) describes."""
    sizes, keys, large = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["keys"], np.int64), np.frombuffer(row["large"], np.int32)
    out = drawn(sizes, residuals(row, f["start"]), keys, f)
    return np.where(large < 0, out, f["large"][large] if len(f["large"]) else 0.0)


def residuals(row: dict, trees: list) -> np.ndarray:
    """Sums by group of a block's response less the trees, of its rows or cells."""
    code, y, many = np.frombuffer(row["code"], np.int32), np.frombuffer(row["sums"] or row["y"]), np.frombuffer(row["many"])
    codes, groups = np.frombuffer(row["codes"], np.uint16).reshape(-1, len(y)), len(row["names"])
    total = np.zeros(groups)
    for a in range(0, len(y), CHUNK):
        cut = slice(a, min(len(y), a + CHUNK))
        e = y[cut].copy()
        for t in trees:
            e -= spread(t, codes[:, cut]) * (many[cut] if len(many) else 1.0)
        total += np.bincount(code[cut], e, groups)
    return total


def drawn(sizes: np.ndarray, sums: np.ndarray, keys: np.ndarray, f: dict) -> np.ndarray:
    """Intercepts from the groups' sizes and sums of residuals."""
    s2 = f["sigma"] ** 2
    v = 1 / (sizes / s2 + 1 / f["tau"] ** 2)
    return v / s2 * sums + np.sqrt(v) * group_normals(f["key"], keys)


def rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    """The blocks of a batch, one at a time."""
    for at in range(b.num_rows):
        yield b.slice(at, 1).to_pylist()[0]


def large_sums(rows: DataFrame, forests: list[list], many: int) -> np.ndarray:
    """(chains, large groups): sums of residuals of the large groups, by chain's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                large = np.frombuffer(row["large"], np.int32)
                if (large < 0).all():
                    continue
                at = np.flatnonzero(large >= 0)
                for i, trees in enumerate(forests):
                    s = residuals(row, trees)[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(large[at]), pa.array(s)], names=["chain", "large", "s"])

    out = np.zeros((len(forests), many))
    for r in rows.mapInArrow(run, "chain int, large int, s double").groupBy("chain", "large").agg(F.sum("s").alias("s")).toLocalIterator():
        out[r["chain"], r["large"]] = r["s"]
    return out


def group_posteriors(rows: DataFrame, trees: list, sigma: float, tau: float) -> DataFrame:
    """(g, n, mean, sd) of all groups' intercepts given trees, sigma and tau, from grouped blocks: a row per group and block
    meets by name, so that a large group costs as many rows as it has blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                yield pa.RecordBatch.from_arrays([pa.array(row["names"], pa.string()), pa.array(np.frombuffer(row["sizes"], np.int64)), pa.array(residuals(row, trees))], names=["g", "n", "s"])

    d = rows.mapInArrow(run, "g string, n long, s double").groupBy("g").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    v = 1 / (F.col("n") / sigma**2 + 1 / tau**2)
    return d.select("g", "n", (v / sigma**2 * F.col("s")).alias("mean"), F.sqrt(v).alias("sd"))


def intercept_rows(rows: DataFrame, draws: list[tuple[int, int, dict]], scale: float) -> DataFrame:
    """Rows of sampler._OUT: the intercepts of all groups that stand in one block, for draws (chain, sample, what intercepts takes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows_of(b):
                whole = np.flatnonzero(np.frombuffer(row["large"], np.int32) < 0)
                names = [row["names"][i] for i in whole]
                for chain, sample, f in draws:
                    yield pa.RecordBatch.from_arrays([pa.array([chain] * len(names), pa.int32()), pa.array([sample] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(intercepts(row, f)[whole] * scale)], names=["chain", "sample", "name", "value"])

    kind = dict(x.split() for x in sampler._OUT.split(", "))
    d = rows.mapInArrow(run, "chain int, sample int, name string, value double")
    return d.select(*((F.lit("ranef") if c == "kind" else F.col(c) if c in d.columns else F.lit(None).cast(t)).alias(c) for c, t in kind.items()))


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(codes (variables, rows), ids, y, weight, offset, folds (columns, rows), many, rest) of a batch of blocks, CHUNK rows or cells
    at a time."""
    kinds = (np.int64, np.uint16, np.float64, np.float64, np.float64, np.int16, np.float64, np.float64)
    for at in range(batch.num_rows):
        ids, codes, y, w, off, folds, many, rest = (np.frombuffer(batch.column(i)[at].as_py(), k) for i, k in enumerate(kinds, 1))
        codes, folds = codes.reshape(-1, len(y)), folds.reshape(-1, len(y))
        for a in range(0, len(y), CHUNK):
            cut = slice(a, min(len(y), a + CHUNK))
            yield codes[:, cut], ids[cut], y[cut], w[cut], off[cut], folds[:, cut], many[cut], rest[cut]


# what goes out


def packed(x: Node, leaf) -> tuple | float:
    """A tree as nested tuples (var, cut, left, right), leaf(node) at its leaves."""
    return leaf(x) if x.leaf else (x.var, x.cut, packed(x.left, leaf), packed(x.right, leaf))


def spread(tree, codes: np.ndarray):
    """What the leaves hold, by row."""
    if not isinstance(tree, tuple):
        return tree
    var, cut, left, right = tree
    return np.where(codes[var] > cut, spread(right, codes), spread(left, codes))


@dataclass
class Step:
    """One tree of a pass: its move, its cells by old and new leaf, and its place among the cells of the pass."""

    root: Node
    move: Proposal | None
    r: np.random.Generator
    old: list[Node]
    new: list[Node]
    cells: list[tuple[int, int]]
    base: int

    def shipped(self) -> tuple:
        """(tree of old leaves' numbers, tree of new leaves' numbers or None, cell of each pair)."""
        table = np.full((len(self.old), len(self.new)), -1, np.int32)
        for i, (a, b) in enumerate(self.cells):
            table[a, b] = self.base + i
        at = {id(x): i for i, x in enumerate(self.old)}
        before = packed(self.root, lambda x: at[id(x)])
        if self.move is None:
            return before, None, table
        self.move.apply()
        at = {id(x): i for i, x in enumerate(self.new)}
        after = packed(self.root, lambda x: at[id(x)])
        self.move.undo()
        return before, after, table


def leaves(x: Node) -> list[Node]:
    return [y for y in walk(x) if y.leaf]


def step(root: Node, move: Proposal | None, r: np.random.Generator, base: int) -> Step:
    old = leaves(root)
    if move is None:
        return Step(root, None, r, old, old, [(i, i) for i in range(len(old))], base)
    inside = {id(x) for x in leaves(move.node)}
    move.apply()
    new, within = leaves(root), {id(x) for x in leaves(move.node)}
    move.undo()
    at = {id(x): i for i, x in enumerate(new)}
    cells = [(i, at[id(x)]) for i, x in enumerate(old) if id(x) not in inside]
    cells += [(i, j) for i, x in enumerate(old) if id(x) in inside for j, y in enumerate(new) if id(y) in within]
    return Step(root, move, r, old, new, cells, base)


# sums


def measured(rows: DataFrame, forests: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float, float]]:
    """One pass: for each chain's forest (G, b, counts, weighted squares of the residuals). A forest: trees now (of means),
    those at the start of the sweep that differ from them, the steps' shipped parts, cells, (seed, chain, sweep) where the
    response is binary, the (column, number) of folds that is left out, if one is, and what intercepts takes, if rows have
    groups: then the squares of the intercepts come too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[np.zeros((f["cells"], f["cells"])), np.zeros(f["cells"]), np.zeros(f["cells"]), 0.0, 0.0] for f in forests]
        for batch in batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1)
                row = block.to_pylist()[0] if any(f["group"] for f in forests) else None
                shifts = [_shift(row, f["group"], s) if f["group"] else None for f, s in zip(forests, sums, strict=True)]
                for i, (codes, ids, y, *rest) in enumerate(unpacked(block)):
                    for f, s, b in zip(forests, sums, shifts, strict=True):
                        _add(s, f, codes, ids, y if b is None else y - b[i * CHUNK : (i + 1) * CHUNK], *rest)
        if sums:
            out = [np.concatenate([g.ravel(), b, c, [q, u]]) for g, b, c, q, u in sums]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], names=["chain", "sums"])

    parts = rows.mapInArrow(run, "chain int, sums binary")
    many = rows.rdd.getNumPartitions()
    sizes = [f["cells"] ** 2 + 2 * f["cells"] + 2 for f in forests]
    total = [np.zeros(k) for k in sizes]
    if many * sum(sizes) * 8 <= GATHER:
        for r in parts.collect():
            total[r["chain"]] += np.frombuffer(r["sums"])
    else:
        for r in _added(parts, max(1, math.isqrt(many))).collect():
            total[r["chain"]][r["at"] * SLICE : (r["at"] + 1) * SLICE] += np.frombuffer(r["sums"])
    out = []
    for k, s in zip((f["cells"] for f in forests), total, strict=True):
        out.append((s[: k * k].reshape(k, k), s[k * k : k * k + k], s[k * k + k : -2], float(s[-2]), float(s[-1])))
    return out


def _added(parts: DataFrame, ways: int) -> DataFrame:
    """parts(chain, sums) to (chain, at, sums): slices added in two levels, so that no task gets those of all tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, at // SLICE, x[8 * at : 8 * (at + SLICE)]) for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for at in range(0, len(x) // 8, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["chain", "at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(x) for x in table["sums"].to_pylist())
        return pa.table({"chain": table["chain"][:1], "at": table["at"][:1], "sums": pa.array([s.tobytes()], pa.binary())})

    kind = "chain int, at int, sums binary"
    d = parts.mapInArrow(cut, kind).withColumn("way", F.pmod(F.spark_partition_id(), F.lit(ways)))
    return d.groupBy("chain", "at", "way").applyInArrow(add, kind).groupBy("chain", "at").applyInArrow(add, kind)


def _shift(row: dict, f: dict, s: list) -> np.ndarray:
    """The intercept of each row of a block; squares of those of groups in one block are added to s."""
    b = intercepts(row, f)
    s[4] += float(np.sum(b[np.frombuffer(row["large"], np.int32) < 0] ** 2))
    return b[np.frombuffer(row["code"], np.int32)]


def _add(s: list, f: dict, codes: np.ndarray, ids: np.ndarray, y: np.ndarray, w: np.ndarray, off: np.ndarray, folds: np.ndarray, many: np.ndarray, rest: np.ndarray) -> None:
    if f["held"] is not None:
        at = np.flatnonzero(folds[f["held"][0]] != f["held"][1])
        codes, y, w = codes[:, at], y[at], w[at]
        ids, off, many, rest = (a[at] if len(a) else a for a in (ids, off, many, rest))
    fit = np.zeros(len(y))
    for t in f["trees"]:
        fit += spread(t, codes)
    if f["latent"]:
        first = fit.copy()
        for now, then in f["moved"]:
            first += spread(then, codes) - spread(now, codes)
        y = latents(y, first + off, w, keyed_uniforms(f["latent"], ids)) - off
    e = y - fit
    z = np.zeros((len(y), f["cells"]))
    every = np.arange(len(y))
    for before, after, table in f["steps"]:
        a = spread(before, codes)
        cell = table[a, a if after is None else spread(after, codes)]
        z[every, cell] = 1
    zw = z * w[:, None]
    s[0] += zw.T @ z
    s[1] += zw.T @ e
    s[2] += many @ z if len(many) else z.sum(0)
    s[3] += float(w @ (e * e)) + float(rest.sum())


# chains


class Driven(Chain):
    """A chain without rows: it proposes, and goes on from sums that passes over the rows bring."""

    def __init__(self, n: int, n_cuts: np.ndarray, settings: Settings, sigma: float, seed: int, chain: int, held: tuple[int, int] | None = None):
        """n rows; held: the column and number of the fold that the chain leaves out."""
        self.s, self.n_cuts, self.n, self.p, self.held = settings, np.asarray(n_cuts), n, len(n_cuts), held
        self.start(settings, sigma, seed, chain)
        self.tau, self.tau_prior, self.group = 0.0, None, None

    def open_groups(self, start: list, large: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> None:
        """What this sweep's intercepts follow from; those of large groups (sizes, keys, sums of residuals) are drawn here."""
        self.group = {"start": start, "sigma": self.sigma, "tau": self.tau, "key": (self.seed, self.chain, self.sweeps), "large": np.zeros(0)}
        self.group["large"] = drawn(large, sums, keys, self.group)

    def forest(self, steps: list[Step], began: list | None = None) -> dict:
        trees = [packed(root, lambda x: float(x.mean)) for root in self.roots]
        moved = [(a, b) for a, b in zip(trees, began or trees, strict=True) if a is not b and a != b]
        latent = (self.seed, self.chain, self.sweeps) if self.s.binary else None
        return {"trees": trees, "moved": moved, "steps": [x.shipped() for x in steps], "cells": sum(len(x.cells) for x in steps), "latent": latent, "held": self.held, "group": self.group}

    def propose(self, numbers: range) -> list[Step]:
        """Moves of these trees, each from its own stream."""
        out, base = [], 0
        for t in numbers:
            self.r = self.stream(t + 1, self.sweeps)
            out.append(step(self.roots[t], self.proposal(self.roots[t]), self.r, base))
            base += len(out[-1].cells)
        return out

    def likelihood(self, n: np.ndarray, w: np.ndarray, wy: np.ndarray) -> float:
        """Of leaves by their sums, but for what a cut of the same rows does not change."""
        a, s2, out = self.precision, self.sigma**2, 0.0
        for k, sw, sy in zip(n, w, wy, strict=True):
            if k < 0.5:
                out -= 1e7
                continue
            b, m = sw / s2, sy / sw if sw > 0 else 0.0
            out += 0.5 * math.log(a / (a + b)) + 0.5 * b * m * m - 0.5 * a * b * m * m / (a + b)
        return out

    def settle(self, steps: list[Step], g: np.ndarray, b: np.ndarray, count: np.ndarray, squares: float) -> float:
        """Back-fits the trees of a pass in turn; the weighted squares of the residuals after it."""
        moved = np.zeros(len(b))
        weight = np.diag(g)
        for x in steps:
            own = np.arange(x.base, x.base + len(x.cells))
            at = [np.array(i) for i in zip(*x.cells, strict=True)]
            before = np.array([leaf.mean for leaf in x.old])[at[0]]
            wy = b[own] - g[own] @ moved + weight[own] * before
            gathered = [[np.bincount(i, v, k) for v in (count[own], weight[own], wy)] for i, k in zip(at, (len(x.old), len(x.new)), strict=True)]
            took = bool(x.move is not None and math.log(x.r.random()) < x.move.odds + self.likelihood(*gathered[1]) - self.likelihood(*gathered[0]))
            if took:
                x.move.apply()
                self.accepted += 1
            a, s2 = self.precision, self.sigma**2
            kept = x.new if took else x.old
            for leaf, k, sw, sy in zip(kept, *gathered[took], strict=True):
                leaf.mean = sy / s2 / (a + sw / s2) + x.r.standard_normal() / math.sqrt(a + sw / s2)
                leaf.n = round(k)
            moved[own] = np.array([leaf.mean for leaf in kept])[at[took]] - before
        return max(0.0, squares - 2 * float(moved @ b) + float(moved @ g @ moved))

    def collapse_by(self, count: np.ndarray) -> None:
        """Splits with an empty side go, by the leaves' counts in the order of trees and leaves; for trees without means."""
        rest = iter(count)

        def go(x: Node) -> int:
            if x.leaf:
                x.n = round(next(rest))
                return x.n
            a, b = go(x.left), go(x.right)
            if not a or not b:
                x.left = x.right = None
                x.var = x.cut = -1
            x.n = a + b
            return x.n

        for root in self.roots:
            go(root)

    def counts_of(self, x: Node) -> int:
        return x.n if x.leaf else self.counts_of(x.left) + self.counts_of(x.right)

    def rows(self, cuts: list[np.ndarray] | None) -> list[tuple]:
        """(tree, node, n, var, value), values as cuts on the predictors' scale, or as their numbers."""
        return [(t, i, self.counts_of(x), x.var, float(x.mean if x.leaf else x.cut if cuts is None else cuts[x.var][x.cut])) for t, root in enumerate(self.roots) for i, x in enumerate(walk(root))]

    def restore(self, rows: list[tuple], sigma: float, k: float, sweeps: int) -> None:
        """From rows (tree, node, n, var, number of a cut or mean) of a state."""
        self.sigma, self.k, self.sweeps = sigma, k, sweeps
        trees: dict[int, list] = {}
        for t, i, n, var, value in sorted(rows):
            trees.setdefault(t, []).append((n, var, value))
        self.roots = []
        for t in sorted(trees):
            rest = iter(trees[t])

            def grow(parent: Node | None) -> Node:
                n, var, value = next(rest)  # noqa: B023
                x = Node(parent=parent)
                if var < 0:
                    x.mean, x.n = value, n
                else:
                    x.var, x.cut = var, int(value)
                    x.left = grow(x)
                    x.right = grow(x)
                return x

            self.roots.append(grow(None))


def sweep(rows: DataFrame, chains: list[Driven], batch: int = BATCH, groups: tuple | None = None) -> None:
    """One sweep of all chains together, a pass over the rows for each batch of trees. groups: the large groups and the number
    of all, as grouped_blocks gives them."""
    for c in chains:
        c.sweeps += 1
    if groups is not None:
        large, many = groups
        start = [[packed(root, lambda x: float(x.mean)) for root in c.roots] for c in chains]
        sums = large_sums(rows, start, len(large)) if large else np.zeros((len(chains), 0))
        sizes, keys = np.array([n for _, n in large], np.int64), group_ids([g for g, _ in large])
        for c, s, x in zip(chains, start, sums, strict=True):
            c.open_groups(s, sizes, keys, x)
    began = [[packed(root, lambda x: float(x.mean)) for root in c.roots] if c.s.binary else None for c in chains]
    trees = chains[0].s.trees
    for at in range(0, trees, batch):
        steps = [c.propose(range(at, min(trees, at + batch))) for c in chains]
        sums = measured(rows, [c.forest(s, b) for c, s, b in zip(chains, steps, began, strict=True)])
        squares = [c.settle(s, *x[:4]) for c, s, x in zip(chains, steps, sums, strict=True)]
    for c, q, x in zip(chains, squares, sums, strict=True):
        c.r = c.stream(0, c.sweeps)
        c.draw_scales(q)
        if groups is not None:
            c.tau = sampler.draw_tau(c.tau, many, x[4] + float(np.sum(c.group["large"] ** 2)), c.tau_prior, c.r)


def begin(rows: DataFrame, chains: list[Driven]) -> None:
    """Trees from the prior, without splits of which a side is empty."""
    for c in chains:
        c.grow_from_prior()
    trees = chains[0].s.trees
    found: list[list] = [[] for _ in chains]
    for at in range(0, trees, BATCH):
        steps, base = [], [0] * len(chains)
        for i, c in enumerate(chains):
            own = []
            for root in c.roots[at : at + BATCH]:
                own.append(step(root, None, c.r, base[i]))
                base[i] += len(own[-1].cells)
            steps.append(own)
        for i, (_, _, n, _, _) in enumerate(measured(rows, [c.forest(s) for c, s in zip(chains, steps, strict=True)])):
            found[i].extend(n)
    for c, n in zip(chains, found, strict=True):
        c.collapse_by(np.array(n))


# runs


def fit(frame: DataFrame, control: sampler.Control = sampler.PRESETS["modern"], tree_prior: stats.TreePrior = stats.TreePrior(), leaf_prior: stats.NormalPrior = stats.NormalPrior(), variance=stats.ChiSquaredPrior(), preset: str = "modern", hastings: str = "exact", test: DataFrame | None = None, batch: int = BATCH, every: int = 50, path: str | None = None, group: bool = False, tau_prior: str | Callable = "cauchy") -> sampler.Model:
    """frame(row_id, y, weight, offset, x[, g]) as sampler.fit, over all rows whatever their number. The run's folder is
    `path`, or a new one in the shared folder; its state is written every `every` sweeps. Group intercepts need a continuous
    response: those of a binary one follow from latents that follow from intercepts, which would have to be stored."""
    p = sampler.prepare(frame, control, tree_prior, leaf_prior, variance, hastings, preset=preset)
    if group and p.binary:
        raise ValueError("rows that stay in their partitions have no group intercepts of a binary response")
    spark = frame.sparkSession
    path = path or folder(spark, "run")
    kept = {"lo": p.lo, "span": p.span, "sigma": p.sigma, "binary": p.binary, "cuts": [c.tolist() for c in p.cuts], "settings": asdict(p.settings), "control": asdict(control)}
    kept["settings"]["split_probs"] = None if p.settings.split_probs is None else list(map(float, p.settings.split_probs))
    kept["groups"] = {"scale": sampler.spread_of(frame, p) / p.span, "prior": None if callable(tau_prior) else tau_prior} if group else None
    spark.createDataFrame([(json.dumps(kept),)], "meta string").coalesce(1).write.text(f"{path}/meta")
    return proceed(frame, path, control, test, batch, every, tau_prior if callable(tau_prior) else None)


def proceed(frame: DataFrame, path: str, control: sampler.Control | None = None, test: DataFrame | None = None, batch: int = BATCH, every: int = 50, tau_prior: Callable | None = None) -> sampler.Model:
    """Goes on with the run in `path`, over the frame it was begun with, from its latest state up to control's draws (those
    of the run, if not given). Only the number of draws may differ from what the run was begun with. A prior of tau that is
    a function is not in the folder: it is given again."""
    spark = frame.sparkSession
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    first = sampler.Control(**meta["control"])
    control = control or first
    if replace(control, draws=first.draws) != first:
        raise ValueError("a run goes on with the control it was begun with, but for the number of draws")
    s = meta["settings"] | {"k_chi": meta["settings"]["k_chi"] and tuple(meta["settings"]["k_chi"])}
    s["split_probs"] = None if s["split_probs"] is None else np.array(s["split_probs"])
    p = sampler.Prepared([np.array(c, float) for c in meta["cuts"]], meta["lo"], meta["span"], meta["sigma"], Settings(**s), meta["binary"])
    of_groups, groups = meta.get("groups"), None
    if of_groups and of_groups["prior"] is None and tau_prior is None:
        raise ValueError("the run was begun with a prior of tau of its own, which must be given")
    packed_, *found = grouped_blocks(frame, p) if of_groups else (blocks(frame, p),)
    rows = staged(packed_, "blocks").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.agg(F.sum("n")).first()[0] or 0
        chains = [Driven(n, np.array([len(c) for c in p.cuts]), replace(p.settings), p.sigma, control.seed, i) for i in range(control.chains)]
        if of_groups:
            groups = tuple(found)
            for c in chains:
                c.tau, c.tau_prior = of_groups["scale"] / 5, sampler.tau_density(tau_prior or of_groups["prior"], of_groups["scale"])
        done = _restored(spark, path, chains)
        if not done and p.settings.prior_trees:
            begin(rows, chains)
        last, out, draws = control.burn + control.draws * control.thin, [], []
        for it in range(done, last):
            sweep(rows, chains, batch, groups)
            kept = it - control.burn
            if kept < 0 or (kept + 1) % control.thin == 0:
                k = kept // control.thin
                for c in chains:
                    phase, at = ("burn", it) if kept < 0 else ("keep", k)
                    out += [(phase, c.chain, at, None, None, None, None, c.sigma * p.span if not p.binary else 1.0, "sigma"), (phase, c.chain, at, None, None, None, None, c.k, "k")]
                    if groups:
                        out.append((phase, c.chain, at, None, None, None, None, c.tau * p.span, "tau"))
                    if groups and kept >= 0:
                        draws.append((c.chain, k, c.group))
                        out += [("ranef", c.chain, k, None, None, None, None, float(b) * p.span, g) for (g, _), b in zip(groups[0], c.group["large"], strict=True)]
                    if kept >= 0 and control.keep_trees:
                        out += [("tree", c.chain, k, *r, None) for r in c.rows(p.cuts)]
            if (it + 1) % every == 0 or it + 1 == last:
                _save(spark, path, it + 1, chains, out, intercept_rows(rows, draws, p.span) if draws else None)
                out, draws = [], []
    finally:
        rows.unpersist()
    table = spark.read.schema(sampler._OUT + ", upto int").parquet(f"{path}/draws").drop("upto")
    if last < (done or 0):
        table = table.where(F.col("sample") < F.when(F.col("kind") == "burn", control.burn).otherwise(control.draws))
    return sampler.Model(table, p.lo, p.span, p.binary, control, frame, test)


def _save(spark: SparkSession, path: str, upto: int, chains: list[Driven], out: list[tuple], more: DataFrame | None = None) -> None:
    """Draws first, `more` beside those of the driver: a state stands for all draws before it."""
    slices = max(1, len(out) // 50_000)
    draws = spark.createDataFrame(spark.sparkContext.parallelize(out, slices), sampler._OUT)
    (draws if more is None else draws.union(more)).write.mode("overwrite").parquet(f"{path}/draws/upto={upto}")
    state = [("tree", c.chain, *r, None) for c in chains for r in c.rows(None)] + [(None, c.chain, None, None, None, None, v, k) for c in chains for k, v in (("sigma", c.sigma), ("k", c.k), ("tau", c.tau), ("accepted", float(c.accepted)))]
    spark.createDataFrame(state, "kind string, chain int, tree int, node int, n long, var int, value double, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/state/upto={upto}")


def _restored(spark: SparkSession, path: str, chains: list[Driven]) -> int:
    """Puts the latest state of the run in `path` into chains; the number of sweeps it stands for, 0 if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = lambda what: {int(x.getPath().getName().partition("=")[2]): x.getPath() for x in files.listStatus(at(f"{path}/{what}"))} if files.exists(at(f"{path}/{what}")) else {}
    done = max((k for k, x in written("state").items() if files.exists(at(x, "_SUCCESS"))), default=0)
    # draws after the last state are of a run that was cut short: they are made again
    for k, x in written("draws").items():
        if k > done:
            files.delete(x, True)
    if done:
        found = spark.read.parquet(f"{path}/state/upto={done}").collect()
        for c in chains:
            own = [r for r in found if r["chain"] == c.chain]
            named = {r["name"]: r["value"] for r in own if r["name"]}
            c.restore([(r["tree"], r["node"], r["n"], r["var"], r["value"]) for r in own if r["kind"] == "tree"], named["sigma"], named["k"], done)
            c.accepted, c.tau = int(named["accepted"]), named.get("tau", 0.0)
    return done
