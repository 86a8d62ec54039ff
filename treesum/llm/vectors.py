"""Near-duplicate vectors by NN-descent.

Vectors link when their labels are equal and their cosine is at least THRESHOLD, in double precision.

0. Copies. Vectors that are equal, with their label, are one row with a weight; all else works on those rows.
1. Nodes. Codes of random hyperplanes deal vectors of a label into leaves of at most about LEAF rows (a code that holds
   more is split by a hash). A leaf is covered by balls of an angle so small (HALF, under half the link angle) that all
   members of a ball link; a ball is one node. A group of g near copies so makes about g / LEAF nodes, not g, and its
   links inside are counted, not listed.
2. Graph. Each node keeps a list of its nearest nodes, by angle less both radii. Lists start from leaves of several other
   hyperplane codes and are refined through neighbours of neighbours: forward and reverse neighbours of a node meet, and
   pairs that improve either list enter it, until few do. A list that is full of nodes within the link angle is saturated
   and doubles, up to LONG; sizes are kept from pass to pass.
3. Audit. Each label of at least a SHARE of the nodes, and all others together, are audited by themselves: a sample of
   nodes (AUDIT of them, by hash, more until SEEN pairs within the link angle or PROBES nodes are reached) is compared
   with all nodes by brute force. Where the lists hold less than RECALL of the pairs, more hyperplane codes are added and
   refined. Labels in which so many probes see fewer than SEEN pairs are thin: they get a second set of codes in any case,
   each set dealing a pair at the link angle into one leaf with probability RECALL at least.
4. Rest. Nodes whose lists stay saturated, all nodes of labels that fail the last audit, and of thin labels of at most FEW
   nodes, are compared with every ball of their label in double precision, in blocks; only counts and the edges of
   spanning forests come out.
5. Edges. Listed pairs that may link are settled exactly: both balls wholly within the angle (counted by size), wholly
   outside, or member by member in double precision. Components run over nodes.

Defined results: vectors that are null, zero or hold null or non-finite components, or whose label is null, link with
nothing; vectors of different dimension do not link; copies link with each other, however many; rows that share an id count once, by their smallest label and
vector; a null id has no component and is kept; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treesum.llm.common import components, stage

THRESHOLD = 0.93
LEAF, TABLES, LIST, ROUNDS = 256, 8, 10, 4
#: Size at which lists double no more and their nodes are settled exactly; bytes of vectors held against the rest at once.
LONG, CHUNK = 160, 8 << 20
AUDIT, RECALL, AGAIN = 256, 0.98, 3
#: True pairs an audit has to see, nodes it probes at most for them, and the share of nodes of a label audited by itself.
SEEN, PROBES, SHARE = 50, 2048, 1 / 16
#: Nodes of a thin label up to which it is compared as a whole.
FEW = 2048
#: What float16 centres may be off by, as an angle; what double precision may.
COARSE, FINE = 0.06, 1e-7


def _planes(dim: int, table: int, bits: int) -> np.ndarray:
    return np.random.default_rng([dim, table]).normal(size=(dim, bits))


def _codes(units: np.ndarray, table: int, bits: int) -> np.ndarray:
    if not bits:
        return np.zeros(len(units), np.int64)
    return (units @ _planes(units.shape[1], table, bits) > 0) @ (1 << np.arange(bits, dtype=np.int64))


def _bits(n: int) -> int:
    return int(np.clip(np.round(np.log2(max(1, n) / (LEAF / 4))), 0, 60))


def _tables(bits: int, theta: float) -> int:
    """Tables in which a pair at the link angle shares a code of `bits` planes at least once with probability RECALL."""
    once = (1 - theta / np.pi) ** bits
    return TABLES if once >= RECALL else max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log1p(-once))))


def _salted(df: DataFrame, key: list[str], by: str) -> DataFrame:
    """Adds part, so that groups of (key, part) have about LEAF rows; only codes that hold more are counted in the join."""
    big = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LEAF).withColumn("_n", F.ceil(F.col("_n") / LEAF))
    d = df.join(big, key, "left")
    return d.withColumn("part", F.pmod(F.xxhash64(F.lit(3), by), F.coalesce("_n", F.lit(1)))).drop("_n")


def _cover(units: np.ndarray, half: float) -> Iterator[tuple[int, np.ndarray, float]]:
    """Greedy balls: (centre, members, radius), each row in one."""
    cos = np.clip(units @ units.T, -1, 1)
    near = cos >= np.cos(half)
    np.fill_diagonal(near, True)
    free = np.ones(len(units), bool)
    for i in np.argsort(-near.sum(1), kind="stable"):
        if free[i]:
            m = np.flatnonzero(near[i] & free)
            if i not in m:
                m = np.append(m, i)
            free[m] = False
            yield int(i), m, float(np.arccos(cos[i, m]).max()) if len(m) > 1 else 0.0


#: n: rows of a ball, w: vectors, copies counted; weights: those of its rows.
_NODE = "id long, label string, dim int, r double, n int, w long, low long, centre binary, members binary, weights binary, data binary"


def nodes(vectors: DataFrame, theta: float, total: int) -> DataFrame:
    """Balls over vectors(vec_id, label, embedding, w)."""
    bits, half = _bits(total), theta / 2 * 0.99

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            for dim, part in g.groupby(g["embedding"].map(len)):
                x = np.array(part["embedding"].tolist(), np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                yield pd.DataFrame({"vec_id": part["vec_id"], "w": part["w"], "label": part["label"], "dim": dim, "code": _codes(x, 0, bits), "unit": [r.tobytes() for r in x]})

    d = vectors.mapInPandas(coded, "vec_id long, w long, label string, dim int, code long, unit binary")
    key = ["label", "dim", "code"]

    def cover(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids = g["vec_id"].to_numpy(np.int64)
        order = np.argsort(ids)
        ids, w, units = ids[order], g["w"].to_numpy(np.int64)[order], np.frombuffer(b"".join(g["unit"]), np.float64).reshape(len(g), -1)[order]
        rows = [(int(ids[c]), k[0], k[1], r, len(m), int(w[m].sum()), int(ids[m].min()), units[c].astype(np.float16).tobytes(), ids[m].tobytes(), w[m].tobytes(), units[m].tobytes()) for c, m, r in _cover(units, half)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in _NODE.split(", ")])

    return _salted(d, key, "vec_id").groupBy(*key, "part").applyInPandas(cover, _NODE)


def _gaps(centres: list[bytes], r: np.ndarray) -> np.ndarray:
    c = np.frombuffer(b"".join(centres), np.float16).reshape(len(r), -1).astype(np.float32)
    c /= np.sqrt((c * c).sum(1, keepdims=True))
    return np.arccos(np.clip(c @ c.T, -1, 1)) - r[:, None] - r[None, :]


def _leaves(light: DataFrame, tables: range, bits: int, most: int) -> DataFrame:
    """(u, v, gap): for each node the `most` nearest of its leaf in each table."""

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            for dim, part in g.groupby("dim"):
                x = np.frombuffer(b"".join(part["centre"]), np.float16).reshape(len(part), dim).astype(np.float64)
                for t in tables:
                    yield part[["id", "label", "dim", "r", "centre"]].assign(table=t, code=_codes(x, t, bits))

    d = light.mapInPandas(coded, "id long, label string, dim int, r double, centre binary, table int, code long")
    key = ["label", "dim", "table", "code"]
    packed = _salted(d, key, "id").groupBy(*key, "part").agg(F.collect_list(F.struct("id", "r", "centre")).alias("m")).select("m")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, gs = [], [], []
            for m in batch.column(0):
                m = m.as_py()
                if len(m) < 2:
                    continue
                ids, gap = np.array([x["id"] for x in m]), _gaps([x["centre"] for x in m], np.array([x["r"] for x in m]))
                np.fill_diagonal(gap, np.inf)
                k = min(most, len(m) - 1)
                best = np.argpartition(gap, k - 1, axis=1)[:, :k]
                us.append(np.repeat(ids, k))
                vs.append(ids[best].ravel())
                gs.append(np.take_along_axis(gap, best, 1).ravel())
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(gs).astype(np.float64))], ["u", "v", "gap"])

    return packed.mapInArrow(near, "u long, v long, gap double")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours of one node meet: pairs, one of them fresh, that improve a list come out."""
    for batch in batches:
        us, vs, gs = [], [], []
        for m in batch.column(0):
            m = m.as_py()
            if len(m) < 2:
                continue
            ids, bound, fresh = (np.array([x[f] for x in m]) for f in ("id", "bound", "fresh"))
            gap = _gaps([x["centre"] for x in m], np.array([x["r"] for x in m]))
            better = (gap < bound[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
            i, j = np.nonzero(better)
            us.append(ids[i])
            vs.append(ids[j])
            gs.append(gap[i, j])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(gs).astype(np.float64))], ["u", "v", "gap"])


def _lists(found: DataFrame, size: DataFrame) -> DataFrame:
    """The best of found(u, v, gap, fresh) by the list sizes (u, k); a pair known before is not fresh."""
    f = found.groupBy("u", "v").agg(F.min("gap").alias("gap"), F.min("fresh").alias("fresh"))
    f = f.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("gap", "v")))
    return f.join(size, "u", "left").where(F.col("rank") <= F.coalesce("k", F.lit(LIST))).drop("k")


def _saturated(lists: DataFrame, size: DataFrame, theta: float) -> DataFrame:
    """(u, k, n, far, full, hot) of each list; a full list wholly within the link angle (hot) may leave out links."""
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("far")).join(size.select("u", "k"), "u", "left")
    full = full.withColumn("k", F.coalesce("k", F.lit(LIST))).withColumn("full", F.col("n") >= F.col("k"))
    return full.withColumn("hot", F.col("full") & (F.col("far") <= theta + COARSE))


def refine(light: DataFrame, start: DataFrame, theta: float, size: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """NN-descent from start(u, v, gap) with lists of size (u, k): lists (u, v, gap) and their sizes (u, k). Rounds go on
    while saturated lists double, at most until each could have doubled to LONG; lists that have doubled are to come to
    rest by themselves, however few they are."""
    if size is None:
        size = start.sparkSession.createDataFrame([], "u long, k int")
    lists, settled = stage(_lists(start.withColumn("fresh", F.lit(True)), size), "lists"), False
    for i in range(rounds + int(np.ceil(np.log2(max(1, LONG / LIST))))):
        state = _saturated(lists, size, theta)
        grows = F.col("hot") & (F.col("k") < LONG)
        size = stage(state.select("u", F.when(grows, F.least(F.col("k") * 2, F.lit(LONG))).otherwise(F.col("k")).alias("k"), grows.alias("grows"), (F.col("hot") & ~grows).alias("dense"), F.when(F.col("full") & ~F.col("hot"), F.col("far")).otherwise(F.lit(float(np.pi))).alias("bound")), "sizes")
        if (settled or i >= rounds) and size.where("grows").isEmpty():
            break
        back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "gap", "fresh").withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("gap", "v"))).where(F.col("rank") <= LIST)
        around = lists.select("u", "v", "fresh").union(back.select("u", "v", "fresh")).union(lists.select("u", F.col("u").alias("v"), F.lit(False).alias("fresh")).distinct()).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        # at a list that is to be settled exactly nothing needs to meet
        around = around.join(size.where("dense").select("u"), "u", "left_anti")
        # centres are joined to the members and gathered by the node at which they meet: at most a list and LIST more
        m = around.join(light.select(F.col("id").alias("v"), "r", "centre"), "v").join(size.select(F.col("u").alias("v"), "bound"), "v", "left")
        met = m.groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("id"), F.coalesce("bound", F.lit(float(np.pi))).alias("bound"), "fresh", "r", "centre")).alias("m"))
        new = met.select("m").mapInArrow(_meet, "u long, v long, gap double").withColumn("fresh", F.lit(True))
        lists = stage(_lists(lists.select("u", "v", "gap", F.lit(False).alias("fresh")).unionByName(new), size.select("u", "k")), "lists")
        # lists that have doubled are counted apart: a small hot group is not to end with the many that are at rest
        doubled = lists.join(size.where(F.col("k") > LIST).select("u", F.lit(True).alias("doubled")), "u", "left")
        settled = all(c <= 0.01 * k for c, k in doubled.groupBy("doubled").agg(F.count(F.when(F.col("fresh"), 1)).alias("c"), F.count(F.lit(1)).alias("k")).select("c", "k").collect())
    return lists.select("u", "v", "gap"), size.select("u", "k")


def grouped(light: DataFrame, total: int) -> tuple[DataFrame, int]:
    """light with grp, the group it is audited in: 1, 2, ... for labels with a SHARE of all nodes, 0 for all others; and
    the number of groups."""
    hot = light.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARE * total).collect()
    names = light.sparkSession.createDataFrame([(x["label"], x["dim"], i + 1) for i, x in enumerate(hot)], "label string, dim int, grp int")
    return light.join(F.broadcast(names), ["label", "dim"], "left").withColumn("grp", F.coalesce("grp", F.lit(0))), len(hot) + 1


@dataclass
class Audit:
    """What the probes of a group saw: pairs, how many of them the lists hold, and whether all nodes were probed."""

    pairs: int
    held: int
    whole: bool
    nodes: int

    @property
    def missing(self) -> bool:
        return self.held < RECALL * self.pairs

    @property
    def thin(self) -> bool:
        return self.pairs < SEEN and not self.whole


def audit(light: DataFrame, lists: DataFrame, theta: float, groups: list[int]) -> dict[int, Audit]:
    """For each of groups, pairs within the link angle of a sample of its nodes and all others, and how many of them the
    lists hold. light has a column grp. The samples, which are
    broadcast, hold about AUDIT nodes a group, four times as many in each further round up to PROBES; a group that is
    probed whole is measured, whatever it holds."""
    nodes_in = {x["grp"]: x["count"] for x in light.where(F.col("grp").isin(groups)).groupBy("grp").count().collect()}
    known = lists.select("u", "v").union(lists.select(F.col("v"), F.col("u"))).distinct().withColumn("known", F.lit(1))
    out = {g: Audit(0, 0, True, 0) for g in groups if g not in nodes_in}
    want = AUDIT
    while len(out) < len(groups):
        share = {g: min(1.0, want / nodes_in[g]) for g in groups if g not in out}
        least = F.coalesce(*(F.when(F.col("grp") == g, F.lit(round(x * 1_000_000))) for g, x in share.items()))
        probe = light.where(F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(1_000_000)) < least).select("id", "label", "dim", "r", "centre", "grp").toPandas()

        def scan(frames: Iterator[pd.DataFrame], probe: pd.DataFrame = probe) -> Iterator[pd.DataFrame]:
            of = dict(list(probe.groupby(["label", "dim"])))
            for g in frames:
                for (label, dim), part in g.groupby(["label", "dim"]):
                    if (label, dim) not in of:
                        continue
                    p = of[label, dim]
                    unit = lambda c: (lambda x: x / np.sqrt((x * x).sum(1, keepdims=True)))(np.frombuffer(b"".join(c), np.float16).reshape(-1, dim).astype(np.float32))  # noqa: B023, E731
                    gap = np.arccos(np.clip(unit(p["centre"]) @ unit(part["centre"]).T, -1, 1)) - p["r"].to_numpy()[:, None] - part["r"].to_numpy()[None, :]
                    i, j = np.nonzero((gap <= theta) & (p["id"].to_numpy()[:, None] != part["id"].to_numpy()[None, :]))
                    yield pd.DataFrame({"u": p["id"].to_numpy()[i], "v": part["id"].to_numpy()[j], "grp": p["grp"].to_numpy()[i]})

        true = light.where(F.col("grp").isin(list(share))).select("id", "label", "dim", "r", "centre").mapInPandas(scan, "u long, v long, grp int")
        seen = {x["grp"]: (x["n"], x["hit"]) for x in true.join(known, ["u", "v"], "left").groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("hit")).collect()}
        for g, x in share.items():
            n, hit = seen.get(g, (0, 0))
            if n >= SEEN or x == 1.0 or want >= PROBES:
                out[g] = Audit(n, hit, x == 1.0, nodes_in[g])
        want = min(4 * want, max(PROBES, AUDIT))
    return out


def _settle(batches: Iterator[pa.RecordBatch], least: float, theta: float) -> Iterator[pa.RecordBatch]:
    """Pairs of balls to (kind, id, other, n): 'ball' adds n links to each member of ball id, 'one' adds n to vector id,
    'edge' joins balls id and other."""
    for batch in batches:
        out: list[tuple] = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = (np.frombuffer(s["data"], np.float64).reshape(s["n"], -1) for s in (a, b))
            xi, yi = (np.frombuffer(s["members"], np.int64) for s in (a, b))
            xw, yw = (np.frombuffer(s["weights"], np.int64) for s in (a, b))
            hit = x @ y.T >= least
            if not hit.any():
                continue
            out.append(("edge", a["id"], b["id"], 0))
            if hit.all():
                out += [("ball", a["id"], None, b["w"]), ("ball", b["id"], None, a["w"])]
            else:
                out += [("one", int(i), None, int(k)) for i, k in zip(xi, hit @ yw, strict=True) if k] + [("one", int(i), None, int(k)) for i, k in zip(yi, xw @ hit, strict=True) if k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["kind", "id", "other", "n"])


_FOUND = "kind string, id long, other long, n long"


def _spanning(hit: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple]:
    """Edges of a spanning forest of the bipartite graph hit between balls xs and ys."""
    none = len(xs)
    low = np.arange(len(xs))
    while True:
        right = np.where(hit, low[:, None], none).min(0)
        new = np.minimum(low, np.where(hit, right[None, :], none).min(1))
        if (new == low).all():
            break
        low = new
    pairs = [(xs[i], xs[low[i]]) for i in np.flatnonzero(hit.any(1)) if low[i] != i] + [(ys[j], xs[right[j]]) for j in np.flatnonzero(hit.any(0))]
    return [("edge", int(a), int(b), 0) for a, b in pairs if a != b]


def _exactly(heavy: DataFrame, exact: DataFrame, least: float) -> DataFrame | None:
    """Links of the balls exact(id) with all balls of heavy, as rows of _settle. Balls to settle are held against the
    others CHUNK bytes at a time, by tasks over all balls: nothing is shuffled, no pair is listed."""
    marked = stage(heavy.join(exact.select("id", F.lit(True).alias("exact")), "id", "left").withColumn("exact", F.coalesce("exact", F.lit(False))), "marked")
    size = marked.where("exact").agg(F.sum(F.col("n") * F.col("dim") * 8)).first()[0]
    if not size:
        return None
    chunks, out = -(-size // CHUNK), None
    for c in range(chunks):
        mine = marked.where("exact").where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(chunks)) == c).select("id", "label", "dim", "n", "members", "weights", "data").toPandas()
        sides = {k: (p["id"].to_numpy(), p["n"].to_numpy(), b"".join(p["members"]), b"".join(p["weights"]), b"".join(p["data"])) for k, p in mine.groupby(["label", "dim"])}

        def scan(frames: Iterator[pd.DataFrame], sides: dict = sides) -> Iterator[pd.DataFrame]:
            own = {k: np.zeros(s[1].sum(), np.int64) for k, s in sides.items()}
            for f in frames:
                rows: list[tuple] = []
                for k, g in f.groupby(["label", "dim"]):
                    if k not in sides:
                        continue
                    xs, xn, _, xw, data = sides[k]
                    xw, x, x_ball = np.frombuffer(xw, np.int64), np.frombuffer(data, np.float64).reshape(-1, k[1]), np.repeat(np.arange(len(xs)), xn)
                    # about 2,048 vectors of either side at a time
                    for _, h in g.groupby(g["n"].cumsum() // 2048):
                        ys, yn = h["id"].to_numpy(), h["n"].to_numpy()
                        y, y_id = np.frombuffer(b"".join(h["data"]), np.float64).reshape(-1, k[1]), np.repeat(ys, yn)
                        yw = np.frombuffer(b"".join(h["weights"]), np.int64)
                        begin, n = np.cumsum(yn) - yn, np.zeros(len(y), np.int64)
                        for lo in range(0, len(x), 2048):
                            at = slice(lo, lo + 2048)
                            hit = (x[at] @ y.T >= least) & (xs[x_ball[at]][:, None] != y_id[None, :])
                            if not hit.any():
                                continue
                            own[k][at] += hit @ yw
                            n += xw[at] @ hit
                            here, first = np.unique(x_ball[at], return_index=True)
                            rows += _spanning(np.logical_or.reduceat(np.logical_or.reduceat(hit, begin, axis=1), first, axis=0), xs[here], ys)
                        # a ball that is settled exactly itself counts its own links
                        n[np.repeat(h["exact"].to_numpy(), yn)] = 0
                        ids = np.frombuffer(b"".join(h["members"]), np.int64)
                        rows += [("one", int(ids[i]), None, int(n[i])) for i in np.flatnonzero(n)]
                if rows:
                    yield pd.DataFrame(rows, columns=["kind", "id", "other", "n"]).astype({"other": "Int64"})
            for k, n in own.items():
                ids, at = np.frombuffer(sides[k][2], np.int64), np.flatnonzero(n)
                if len(at):
                    yield pd.DataFrame({"kind": "one", "id": ids[at], "other": pd.array([None] * len(at), "Int64"), "n": n[at]})

        part = stage(marked.select("id", "label", "dim", "n", "exact", "members", "weights", "data").mapInPandas(scan, _FOUND), "exact")
        out = part if out is None else out.unionByName(part)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, label, embedding) to (vec_id, n_links, component_id, kept)."""
    theta = float(np.arccos(threshold))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    v = stage(v.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.label", "x.embedding"), "vectors")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    # copies are one row, named by their smallest id
    key = [F.xxhash64(F.lit(k), "label", "embedding").alias(f"h{k}") for k in (1, 2)]
    first = v.where(sound).groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    reps = stage(first, "copies")
    alone = v.join(reps.select(F.col("rep").alias("vec_id"), "w"), "vec_id")
    heavy = stage(nodes(alone, theta, reps.count()), "balls")
    count = heavy.count()
    light, n = grouped(heavy.select("id", "label", "dim", "r", "centre"), count)
    bits, lists, size, done, audits, todo = _bits(count), None, None, 1, {}, list(range(n))
    for k in range(AGAIN):
        tables = _tables(bits, theta)
        start = _leaves(light.where(F.col("grp").isin(todo)), range(done, done + tables), bits, LIST // 2)
        done += tables
        lists, size = refine(light, start if lists is None else start.unionByName(lists), theta, size)
        dense = stage(_saturated(lists, size, theta).where("hot").select(F.col("u").alias("id")), "dense")
        audits |= audit(light.join(dense, "id", "left_anti"), lists, theta, todo)
        todo = [g for g, x in audits.items() if x.missing or k == 0 and x.thin and x.nodes > FEW]
        if not todo:
            break
    rest = [g for g, x in audits.items() if x.missing or x.thin and x.nodes <= FEW]
    exact = stage(dense.union(light.where(F.col("grp").isin(rest)).select("id")).distinct(), "exact")
    more = _exactly(heavy, exact, threshold)
    pairs = lists.where(F.col("gap") <= theta + COARSE).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    if more is not None:
        pairs = pairs.join(exact.withColumnRenamed("id", "a"), "a", "left_anti").join(exact.withColumnRenamed("id", "b"), "b", "left_anti")
    side = heavy.select("id", F.struct("id", "n", "w", "members", "weights", "data").alias("ball"))
    both = pairs.join(side.withColumnRenamed("ball", "x").withColumnRenamed("id", "a"), "a").join(side.withColumnRenamed("ball", "y").withColumnRenamed("id", "b"), "b")
    found = stage(both.select("x", "y").mapInArrow(lambda it: _settle(it, threshold, theta), _FOUND), "links")
    found = found if more is None else found.unionByName(more)
    whole = components(found.where("kind = 'edge'").select(F.col("id").alias("a"), F.col("other").alias("b")))
    balls = stage(heavy.select("id", "w", "low", "members").join(whole, "id", "left").withColumn("component", F.coalesce("component", "id")), "joined")
    lowest = balls.groupBy("component").agg(F.min("low").alias("component_id"))
    per_ball = found.where("kind = 'ball'").groupBy("id").agg(F.sum("n").alias("more"))
    per_one = found.where("kind = 'one'").groupBy(F.col("id").alias("vec_id")).agg(F.sum("n").alias("own"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(m, np.int64) for m in batch.column(0).to_pylist()]
            rep = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64)), batch.column(1).take(pa.array(rep)), batch.column(2).take(pa.array(rep))], ["vec_id", "base", "component_id"])

    one = balls.join(lowest, "component").join(per_ball, "id", "left").select("members", (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("base"), "component_id")
    linked = one.mapInArrow(expand, "vec_id long, base long, component_id long").join(per_one, "vec_id", "left").select(F.col("vec_id").alias("rep"), (F.col("base") + F.coalesce("own", F.lit(0))).alias("n_links"), "component_id")
    linked = v.where(sound).select("vec_id", *key).join(reps.join(linked, "rep"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    rest = v.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op4_nndescent(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH RECURSIVE u AS (SELECT vec_id, min({{'label': label, 'e': CAST(embedding AS DOUBLE[])}}) AS x FROM embeddings GROUP BY vec_id),
w AS (SELECT vec_id, x.label AS label, x.e AS e FROM u),
v AS (SELECT * FROM w WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a),
c AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a)
SELECT w.vec_id, coalesce(n_links, 0) AS n_links, CASE WHEN low < w.vec_id THEN low ELSE w.vec_id END AS component_id, coalesce(NOT low < w.vec_id, true) AS kept
FROM w LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
