"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct runs of SHINGLE words. Documents link when 100 * intersection >=
75 * union; the result is the components of those links and each set's size.

1. Documents with equal sets (128 bits) are one class. Everything below works on classes, so copies cost one row each.
2. Two sets that link share a shingle among the first (a quarter, about) of either, in any order common to all. The order
   is by the number of classes a shingle is in, over all documents: sets are dealt out by shingle in packed blocks, each
   bucket counts, and only shingles that two classes or more hold come back to their class. What is rare stands first, so
   a set with a quarter of its shingles to itself is in no list; a list is a shingle of several such beginnings.
3. Leaders: the members of all lists with one and the same least class are a star. In each star the class that is in most
   lists is checked against the others, then further ones, until that joins few more. Groups of near copies become
   components this way without forming their pairs.
4. Signature trees: stars that still hold several components are grouped by size range. A tree has the OR of its members' bitmaps
   and the range of sizes at each node. Two nodes are traversed together only while the largest possible overlap of their
   members reaches what a link takes; nodes of one and the same component are not compared. Groups of more than a tile
   (by shingles) are dealt to tasks by pairs of tiles. What comes out is the members that may link, at most a row each.
5. Those members come together again with their whole sets, and pairs of the same traversal are settled exactly where
   they are found; a pair within a component that has grown together by then is skipped, so at most size - 1 links a group
   come out.

No link between different components can be missed; links inside a component do not change the result.

Defined results: a null or wordless text has size 0 and links with nothing; fewer than SHINGLE words count as one
shingle; rows with a null id have no component and take no part; repeated rows give repeated rows; rows that share an id
but not a text are separate documents; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesum.llm.common import components, drop, lean, stage, tidy

SHINGLE, SHARE = 5, 75
#: Cells in which shingles are counted, at least and at most (see _size), and cells of one row of counts.
CELLS, MOST_CELLS, ROW = 1 << 18, 1 << 24, 1 << 12
#: Shingles of one bucket, about, and bits of a shingle inside it; shingles and classes a task gathers before it sends
#: them; documents that may hold a shingle above which it counts as common without being dealt to one bucket, if that is
#: also ABOVE times what a cell holds on average.
BUCKET, FINE, FLUSH, MOST, HOT, ABOVE = 1 << 20, 28, 1 << 19, 60_000, 1 << 16, 4
#: Negative buckets.
PASSED = 1024
#: Ids that are broadcast at most, above, they are joined by shuffle; classes of a star that meet their leader in a task.
BROADCAST, SALT = 500_000, 4096
#: Bits of a bitmap for each shingle, at least; children of a node; shingles of a tile.
WIDTH, FANOUT, TILE = 4, 8, 1 << 20
#: Rounds of leaders at most; a further round is made while the last one closed this share of the open memberships.
LEADERS, WORTH = 6, 0.1
#: Bits of the first number of a class, the key of lists.
KEY = 64
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes. bytes.lower and bytes.split know A-Z and the white space 9-13 and 32 only."""
    from xxhash import xxh3_64_intdigest as hashed

    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([hashed(b"\0" + b" ".join(words))] if words else [], np.uint64)
    w = np.fromiter(map(hashed, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = h * _K + w[i : i + n]
    return np.unique(_mix(h))


def class_of(s: np.ndarray, key: int) -> tuple[int, int]:
    """A set's class: 128 bits as two signed numbers, `key` bits of the first."""
    from xxhash import xxh3_128_intdigest as hashed

    x = hashed(s.tobytes())
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(x & ((1 << key) - 1)), signed(x >> 64)


def bits(s: np.ndarray) -> bytes:
    """A bitmap of WIDTH bits per shingle at least: a power of two, 64 at least."""
    width = max(64, 1 << (WIDTH * len(s) - 1).bit_length())
    b = np.zeros(width, bool)
    b[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(b, bitorder="little").tobytes()


def _planes(x: np.ndarray) -> bytes:
    """The bytes of x, the first of all numbers first: what numbers have in common compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(b: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(dtype).ravel()


_FIRST = "doc_id long, class long, mark long, n long, row int, counts binary"


def _first(batches: Iterator[pa.RecordBatch], size: int, key: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to rows of documents (class, mark, n), and at the end of a task how often shingles fall into each of
    `size` cells, ROW cells a row."""
    cells = np.zeros(size, np.uint32)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _FIRST.split(", ")]
    for batch in batches:
        n, cls, mark = [], [], []
        for text in batch.column(1):
            s = shingles(text.as_py())
            c = class_of(s, key) if len(s) else (0, 0)
            n.append(len(s))
            cls.append(c[0])
            mark.append(c[1])
            np.add.at(cells, (s & np.uint64(size - 1)).astype(np.int64), 1)
        none = [None] * len(n)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((batch.column(0).to_pylist(), cls, mark, n, none, none), types, strict=True)], names)
    rows = [i for i in range(size // ROW) if cells[i * ROW : (i + 1) * ROW].any()]
    none = [None] * len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, none, rows, [cells[i * ROW : (i + 1) * ROW].tobytes() for i in rows]), types, strict=True)], names)


def _size(docs: DataFrame) -> int:
    """Cells for a table: four for each bucket that a shingle every six bytes would fill, CELLS at least and MOST_CELLS at most,
    so that a cell holds a quarter of a bucket on average. The lengths of texts are added up for this."""
    length = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_CELLS, max(CELLS, 1 << (4 * length // (6 * BUCKET)).bit_length()))


def _common(counts: np.ndarray) -> np.ndarray:
    """Cells that only a common shingle can have filled. However many shingles there are, less than one in ABOVE cells is
    such a cell, so that rare shingles keep their exact counts; a shingle elsewhere adds ABOVE average cells to its
    bucket at most, or HOT."""
    return counts > max(HOT, ABOVE * counts.mean())


def _counted(first: DataFrame, size: int) -> np.ndarray:
    """Counts of all `size` cells. Tasks' rows are added in two levels; what comes to the driver is `size` numbers."""

    def add(g: pa.Table) -> pa.Table:
        total = np.zeros(ROW, np.int64)
        for wide, c in zip(g["wide"].to_pylist(), g["counts"].to_pylist(), strict=True):
            total += np.frombuffer(c, np.int64 if wide else np.uint32)
        return pa.table({"row": g["row"].slice(0, 1), "wide": [True], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "row int, wide boolean, counts binary"
    rows = first.where("row is not null").select("row", F.lit(False).alias("wide"), "counts")
    rows = rows.groupBy("row", F.pmod(F.xxhash64("counts"), F.lit(64))).applyInArrow(add, schema).groupBy("row").applyInArrow(add, schema)
    out = np.zeros(size, np.int64)
    # a job for each of these parts, of 8 MB
    for r in rows.repartition(max(1, size >> 20)).toLocalIterator():
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["counts"], np.int64)
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin that differ from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


_PACKED = "bucket int, flush long, marks binary, at binary, levels binary, classes binary, spare binary"


def _entries(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """_PACKED: the shingles of all classes, each class once per flush of a task, in blocks by bucket, and the classes of
    each flush. A shingle is here its bucket and FINE bits, a class its number in the flush. spare: how many shingles of a
    class may come after its prefix. Classes, and shingles that more than HOT documents may hold, by the cells, and so are
    common for sure, stand in negative buckets, which only pass them on to their flush."""
    if len(counts) > 1 << FINE:
        counts = counts.reshape(-1, 1 << FINE).sum(0)
    hot, mask, bits_ = np.packbits(_common(counts)), np.uint64(len(counts) - 1), np.uint64(FINE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        is_hot = np.unpackbits(hot).astype(bool)
        some_hot = bool(is_hot.any())
        held: list[np.ndarray] = []
        classes: list[int] = []
        seen: set[tuple] = set()
        # numbers are the task's and its flushes', so a task that runs again numbers alike
        name = TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in held])
            h, at = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), sizes)
            rows = []
            key = ((h >> np.uint64(32)) % np.uint64(buckets)) << bits_ | (h & np.uint64((1 << FINE) - 1))
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            # shingles of one set that are alike here count once, common or not
            first = _runs(key, at)
            sizes_here = sizes - np.bincount(np.delete(at, first), minlength=len(sizes))
            key, at = key[first], at[first]
            if some_hot:
                # a cell is told by the last bits, which a key keeps
                common = is_hot[(key & mask).astype(np.int64)]
                rows.append((-1 - name % PASSED, name, key[common].tobytes(), at[common].tobytes(), None, None, None))
                key, at = key[~common], at[~common]
            spare = (sizes_here - (sizes - -(-SHARE * sizes // 100) + 1)).astype(np.int32)
            rows.append((-1 - name % PASSED, name, None, None, None, np.array(classes, np.int64).tobytes(), spare.tobytes()))
            bucket, fine = (key >> bits_).astype(np.int64), (key & np.uint64((1 << FINE) - 1)).astype(np.uint32)
            begin = _runs(bucket)
            for i, j in zip(begin, [*begin[1:], len(bucket)], strict=len(bucket) > 0):
                rows.append((int(bucket[i]), name, _planes(np.diff(fine[i:j], prepend=np.uint32(0))), _planes(at[i:j]), None, None, None))
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in _PACKED.split(", ")])

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(text.as_py()) if doc_id is not None else np.zeros(0, np.uint64)
                if not len(s) or (c := class_of(s, KEY)) in seen:
                    continue
                seen.add(c)
                held.append(s)
                classes.append(c[0])
                size += len(s)
                if size >= FLUSH or len(held) >= MOST:
                    yield flush()
                    name, size, seen = name + 1, 0, set()
                    held.clear()
                    classes.clear()
        if held:
            yield flush()

    return docs.mapInArrow(lambda it: tidy(run(it)), _PACKED)


def _lists(packed: DataFrame) -> DataFrame:
    """(list, class): the shingles in the beginnings of sets that several classes may hold. A bucket has about BUCKET
    entries, those of one shingle HOT at most; a flush has FLUSH, about, of at most MOST classes."""
    bits_ = np.uint64(FINE)

    names = [x.split()[0] for x in _PACKED.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]

    def count(key: tuple, g: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return g.select(names)
        blocks = [np.cumsum(_unplaned(m, np.uint32), dtype=np.uint32) for m in g["marks"].to_pylist()]
        fine = np.concatenate(blocks)
        # blocks are sorted, so that sorting them together is merging
        order = np.argsort(fine, kind="stable")
        begin = _runs(fine[order])
        times = np.diff([*begin, len(fine)])
        level = np.zeros(len(fine), np.uint8)
        level[order] = np.repeat(np.minimum(254, 4 * np.log2(times)).astype(np.uint8), times)
        rows, lo = [], 0
        for flush, block, at in zip(g["flush"].to_pylist(), blocks, g["at"].to_pylist(), strict=True):
            own = level[lo : lo + len(block)]
            lo += len(block)
            # 0: held once
            k = np.flatnonzero(own)
            if len(k):
                rows.append((key[0].as_py(), flush, block[k].tobytes(), _unplaned(at, np.uint16)[k].tobytes(), own[k].tobytes(), None, None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

    def begin_of(g: pa.Table) -> pa.Table:
        marks, at, level = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], [np.zeros(0, np.uint8)]
        for b, m, a, v, c, s in zip(*(g[k].to_pylist() for k in ("bucket", "marks", "at", "levels", "classes", "spare")), strict=True):
            if c is not None:
                classes, spare = np.frombuffer(c, np.int64), np.frombuffer(s, np.int32)
            elif v is None:
                marks.append(np.frombuffer(m, np.uint64))
                at.append(np.frombuffer(a, np.uint16))
                level.append(np.full(len(at[-1]), 255, np.uint8))
            else:
                marks.append((np.uint64(b) << bits_) | np.frombuffer(m, np.uint32).astype(np.uint64))
                at.append(np.frombuffer(a, np.uint16))
                level.append(np.frombuffer(v, np.uint8))
        marks, at, level = np.concatenate(marks), np.concatenate(at), np.concatenate(level)
        order = np.lexsort((marks, level, at))
        marks, at = marks[order], at[order]
        one = _runs(marks, at)
        marks, at = marks[one], at[one]
        begin = _runs(at)
        sizes = np.diff([*begin, len(at)])
        keep = np.arange(len(at)) - np.repeat(begin, sizes) < np.repeat(sizes, sizes) - spare[at]
        return pa.table({"list": marks[keep].view(np.int64), "class": classes[at[keep]]})

    return packed.groupBy("bucket").applyInArrow(count, _PACKED).groupBy("flush").applyInArrow(begin_of, "list long, class long")


def possible(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least intersection of linked sets of sizes n and m, as a float: 3 (n + m) / 7."""
    return SHARE * (n + m) / (100.0 + SHARE)


def _fold(b: np.ndarray, width: int) -> np.ndarray:
    while len(b) > width:
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return b


class SignatureTree:
    """Levels of nodes over members in the order given: OR of bitmaps, sizes, excess (shingles less bits), component."""

    def __init__(self, n: np.ndarray, maps: list[bytes], comp: np.ndarray):
        raw = [np.frombuffer(b, np.uint64) for b in maps]
        width = min(map(len, raw))
        bit = np.stack([_fold(b, width) for b in raw])
        over = n - np.bitwise_count(bit).sum(1)
        # comp -1: members of several components
        self.levels = [(bit, n, n, over, comp)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, e, c = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            first, last = np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at), np.where(first == last, first, -1)))

    def _keep(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        b, lo, hi, e, c = self.levels[level]
        ok = (c[i] != c[j]) | (c[i] == -1)
        ok &= (100 * hi[i] >= SHARE * lo[j]) & (100 * hi[j] >= SHARE * lo[i])
        k = np.flatnonzero(ok)
        most = np.bitwise_count(b[i[k]] & b[j[k]]).sum(1) + np.minimum(e[i[k]], e[j[k]])
        ok[k] = np.minimum(most, np.minimum(hi[i[k]], hi[j[k]])) >= possible(lo[i[k]], lo[j[k]]) - 1e-6
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members of different components that may link, by dual traversal from the root, depth first in blocks
        of about half a million words of bitmap."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        step = max(8, (1 << 19) // (FANOUT * FANOUT * self.levels[0][0].shape[1]))
        while todo:
            level, i, j = todo.pop()
            ok = self._keep(level, i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if level == 0:
                yield i[i != j], j[i != j]
                continue
            n = len(self.levels[level - 1][1])
            for lo in range(0, len(i), step):
                a = (i[lo : lo + step, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
                z = (j[lo : lo + step, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
                a, z = a.ravel(), z.ravel()
                k = (a <= z) & (z < n)
                todo.append((level - 1, a[k], z[k]))


_KEY = ["leader", "group", "ta", "tb"]
_MEMBER = "leader long, group int, ta long, tb long, tile long, band int, class long, comp long, n long"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of one group after another, from rows sorted by _KEY."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            cols = batch.slice(lo, 256).to_pydict()
            keys = list(zip(*(cols[k] for k in _KEY), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != last:
                    if held:
                        yield held
                    held, last = {k: [] for k in cols}, keys[at]
                for k, v in cols.items():
                    held[k] += v[at:end]
                at = end
    if held:
        yield held


def _open_pairs(g: dict[str, list], maps: list[bytes]) -> tuple[np.ndarray, Iterator]:
    """The order in which a group's members stand in its tree, and pairs (i, j) in that order which may link. A pair
    belongs to the group of the larger of its bands, and one of a tile to the group of that tile alone."""
    comp = np.unique(np.array(g["comp"]), return_inverse=True)[1].astype(np.int64)
    n = np.array(g["n"])
    order = np.lexsort((np.array(g["class"]), n, comp))
    band, tile = np.array(g["band"])[order], np.array(g["tile"])[order]
    here, across = g["group"][0], g["ta"][0] != g["tb"][0]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in SignatureTree(n[order], [maps[k] for k in order], comp[order]).pairs():
            k = np.maximum(band[i], band[j]) == here
            if across:
                k &= tile[i] != tile[j]
            yield i[k], j[k]

    return order, pairs()


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (_MEMBER, bits) to those that some other member of their group may link with."""
    names = [x.split()[0] for x in _MEMBER.split(", ")]
    for g in _groups(batches):
        if len(set(g["comp"])) < 2:
            continue
        order, pairs = _open_pairs(g, g["bits"])
        live = np.zeros(len(order), bool)
        for i, j in pairs:
            live[i] = live[j] = True
        at = order[live].tolist()
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([g[c][k] for k in at], pa.int32() if c in ("group", "band") else pa.int64()) for c in names], names)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (_MEMBER, set) to links (a, b) that join their components: at most one fewer than a group has members."""
    for g in _groups(batches):
        sets = [np.frombuffer(x, np.uint64) for x in g["set"]]
        order, pairs = _open_pairs(g, [bits(s) for s in sets])
        sets, cls = [sets[k] for k in order], [g["class"][k] for k in order]
        comp = np.unique(np.array(g["comp"])[order], return_inverse=True)[1].astype(np.int64)
        out: list[tuple] = []
        for i, j in pairs:
            # pairs of one member are settled together, against the components as they are by then
            by = np.argsort(i, kind="stable")
            i, j = i[by], j[by]
            begins = np.flatnonzero(np.diff(i, prepend=-1))
            for lo, hi in zip(begins, np.append(begins[1:], len(i)), strict=False):
                a = int(i[lo])
                others = j[lo:hi]
                others = others[comp[others] != comp[a]]
                for start in range(0, len(others), 512):
                    some = others[start : start + 512]
                    some = some[comp[some] != comp[a]]
                    if not len(some):
                        continue
                    flat, sizes = np.concatenate([sets[k] for k in some]), np.array([len(sets[k]) for k in some])
                    place = np.minimum(np.searchsorted(sets[a], flat), len(sets[a]) - 1)
                    both = np.add.reduceat(sets[a][place] == flat, np.cumsum(sizes) - sizes)
                    for b in some[100 * both >= SHARE * (len(sets[a]) + sizes - both)].tolist():
                        if comp[a] != comp[b]:
                            out.append((cls[a], cls[b]))
                            comp[comp == comp[b]] = comp[a]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, salt, first, class, set), sorted, to links (class, b): the first row of a group is its leader b."""
    last, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            a, b = [], []
            for leader, salt, first, cls, x in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                q = np.frombuffer(x, np.uint64)
                if first:
                    last, own = (leader, salt), q
                    continue
                assert last == (leader, salt), "a leader without its set"
                both = int((own[np.minimum(np.searchsorted(own, q), len(own) - 1)] == q).sum())
                if 100 * both >= SHARE * (len(own) + len(q) - both):
                    a.append(cls)
                    b.append(leader)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, set) of wanted(class), staged: read again from the text of one document each."""
    needed = stage(wanted.distinct().join(classes.select("class", "key", "mark", F.col("low").alias("doc_id")), "class"), "needed")
    ids = needed.select("doc_id").distinct()
    # the texts are not shuffled while the ids are few, by count; beyond, the join goes by doc_id
    ids = F.broadcast(ids) if needed.count() <= BROADCAST else ids

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                found = [shingles(t.as_py()) for t in batch.column(1).slice(lo, 512)]
                both = [class_of(s, KEY) for s in found]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in both], pa.int64()), pa.array([m for _, m in both], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["key", "mark", "set"])

    s = docs.join(ids, "doc_id").select("doc_id", "text").mapInArrow(lambda it: tidy(sets(it)), "key long, mark long, set binary")
    # rows that repeat, or share an id, may give a class twice or one not asked for
    out = stage(s.join(needed.select("class", "key", "mark"), ["key", "mark"]).groupBy("class").agg(F.first("set").alias("set")), "sets")
    drop(needed)
    return out


def _few(staged: DataFrame) -> DataFrame:
    """A staged table of numbers, to be broadcast while it has few rows, by count: whole sets are then not shuffled to it."""
    return F.broadcast(staged) if staged.count() <= BROADCAST else staged


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes and their leaders that link, staged. A leader of many is dealt to several tasks."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT).alias("parts"))
    members = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("salt"), F.lit(False).alias("first"), F.col("a").alias("class"))
    leaders = many.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("first"), F.col("b").alias("class"))
    asked = stage(members.unionByName(leaders), "asked")
    rows = sets.join(_few(asked), "class").select("b", "salt", "first", "class", "set")
    dealt = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.desc("first"))
    out = stage(dealt.mapInArrow(_linked, "a long, b long"), "linked")
    drop(asked)
    return out


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(class, n, bits) of sets(class, set), staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([bits(s) for s in found], pa.binary())], ["class", "n", "bits"])

    return stage(sets.select("class", "set").mapInArrow(run, "class long, n long, bits binary"), "bits")


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """docs(text, ...) with the class of each text's set, 0 for an empty set."""
    own = docs.columns
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [class_of(s, KEY)[0] if len(s) else 0 for s in map(shingles, part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], [*own, name])

    return docs.mapInArrow(run, docs.select(*own).schema.add(name, "long"))


def _classes(first: DataFrame) -> tuple[DataFrame, bool]:
    """(class, key, mark, n, low), one row per set that some row with an id has, and whether two sets share a key
    (the first 64 bits). class is the key but where that is shared; there, further sets get a number of their own."""
    one = first.where("n > 0").groupBy(F.col("class").alias("key"), "mark").agg(F.first("n").alias("n"), F.min("doc_id").alias("low")).where("low is not null")
    one = stage(one, "classes")
    shared = one.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("mark").alias("least")).where("times > 1").select("key", "least")
    if shared.isEmpty():
        return one.select(F.col("key").alias("class"), "*"), False
    own = F.when(F.coalesce(F.col("mark") != F.col("least"), F.lit(False)), F.xxhash64("key", "mark")).otherwise(F.col("key"))
    return stage(one.join(shared, "key", "left").select(own.alias("class"), "key", "mark", "n", "low"), "classes"), True


def _tiled(members: DataFrame) -> DataFrame:
    """members(leader, group, band, class, comp, n, ...) with ta, tb and tile, once for each pair of tiles their own is
    in. Groups of at most a tile, by shingles, are one; of others, a component with more than a tile has tiles of its own,
    which are not paired with each other."""
    room = F.greatest(F.lit(8.0), F.lit(float(TILE)) / F.pow(F.lit(100 / SHARE), F.col("group") + 1))
    g = ["leader", "group"]
    sizes = members.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").withColumn("_room", room)
    members = members.join(sizes.select(*g, "_n", "_room"), g)
    small = members.where("_n <= _room").drop("_n", "_room").withColumns({"tile": F.lit(0).cast("long"), "ta": F.lit(0).cast("long"), "tb": F.lit(0).cast("long")})
    big = members.where("_n > _room")
    if big.isEmpty():
        return small
    whole = big.groupBy(*g, "comp").agg(F.count(F.lit(1)).alias("_c")).join(sizes.select(*g, "_room"), g).where("_c > _room").select(*g, "comp", F.ceil(F.col("_c") / F.col("_room")).alias("_own"))
    named = big.join(whole, [*g, "comp"], "left")
    pooled = F.xxhash64(F.lit(-1), F.pmod(F.xxhash64("comp"), F.ceil(F.col("_n") / F.col("_room"))))
    named = named.withColumn("tile", F.when(F.col("_own").isNull(), pooled).otherwise(F.xxhash64("comp", F.pmod(F.xxhash64("class"), F.col("_own"))))).withColumn("_only", F.when(F.col("_own").isNotNull(), F.col("comp")))
    tiles = stage(named.select(*g, "tile", "_only").distinct(), "tiles")
    other = tiles.select(*g, F.col("tile").alias("tb"), F.col("_only").alias("_other"))
    pairs = tiles.withColumnRenamed("tile", "ta").join(other, g).where("ta <= tb and not coalesce(_only = _other, false)").select(*g, "ta", "tb")
    pairs = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("ta", "tb"))))
    return small.unionByName(named.drop("_n", "_room", "_own", "_only").join(pairs, [*g, "tile"]))


def join_components(docs: DataFrame, classes: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_shingles, component_id), and each row's class if asked for."""
    more = ["class"] if classes else []
    spark: SparkSession = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lean(spark)
    size, key = _size(d), KEY
    first = stage(d.mapInArrow(lambda it: tidy(_first(it, size, key)), _FIRST), "shingles")
    rows = first.where("row is null").select("doc_id", "class", "mark", "n")
    counts = _counted(first, size)
    classes, shared = _classes(first)
    entries = int(classes.agg(F.sum("n")).first()[0] or 0)
    packed = _entries(d, counts, max(1, -(-entries // BUCKET)))
    lists = stage(_lists(packed), "lists")
    named = lists.withColumnRenamed("class", "key").join(classes.select("key", "class"), "key").select("list", "class") if shared else lists
    lead = named.groupBy("list").agg(F.min(F.struct(F.xxhash64("class"), "class")).alias("l"), F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("list", F.col("l.class").alias("leader"))
    stars = stage(named.join(lead, "list").groupBy("leader", "class").agg(F.count(F.lit(1)).alias("votes")), "stars")
    drop(lists)
    sets = _sets(d, classes, stars.select("class"))
    degree = stars.groupBy("class").agg(F.sum("votes").alias("degree"))
    links, open_, still = spark.createDataFrame([], "a long, b long"), stars.withColumn("comp", F.col("class")), None
    for k in range(LEADERS):
        # what copies were made of shares a list with each of them: the first round takes the class that is in most lists
        first_of = F.struct(-F.col("degree"), F.xxhash64(F.lit(k), "class"), "class", "comp") if k == 0 else F.struct(F.xxhash64(F.lit(k), "class"), "class", "comp")
        lead = (open_.join(degree, "class") if k == 0 else open_).groupBy("leader").agg(F.min(first_of).alias("l")).select("leader", F.col("l.class").alias("b"), F.col("l.comp").alias("other"))
        votes = open_.join(lead, "leader").where("comp <> other")
        best = votes.groupBy(F.col("class").alias("a")).agg(F.max(F.struct("votes", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        links = links.union(_links(best, sets))
        comp = stage(components(links).select(F.col("id").alias("class"), F.col("component").alias("comp")), "components")
        named = open_.drop("comp").join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
        # stars whose classes have become one component are closed for good
        mixed = named.groupBy("leader").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("leader")
        closed, open_ = open_, stage(named.join(mixed, "leader", "left_semi"), "open")
        drop(comp, *([closed] if k else []))
        before, still = still, open_.select("leader", "comp").distinct().count()
        if not still or before is not None and still > (1 - WORTH) * before:
            break
    star = open_.select("leader", "class", "comp")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / SHARE))).cast("int")
    # sizes of linked sets lie in one band or in neighbours: a class stands in its own group and in the next
    inside = stage(star.select("class").distinct(), "inside")
    maps = _bitmaps(sets.join(_few(inside), "class", "left_semi"))
    met = star.join(maps.select("class", "n"), "class").withColumn("band", band).withColumn("group", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    names = [x.split()[0] for x in _MEMBER.split(", ")]
    whole_groups = stage(met, "met")
    met = stage(_tiled(whole_groups).select(*names), "members")
    dealt_by = lambda m: m.repartition(*_KEY).sortWithinPartitions(*_KEY)
    live = stage(dealt_by(met.join(maps.select("class", "bits"), "class").select(*names, "bits")).mapInArrow(_live, _MEMBER), "live")
    links = links.union(stage(dealt_by(sets.join(_few(live), "class").select(*names, "set")).mapInArrow(_settled, "a long, b long"), "settled"))
    drop(met, whole_groups, live, inside, sets, maps, stars, open_)
    joined = components(links).select(F.col("id").alias("class"), "component")
    named = classes.select("class", "key", "mark", "low").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = stage(named.join(lowest, "component").select(F.col("key").alias("class"), "mark", "component_id"), "named")
    linked = rows.where("n > 0 and doc_id is not null").join(of, ["class", "mark"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more)
    rest = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more)
    return linked.unionByName(rest)


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i + 1 : i + 5], ' ') END AS g FROM (SELECT rid, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT x.rid AS a, y.rid AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
p AS (SELECT a, b FROM i JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS rid, min(d.doc_id) AS low FROM r JOIN d ON d.rid = r.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)"""
