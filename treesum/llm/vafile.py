"""Vector compression by codebooks, nearest entries found through a VA-file.

Vectors become integers, floor(1024 x), and are cut into PARTS equal consecutive parts. Each part position has a codebook
of at most ENTRIES entries, which starts as that part of the vectors with the smallest ids and is refined in ROUNDS rounds of
assignment and componentwise floor means; a last assignment gives the codes.

The nearest entry comes from a vector-approximation file of the codebook: along each coordinate the entries fall into at
most CELLS cells of equal count, so that an entry is a few bits a coordinate. A query part looks up, once per coordinate and
cell, the least and greatest squared distance to the cell; sums of these along an entry's cells bound its distance from
below and above. Entries whose lower bound is above the smallest upper bound cannot be nearest; the rest are refined with
integer distances, ties to the lower index. Bounds are taken in single precision and widened by more than its rounding.

A round is one pass over the table: tasks add up their parts by entry and send at most a codebook's size of sums, which
are added by entry and component. Codebooks (PARTS x ENTRIES entries of a part's length) are all that comes to the driver.

Defined results: vectors that are null or hold null or non-finite components take no part; integers are held at +-HELD, so
that distances fit 64 bits; a length that PARTS does not divide is filled up with zeros; vectors of each length have
codebooks of their own (LENGTHS lengths at most, else an error); null ids come last among the starts, equal ids by vector;
fewer vectors than entries make as many entries; rows that share an id are coded each; equal labels, nulls together, share
label_error, held at the largest 64-bit integer; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treesum.llm.common import lean, read, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELLS = 16
HELD = 1 << 25
#: Lengths of vectors in one table; bytes that lookups or refined pairs of a block of rows take.
LENGTHS, WORK = 100, 8 << 20
#: Labels up to which sums by label are broadcast.
BROADCAST = 100_000


class Approximation:
    """The VA-file of the entries (m, d) of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m, d = entries.shape
        self.cells = min(CELLS, m)
        order = np.argsort(entries, axis=0, kind="stable")
        cell = np.empty((m, d), np.int64)
        np.put_along_axis(cell, order, np.repeat((np.arange(m) * self.cells // m)[:, None], d, 1), 0)
        ranked = np.take_along_axis(entries, order, 0)
        first = np.array([-(-c * m // self.cells) for c in range(self.cells + 1)])
        self.low, self.high = ranked[first[:-1]].T.astype(np.float64), ranked[first[1:] - 1].T.astype(np.float64)
        # which of the d x cells lookups make up an entry's bounds
        self.member = np.zeros((d * self.cells, m), np.float32)
        self.member[(np.arange(d) * self.cells + cell).T, np.arange(m)] = 1
        self.slack = np.float32(1e-6 * max(1, d * self.cells))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (n, m) of squared distances of q (n, d) to the entries."""
        x = q.astype(np.float64)[:, :, None]
        under, over = self.low - x, x - self.high
        least = np.maximum(np.maximum(under, over), 0) ** 2
        most = np.maximum(-under, -over) ** 2
        lower = least.reshape(len(q), -1).astype(np.float32) @ self.member
        upper = most.reshape(len(q), -1).astype(np.float32) @ self.member
        return lower * (1 - self.slack), upper * (1 + self.slack)

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of q (n, d) int64; ties to the lower index."""
        m, d = self.entries.shape
        index, distance = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        step = max(1, WORK // (16 * max(1, d * self.cells, m)))
        for a in range(0, len(q), step):
            block = q[a : a + step]
            lower, upper = self.bounds(block)
            row, entry = np.nonzero(lower <= upper.min(1)[:, None])
            exact = np.empty(len(row), np.int64)
            most = max(1, WORK // (16 * max(1, d)))
            for b in range(0, len(row), most):
                gap = block[row[b : b + most]] - self.entries[entry[b : b + most]]
                exact[b : b + most] = (gap * gap).sum(1)
            start = np.searchsorted(row, np.arange(len(block)))
            best = np.minimum.reduceat(exact, start)
            at = np.flatnonzero(exact == best[row])
            _, once = np.unique(row[at], return_index=True)
            index[a : a + step], distance[a : a + step] = entry[at[once]], best
        return index, distance


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) to (vec_id, label, length, v: int32 components, filled up to a multiple of PARTS)."""
    for b in batches:
        e = b.column("embedding")
        there = ~e.is_null().to_numpy(zero_copy_only=False)
        # as doubles, null components as NaN
        flat = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        size = np.where(there, np.nan_to_num(e.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)), 0).astype(np.int64)
        start = np.cumsum(size) - size
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
        keep = np.flatnonzero(there & (bad[start + size] == bad[start]))
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.nan_to_num(np.clip(np.floor(SCALE * flat), -HELD, HELD)).astype(np.int32)
        fill = -size % PARTS
        v = [whole[start[i] : start[i] + size[i]].tobytes() + bytes(4 * int(fill[i])) for i in keep]
        kept = b.take(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array((size + fill)[keep].astype(np.int32)), pa.array(v, pa.binary())], names=["vec_id", "label", "length", "v"])


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors by part: (n, PARTS, d) int64) of a batch."""
    size = b.column("length").to_numpy()
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        flat = np.frombuffer(b"".join(b.column("v").take(pa.array(rows)).to_pylist()), np.int32)
        yield int(length), rows, flat.reshape(len(rows), PARTS, int(length) // PARTS).astype(np.int64)


def kept(vectors: DataFrame) -> DataFrame:
    """The vectors that take part, as integers."""
    label = vectors.schema["label"].dataType.simpleString()
    d = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>"))
    return d.mapInArrow(_integers, f"vec_id long, label {label}, length int, v binary")


def tally(vectors: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """One assignment of kept vectors: (length, part, entry, n, at, total), the count and component sums of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {k: [Approximation(e) for e in book] for k, book in books.items()}
        total = {k: [np.zeros((*e.shape,), np.int64) for e in book] for k, book in books.items()}
        count = {k: [np.zeros(len(e), np.int64) for e in book] for k, book in books.items()}
        for b in batches:
            for k, _, v in _blocks(b):
                for p in range(PARTS):
                    index, _ = files[k][p].nearest(v[:, p])
                    np.add.at(total[k][p], index, v[:, p])
                    count[k][p] += np.bincount(index, minlength=len(count[k][p]))
        rows = [(k, p, i, int(c), total[k][p][i]) for k in books for p in range(PARTS) for i, c in enumerate(count[k][p]) if c]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["length", "part", "entry", "n", "totals"])

    sums = vectors.mapInArrow(add, "length int, part int, entry int, n long, totals array<long>")
    sums = sums.select("length", "part", "entry", "n", F.posexplode("totals").alias("at", "total"))
    return sums.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def start(vectors: DataFrame, entries: int = ENTRIES) -> dict[int, list[np.ndarray]]:
    """Codebooks by length, as they begin: the parts of the kept vectors with the smallest ids."""
    lengths = sorted(r["length"] for r in vectors.select("length").distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors have more than {LENGTHS} different lengths")
    books = {}
    for k in lengths:
        # a codebook's worth of rows
        first = vectors.where(F.col("length") == k).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        v = np.frombuffer(b"".join(bytes(r["v"]) for r in first), np.int32).reshape(len(first), PARTS, k // PARTS).astype(np.int64)
        books[k] = [v[:, p].copy() for p in range(PARTS)]
    return books


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks by length after `rounds` rounds over all kept vectors; entries that nothing is assigned to stay."""
    books = start(vectors, entries)
    for _ in range(rounds if any(books) else 0):
        # as many rows as the codebooks have components
        for r in tally(vectors, books).collect():
            books[r["length"]][r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def digest(book: list[np.ndarray]) -> str:
    """sha256 of all components, decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for e in book for x in e.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """Kept vectors to (vec_id, label, code, error, codebooks_sha256): two hex digits a part, summed squared distances."""
    label = vectors.schema["label"].dataType.simpleString()
    names = {k: digest(book) for k, book in books.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {k: [Approximation(e) for e in book] for k, book in books.items()}
        for b in batches:
            for k, rows, v in _blocks(b):
                found = [files[k][p].nearest(v[:, p]) for p in range(PARTS)]
                indexes = np.stack([i for i, _ in found], 1).astype(np.uint8)
                own = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id"), own.column("label"), pa.array([x.tobytes().hex() for x in indexes]), pa.array(sum(x for _, x in found)), pa.array([names[k]] * len(rows))],
                    names=["vec_id", "label", "code", "error", "codebooks_sha256"],
                )

    return vectors.mapInArrow(code, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vectors(vec_id, embedding, label) to (vec_id, code, error, label_error, codebooks_sha256)."""
    lean(vectors.sparkSession)
    v = stage(kept(vectors), "vectors")
    coded = stage(encode(v, train(v, entries, rounds)), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    by = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), most).cast("long").alias("label_error"))
    by = stage(by, "labels")
    by = F.broadcast(by) if by.count() <= BROADCAST else by
    return coded.join(by, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op11_vafile(spark, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def oracle(entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, by comparing every part with every entry; for vectors of one length that PARTS divides."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (SELECT rn, part, min({{'d': p.xx - 2 * list_dot_product(p.x, c.c) + list_dot_product(c.c, c.c), 'e': entry}}) AS m FROM p JOIN c{k} c USING (part) GROUP BY rn, part)""")
        if k < rounds:
            steps.append(f"""
u{k} AS (SELECT part, entry, pos, floor(sum(x) / count(*)) AS y FROM (SELECT part, m.e AS entry, unnest(p.x) AS x, unnest(range(len(p.x))) AS pos FROM a{k} JOIN p USING (rn, part)) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT part, entry, list(y ORDER BY pos) AS c FROM u{k} GROUP BY ALL) n USING (part, entry))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS rn, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, x, list_dot_product(x, x) AS xx FROM (SELECT rn, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] AS x FROM v, (SELECT unnest(range({PARTS})) AS part))),
c0 AS MATERIALIZED (SELECT part, rn AS entry, x AS c FROM p WHERE rn < {entries}),{",".join(steps)},
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
r AS (SELECT rn, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rn),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM r JOIN v USING (rn) GROUP BY label)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM r JOIN v USING (rn) JOIN l ON v.label IS NOT DISTINCT FROM l.label, s"""
