import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from treesum.llm import vafile


def brute(rows, entries, rounds):
    """rows (vec_id, vector, label) of one length: codes, errors and codebooks by comparing with every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    e = np.array([[int(np.clip(np.floor(1024 * float(np.float32(x))), -vafile.HELD, vafile.HELD)) for x in v] for _, v, _ in rows], dtype=object)
    e = np.concatenate([e, np.zeros((len(e), -e.shape[1] % 4), object)], 1)
    d = e.shape[1] // 4
    parts = [e[:, p * d : (p + 1) * d] for p in range(4)]
    books = [p[:entries].copy() for p in parts]

    def assign(x, book):
        dist = np.array([[sum((a - b) ** 2 for a, b in zip(r, c, strict=True)) for c in book] for r in x], dtype=object)
        return [min(range(len(book)), key=lambda j: (r[j], j)) for r in dist], [min(r) for r in dist]

    for _ in range(rounds):
        for p in range(4):
            at, _ = assign(parts[p], books[p])
            for j in set(at):
                own = [r for r, i in zip(parts[p], at, strict=True) if i == j]
                books[p][j] = sum(own) // len(own)
    found = [assign(parts[p], books[p]) for p in range(4)]
    sha = hashlib.sha256(",".join(str(x) for b in books for r in b for x in r).encode()).hexdigest()
    errors = [sum(f[1][i] for f in found) for i in range(len(rows))]
    total = {}
    for (_, _, label), x in zip(rows, errors, strict=True):
        total[label] = total.get(label, 0) + x
    return [(r[0], "".join(f"{f[0][i]:02x}" for f in found), errors[i], min(total[r[2]], 2**63 - 1), sha) for i, r in enumerate(rows)]


def vectors(n=150, dim=12):
    r = np.random.default_rng(4)
    centre = r.normal(size=(9, dim)) / 3
    rows = [(i * 3 - 40, (centre[i % 9] + r.normal(size=dim) * 0.05).tolist(), [None, 1, 2][i % 7 % 3]) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(40)] + [(rows[3][0], rows[3][1], 1), (None, rows[9][1], None), (2000, [0.0] * dim, 1), (2001, [1e30] * dim, 1), (2002, [-5e4] + [0.0] * (dim - 1), None)]
    return rows


@pytest.mark.parametrize(("entries", "dim"), [(20, 12), (256, 12), (1, 8), (20, 10)])
def test_equals_brute_force(spark, entries, dim):
    rows = vectors(dim=dim)
    out = [(1, None, 1), (2, [None] * dim, 1), (3, [float("nan")] * dim, 1), (4, [0.0] * (dim - 1) + [float("inf")], None)]
    d = spark.createDataFrame(rows + out, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS error", "2 AS length", "3 AS v").repartition(3)
    got = vafile.compress(d, entries)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute(rows, entries, vafile.ROUNDS)))


def test_lengths_apart_and_empty(spark, monkeypatch):
    rows = vectors(40, 8)
    other = [(i, [0.1 * i] * 4, 7) for i in range(5)] + [(9, [], 7)]
    d = spark.createDataFrame(rows + other, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in vafile.compress(d, 6).collect()]
    a, b = brute(rows, 6, 4), brute(other[:5], 6, 4)
    assert sorted(str((r[0], r[1], r[2], r[4])) for r in got) == sorted([str((r[0], r[1], r[2], r[4])) for r in a + b] + [str((9, "00000000", 0, hashlib.sha256(b"").hexdigest()))])
    assert vafile.compress(d.limit(0)).count() == 0
    assert vafile.compress(d.where("vec_id is null").selectExpr("vec_id", "cast(null as array<double>) embedding", "label")).count() == 0
    monkeypatch.setattr(vafile, "LENGTHS", 2)
    with pytest.raises(ValueError, match="lengths"):
        vafile.compress(d)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    entries, q = r.integers(-600, 600, (256, 16)), r.integers(-700, 700, (500, 16))
    entries[17] = entries[3]
    f = vafile.Approximation(entries)
    exact = ((q[:, None] - entries[None]) ** 2).sum(2)
    lower, upper = f.bounds(q)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.5
    index, distance = f.nearest(q)
    assert (index == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    index, distance = f.nearest(entries[[3, 17]])
    assert index.tolist() == [3, 3] and distance.tolist() == [0, 0]


def test_equals_sql(spark):
    rows = [r for r in vectors(120, 8) if r[0] is not None and abs(np.array(r[1])).max() < 1e4]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r) for r in rows])
    want = con.sql(vafile.oracle(30)).fetchall()
    got = vafile.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 30)
    assert sorted(map(str, want)) == sorted(map(str, (tuple(r) for r in got.collect())))
