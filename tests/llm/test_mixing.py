import hashlib
import math
import re

import duckdb

from treesum.llm import mixing

W = (5, 2, 1)


def water(sizes):
    """Resharing as stated: targets above twice their source's size stop there, the excess goes to the rest by weight."""
    w = {s: W[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > 2 * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def run(spark, rows, **more):
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS size", "'t' AS target")
    return mixing.mix(d, **more)


def test_targets_and_takes(spark):
    rows = [(i, "w " * (i % 37), ["a", "b", "c", None, "é", ""][(i * i) % 6]) for i in range(3000)] + [(5, None, "a"), (None, "x y", None), (5, None, "a")]
    got = run(spark, rows, chunks=3).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(80, 0.02 * want[s])
    again = run(spark, rows, chunks=3).select("doc_id", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in run(spark, rows[::-1], chunks=3).select("doc_id", "copies").collect())


def test_copies_by_prefix_sums(spark, tmp_path):
    """Each document by a plain running sum along its source, and the query against its SQL."""
    rows = [(i, "w " * (i * i % 41), ["a", "b", "c", None, ""][i % 7 % 5]) for i in range(900)] + [(None, "x y", "a"), (7, "same id", "a"), (7, "same id", "a"), (901, None, "b"), (902, "é\u00a0e\x0bf", "c")]
    number = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16) / 2**32
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = water(sizes)
    want = []
    for s in sizes:
        u, each = number(17, "offset", s or "", str(s is None).lower()), target[s] / sizes[s]
        of = sorted((math.floor(math.sqrt(math.sqrt(size(t))) * 4), math.floor(number(17, "null" if i is None else i) * 8), size(t), number(17, "null" if i is None else i), -1 if i is None else i) for i, t, x in rows if x == s)
        for k, x in enumerate(of):
            copies = math.floor((k + 1) * each + u) - math.floor(k * each + u)
            want.append((None if x[4] < 0 else x[4], x[2], sizes[s], copies * x[2]))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op5_mixing(spark, f"file://{tmp_path}").collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got), key=str) == sorted(want, key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, con.sql(mixing.ORACLE).fetchall()))


def test_empty_and_wordless(spark):
    assert run(spark, [(1, "a", "s")]).limit(0).count() == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert {r["copies"] for r in run(spark, [(1, "", "s"), (2, None, "s")]).collect()} == {0}


def test_mixed_repeats_rows(spark):
    rows = [(i, "one two three", "ab"[i % 2]) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = mixing.mixed(d)
    assert n.columns == d.columns
    assert abs(n.count() - 300) <= 4
