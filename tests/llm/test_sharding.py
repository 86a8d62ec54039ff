import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from treesum.llm import sharding


def test_hypergeometric_is_exact():
    """Inversion at the steps of the distribution function, by binomial coefficients."""
    for good, bad, n in [(5, 7, 4), (10, 3, 9), (1, 1, 1), (40, 60, 50), (3, 0, 2), (0, 5, 3), (6, 6, 0), (6, 6, 12)]:
        p = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
        c = 0.0
        for k, x in p.items():
            if x > 1e-9:
                assert sharding.hypergeometric(c + x * 1e-3, good, bad, n) == k == sharding.hypergeometric(c + x * (1 - 1e-3), good, bad, n)
            c += x


def test_hypergeometric_of_large_populations():
    good, bad, n = 10**12, 23 * 10**12, 10**9
    r = np.random.default_rng(1)
    got = np.array([sharding.hypergeometric(u, good, bad, n) for u in r.random(400)], float)
    mean, sd = n / 24, math.sqrt(n * (1 / 24) * (23 / 24) * (1 - n / (good + bad)))
    assert abs(got.mean() - mean) < 4 * sd / 20 and 0.85 < got.std() / sd < 1.15


def test_matrix_has_its_margins_and_law():
    sizes, margins = [3, 0, 5, 2], [4, 3, 3]
    seen = Counter()
    for i in range(4000):
        m = sharding.draw(sizes, margins, [9, i])
        assert m.sum(1).tolist() == sizes and m.sum(0).tolist() == margins and (m >= 0).all()
        seen[int(m[0, 0])] += 1
    for k in range(4):
        p = math.comb(4, k) * math.comb(6, 3 - k) / math.comb(10, 3)
        assert abs(seen[k] / 4000 - p) < 0.04


def brute(places, n, shards, seed, matrix):
    """Shard and slot of each place by plain sorting, from the matrix of counts."""
    ranked, out = {}, {}
    for place, local, key in places:
        ranked.setdefault(place >> sharding.PART_BITS, []).append((local, place, key))
    for part, rows in ranked.items():
        upto = matrix[part]
        for rank, (_, place, key) in enumerate(sorted(rows), 1):
            out.setdefault(sum(c < rank for c in upto), []).append((key, place))
    return {place: (s, slot) for s, rows in out.items() for slot, (_, place) in enumerate(sorted(rows))}


@pytest.mark.parametrize(("rows", "bits"), [(3000, 5), (3000, 13), (10, 2), (0, 13), (24 * 7, 3)])
def test_shuffle(spark, monkeypatch, rows, bits):
    monkeypatch.setattr(sharding, "PART_BITS", bits)
    monkeypatch.setattr(sharding, "GROUP", 7)
    ids = [None if i % 3 == 0 else i // 2 for i in range(rows)]
    d = spark.createDataFrame([(i, "same" if i is None else f"é{i}") for i in ids], "doc_id long, text string").repartition(4).selectExpr("*", "'own' AS shard", "9 AS slot", "1 AS part", "2 AS upto")
    got = sharding.shuffled(d.withColumn("at", F.monotonically_increasing_id()))
    rows_ = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows_) == Counter((i, "same" if i is None else f"é{i}") for i in ids)
    per = Counter(r["shard"] for r in rows_)
    assert [per[s] for s in range(24)] == [rows // 24 + (s < rows % 24) for s in range(24)]
    for s in range(24):
        assert sorted(r["slot"] for r in rows_ if r["shard"] == s) == list(range(per[s]))
    # against sorting by hand, with the drawn matrix
    places = spark.createDataFrame([(r["at"],) for r in rows_], "p long")
    h = places.select("p", F.xxhash64(F.lit(29), F.lit(0), "p"), F.xxhash64(F.lit(29), F.lit(1), "p")).collect()
    counts = Counter(r["at"] >> bits for r in rows_)
    m, n = sharding.matrix(spark.createDataFrame(list(counts.items()), "part long, n long"), 24, 29)
    m = {r["part"]: r["upto"] for r in m.collect()}
    assert n == rows and all(m[p][-1] == c for p, c in counts.items())
    assert {r["at"]: (r["shard"], r["slot"]) for r in rows_} == brute([tuple(x) for x in h], n, 24, 29, m)
    again = sharding.shuffled(d.withColumn("at", F.monotonically_increasing_id())).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows_))


def test_shuffle_is_uniform(spark):
    """Shards of rows, and shards of pairs of neighbours, by chi-squared."""
    d = spark.range(48_000, numPartitions=6)
    got = {r["id"]: r for r in sharding.shuffled(d).collect()}
    cells = Counter((i // 8000, got[i]["shard"]) for i in got)
    assert sum((cells[b, s] - 8000 / 24) ** 2 / (8000 / 24) for b in range(6) for s in range(24)) < 5 * 23 + 4 * math.sqrt(2 * 5 * 23)
    pairs = Counter((got[i]["shard"], got[i + 1]["shard"]) for i in range(0, 48_000, 2))
    e = 24_000 / 576
    assert abs(sum((pairs[a, b] - e) ** 2 / e for a in range(24) for b in range(24)) - 575) < 5 * math.sqrt(2 * 575)
    slots = np.array([[i, got[i]["slot"]] for i in got if got[i]["shard"] == 3], float)
    assert abs(np.corrcoef(slots.T)[0, 1]) < 0.1
    other = {r["id"]: r["shard"] for r in sharding.shuffled(d, seed=30).collect()}
    assert 0.8 * 2000 < sum(other[i] == got[i]["shard"] for i in got) < 1.2 * 2000


def test_query_and_files(spark, tmp_path):
    texts = [None, "", "abc", "é" * 1000, "x" * 2_000_000] + ["copy"] * 200
    docs = [(i if i % 5 else None, t, None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op12_sharding(spark, str(tmp_path))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", None) for i, t, *_ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got.collect()) == want
    placed = sharding.shuffled(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    sharding.write(placed, f"{tmp_path}/shards", 3)
    back = spark.read.parquet(f"{tmp_path}/shards")
    columns = ["doc_id", "text", "shard", "slot"]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, placed.select(*columns).collect()))
