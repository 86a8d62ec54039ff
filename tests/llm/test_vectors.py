import math

import numpy as np

from treesum.llm import topk, vectors

NAN, INF = float("nan"), float("inf")


def brute_topk(rows, every, k=5):
    ok = {}
    for i, e in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        e = [float(x) for x in e]
        ok[i] = min(ok.get(i, e), e)
    v = {i: [math.floor(256 * x) for x in e] for i, e in ok.items()}
    out = []
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def odd_rows(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * np.exp(r.normal(size=(n, 1)))
    x[10:40] = x[9] * (1 + 0.01 * r.normal(size=(30, dim)))
    x[50:60] = x[50]
    rows = [(i, [float(np.float32(y)) for y in x[i]]) for i in range(n)]
    return rows + [(n, None), (n + 1, [None] * dim), (n + 2, [NAN] * dim), (n + 3, [INF] + [0.0] * (dim - 1)), (n + 4, [0.0] * dim), (None, [1.0] * dim), (5, rows[5][1]), (7, [9.0] * dim), (n + 10, [1.0, 2.0]), (n + 11, [2.0, 1.0]), (n + 12, [])]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rows = odd_rows(300, 6, 1)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS dim")
    got = sorted(tuple(r) for r in topk.top_k(d, d.where("vec_id % 3 = 0")).collect())
    assert got == brute_topk(rows, 3)
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0


def test_top_k_beyond_doubles(spark):
    rows = [(i, [float((i * 7919) % 11 + 1) * 1e6, float(i)]) for i in range(0, 40)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(d, d.where("vec_id % 5 = 0")).collect()) == brute_topk(rows, 5)


def brute_links(rows, least=0.93):
    ok = {}
    for i, label, e in rows:
        x = (label, e)
        if i is not None:
            ok[i] = x
    good = {i: (lab, np.array(e, float)) for i, (lab, e) in ok.items() if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    n, link = dict.fromkeys(ok, 0), {i: {i} for i in ok}
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                n[i] += 1
                link[i].add(j)
    low = {i: i for i in ok}
    while True:
        new = {i: min(low[j] for j in link[i]) for i in ok}
        if new == low:
            break
        low = new
    return sorted((i, n[i], low[i], low[i] == i) for i in ok)


def links(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS id", "'x' AS part")
    return vectors.near_duplicates(d)


def test_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 32)
    r = np.random.default_rng(4)
    rows = []
    for g in range(30):
        c = r.normal(size=16)
        for k in range([1, 2, 3, 150][3 if g == 0 else g % 3]):
            rows.append((len(rows) * 2, g % 4, list(map(float, c + (0.05, 0.2)[g % 2] * r.normal(size=16)))))
    n = len(rows) * 2
    # a chain whose ends do not link, and copies
    rows += [(n + i, 1, [math.cos(i / 4), math.sin(i / 4)] + [0.0] * 14) for i in range(12)]
    rows += [(n + 50 + i, 2, rows[3][2]) for i in range(40)]
    rows += [(n + 100, None, rows[0][2]), (n + 101, 0, None), (n + 102, 0, [None] * 16), (n + 103, 0, [NAN] * 16), (n + 104, 0, [0.0] * 16), (n + 105, 1, [1.0, 0.0]), (n + 106, 1, [])]
    got = sorted(tuple(x) for x in links(spark, rows).collect())
    assert got == brute_links(rows)
    assert got == sorted(tuple(x) for x in links(spark, rows + rows[:3]).collect())


def test_links_of_nothing(spark):
    assert links(spark, [(1, 1, [1.0])]).limit(0).count() == 0
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<double>")).count() == 0
    assert [tuple(x) for x in links(spark, [(None, 1, [1.0])]).collect()] == [(None, 0, None, True)]


def table(spark, label, x):
    import pyarrow as pa

    rows = pa.table({"vec_id": np.arange(len(x)), "label": np.asarray(label, np.int32), "embedding": pa.array(list(x), pa.list_(pa.float64()))})
    return spark.createDataFrame(rows)


def test_many_copies_and_near_copies(spark):
    """20,000 exact copies and 6,000 near copies of other vectors: every link counts, none is lost to the length of a list."""
    r = np.random.default_rng(8)
    c = r.normal(size=(3, 16))
    near = c[1] + 0.02 * r.normal(size=(6000, 16))
    x = np.concatenate([np.repeat(c[:1], 20_000, 0), near, r.normal(size=(1000, 16)), c[2:]])
    label = np.array([1] * 20_000 + [2] * 6000 + [1, 2] * 500 + [1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {g["vec_id"]: g for g in vectors.near_duplicates(table(spark, label, x)).collect()}
    assert len(got) == len(x)
    for k in (1, 2):
        rows = np.flatnonzero(label == k)
        first, times = np.unique(u[rows], axis=0, return_index=True, return_counts=True)[1:]
        d = rows[first]
        hit = u[d] @ u[d].T >= 0.93
        np.fill_diagonal(hit, True)
        want = dict(zip(map(bytes, u[d]), (hit @ times) - 1, strict=True))
        assert all(got[int(i)]["n_links"] == want[bytes(u[i])] for i in rows)
    assert all(got[i]["component_id"] == 0 for i in range(20_000))


def test_recall_on_clusters(spark):
    """30,000 vectors in clusters of many sizes: the share of true links that is found, by vectors."""
    r = np.random.default_rng(10)
    sizes = r.zipf(1.7, 8_000).clip(1, 700)
    sizes = sizes[np.cumsum(sizes) <= 30_000]
    c = r.normal(size=(len(sizes), 24))
    x = np.repeat(c, sizes, 0)
    x += r.choice([0.05, 0.15, 0.25], len(x))[:, None] * r.normal(size=x.shape)
    label = np.repeat(r.integers(0, 4, len(sizes)), sizes)
    got = vectors.near_duplicates(table(spark, label, x)).orderBy("vec_id").toPandas()["n_links"].to_numpy()
    want = np.zeros(len(x), np.int64)
    for k in range(4):
        at = np.flatnonzero(label == k)
        u = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
        for lo in range(0, len(at), 2000):
            want[at[lo : lo + 2000]] = (u[lo : lo + 2000] @ u.T >= 0.93).sum(1) - 1
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum() > 100_000


def star(n, dim, seed, start=0, label=1):
    """Vectors that all link and are too far apart to share a ball."""
    r = np.random.default_rng(seed)
    c, y = np.eye(dim)[0], r.normal(size=(n, dim))
    y[:, 0] = 0
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return [(start + i, label, list(map(float, x))) for i, x in enumerate(c * math.sqrt(0.95) + y * math.sqrt(0.05))]


def test_links_beyond_the_longest_list(spark):
    rows = star(220, 64, 5) + [(1000 + i, 1, list(map(float, x))) for i, x in enumerate(np.random.default_rng(6).normal(size=(100, 64)))]
    assert sorted(tuple(x) for x in links(spark, rows).collect()) == brute_links(rows)


def test_links_where_no_pass_passes_the_audit(spark, monkeypatch):
    """Lists that find nothing: what the audit does not pass is settled exactly, in several chunks."""
    monkeypatch.setattr(vectors, "AGAIN", 1)
    monkeypatch.setattr(vectors, "CHUNK", 20_000)
    whole = vectors._lists
    monkeypatch.setattr(vectors, "_lists", lambda found, size: whole(found, size).where("false"))
    rows = star(60, 64, 5) + star(20, 64, 6, 100, 2) + [(200 + i, 1, [1.0] + [0.05] * 63) for i in range(9)]
    assert sorted(tuple(x) for x in links(spark, rows).collect()) == brute_links(rows)


def test_links_that_the_audit_does_not_see(spark, monkeypatch):
    """Few links among many nodes, and lists that find none: no sample of AUDIT nodes may pass them."""
    monkeypatch.setattr(vectors, "AUDIT", 8)
    monkeypatch.setattr(vectors, "PROBES", 32, raising=False)
    whole = vectors._lists
    monkeypatch.setattr(vectors, "_lists", lambda found, size: whole(found, size).where("false"))
    x = np.random.default_rng(7).normal(size=(400, 24))
    x[7], x[300] = x[5] + 0.3 * x[6], x[301] + 0.3 * x[302]
    rows = [(i, i // 250, list(map(float, e))) for i, e in enumerate(x)]
    want = brute_links(rows)
    assert sum(r[1] for r in want) == 4
    assert sorted(tuple(r) for r in links(spark, rows).collect()) == want


def test_tables_grow_with_bits():
    theta = math.acos(vectors.THRESHOLD)
    for bits in (0, 6, 10, 14, 20):
        missed = (1 - (1 - theta / math.pi) ** bits) ** vectors._tables(bits, theta)
        assert missed <= 1 - vectors.RECALL
