import random

import numpy as np

from treesum.llm import jaccard


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w)} if 0 < len(w) < 5 else {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    low = [i for i in range(len(rows))]
    real = [i for i in range(len(rows)) if rows[i][0] is not None and sets[i]]
    top = {i: i for i in low}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in real:
        for b in real:
            k = len(sets[a] & sets[b]) if a < b else 0
            if k and 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                top[root(a)] = root(b)
    least = {}
    for i in real:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), least[root(i)] if i in real else rows[i][0]) for i in low), key=str)


def corpus(seed=2, n=260):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(4))
    line = " ".join(word() for _ in range(14))
    out = []
    for i in range(n):
        if out and r.random() < 0.55:
            w = r.choice(out[-40:]).split()
            for _ in range(r.randrange(0, 1 + len(w) // 18)):
                if w:
                    w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join([line] * (r.random() < 0.5) + [word() for _ in range(r.choice([0, 1, 3, 5, 6, 40, 120, 400]))]))
    rows = [(i * 3, t) for i, t in enumerate(out)]
    return rows + [(1, None), (4, ""), (7, " \n"), (10, "One TWO\tthree"), (13, "one two\nthree"), (None, out[5]), (3, out[1]), (3, out[1]), (6, "other text under an id that is there already today"), (16, "É é x y z w"), (19, "é é x y z w")]


def run(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'c' AS class")
    return sorted((tuple(x) for x in jaccard.join_components(d).collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rows = corpus()
    want = brute(rows)
    assert run(spark, rows) == want
    # few cells, many buckets and blocks, common shingles, ids joined by shuffle, one leader round, pairs of tiles: the same
    for name, v in (("CELLS", 1 << 12), ("SALT", 2), ("FINE", 9), ("BUCKET", 500), ("FLUSH", 700), ("HOT", 30), ("MOST", 9), ("BROADCAST", 0), ("LEADERS", 1), ("TILE", 300)):
        monkeypatch.setattr(jaccard, name, v)
    assert run(spark, rows) == want


def test_full_cells_leave_the_order_as_it_is(spark, monkeypatch):
    """Cells so few that nearly all hold more than HOT shingles: lists are those of exact counts, but for the commonest."""
    rows = [(i, t) for i, t in corpus(7, 1200) if i is not None]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    length = sum(len(t or "") for _, t in rows)

    def lists(cells, hot):
        for name, v in (("CELLS", cells), ("MOST_CELLS", cells), ("HOT", hot)):
            monkeypatch.setattr(jaccard, name, v)
        first = d.mapInArrow(lambda it: jaccard._first(it, cells, 64), jaccard._FIRST).cache()
        counts = jaccard._counted(first, jaccard._size(d))
        got = jaccard._lists(jaccard._entries(d, counts, 3)).groupBy("list").count().collect()
        return counts, sum(r["count"] for r in got), sum(r["count"] for r in got if r["count"] > 1), run(spark, rows)

    _, exact, shared, want = lists(1 << 18, 1 << 16)
    counts, rows_, shared_, found = lists(1 << 12, 1)
    assert (counts > 1).mean() > 0.9 and jaccard._common(counts).mean() < 0.25
    assert found == want and rows_ <= 1.1 * exact and shared_ <= 1.1 * shared
    # a table that is larger than its cells were made for has more of them
    monkeypatch.setattr(jaccard, "MOST_CELLS", 1 << 24)
    monkeypatch.setattr(jaccard, "BUCKET", 100)
    assert 4 * length / 600 < jaccard._size(d) <= 8 * length / 600


def test_sets_that_share_a_key(spark, monkeypatch):
    """The first 64 bits of all classes are cut to two."""
    rows = corpus(5, 120)
    monkeypatch.setattr(jaccard, "KEY", 2)
    assert run(spark, rows) == brute(rows)


def test_a_list_of_thousands(spark, monkeypatch):
    """5,000 texts with one of 60 words changed: texts of one place link, and texts of neighbouring places."""
    monkeypatch.setattr(jaccard, "LEADERS", 1)
    monkeypatch.setattr(jaccard, "TILE", 20_000)
    base = [f"w{i}" for i in range(60)]
    text = lambda place, k: " ".join(base[:place] + [f"x{place}y{k}"] + base[place + 1 :])
    places, each = [4, 10, 11, 16, 22, 28, 34, 40, 46, 52], 500
    rows = [(p * each + k, text(place, k)) for p, place in enumerate(places) for k in range(each)]
    few = [(p * each + k, text(place, k)) for p, place in enumerate(places) for k in range(3)]
    least = {i // each: c for i, _, c in brute(few)}
    got = run(spark, rows)
    assert len({c for _, _, c in got}) == len(set(least.values())) > 1
    assert all(n == 56 and c == least[i // each] for i, n, c in got)


def test_tree_finds_all_pairs():
    r = np.random.default_rng(3)
    sets = []
    for i in range(120):
        base = r.integers(0, 1 << 62, 60, dtype=np.uint64) if i % 3 == 0 else sets[-1].copy()
        if i % 3:
            base[r.integers(0, len(base), 5)] = r.integers(0, 1 << 62, 5, dtype=np.uint64)
        sets.append(np.unique(base))
    tree = jaccard.SignatureTree(np.array(list(map(len, sets))), [jaccard.bits(s) for s in sets], np.arange(120))
    found = {(int(a), int(b)) for i, j in tree.pairs() for a, b in zip(i, j, strict=True)}
    for a in range(120):
        for b in range(a + 1, 120):
            k = len(np.intersect1d(sets[a], sets[b]))
            if 100 * k >= 75 * (len(sets[a]) + len(sets[b]) - k):
                assert (a, b) in found
    assert len(found) < 1500


def test_nothing(spark):
    assert run(spark, [(1, "a b c d e f")])[0] == (1, 2, 1)
    assert jaccard.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_counts_come_in_few_jobs(spark):
    """The driver runs no job for each partition of a shuffle."""
    d = spark.createDataFrame([r for r in corpus(n=60) if r[0] is not None], "doc_id long, text string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    size = jaccard._size(d)
    first = d.mapInArrow(lambda it: jaccard._first(it, size, 64), jaccard._FIRST)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        before = jobs()
        assert jaccard._counted(first, size).sum() > 0
        assert jobs() - before < 10
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_components_with_and_without_broadcast(spark, monkeypatch):
    """Few edges are joined by broadcast, others by shuffle: the same, with edges that repeat and hot nodes."""
    from treesum.llm import common

    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1080)] + [(k, k + 1) for k in range(2000, 2040)] * 2
    least = {}
    for a, b in edges * 60:
        if a != b:
            least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    got = []
    for few in (common.FEW, 0):
        monkeypatch.setattr(common, "FEW", few)
        got.append(sorted(tuple(x) for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got[0] == got[1] == sorted(least.items())
