import math
import random
import re

import duckdb
import pandas as pd
import pytest

from treesum.llm import lexical


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, k=50):
    """Scores of every document for every item, by the formula."""
    ws = [(i, words(t)) for i, t in docs]
    n, length = sum(bool(w) for _, w in ws), sum(len(w) for _, w in ws)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    df = {t: sum(t in w for _, w in ws) for t in set().union(*terms.values())} if terms else {}
    out = []
    for i, own in terms.items():
        found = []
        for doc, w in ws:
            m = 50 + (50 * len(w) * n) // length if w else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in own if t in w)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(i, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    r = random.Random(5)
    vocabulary = ["the", "of", "été", "x1", *(f"w{i}" for i in range(60)), "K", "ÉTÉ"]
    docs = [(i, " ".join(r.choices(vocabulary, [1 / (j + 1) for j in range(len(vocabulary))], k=r.randint(0, 40)))) for i in range(400)]
    docs += [(i, "THE w3_w4;w5 copies") for i in range(400, 520)] + [(7, "w1 w2 repeated"), (7, "w1 w2 repeated"), (None, "w3 w4"), (None, "w3 w4"), (None, None), (600, None), (601, ""), (602, " .,_\n")]
    docs += [(603, "w3 " * 40_000 + "tail w59"), (604, "nowhere\x00else w59 w58")]
    items = [(0, "the w3 w4 w5 copies"), (1, "w59 w58 zebra"), (2, None), (3, "...") , (4, "zebra"), (5, "w1 w1 W2"), (6, " ".join(vocabulary)), (6, "copies"), (None, "tail"), (8, "ÉTÉ été")]
    return docs, items


@pytest.mark.parametrize("shard", [lexical.SHARD, 2_000])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "START", 40)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS terms", "3 AS row").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS term", "2 AS score")
    for k in (50, 3):
        got = lexical.top_documents(d, i, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items, k)
    assert lexical.top_documents(d.limit(0), i).count() == 0
    assert lexical.top_documents(d, i.limit(0)).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 20)
    docs, items = corpus()
    got = lexical.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_equals_sql(spark):
    docs, items = corpus()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert sorted(map(str, con.sql(lexical.ORACLE).fetchall())) == sorted(map(str, brute(docs, items)))


def test_wand_skips_and_keeps_ties():
    r = random.Random(3)
    for _ in range(300):
        lists = []
        for _ in range(r.randint(1, 6)):
            docs = sorted(r.sample(range(60), r.randint(1, 40)))
            impacts = [r.randint(1, 5) for _ in docs]
            lists.append((docs, impacts, max(impacts)))
        total = {}
        for docs, impacts, _ in lists:
            for d, x in zip(docs, impacts, strict=True):
                total[d] = total.get(d, 0) + x
        want = sorted(((s, d) for d, s in total.items()), key=lambda x: (-x[0], x[1]))[:7]
        kth = want[-1][0] if len(want) == 7 else 1
        for floor in (0, kth - 1):
            assert sorted(lexical.wand(lists, 7, floor), key=lambda x: (-x[0], x[1])) == want


def test_wand_reads_few_documents():
    """A list with no weight to speak of is stepped over, not read."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            if isinstance(i, int):
                Counted.reads += 1
            return list.__getitem__(self, i)

    long, rare = Counted(range(100_000)), list(range(0, 100_000, 1000))
    got = lexical.wand([(long, [1] * 100_000, 1), (rare, [100] * 100, 100)], 5, 0)
    assert sorted(got, key=lambda x: x[1]) == [(101, d) for d in (0, 1000, 2000, 3000, 4000)]
    assert Counted.reads < 5_000


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 10)
    text = ("ab cde " * 50 + "x" * 100 + " ab").encode()
    n, found = lexical.count_terms(text, {b"ab": 0, b"x" * 100: 1}.get)
    assert n == 102 and found == {0: 51, 1: 1}
