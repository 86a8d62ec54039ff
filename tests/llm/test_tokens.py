import hashlib
import random
import time

import numpy as np

from treesum.llm import tokens


def library():
    import base64

    import tiktoken

    path, pattern = tokens.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def cases():
    r = random.Random(3)
    out = ["", " ", "\n\n  \n", "a", "it's we'll", "x" * 5000, "ab" * 3000 + " " + "é" * 2000, " " * 3000 + "end", "日本語" * 500, "日本，語。" * 300, "1" * 700 + "a" * 300 + "!" * 400]
    out += ["a\u0301b " * 90, "'s't" * 200, "don't " * 200, "''re" * 150, "\x1c\x85\ufeff\u200b x" * 60, "\r\n \t" * 90, "😀é" * 400]
    for _ in range(80):
        out.append("".join(r.choice("ab e\n\tü12!?'s  日") for _ in range(r.randrange(1, 900))))
    return out


def test_tree_equals_library_whatever_the_leaf():
    path, pattern = tokens.default_vocabulary()
    want = library()
    for leaf, piece in ((1, 1), (3, 2), (7, 64), (40, 8), (tokens.LEAF, tokens.PIECE)):
        e = tokens.TreeBPE(path, pattern, leaf, piece)
        for t in cases():
            ids = e.encode(t)
            assert ids == want(t), (leaf, piece, t[:80])
            assert e.decode(ids) == t.encode()


def test_a_very_long_text():
    e, want = tokens.encoder(*tokens.default_vocabulary()), library()
    r = random.Random(4)
    t = " ".join("".join(r.choice("aeioubcdé") for _ in range(r.randrange(1, 12))) for _ in range(60_000)) + "z" * 15_000
    ids = e.encode(t)
    assert ids == want(t) and e.decode(ids) == t.encode()


def test_runs_of_one_mark_take_no_more_than_their_length():
    e, want = tokens.encoder(*tokens.default_vocabulary()), library()
    for mark in ("-", "=", " ", "a", "\n", "-=", "abc", "é"):
        for n in (700, 5_000, 100_003):
            t = "head " + mark * n + " tail"
            assert e.encode(t) == want(t), (mark, n)
    for mark in "-= a":
        t = "it's " + mark * 1_000_000
        began = time.perf_counter()
        ids = e.encode(t)
        assert time.perf_counter() - began < 10, mark
        assert e.decode(ids) == t.encode()
    mixed = "".join(m * 3_000 + "\n" for m in "-=#* a9'\t") * 4
    assert e.encode(mixed) == want(mixed)


def test_merges_with_and_without_a_heap():
    e = tokens.encoder(*tokens.default_vocabulary())
    r = random.Random(8)
    for _ in range(200):
        piece = bytes(r.choice(b"abe-= \xc3\xa9") for _ in range(r.randrange(2, 250)))
        if piece not in e.ranks:
            assert e._merge(piece) == e._merge_long(piece)


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "hello there"), (3, "naïve café")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "'x' AS ids")
    got = sorted(map(tuple, tokens.digests(d).collect()), key=str)
    encode = library()
    want = []
    for i, t in rows:
        ids = encode(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = tokens.decode(tokens.encode(d))
    assert sorted((r[0], bytes(r[1])) for r in back.collect() if r[0]) == sorted((i, (t or "").encode()) for i, t in rows if i)
    assert tokens.digests(d.limit(0)).count() == 0
