import math
import random
import zlib

import numpy as np
import regex

from treesum.llm import language, quality


def test_forward_sums_all_segmentations():
    p = language.pieces(language.default_vocabulary())
    r = np.random.default_rng(0)
    w = r.random((p.n, 2)) * np.array([0.01, 0.02])
    byte = {}
    for word in ("a", "the", "straße", "ünder"):
        raw = (" " + word).encode()
        # pieces by brute force over all cuts
        codes = p.code[np.frombuffer(raw, np.uint8)]

        def piece(i, j, codes=codes):
            s = 1
            for c in codes[i:j]:
                s = int(p.next[min(s, p.last) * p.width + c])
                if not s:
                    return -1
            return int(p.piece[s])

        total = [np.zeros(2) for _ in range(len(raw) + 1)]
        total[0] = np.ones(2)
        for j in range(1, len(raw) + 1):
            for i in range(j):
                k = piece(i, j)
                if k >= 0:
                    total[j] = total[j] + total[i] * w[k]
        byte[word] = np.log(total[-1])
    scale = w * language.SCALE ** p.length[:, None]
    got = p.forward(list(byte), scale)
    assert np.allclose(got, np.stack(list(byte.values())), rtol=1e-9)
    assert all(p.piece[p.next[p.width + p.code[b]]] >= 0 for b in b"az \xc3")


def log_word(p, word, logw):
    """log probability of a word by plain sums of logarithms over all pieces that end at each byte."""
    raw = (" " + word).encode()
    total = [0.0] + [-math.inf] * len(raw)
    for i in range(len(raw)):
        s = 1
        for j in range(i, len(raw)):
            s = int(p.next[min(s, p.last) * p.width + int(p.code[raw[j]])])
            if not s:
                break
            k = int(p.piece[s])
            if k >= 0:
                x, y = sorted((total[j + 1], total[i] + logw[k]))
                total[j + 1] = y + math.log1p(math.exp(x - y))
    return total[-1]


def test_long_words_do_not_underflow():
    """Runs of letters that no language has seen, far beyond the range of doubles, and one that a language knows better."""
    p = language.pieces(language.default_vocabulary())
    r = np.random.default_rng(3)
    w = r.random((p.n, 3)) * 1e-8
    words = ["ж" * 900, "漢字" * 700, "a" * 5000, "ab", "é" * 47 + "x", "þ" * 49]
    got = p.forward(words, w * language.SCALE ** p.length[:, None])
    for word, g in zip(words, got, strict=True):
        for k in range(3):
            assert abs(g[k] - log_word(p, word, np.log(w[:, k]))) < 1e-6 * abs(g[k]), (word[:5], k)
    fitted = [p.fit([("ж" if k else "ш") * 300, "common"], np.array([5.0, 1.0]), 2) for k in range(2)]
    m = language.Model(language.default_vocabulary(), ["sh", "zh"], np.stack(fitted, axis=1))
    assert m.scorer()(["ж" * 4000, "ш" * 4000])[0] == ["zh", "sh"]


def test_documents_by_brute_force(spark):
    """Predictions and scores of whole texts against plain sums, word by word."""
    r = random.Random(9)
    kinds = {"xx": ["th", "e", "ing"], "yy": ["ü", "sch", "ver"]}
    rows = [(i, tongue(r, kinds[k], 12), k) for i in range(40) for k in [("xx", "yy")[i % 2]]] + [(90, "Thing 12 SCH-ver " + "ж" * 200, "xx"), (91, "q", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(d.where("doc_id < 40"))
    p = language.pieces(m.path)
    by = {g["doc_id"]: g for g in language.identify(d, m).collect()}
    for i, t, _ in rows:
        words = regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower())
        s = [sum(log_word(p, w, np.log(m.p[:, k])) for w in words) for k in range(2)]
        assert by[i]["lang_pred"] == m.langs[int(np.argmax(s))]
        assert abs(by[i]["score"] - 1 / sum(math.exp((x - max(s)) / len(words)) for x in s)) < 1e-9


def test_fit_raises_likelihood():
    p = language.pieces(language.default_vocabulary())
    words, counts = ["the", "thing", "other", "then"], np.array([9.0, 3, 2, 1])
    last = -math.inf
    for rounds in (1, 2, 4):
        w = p.fit(words, counts, rounds)
        assert abs(w.sum() - 1) < 1e-9
        ll = float(counts @ p.forward(words, (w * language.SCALE**p.length)[:, None])[:, 0])
        assert ll > last
        last = ll


def tongue(r, sounds, n):
    return " ".join("".join(r.choice(sounds) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_identify(spark):
    r = random.Random(1)
    kinds = {"xx": ["th", "e", "ing", "ed", "on"], "yy": ["ü", "sch", "ver", "keit", "de"]}
    rows = [(i, tongue(r, kinds[k], 30), k) for i in range(120) for k in [("xx", "yy")[i % 2]]]
    odd = [(500, None, "xx"), (501, "", None), (502, "123 !!", "yy"), (None, rows[0][1], None), (503, "x" * 70_000, None), (0, rows[0][1], "xx"), (504, "ﬁ İ ß 日本", None)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'q' AS lang_pred")
    m = language.fit(d.where(~language.held_out(4, 2)), texts=50)
    assert m.langs == ["xx", "yy"]
    got = language.identify(d, m).collect()
    assert len(got) == len(rows) + len(odd)
    right = [g["lang_pred"] == g["lang"] for g in got if g["doc_id"] is not None and g["doc_id"] < 500 and zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2]
    assert len(right) > 15 and all(right)
    by = {g["doc_id"]: g for g in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502))
    assert by[None]["lang_pred"] == "xx" and all(0 <= g["score"] <= 1 for g in got)
    none = language.fit(d.limit(0))
    assert {x["lang_pred"] for x in language.identify(d, none).collect()} == {"und"}
    assert language.identify(d.limit(0), m).count() == 0


def test_blocks_do_not_change_the_maxima(monkeypatch):
    net = quality.Network()
    r = np.random.default_rng(2)
    texts = [r.integers(1, 255, n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 15, 16, 17, 24, 100, 1000, 4096)]
    whole = [net.pool(t) for t in texts]
    monkeypatch.setattr(quality, "BLOCK", 64)
    for t, w in zip(texts, whole, strict=True):
        assert np.allclose(net.pool(t), w, atol=1e-6), len(t)


def test_score_by_a_plain_pass():
    """The network over whole texts, chunk by chunk and byte by byte."""
    net = quality.Network(4)
    r = np.random.default_rng(8)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = [b"", b"a", b"abab" * 30, *(r.integers(1, 255, n, dtype=np.uint8).tobytes() for n in (16, 17, 40, 333))]
    for t, got in zip(texts, net.score(texts), strict=True):
        n = max(1, -(-(len(t) - quality.CHUNK) // quality.STEP) + 1)
        best = np.full(quality.FILTERS, -np.inf)
        for c in range(n):
            z = np.zeros(quality.FILTERS)
            for i in range(quality.CHUNK):
                at = c * quality.STEP + i
                b = t[at] if at < len(t) else 0
                z += p["E"][b] @ p["W"][i * quality.EMBED : (i + 1) * quality.EMBED]
                for lag in range(1, quality.LAGS + 1):
                    if b and at >= lag and t[at - lag] == b:
                        z += p["S"][lag - 1] / quality.CHUNK
            best = np.maximum(best, z)
        h = np.tanh(np.maximum(best + p["b"], 0) @ p["H"] + p["c"])
        want = 1 / (1 + math.exp(-(h @ p["v"] + p["d"][0] + net.shift)))
        assert abs(got - want) < 1e-4


def test_gradient():
    r = np.random.default_rng(1)
    net = quality.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    texts = [r.integers(97, 123, 60, dtype=np.uint8) for _ in range(4)]
    data = [quality.chunks(np.concatenate([np.zeros(quality.LAGS, np.uint8), t])) for t in texts]
    net.p["b"] += 5  # all filters fire, so that the gradient is exact
    y, w = np.array([0.0, 1, 1, 0]), np.ones(4)

    def loss():
        q = net.score([t.tobytes() for t in texts])
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    g = net._gradient(data, y, w)
    for k in ("W", "S", "H", "v", "c", "E"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-4
        up = loss()
        net.p[k][i] = old - 1e-4
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / 2e-4 - g[k][i]) < 0.02 * abs(g[k][i]) + 1e-5, k


def test_quality(spark):
    r = random.Random(5)
    good = lambda: tongue(r, ["th", "e", "ing", "ed", "on"], 60)
    bad = lambda: good().upper().replace(" ", "!! ")
    rows = [(i, good() if i % 2 else bad()) for i in range(160)] + [(900, None), (901, ""), (None, "a b c"), (902, good() * 2000), (3, rows_text := good())]
    labels = [(i, i % 2) for i in range(160)] + [(None, 1), (7, None), (5000, 0), (3, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS score", "1 AS quality")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    net = quality.fit(d.select("doc_id", "text"), lab.where(~language.held_out(3, 1)))
    got = quality.score(d, net).collect()
    assert len(got) == len(rows) and rows_text
    test = [g for g in got if g["doc_id"] is not None and g["doc_id"] < 160 and zlib.crc32(str(g["doc_id"]).encode()) % 3 == 1]
    assert len(test) > 30 and all((g["score"] >= 0.5) == (g["doc_id"] % 2 == 1) for g in test)
    assert all(0 <= g["score"] <= 1 for g in got)
    one = quality.fit(d.select("doc_id", "text"), lab.where("quality = 1"))
    assert {g["score"] for g in quality.score(d, one).collect()} == {1.0}
    # labels of documents that are not there, or only of one kind that is, train nothing
    away = spark.createDataFrame([(10_000 + i, i % 2) for i in range(50)] + [(1, 1), (3, 1)], "doc_id long, quality int")
    assert {g["score"] for g in quality.score(d, quality.fit(d.select("doc_id", "text"), away)).collect()} == {1.0}
    gone = quality.fit(d.select("doc_id", "text"), away.where("doc_id > 9"))
    assert {g["score"] for g in quality.score(d, gone).collect()} == {0.5}
    assert quality.score(d.limit(0), net).count() == 0


def test_letters_are_letters_with_their_marks(spark):
    assert language.words_of("½ ² Ⅷ ١٢ 3rd x2y e\u0301te\u0301 \u0301 É") == ["rd", "x", "y", "e\u0301te\u0301", "é"]
    assert language.words_of("हिन्दी में क़िताब") == ["हिन्दी", "में", "क़िताब"]
    rows = [(i, w, lang) for i in range(80) for w, lang in ((f"हिन्दी में लिखा {i}", "hi"), (f"written in english {i}", "en"))]
    rows = [(2 * i + (lang == "en"), t, lang) for i, (_, t, lang) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(d)
    odd = spark.createDataFrame([(0, "½", None), (1, "² Ⅷ 12", None), (2, "\u0301", None), (3, "हिन्दी", None), (4, "english", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[3][0] == "hi" and got[4][0] == "en"
