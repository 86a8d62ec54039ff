import random

import corpus_pipeline
from test_jaccard import brute
from test_mixing import water
from test_tokens import library


def build(spark, folder):
    r = random.Random(8)
    sounds = {"xx": ["th", "e", "ing", "ed", "on", "st"], "yy": ["ü", "sch", "ver", "keit", "de", "au"]}
    tongue = lambda k, n: " ".join("".join(r.choice(sounds[k]) for _ in range(r.randrange(1, 4))) for _ in range(n))
    rows = []
    for i in range(300):
        lang = ["xx", "yy"][i % 2]
        text = tongue(lang, r.randrange(20, 90))
        if i % 7 == 0:
            text = text.upper().replace(" ", "!! ")
        elif i % 9 == 4 and i > 20 and (i - 20) % 7:
            words = rows[i - 20][1].split()
            words[-1] = "changed"
            text = " ".join(words)
        rows.append((i, text, lang, ["a", "b", "c", None][i % 4], len(text)))
    rows.append((405, tongue("xx", 30_000), "xx", "b", 9))
    rows += [(400, None, "xx", "a", None), (401, "", None, None, 0), (402, "12 34 56", "yy", "b", 8), (404, "漢字かな " * 30, None, "b", 8), (None, tongue("xx", 40), "xx", "a", 9), rows[1], (5, tongue("xx", 40), "xx", "b", 1), (8, rows[2][1], "xx", "c", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns with names that stages use themselves
    d.selectExpr("*", "1.5 AS score", "'c' AS class", "7L AS copies", "true AS kept", "'k' AS _c0").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    build(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, seen[-1], folder)
        out.write.parquet(f"{folder}/{len(seen)}")
        seen.append(spark.read.parquet(f"{folder}/{len(seen)}"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[-1].columns == docs.columns
    keys = lambda d: sorted((tuple(x) for x in d.select("doc_id", "text").collect()), key=str)
    quality, language, groups, mix, last = seen[1:]
    # shouted documents go, the others stay
    kept = {k for k, t in keys(quality) if k is not None and k < 300}
    assert kept == {i for i in range(300) if i % 7} and None in {k for k, _ in keys(quality)}
    assert {k for k, t in keys(language)} == {k for k, t in keys(quality)} - {400, 401, 402, 404}
    rows = [tuple(x) for x in language.select("doc_id", "text").collect()]
    want, once = [], set()
    for (i, _, c), (j, t) in zip(brute_in_order(rows), rows, strict=True):
        if i is None or (i == c and (j, t) not in once):
            once.add((j, t))
            want.append((j, t))
    assert keys(groups) == sorted(want, key=str)
    sizes, taken = {}, {}
    for x in groups.collect():
        sizes[x["source"]] = sizes.get(x["source"], 0) + len(x["text"].split())
    for x in mix.collect():
        taken[x["source"]] = taken.get(x["source"], 0) + len(x["text"].split())
    for s, t in water(sizes).items():
        # the long document is taken a whole number of times
        assert abs(taken.get(s, 0) - t) < 0.1 * t + 90 + 30_000 * (s == "b")
    encode = library()
    assert sorted(((x["doc_id"], x["n_tokens"]) for x in last.collect()), key=str) == sorted(((x["doc_id"], len(encode(x["text"]))) for x in mix.collect()), key=str)


def brute_in_order(rows):
    """brute() gives sorted rows; ask for one row at a time by number."""
    n = [(k, t) for k, t in rows]
    named = [(None if k is None else k * 1000 + i, t) for i, (k, t) in enumerate(n)]
    by = {r[0]: r for r in brute(named) if r[0] is not None}
    out = []
    for (k, t), (m, _) in zip(n, named, strict=True):
        out.append((None, 0, None) if k is None else (k, by[m][1], by[m][2] // 1000))
    return out


def test_run_on_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
