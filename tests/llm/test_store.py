import random
import re
import zlib

import numpy as np
import pytest

from treesum.llm import store


def texts():
    r = random.Random(5)
    base = " ".join(r.choice(["the", "Çtre", "it's", "x1", "don't", "größe,", "12", "!!!", "café", "日本"]) + r.choice(["", "a", "."]) for _ in range(3000))
    return [None, "", "   ", base, base + " more", "start " + base, "İstanbul ß ſ ﬁ", "plain words, and 1234 numbers!", "a'b 'sad can't", "z" * 5000, "\x1c odd space x", "foo<|endoftext|>bar", "<|startoftext|> Ünd <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end oftext|>"]


def library():
    """The library as it comes, with nothing set."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(store.default_vocabulary())
    return lambda t: whole.encode(t or "", add_special_tokens=False).ids



def test_words_equal_library():
    w, encode = store.word_ids(store.default_vocabulary()), library()
    for t in texts():
        assert w(t or "") == w(t or "") == encode(t), (t or "")[:60]
    assert encode("foo<|endoftext|>bar") == [23435, 49407, 2411]
    ids, sizes = w.batch(texts() * 2)
    assert sizes.tolist() == [len(encode(t)) for t in texts()] * 2 and ids.tolist() == [i for t in texts() for i in encode(t)] * 2


def test_pieces_of_a_batch_are_looked_up_once(monkeypatch):
    """Texts are cut together, and words that repeat cost one look each batch."""
    w = store.WordIds(store.default_vocabulary())
    asked, own = [], w._numbered
    monkeypatch.setattr(w, "_numbered", lambda pieces, plain: asked.append(list(pieces)) or own(pieces, plain))
    many = ["the cat and the dog, 1991!\r\n"] * 300 + ["don't 日本 don't"] * 300 + [None, " "]
    encode = library()
    ids, sizes = w.batch(many)
    assert sizes.tolist() == [len(encode(t)) for t in many] and ids.tolist() == [i for t in many for i in encode(t)]
    assert sum(map(len, asked)) <= 12


def test_pieces_equal_a_pattern():
    r = random.Random(2)
    many = ["".join(r.choice("ab zÀß'ÿ\t\n\r019!-.é日") for _ in range(r.randrange(30))) or " " for _ in range(500)]
    for kinds, pattern, texts_ in ((store._PLAIN, "[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ÿ]+", [t.lower().replace("日", "") or " " for t in many]), (store._BLANKS, "[^ \t\n]+", many)):
        distinct, which, n = store.pieces(texts_, kinds)
        want = [re.findall(pattern, t) for t in texts_]
        assert [distinct[i] for i in which] == [p for x in want for p in x] and n.tolist() == [len(x) for x in want]
        assert len(set(distinct)) == len(distinct) == len({p for x in want for p in x})


def test_round_trip(spark, tmp_path):
    w = store.word_ids(store.default_vocabulary())
    encode = library()
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "nobody"), (3, "again"), (3, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'r' AS root")
    folder = f"file://{tmp_path}/s"
    store.write(d, folder)
    store.check_manifest(spark, folder)
    streams = {r["root"]: bytes(r["ids"]) for r in ((x.asDict()) for x in store.documents(spark, folder, w.width).collect())}
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], streams[r["root"]]) for r in store.index(spark, folder).collect()), key=lambda x: x[1])
    assert [x[0] for x in found] == [None] + sorted(r[0] for r in rows if r[0] is not None)
    want = sorted(((i, np.array([*encode(t), 2], "<u4").tobytes()) for i, t in rows), key=str)
    assert sorted(((x[0], x[3]) for x in found), key=str) == want
    crc = {bytes(r["root"]): (r["n"], r["crc32"]) for r in store.documents(spark, folder, w.width, sums=True).collect()}
    assert crc == {bytes(k): (len(v) // 4, zlib.crc32(v)) for k, v in streams.items()}
    at = 0
    for _, start, n, ids in found:
        assert start == at and n * 4 == len(ids)
        at += n
    chunks = spark.read.parquet(f"{folder}/chunks")
    assert chunks.count() == chunks.select("hash").distinct().count()
    # passages that documents share are stored once
    assert chunks.selectExpr("sum(n)").first()[0] < 0.6 * at


def test_damage_is_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    store.write(spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string"), folder)
    spark.read.parquet(f"{folder}/chunks").limit(1).write.parquet(f"file://{tmp_path}/x/chunks")
    spark.read.parquet(f"{folder}/places").write.parquet(f"file://{tmp_path}/x/places")
    spark.read.parquet(f"{folder}/recipes").write.parquet(f"file://{tmp_path}/x/recipes")
    spark.read.parquet(f"{folder}/manifest").where("false").write.parquet(f"file://{tmp_path}/x/manifest")
    with pytest.raises(Exception, match="missing"):
        store.documents(spark, f"file://{tmp_path}/x").collect()
    with pytest.raises(ValueError, match="manifest"):
        store.check_manifest(spark, f"file://{tmp_path}/x")


def test_empty(spark, tmp_path):
    folder = f"file://{tmp_path}/e"
    store.write(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert store.documents(spark, folder).count() == 0 and store.index(spark, folder).count() == 0


def test_crc_is_of_32_bit_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\0\0\0")
