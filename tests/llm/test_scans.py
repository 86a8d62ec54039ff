import re

import duckdb
import pandas as pd

from treesum.llm import chat, licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "...", "CC BY", "cc by cc by-sa. All Rights Reserved, general public license", "cc", "by cc", "all rights all rights reserved",
    "K cc by É", "general public", "Released under the MIT License.", "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated EXTRA documentation files (the Software), to deal in the Software without restriction",
    "permission is hereby granted", "cc-by " * 400, "the license of the software " * 50, "words and all rights reserved words " * 12_000,
]


def test_scan(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "CC BY"), (None, "cc by")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS h")
    got = licenses.scan(d).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    by = {r["doc_id"]: r for r in got}
    assert by[10]["labels"] == "mit" and by[11]["labels"] == "mit" and by[12]["labels"] == "" and by[14]["labels"] == ""
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.sql(licenses.oracle()).fetchall()
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got))) == sorted(str(tuple(r)) for r in want)
    assert licenses.scan(d.limit(0)).count() == 0


def test_preferences(spark):
    c = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", None),
        (2, 0, "user", "alone"), (5, 0, None, "x"), (4, 0, None, "x"), (6, None, "user", "a"), (6, None, "user", "a"), (7, None, "user", "a"),
        (-1, 0, "user", "n"), (-2, 0, "user", "n"), (None, 0, "user", "lost"),
    ]
    d = spark.createDataFrame(c, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS chosen", "2 AS pair_id")
    got = {r["pair_id"]: r for r in chat.preferences(chat.pairs_by_id(d)).collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3]
    r = got[0]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n" and r["n_prompt_turns"] == 1
    assert r["chosen"] == "<|assistant|>\ngood<|end|>\n" and r["chosen_mask"] == "14:0 11:1 1:0"
    assert r["rejected"].startswith("<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n")
    for r in got.values():
        for side in ("chosen", "rejected"):
            assert sum(int(x.split(":")[0]) for x in r[side + "_mask"].split()) == len(r[side])
    assert got[1]["prompt"] == "" and got[1]["rejected"] == "" and "alone" in got[1]["chosen"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and "unknown" in got[2]["prompt"]
    assert got[3]["n_prompt_turns"] == 0
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(c, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.values()))) == sorted(str(tuple(r)) for r in con.sql(chat.oracle(chat._BY_ID)).fetchall())
    assert chat.preferences(chat.pairs_by_id(d.limit(0))).count() == 0


def test_pairs_of_replies(spark):
    long = "word " * 60_000
    c = [
        (0, 0, "user", "q"), (0, 1, "assistant", "one two three four"), (0, 2, "user", "next"), (0, 3, "assistant", "five six seven"), (0, 4, "user", "thanks"),
        (1, 0, "user", "never answered"), (2, 0, "assistant", "short"), (3, 0, "user", None), (3, 1, "assistant", None), (4, 0, None, "x"), (4, None, "assistant", "a b"),
        (5, 1, "assistant", "a b c"), (5, 1, "assistant", "a b c"), (5, 1, "user", "u"), (None, 0, "user", "lost"), (6, 0, "user", long), (6, 1, "assistant", long),
    ] + [(7, i, ["user", "assistant"][i % 2], f"turn {i} {'y' * (i % 5)}") for i in range(400)]
    d = spark.createDataFrame(c, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS chosen", "2 AS pair_id", "3 AS last")
    got = {r["pair_id"]: r for r in chat.preferences(chat.pairs_of_replies(d)).collect()}
    assert sorted(got) == list(range(8))
    assert got[0]["n_prompt_turns"] == 3 and got[0]["chosen"] == "<|assistant|>\nfive six seven<|end|>\n" and got[0]["rejected"] == "<|assistant|>\nfive<|end|>\n"
    assert "thanks" not in got[0]["prompt"] and got[1]["chosen"] == got[1]["rejected"] == "" and "never" in got[1]["prompt"]
    assert got[2]["rejected"] == "" and got[3]["rejected"] == "" and got[5]["n_prompt_turns"] == 0
    assert got[6]["prompt"] == f"<|user|>\n{long}<|end|>\n" and got[7]["n_prompt_turns"] == 399
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(c, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    names = ["pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.values()))) == sorted(str(tuple(r)) for r in con.sql(chat.oracle()).fetchall())
    assert chat.preferences(chat.pairs_of_replies(d.limit(0))).count() == 0
