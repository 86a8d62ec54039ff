"""License scans by diagonal voting, in DataFrame operations only.

All rolling word k-grams of a text (k = 2 and 3, hashed) are joined to the positions of the same k-grams in fixed
templates. A match votes for its diagonal, text position less template position. Votes are counted per document,
template and diagonal, neighbouring diagonals (an inserted or missing word shifts the rest) are merged, and a span stands
if it covers enough of its template within a length near the template's.

Phrases (k = 2) stand only where every one of their k-grams votes on one diagonal, which is where their words stand
consecutively. Templates (k = 3) add labels of their own.

The template side is fixed (a few hundred rows whatever the input) and is broadcast; nothing else is. Each document
also casts one vote for itself, so that documents without a match come out of the same aggregation and repeated rows
are counted; a document is one key, and no key gathers rows of several documents that differ.

Defined results: a null text counts as empty (0 words, no labels, score 0); repeated rows give repeated rows; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wording of public licenses and of the notices that name them.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Share of a template's k-grams that a span must cover; its length at most, in templates; diagonals this near merge.
COVER, STRETCH, NEAR = 0.8, 1.5, 3


def _grams(words: str, k: int) -> str:
    """SQL for an array with the hash of the k words from each word on; the last k - 1 are null."""
    rest = ", ".join(f"get({words}, i + {j})" for j in range(1, k))
    return f"transform({words}, (w, i) -> if(i + {k} <= size({words}), xxhash64({k}, w, {rest}), null))"


def template_grams(spark, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """(h, tid, label, base, tpos, need): positions of the templates' k-grams. Its size is fixed by the templates."""
    rows = [F.struct(F.lit(i).alias("tid"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.split(F.lit(text), " ").alias("ws")) for i, (text, label, base) in enumerate([(*p, True) for p in phrases] + [(*t, False) for t in templates])]
    t = spark.range(1).select(F.inline(F.array(*rows)))
    t = t.withColumn("g", F.when(F.col("base"), F.expr(_grams("ws", 2))).otherwise(F.expr(_grams("ws", 3))))
    t = t.select("tid", "label", "base", F.expr("filter(g, x -> x is not null)").alias("g"))
    t = t.select("tid", "label", "base", F.size("g").alias("need"), F.posexplode_outer("g").alias("tpos", "h"))
    own = spark.range(1).select(F.lit(-1).alias("tid"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("base"), F.lit(1).alias("need"), F.lit(None).cast("int").alias("tpos"), F.lit(0).cast("long").alias("h"))
    return t.unionByName(own)


def spans(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """Verified spans (doc_id, text_hash, n_words, times, label, base, start, stop, cover), stop exclusive, in words;
    each document also has one row without a label. times: how often the row occurs."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("ws"))
    # 0 stands for the document itself
    d = d.select("doc_id", "text_hash", F.size("ws").alias("n_words"), F.expr(f"concat({_grams('ws', 2)}, {_grams('ws', 3)}, array(0L))").alias("g"))
    # outer: for the inner form the optimizer infers a filter on the array, pushes it down and computes the words in it again
    d = d.select("doc_id", "text_hash", "n_words", F.posexplode_outer("g").alias("at", "h")).where("h is not null")
    hits = d.join(F.broadcast(template_grams(docs.sparkSession, phrases, templates)), "h")
    pos = F.when(F.col("tid") >= 0, F.col("at") - F.when(F.col("at") >= F.col("n_words"), F.col("n_words")).otherwise(0))
    hits = hits.withColumn("diagonal", pos - F.col("tpos"))
    key = ["doc_id", "text_hash", "n_words"]
    votes = hits.groupBy(*key, "tid", "label", "base", "need", "diagonal").agg(F.collect_set("tpos").alias("tpos"), F.count(F.lit(1)).alias("times"))
    votes = votes.withColumn("size", F.size("tpos"))
    order = Window.partitionBy(*key, "tid").orderBy("diagonal")
    fresh = F.col("base") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    votes = votes.withColumn("run", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = votes.groupBy(*key, "tid", "label", "base", "need", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("covered"),
        F.min(F.col("diagonal") + F.array_min("tpos")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("tpos")).alias("last"),
        F.sum(F.when(F.col("tid") < 0, F.col("times"))).alias("times"),
    )
    k = F.when(F.col("base"), 2).otherwise(3)
    merged = merged.withColumn("stop", F.col("last") + k).withColumn("cover", F.col("covered") / F.col("need"))
    long_enough = F.when(F.col("base"), F.col("covered") == F.col("need")).otherwise((F.col("cover") >= COVER) & (F.col("stop") - F.col("start") <= STRETCH * (F.col("need") + k - 1)))
    return merged.where((F.col("tid") < 0) | long_enough).select(*key, "times", "label", "base", "start", "stop", "cover")


def scan(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    d = spans(docs, phrases, templates).groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum("times").alias("times"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("cover"))), F.lit(0.0)).alias("score"),
    )
    d = d.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return d.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle(phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> str:
    """The same in DuckDB's SQL, on word strings instead of hashes."""
    rows = ", ".join(f"({i}, '{t}', '{label}', {str(i < len(phrases)).lower()})" for i, (t, label) in enumerate([*phrases, *templates]))
    return f"""
WITH t0(tid, phrase, label, base) AS (VALUES {rows}),
t1 AS (SELECT *, string_split(phrase, ' ') ws, CASE WHEN base THEN 2 ELSE 3 END k FROM t0),
t AS (SELECT tid, label, base, k, len(ws) - k + 1 AS need, tpos, array_to_string(ws[tpos + 1 : tpos + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(ws) - k + 1)) AS tpos FROM t1)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS a, unnest(range(0, len(ws))) AS pos FROM d),
g0 AS (SELECT rid, pos, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
g AS (SELECT rid, pos, 2 AS k, a || ' ' || b AS gram FROM g0 WHERE b IS NOT NULL UNION ALL SELECT rid, pos, 3, a || ' ' || b || ' ' || c FROM g0 WHERE c IS NOT NULL),
v AS (SELECT rid, tid, label, base, k, need, pos - tpos AS diagonal, list(DISTINCT tpos) AS tpos FROM g JOIN t USING (k, gram) GROUP BY ALL),
f AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {NEAR} THEN 1 ELSE 0 END AS fresh FROM v WINDOW o AS (PARTITION BY rid, tid ORDER BY diagonal)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tid ORDER BY diagonal) AS run FROM f),
m AS (SELECT rid, tid, label, base, k, need, run, len(list_distinct(flatten(list(tpos)))) AS covered, min(diagonal + list_min(tpos)) AS start, max(diagonal + list_max(tpos)) AS last FROM r GROUP BY ALL),
s AS (SELECT * FROM m WHERE CASE WHEN base THEN covered = need ELSE covered >= {COVER} * need AND last + k - start <= {STRETCH} * (need + k - 1) END),
x AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
      array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(covered / need) AS score FROM s GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN x USING (rid)"""
