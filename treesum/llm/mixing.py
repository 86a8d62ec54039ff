"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source is expected target / source_size times (never above the cap). Within a source the
documents stand in one deterministic order (by size class, then a hashed sub-chunk, then size, hash, id and text); the
running sum of expected copies, plus one random offset per source, emits a document once for each integer boundary it
crosses. Hashes are md5, so that SQL can tell the same.

A source may hold a third of all rows, so no window spans a source: documents are numbered inside chunks (source, size
class, hash chunk), and only the chunk totals are summed along the source. Chunks grow with the root of the rows, and so
do their totals.

Defined results: a null text has size 0; null sources are one source, ordered last; rows that repeat are separate
documents of equal order key; an empty table gives an empty result; a source whose documents are all empty has
target 0 and takes nothing; further columns are carried along under their own names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesum.functions.scalar import u01, u01_sql
from treesum.llm.common import hide, shown, stage

WEIGHTS = (5.0, 2.0, 1.0)
#: There are as many hash chunks as the root of the rows in thousands, so many at least.
CHUNKS = 8
SEED = 17


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target: the level at which min(cap * size, level * weight)
    adds up to share * all sizes, which is where resharing the excess by weight ends. The windows without a key see
    this table of sources only, never documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_r", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_r", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - capped) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the first source, by cap over weight, that the level of those not capped before it does not lift above its cap
    ranked = ranked.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_level"))).over(everything)["_level"]
    ranked = ranked.withColumn("_level", F.coalesce(first, F.max("_r").over(everything)))
    return ranked.withColumn("target", F.least(F.col("_cap"), F.col("_level") * F.col("_w"))).drop("_w", "_cap", "_r", "_level")


def _sized(d: DataFrame, doc: Column, text: Column, source: Column) -> DataFrame:
    """d with what the sample needs to know of its rows."""
    return d.withColumns({"_doc": doc, "_size": word_count(text), "_source": source, "_text": F.xxhash64(text)})


def _numbered(d: DataFrame, share: float, cap: float, weights: tuple, seed: int, chunks: int) -> DataFrame:
    """d of _sized; adds copies, source_size, target."""
    d = d.withColumn("_s", F.coalesce(F.col("_source").cast("string"), F.lit(""))).withColumn("_null", F.col("_source").isNull())
    d = d.withColumn("_h", u01(F.lit(seed), F.coalesce(F.col("_doc").cast("string"), F.lit("null"))))
    d = d.withColumn("_class", F.floor(F.sqrt(F.sqrt(F.col("_size").cast("double"))) * 4).cast("int"))
    # the number of rows comes from the file footers, without reading a column
    chunks = max(chunks, int(np.ceil(np.sqrt(d.select(F.lit(1)).count() / 1000))))
    d = d.withColumn("_chunk", F.floor(F.col("_h") * chunks).cast("int"))
    key = ["_s", "_null", "_class", "_chunk"]
    per = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"))
    sources = per.groupBy("_s", "_null").agg(F.sum("_words").alias("source_size")).withColumn("source", F.when(~F.col("_null"), F.col("_s")))
    sources = targets(sources, share, cap, weights).drop("source")
    along = Window.partitionBy("_s", "_null").orderBy("_class", "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).join(sources, ["_s", "_null"])
    per = per.withColumn("_u", u01(F.lit(seed), F.lit("offset"), F.col("_s"), F.col("_null"))).drop("_n", "_words")
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy("_size", "_h", "_doc", "_text"))).join(per, key)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda k: F.floor(k * each + F.col("_u"))
    copies = upto(F.col("_before") + F.col("_i")) - upto(F.col("_before") + F.col("_i") - 1)
    return d.withColumn("copies", F.least(copies, F.lit(int(-(-cap // 1)))).cast("int"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED, chunks: int = CHUNKS) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target and copies (int, 0 to cap) added."""
    d, names = hide(docs)
    at = {c: h for h, c in names}
    d = _sized(d, F.col(at["doc_id"]), F.col(at["text"]), F.col(at["source"]))
    added = ("size", "source_size", "target", "copies")
    d = _numbered(d, share, cap, weights, seed, chunks)
    return d.select(*shown(names, added), F.col("_size").alias("size"), *added[1:])


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: docs' own columns, each document as often as it is taken."""
    d, names = hide(docs)
    m = mix(d.withColumns({c: F.col(h) for h, c in names if c in ("doc_id", "text", "source")}), **parameters)
    return m.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*shown(names))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # words are counted once, and texts are read once
    sized = stage(_sized(docs, F.col("doc_id"), F.col("text"), F.col("source")).select("_doc", "_size", "_source", "_text"), "sizes")
    m = _numbered(sized, 1.5, 2.0, WEIGHTS, SEED, CHUNKS)
    return m.select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, {u01_sql(str(SEED), "coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS h FROM documents),
n AS (SELECT greatest({CHUNKS}, ceil(sqrt(count(*) / 1000.0))) AS chunks FROM documents),
k AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(sqrt(CAST(size AS DOUBLE))) * 4), floor(h * chunks), size, h, doc_id) AS k FROM d, n),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS c, 2.0::DOUBLE * source_size / w AS r FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(c) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM r),
t AS (SELECT source, source_size, least(c, w * coalesce((SELECT min_by(l, r) FROM l WHERE l <= r), (SELECT max(r) FROM l))) AS target,
      {u01_sql(str(SEED), "'offset'", "coalesce(source, '')", "(source IS NULL)")} AS u FROM l),
e AS (SELECT doc_id, size, source_size, target, k, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(k * e + u) - floor((k - 1) * e + u), 2) * size AS BIGINT) AS taken FROM e"""
