"""A training-corpus pipeline over `documents`: quality, language, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame; all but the last
return the columns of documents. Stages are written as Parquet in the shared folder and read again.

Defined results: null and empty texts count as empty at the quality stage and go, if not there, at the language stage as
texts without letters; null languages train nothing and null sources are a source; rows that repeat are near duplicates
of each other, of which one stays; rows with a null id take no part in deduplication and stay; very long texts are read
whole by every stage; columns beyond those of documents are carried whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesum.llm import jaccard, language, mixing, quality, tokens
from treesum.llm.common import hide, shown, stage

#: Least probability of quality of documents that stay.
QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels outside the held-out fold, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    net = quality.fit(docs.select("doc_id", "text"), labels.where(~language.held_out(3, 1)))
    d, names = hide(docs)
    at = {c: h for h, c in names}
    d = quality.score(d.withColumn("text", F.col(at["text"])).drop(at["text"]), net)
    return d.where(F.col("score") >= QUALITY).withColumnRenamed("text", at["text"]).select(*shown(names))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that some learned language makes likelier than bytes drawn at random."""
    model = language.fit(docs.select("doc_id", "text", "lang").where(F.coalesce(~language.held_out(4, 2), F.lit(True))))
    d, names = hide(docs)
    at = {c: h for h, c in names}
    d = language.identify(d.withColumn("text", F.col(at["text"])).drop(at["text"]), model)
    return d.where((F.col("lang_pred") != "und") & (F.col("per_byte") > language.UNLIKELY)).withColumnRenamed("text", at["text"]).select(*shown(names))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows that share id and text, one. Rows with a null id or
    without words stay."""
    d, names = hide(docs)
    at = {c: h for h, c in names}
    key, text = at["doc_id"], at["text"]
    groups = stage(jaccard.join_components(d.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), classes=True), "groups").where("doc_id is not null")
    per = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.min("component_id").alias("least"))
    # ids that stand for one row are dropped by id; ids that several rows share are looked at row by row
    apart = stage(per.where("times > 1 or doc_id <> least").select(F.col("doc_id").alias(key), "times"), "apart")
    few = apart.count() <= jaccard.BROADCAST
    hint = F.broadcast if few else (lambda x: x)
    once = d.join(hint(apart.select(key)), key, "left_anti").select(*(h for h, _ in names))
    shared = apart.where("times > 1").select(key)
    if shared.isEmpty():
        return once.select(*shown(names))
    own = groups.withColumnRenamed("doc_id", key).join(hint(shared), key, "left_semi").where(F.col(key) == F.col("component_id")).select(key, "class").distinct()
    again = jaccard.with_class(d.join(hint(shared), key, "left_semi").withColumnRenamed(text, "text"), "class").withColumnRenamed("text", text)
    again = again.join(own, [key, "class"], "left_semi").dropDuplicates([key, "class"]).select(*(h for h, _ in names))
    return once.unionByName(again).select(*shown(names))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of what they decode to, one row per copy."""
    return tokens.digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", tokens_stage),
]

#: Trained models and a graph search are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
