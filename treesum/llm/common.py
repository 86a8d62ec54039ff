"""What several corpus operators share: staged tables, connected components, hashing of ids."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word rules of this subpackage have it.
SPACE = r"\x20\x09-\x0D"
#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 8 << 20
#: Edges of a table whose nodes are broadcast in a round of components.
FEW = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="treesum-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def lean(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES for what runs in this session from now on, unless it asks for less: two tasks of
    an executor hold a batch in the JVM and in Python each."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(key, None) or "").lower())
    if not found or int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidy(batches: Iterator, *then: Callable) -> Iterator:
    """batches, and when they end, or the task does, what remembers words is cleared and memory goes back to the system:
    workers are used again by other tasks. Until then nothing looks for cycles, of which these tasks make none."""
    gc.disable()
    try:
        yield from batches
    finally:
        for f in then:
            f()
        gc.enable()
        trim()


def trim() -> None:
    """Gives memory that nothing holds any more back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; each must be what stage() returned."""
    for df in staged:
        drop_path(df.sparkSession, df.staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): one row (id, component) per node that has an edge,
    component being its smallest node. Alternating large-star and small-star rounds; each round's edges are
    staged, minima are combined before the shuffle, and joins leave hot nodes to the skew join; minima of few edges, by
    count, are broadcast. An edge that several nodes bring is one at the end of a round."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, many = None, now.count()
    for _ in range(most):
        hint = F.broadcast if many <= FEW else (lambda x: x)
        # large-star: each node sends its larger neighbours to the smallest of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(hint(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # nodes that are the largest around them keep an edge to their minimum
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v")))
        # small-star: each node sends its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(last)
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before, many = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def hide(df: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """df with its columns renamed to _c0, _c1, ..., so that no name of the caller's clashes with ours; and (hidden, own) names."""
    names = [(f"_c{i}", c) for i, c in enumerate(df.columns)]
    return df.toDF(*(h for h, _ in names)), names


def shown(names: list[tuple[str, str]], but: tuple = ()) -> list:
    """Columns that bring the caller's names back; a caller's column named as one of ours gives way."""
    return [F.col(h).alias(c) for h, c in names if c not in but]
