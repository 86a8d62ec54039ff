"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows are written to the shared folder with their place (partition and row). Runs of PART places are parts; from here on
   everything follows from places that are written down, so that a lost executor changes nothing.
2. The matrix of part x shard counts has the parts' sizes and the shards' exact sizes (at most one apart) as margins, and the
   distribution that a uniform permutation of all rows would give it. It is drawn in two levels: the driver draws what
   groups of about GROUP parts send to each shard (a row for millions of documents), each group draws its parts' counts by
   itself, from a stream keyed by seed and group.
3. Parts permute their rows by a keyed hash of the place; the first c rows, by the matrix, go to shard 0, and so on.
4. Shards permute what arrives by a second keyed hash. A shard is cut into ranges of the hash with about PART rows, which are
   counted, so that a row's slot is the rows in ranges before it and its rank in its own; no task sees a whole shard.

Law of the query: `rows`. One table, cut into the same partitions, gives the same shuffle for a seed.

Defined results: a null text has size 8 and crc32 0; rows that repeat are rows of their own, whatever ids are null or shared;
texts of any length count whole; shards are empty where there are fewer rows than shards; an empty table gives an empty result;
columns of the caller's that are named shard or slot give way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treesum.llm.common import hide, read, shown, stage

SHARDS, SEED = 24, 29
#: Bits of a place within a part: 8,192 rows; parts of a group.
PART_BITS, GROUP = 13, 512


def hypergeometric(u: float, good: int, bad: int, n: int) -> int:
    """The number of good ones among n drawn of good + bad, by inversion of u about the mode; exact to double precision for
    populations of any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    wide = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 30
    a, b = max(low, mode - wide), min(high, mode + wide)
    k = np.arange(a, b, dtype=np.float64)
    # p(k + 1) / p(k)
    step = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    p = np.concatenate(([0.0], np.cumsum(step)))
    c = np.cumsum(np.exp(p - p.max()))
    return a + min(len(c) - 1, int(np.searchsorted(c, u * c[-1], side="right")))


def draw(sizes: list[int], margins: list[int], key: list[int]) -> np.ndarray:
    """A matrix with these row and column sums (equal in total), as a uniform permutation gives it."""
    r = np.random.Generator(np.random.Philox(key=np.array(key, np.uint64)))
    left, out = list(margins), np.zeros((len(sizes), len(margins)), np.int64)
    for i, n in enumerate(sizes):
        rest, u = sum(left), r.random(len(margins))
        for s in range(len(margins)):
            c = hypergeometric(float(u[s]), left[s], rest - left[s], n)
            rest -= left[s]
            left[s] -= c
            n -= c
            out[i, s] = c
    return out


def matrix(parts: DataFrame, shards: int, seed: int) -> tuple[DataFrame, int]:
    """parts(part, n) to (part, upto array<long>: rows that go to shards 0 to s), and the number of rows."""
    n, many = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-many // GROUP))
    grouped = parts.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int"))
    # one number for about 4 million rows
    sizes = {r["group"]: r["n"] for r in grouped.groupBy("group").agg(F.sum("n").alias("n")).collect()}
    order = sorted(sizes)
    rows = draw([sizes[g] for g in order], [n // shards + (s < n % shards) for s in range(shards)], [seed, 1 << 40])
    margins = {g: [int(x) for x in row] for g, row in zip(order, rows, strict=True)}

    def own(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part")
        counts = draw([int(x) for x in g["n"]], margins[int(key[0])], [seed, int(key[0])])
        return pd.DataFrame({"part": g["part"].to_numpy(), "upto": list(counts.cumsum(1))})

    return grouped.groupBy("group").applyInPandas(own, "part long, upto array<long>"), n


def shuffled(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with shard (int, from 0) and slot (long, gapless from 0 in each shard) added."""
    d, names = hide(rows)
    d = stage(d.withColumn("_place", F.monotonically_increasing_id()), "places").withColumn("_part", F.shiftright("_place", PART_BITS))
    counts, n = matrix(d.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n")), shards, seed)
    mixed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("_place"))
    local = Window.partitionBy("_part").orderBy(mixed(0), "_place")
    d = d.withColumn("_rank", F.row_number().over(local)).join(counts.withColumnRenamed("part", "_part"), "_part")
    d = d.withColumn("shard", F.expr("size(filter(upto, c -> c < _rank))")).drop("_rank", "upto", "_part")
    ranges = max(1, -(-n // (shards << PART_BITS)))
    d = d.withColumn("_key", mixed(1)).withColumn("_range", F.least(F.floor((F.col("_key") / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int"))
    d = stage(d, "dealt")
    along = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row for about PART rows
    before = d.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_range").orderBy("_key", "_place")
    d = d.withColumn("_slot", F.row_number().over(inside)).join(before, ["shard", "_range"])
    return d.select(*shown(names, ("shard", "slot")), "shard", (F.col("_before") + F.col("_slot") - 1).cast("long").alias("slot"))


def write(placed: DataFrame, path: str, files: int = 200) -> None:
    """A shuffle of rows as Parquet, a folder for each shard, rows of a file in order of slots."""
    placed.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(d).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
