"""The tables behind the usual plots of a fit; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesum.sources.staging import staged


def trace(params: DataFrame, name: str = "sigma") -> DataFrame:
    """(chain, phase, iteration, value): a parameter along each chain, burn-in first."""
    p = params.where(F.col("name") == name)
    burn = F.coalesce(F.max(F.when(F.col("phase") == "burn", F.col("sample") + 1)).over(Window.partitionBy("chain")), F.lit(0))
    return p.select("chain", "phase", F.when(F.col("phase") == "burn", F.col("sample")).otherwise(F.col("sample") + burn).cast("int").alias("iteration"), "value")


def intervals(draws: DataFrame, frame: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(row_id, y, low, mid, high): posterior intervals of draws(row_id, value) against the response."""
    q = [F.percentile("value", F.lit(p)).alias(n) for p, n in ((low, "low"), (0.5, "mid"), (high, "high"))]
    return draws.groupBy("row_id").agg(*q).join(frame.select("row_id", "y"), "row_id").select("row_id", "y", "low", "mid", "high")


def bands(dependence: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(level1[, level2], low, mid, high) of dependence.partial over draws; with two levels the surface is mid."""
    by = [c for c in ("level1", "level2") if c in dependence.columns]
    return dependence.groupBy(*by).agg(*[F.percentile("value", F.lit(p)).alias(n) for p, n in ((low, "low"), (0.5, "mid"), (high, "high"))])


def descending(rows: DataFrame, by: Column) -> DataFrame:
    """rows with place: 1 for the largest of by, ties in order of row_id; rows are ranked in ranges of by, not in one task."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # staged, so that both uses below see the same ranges
    d = staged(rows.withColumn("_by", by).repartitionByRange(parts, F.col("_by").desc_nulls_last(), F.col("row_id")).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row per part
    per = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    per = per.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("_by").desc_nulls_last(), "row_id"))
    return d.withColumn("_i", inside).join(F.broadcast(per), "_part").withColumn("place", F.col("_before") + F.col("_i")).drop("_by", "_part", "_i", "_before")


def codes(rows: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values numbered from 1 in their order, for grouping factors; nulls have no code. Values are
    few by nature; they are ranked in one task, and more than a million are an error."""
    d = rows.select(column).where(F.col(column).isNotNull()).distinct()
    n = d.count()
    if n > 1_000_000:
        raise ValueError(f"{n} distinct values of {column} are no factor")
    return d.withColumn("code", F.row_number().over(Window.orderBy(column)).cast("int"))
