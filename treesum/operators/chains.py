"""Draws of several chains in one numbering, back again, and as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def combine(draws: DataFrame, samples: int) -> DataFrame:
    """(chain, sample, ...) to (draw, ...): the draws of chain 0 first, then those of chain 1."""
    return draws.withColumn("draw", (F.col("chain") * samples + F.col("sample")).cast("int")).drop("chain", "sample")


def uncombine(draws: DataFrame, samples: int) -> DataFrame:
    """(draw, ...) to (chain, sample, ...)."""
    return draws.withColumns({"chain": F.expr(f"cast(draw div {int(samples)} as int)"), "sample": F.pmod("draw", F.lit(samples)).cast("int")}).drop("draw")


def by_row(draws: DataFrame, value: str = "value") -> DataFrame:
    """Combined draws (row_id, draw, value) to (row_id, values): one array per row, in order of draws."""
    listed = F.array_sort(F.collect_list(F.struct("draw", value)))
    return draws.groupBy("row_id").agg(F.transform(listed, lambda x: x[value]).alias("values"))


def by_draw(rows: DataFrame) -> DataFrame:
    """(row_id, values) to (row_id, draw, value), the inverse of by_row."""
    return rows.select("row_id", F.posexplode("values").alias("draw", "value"))
