"""Cut points and bin codes as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treesum.sources.staging import staged

MOST_CUTS = 65_535


def _named(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("var"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    return df.select(F.explode(pairs).alias("p")).select("p.var", "p.v").where("v is not null")


def uniform(df: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """cuts(var, cut_idx, cut): n equal steps between minimum and maximum, one pass over df for all columns."""
    if not 1 <= n <= MOST_CUTS:
        raise ValueError(f"between 1 and {MOST_CUTS} cuts, not {n}")
    ends = df.agg(*[a for i, c in enumerate(columns) for a in (F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"))])
    one = ends.select(F.explode(F.array(*[F.struct(F.lit(i).alias("var"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i in range(len(columns))])).alias("e")).select("e.*")
    return one.select("var", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cut_idx")).select("var", "cut_idx", (F.col("lo") + (F.col("cut_idx") + 1) * (F.col("hi") - F.col("lo")) / (n + 1)).alias("cut"))


def _ranked(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(var, v, i, u, next): each distinct value, its place among the u distinct values of its column, from 0, and the value
    after it; and (var, u). Values are dealt out by range; places are places in a part plus the parts before, so no column is
    sorted in one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = _named(df, columns).distinct().repartitionByRange(parts, "var", "v").withColumn("part", F.spark_partition_id())
    d = staged(d, "distinct")
    before, inside = Window.partitionBy("var").orderBy("part"), Window.partitionBy("var", "part").orderBy("v")
    # a row per variable and part
    per = d.groupBy("var", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"))
    per = per.select("var", "part", (F.sum("n").over(before) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("var")).alias("u"), F.lead("first").over(before).alias("beyond"))
    d = d.withColumns({"j": F.row_number().over(inside) - 1, "after": F.lead("v").over(inside)}).join(F.broadcast(per), ["var", "part"])
    return d.select("var", "v", (F.col("base") + F.col("j")).alias("i"), "u", F.coalesce("after", "beyond").alias("next")), per.select("var", "u").distinct()


def ranked_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var, v, i, u): each distinct value and its place among the u distinct values of its column, from 0."""
    return _ranked(df, columns)[0].drop("next")


def quantile(df: DataFrame, columns: list[str], n: int = 100) -> DataFrame:
    """cuts(var, cut_idx, cut) between neighbours of the distinct values: all of them if there are at most n + 1, else
    those at k * floor(u / n) + floor(floor(u / n) / 2), at most u - 2."""
    r, sizes = _ranked(df, columns)
    step = F.floor(F.col("u") / n)
    every = F.col("u") <= n + 1
    k = F.explode(F.sequence(F.lit(0), F.when(every, F.col("u") - 2).otherwise(F.lit(n - 1)).cast("int")))
    counts = sizes.where("u > 1").select("var", "u", k.alias("cut_idx"))
    at = F.when(every, F.col("cut_idx").cast("long")).otherwise(F.least(F.col("cut_idx") * step + F.floor(step / 2), F.col("u") - 2))
    # at most n rows per column are looked up, each with its neighbour beside it, so values are ranked once
    wanted = counts.select("var", "cut_idx", at.alias("i"))
    return r.join(F.broadcast(wanted), ["var", "i"]).select("var", "cut_idx", ((F.col("v") + F.col("next")) * 0.5).alias("cut"))


def ragged(cuts: DataFrame) -> dict[int, list[float]]:
    """The cuts on the driver, by variable: at most the stated number per predictor."""
    out: dict[int, list[float]] = {}
    for r in cuts.orderBy("var", "cut_idx").collect():
        out.setdefault(r["var"], []).append(r["cut"])
    return out


def check_recut(old: int, new: int) -> str | None:
    """Fewer cuts than trees were grown on is an error; more are ignored, which is said."""
    if new < old:
        raise ValueError(f"{new} cuts where trees use {old}")
    return f"{new - old} cuts beyond the first {old} are ignored" if new > old else None


def code(x: Column, cuts: list[float]) -> Column:
    """Number of cuts strictly below x: a value equal to a cut stays left of it. A binary search in when-branches for up to
    64 cuts stays in generated code; more go by array."""
    if len(cuts) <= 64:

        def split(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x > F.lit(float(cuts[mid])), split(mid + 1, hi)).otherwise(split(lo, mid))

        return F.when(x.isNull(), None).otherwise(split(0, len(cuts)))
    return F.when(x.isNull(), None).otherwise(F.size(F.filter(F.array(*map(F.lit, map(float, cuts))), lambda c: c < x)))


def codes(df: DataFrame, columns: list[str], cuts: dict[int, list[float]]) -> DataFrame:
    return df.withColumns({f"{c}_bin": code(F.col(c), cuts.get(i, [])) for i, c in enumerate(columns)})
