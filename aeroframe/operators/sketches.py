"""Approximate aggregates that merge: sketches by key and day, rolled up to any coarser key without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_sketches(df: DataFrame, keys: list[str], t: str, item: str, value: str) -> DataFrame:
    """keys, day, n, total, lo, hi and a sketch of the distinct items: a table that grows with keys and days, not with rows."""
    return df.groupBy(*keys, F.to_date(t).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.hll_sketch_agg(item, 14).alias("items"))


def rolled_up(sketches: DataFrame, keys: list[str], period: Column | None = None) -> DataFrame:
    """Sketches of finer keys or days brought together: keys, period, n, mean, lo, hi, distinct (estimated within about a percent)."""
    by = [*map(F.col, keys), *([period.alias("period")] if period is not None else [])]
    out = sketches.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.hll_union_agg("items").alias("items"))
    return out.withColumn("distinct", F.hll_sketch_estimate("items")).drop("items")
