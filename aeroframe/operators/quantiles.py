"""Exact percentiles of a whole column, however long, without gathering it in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .joins import few

#: Rows up to which one aggregate holds all values, and distinct values that are looked through at the end.
SMALL, NARROW = 1_000_000, 10_000


def exact_percentiles(df: DataFrame, column, shares: list[float], small: int = SMALL, narrow: int = NARROW) -> list[float | None]:
    """Interpolated percentiles of the non-null values; null of an empty column.

    A long column is narrowed down: an approximate percentile brackets the wanted
    rank, rows below the bracket are counted, and what lies in it is bracketed again
    until few distinct values are left. Every step is an aggregate."""
    v = df.select(column.cast("double").alias("v") if not isinstance(column, str) else F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = v.count()
    if n <= small:
        return list(v.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).first()["p"] or [None] * len(shares)) if n else [None] * len(shares)
    at = {k for s in shares for k in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))}
    value = {k: _ranked(v, n, k, narrow) for k in sorted(at)}
    out = []
    for s in shares:
        p = s * (n - 1)
        a, b = value[math.floor(p)], value[math.ceil(p)]
        out.append(a + (b - a) * (p - math.floor(p)))
    return out


def medians(df: DataFrame, columns, small: int = SMALL) -> dict[str, float | None]:
    """The exact median of each column, of short columns in one pass."""
    if df.count() > small:
        return {c: exact_percentiles(df, c, [0.5])[0] for c in columns}
    held = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.agg(*[F.percentile(held(c), 0.5).alias(c) for c in columns]).first().asDict()


def _ranked(v: DataFrame, n: int, k: int, narrow: int) -> float:
    """The value of rank k, from 0."""
    while True:
        if v.select(F.approx_count_distinct("v")).first()[0] <= narrow:
            counts = v.groupBy("v").count().orderBy("v").limit(2 * narrow).collect()
            seen = 0
            for r in counts:
                seen += r["count"]
                if seen > k:
                    return r["v"]
        share, slack = k / max(n - 1, 1), 3e-3
        lo, hi = v.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, share - slack)), F.lit(min(1.0, share + slack))), 2000).alias("p")).first()["p"]
        below, inside = v.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v").between(lo, hi))).first()
        if not below <= k < below + inside:  # never seen; the bracket is three times as wide as the error
            return v.orderBy("v").offset(k).limit(1).first()["v"]
        v, k, n = v.where(F.col("v").between(lo, hi)), k - below, inside


def grouped_percentiles(df: DataFrame, key: str, column, shares: dict[str, float]) -> DataFrame:
    """key and a column for each share: the percentiles that ``percentile`` gives for every key, of groups of any size.

    Distinct values are counted, sorted over all tasks by key and value, and written;
    counts by partition tell which partitions hold the wanted ranks, and these are
    numbered in a stream. No task holds a group. Keys that are null are left out."""
    v = df.select(key, (F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where(F.col(key).isNotNull() & F.col("v").isNotNull())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = materialise(v.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, key, "v").withColumn("__part", F.spark_partition_id()))
    by_key, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("__part")
    held = c.groupBy(key, "__part").agg(F.sum("n").alias("n"))
    held = held.select(key, "__part", (F.sum("n").over(so_far) - F.col("n")).alias("before"), F.sum("n").over(so_far).alias("upto"), F.sum("n").over(by_key).alias("all"))
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for n, s in shares.items()])).alias("w")
    want = held.select("*", named).withColumn("at", (F.col("all") - 1) * F.col("w.share"))
    want = want.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).where("rank >= before AND rank < upto")
    want = want.select(key, "__part", F.col("w.name").alias("name"), "at", (F.col("rank") - F.col("before")).alias("place"))
    want = few(want)
    inside = c.join(want.select(key, "__part"), [key, "__part"], "left_semi")
    last = F.sum("n").over(Window.partitionBy(key, "__part").orderBy("v"))
    met = inside.withColumn("last", last).join(want, [key, "__part"]).where("place >= last - n AND place < last")
    ends = met.groupBy(key, "name").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first("at").alias("at"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    ends = ends.withColumn("value", value)
    return ends.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in shares])
