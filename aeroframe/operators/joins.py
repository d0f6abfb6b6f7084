"""Equi-joins that stay even where a few keys hold much of one side, and row numbers over whole tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: A key with fewer rows than this is never dealt to several tasks.
LEAST_HOT = 1000


def even_join(left: DataFrame, right: DataFrame, on: list[str], salt: list[str], how: str = "inner", least: int = LEAST_HOT) -> DataFrame:
    """Equi-join of ``left`` with a ``right`` of few rows a key; how: inner, left, left_semi or left_anti.

    Keys that hold more than half a partition's share of ``left`` are found by an
    exact count; there are at most twice as many of them as partitions. The rows of
    such a key are dealt by a hash of the ``salt`` columns to as many tasks as they
    fill shares, and its right rows are copied to each. Null keys match nothing but
    are dealt alike. ``left`` is counted twice, so it should be a written table."""
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = left.count()
    share = max(least, n // (2 * parts))
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > share)
    hot = counts.collect() if n > share else []
    if not hot:
        return left.join(right, on, how)
    table = spark.createDataFrame([(*list(r)[:-1], math.ceil(r["__rows"] / share)) for r in hot], counts.schema)
    named = F.broadcast(table.select(*[F.col(c).alias(f"__hot_{c}") for c in on], F.col("__rows").alias("__shares")))

    def with_shares(df):
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__hot_{c}")) for c in on])
        return df.join(named, same, "left").drop(*[f"__hot_{c}" for c in on])

    dealt = with_shares(left).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__shares")), F.lit(0).cast("long"))).drop("__shares")
    copied = with_shares(right).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__shares", F.lit(1).cast("long")) - 1))).drop("__shares")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")


def sorted_join(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """Equi-join that is never a broadcast, for tables of many small rows.

    Spark takes rows that a generator makes for about as large as what they came from,
    and a written table for as large as its compressed files, so it may broadcast
    millions of rows."""
    return left.join(right.hint("merge"), on, how)


#: Rows of a written table that are broadcast at most.
FEW_ROWS = 100_000


def few(df: DataFrame) -> DataFrame:
    """The rows written and, if counted to be few, marked for a broadcast, else for a sorted join: for tables of a row a group, which Spark takes for as large as what they sum up."""
    rows = materialise(df)
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows.hint("merge")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to as many tasks as a shuffle has partitions: a small file is one task, however much work its rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def numbered(df: DataFrame, order: str, out: str = "i", keys: list[str] | None = None) -> DataFrame:
    """Adds the row's number in order, from 1, inside its keys or in the whole table.

    A whole table is range-partitioned and written; rows are numbered inside their
    partition, and partitions by the counts of those before, one number a partition."""
    if keys:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    parts = materialise(df.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id()))
    before, total = {}, 0
    for r in parts.groupBy("__part").count().orderBy("__part").collect():
        before[r["__part"]], total = total, total + r["count"]
    if not before:
        return df.withColumn(out, F.lit(0))
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__part"))
    return parts.withColumn(out, start + F.row_number().over(Window.partitionBy("__part").orderBy(order))).drop("__part")


def numbered_as_is(df: DataFrame, out: str = "i") -> DataFrame:
    """Adds a row number from 0 in the order of partitions, without a shuffle: the table is written once with each row's place in its partition, and partitions are counted."""
    rows = materialise(df.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["__part"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(starts, "__part long, __start long")
    return rows.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + place).drop("__part", "__start", "__at")
