"""Exact dedup by content sort, in DataFrame functions only.

Rows are range-partitioned by Spark's sampled splitters over the leading bytes
of the normalised text and sorted externally by the whole text, so equal texts
stand next to each other and each row is compared in full with its neighbour.
Leading bytes that a bounded sample shows to be frequent are dealt out further
by a salt of the id, so a group of copies (or a common opening) that holds a
third of all rows is sorted by many tasks; the runs those tasks find, one row
per text and salt, are then brought together by digest and length and merged
where their texts are equal in full.

Defined results: null text equals empty text; among equal texts the smallest
id stays, a null id sorts last; rows that repeat an id and text are members of
the same group; a very long text is one row of the sort, which spills; columns
other than id and text play no part, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_WS, WS, frequent_values, materialise

LEAD = 48
#: Rows of the sample that looks for frequent leading bytes.
SAMPLE_ROWS = 20_000


def normalised(text):
    return F.regexp_replace(text, f"{WS}+", " ")


def leading(text, n: int = LEAD):
    """The first ``n`` characters of the normalised text, without reading the rest."""
    head = F.regexp_extract(text, f"^(?:{NOT_WS}|{WS}++){{0,{n}}}+", 0)
    return normalised(head)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``kept`` holds where the row's id is the group's smallest."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = raw.withColumn("lead", leading(F.col("text")))
    hot = frequent_values(keyed, F.col("lead"), parts, sample_rows)
    salt = F.when(F.col("lead").isin(hot), F.pmod(F.xxhash64("id"), F.lit(parts)) + 1).otherwise(0) if hot else F.lit(0).cast("long")
    dealt = keyed.withColumn("salt", salt.cast("long")).repartitionByRange("lead", "salt")

    by_text = Window.partitionBy("lead", "salt").orderBy("norm", F.col("id").asc_nulls_last())
    run = Window.partitionBy("lead", "salt", "run")
    rows = (
        dealt.select("id", "lead", "salt", normalised(F.col("text")).alias("norm"))
        .withColumn("first_of_run", ~F.col("norm").eqNullSafe(F.lag("norm").over(by_text)))
        .withColumn("run", F.sum(F.col("first_of_run").cast("long")).over(by_text))
        .select(
            "id", "lead", "salt", "run", "first_of_run",
            F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"),
            F.when(F.col("first_of_run") & (F.col("salt") > 0), F.col("norm")).alias("norm"),
        )
        .withColumn("run_keep", F.min("id").over(run))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
    )
    if hot:
        rows = materialise(rows)
        split = rows.where("salt > 0")
        # At most one run a text and salt, so a text's list of runs is as short as there are partitions.
        runs = split.where("first_of_run").groupBy("sha", "norm").agg(F.min("run_keep").alias("keep_id"), F.sum("run_size").alias("group_size"), F.collect_list(F.struct("lead", "salt", "run")).alias("at"))
        runs = runs.select(F.explode("at").alias("at"), "keep_id", "group_size").select("at.*", "keep_id", "group_size")
        split = split.join(runs, ["lead", "salt", "run"]).select("id", "keep_id", "group_size", "sha")
        whole = rows.where("salt = 0").select("id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), "sha")
        out = whole.unionByName(split)
    else:
        out = rows.select("id", F.col("run_keep").alias("keep_id"), F.col("run_size").alias("group_size"), "sha")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
