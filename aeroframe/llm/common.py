"""Shared helpers of the training-data operators: tables, shared scratch space, text rules."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import LEAST_HOT, even_join  # noqa: F401
from ..session import materialise, save_table, scratch, shared_dir  # noqa: F401

#: ASCII white space, as the contracts write it.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
WS_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Null text becomes empty text; the column is a string whatever it was."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def drop_folder(spark: SparkSession, where: str) -> None:
    """Delete a written table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of rows without an id start here; ids below it sort before them.
OWN = 2**62


def own_key(*cols):
    """A key for a row that has no id of its own: a digest of the columns in the upper half of the ids."""
    return F.lit(OWN) + F.xxhash64(*cols).bitwiseAND(F.lit(OWN - 1))


def frequent_values(df: DataFrame, column, parts: int, sample_rows: int) -> list:
    """Values of over half a partition's share of the rows in a sample of ``sample_rows`` expected rows, at most ``2 * parts``."""
    n = df.count()
    seen = df.sample(False, min(1.0, sample_rows / max(n, 1)), 7).select(column.alias("v"))
    hot = seen.groupBy("v").count().where(F.col("count") >= max(8, min(n, sample_rows) / (2 * parts)))
    return [r["v"] for r in hot.orderBy(F.desc("count"), "v").limit(2 * parts).collect()]


def slices(batches, rows: int = 256):
    """Small batches, so that a task holds few texts and their results at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tidy(run):
    """For functions over Arrow batches: workers are used again and again, so give memory back when a task ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return wrapped
