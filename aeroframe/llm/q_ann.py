"""Query op4: the nearest neighbours of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from .ann import search
from .common import table


def op4_nearest_neighbours(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


QUERIES = {"op4_nearest_neighbours": op4_nearest_neighbours}
ORACLES: dict = {}
