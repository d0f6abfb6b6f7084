"""Connected components of edges, grid cells and mesh faces.

Alternating large-star and small-star over edge tables: every half round is one
grouping and one join, and its edges are written to the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import kernels
from .joins import even_join, sorted_join

#: Hubs of a mesh are broadcast with their components up to this many.
HUBS = 1_000_000


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(a, b) edges of long ids to (id, component), the smallest id reachable.

    ``nodes`` (id) adds nodes without edges. A round moves each node's larger
    neighbours, then its smaller ones and itself, to the smallest node it knows;
    it ends when every node hangs on one centre."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _all_stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = even_join(both, least, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = materialise(big)
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = even_join(big, least, ["u"], ["v"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return out
    return nodes.select("id").distinct().join(out, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _all_stars(e: DataFrame) -> bool:
    """No node has two smaller neighbours, and none with a smaller neighbour has a larger one."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("low")), F.struct(F.col("v").alias("id"), F.lit(0).alias("low")))).alias("x")).select("x.*")
    per = ends.groupBy("id").agg(F.sum("low").alias("low"), F.count(F.lit(1)).alias("n"))
    return per.where("low > 1 OR (low = 1 AND n > 1)").isEmpty()


def grid_components(cells: DataFrame, width: int = 1 << 31, tile: int = 256) -> DataFrame:
    """Four-neighbour components of the listed cells (row, col): row, col, component.

    Cells are labelled inside tiles first; only labels that meet across a tile's
    border are tied by stars. The component is row * width + col of its first cell."""
    here = lambda c: F.floor(F.col(c) / tile)
    c = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()

    def label(t):
        row, col = t["row"].to_numpy(), t["col"].to_numpy()
        local = kernels.label_mask(row - row.min(), col - col.min())
        first = pd.Series(row * width + col).groupby(local).transform("min")
        return pd.DataFrame({"row": row, "col": col, "id": first})

    c = materialise(c.groupBy(here("row"), here("col")).applyInPandas(label, "row long, col long, id long"))
    edges = None
    for r, k, last in ((1, 0, F.pmod("row", F.lit(tile)) == tile - 1), (0, 1, F.pmod("col", F.lit(tile)) == tile - 1)):
        near = c.where(last).select((F.col("row") + r).alias("row"), (F.col("col") + k).alias("col"), F.col("id").alias("a"))
        met = sorted_join(near, c.withColumnRenamed("id", "b"), ["row", "col"]).select("a", "b")
        edges = met if edges is None else edges.unionByName(met)
    found = connected_components(edges.distinct())
    return sorted_join(c, found, "id", "left").select("row", "col", F.coalesce("component", "id").alias("component"))


def face_components(faces: DataFrame, alone: bool = True) -> DataFrame:
    """Triangles (fid, v0, v1, v2) that share an edge: fid, component. Without ``alone``, faces that share none are left out.

    An edge of several faces has its smallest as hub. A face belongs with its smallest
    hub and ties its other hubs to it, so only hubs go through rounds, not faces."""
    edge = F.explode(F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"), F.lit(k == 0).alias("first")) for k, (a, b) in enumerate((("v0", "v1"), ("v1", "v2"), ("v2", "v0")))]))
    e = faces.select("fid", edge.alias("e")).select("fid", "e.*")
    hubs = e.groupBy("p", "q").agg(F.min("fid").alias("hub"), F.max("fid").alias("__last")).where("hub < __last").drop("__last")
    if alone:
        # A face stays by its first edge, whether or not it is shared.
        met = sorted_join(e, hubs, ["p", "q"], "left").withColumn("hub", F.when(F.col("fid").isNotNull(), F.col("hub"))).where("hub IS NOT NULL OR first")
    else:
        met = sorted_join(e, hubs, ["p", "q"]).where("fid IS NOT NULL")
    w = Window.partitionBy("fid").orderBy(F.asc_nulls_last("hub"))
    met = materialise(met.select("fid", "hub", F.first("hub").over(w).alias("least"), (F.row_number().over(w) == 1).alias("lead")))
    found = materialise(connected_components(met.where("hub <> least").select(F.col("hub").alias("a"), F.col("least").alias("b"))))
    few = found.limit(HUBS + 1).count() <= HUBS
    own, names = met.where("lead").select("fid", "least"), found.withColumnRenamed("id", "least")
    out = own.join(F.broadcast(names), "least", "left") if few else even_join(own, names, ["least"], ["fid"], "left")
    return out.select("fid", F.coalesce("component", "least", "fid").alias("component"))


def large_components(parts: DataFrame, least_share: float = 0.01) -> DataFrame:
    """Rows of components with at least a share of all rows."""
    total = parts.count()
    big = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_share * total)
    return parts.join(big.select("component"), "component", "left_semi")
