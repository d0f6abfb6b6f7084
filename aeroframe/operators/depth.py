"""Depth maps: correction by anchors, statistics, fusion into voxels, key frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import fill_nearest, gaussian


def cell_residuals(anchors: DataFrame, cell: int = 24, least: int = 3, keys=("image",)) -> DataFrame:
    """Median residual of inverse depth in coarse cells with enough anchors: keys, row, col, value. Anchors: keys, u, v, z, d (predicted depth)."""
    at = lambda c: F.floor((F.col(c) - 0.5) / cell).cast("long")
    a = anchors.where("d > 0 AND z > 0").withColumn("res", 1 / F.col("z") - 1 / F.col("d"))
    return a.groupBy(*keys, at("v").alias("row"), at("u").alias("col")).agg(F.percentile("res", 0.5).alias("value"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")


def correct(depth: DataFrame, anchors: DataFrame, height: int, width: int, cell: int = 24, least: int = 3, most: float = 0.3) -> DataFrame:
    """Depth (image, row, col, z) corrected by the smoothed grid of residuals, between cells bilinearly, by ``most`` of the inverse depth at the most.

    Images with fewer than 30 anchors or no full cell stay as they are."""
    n = anchors.groupBy("image").agg(F.count(F.lit(1)).alias("n")).where("n >= 30").select("image")
    res = cell_residuals(anchors.join(n, "image", "left_semi"), cell, least)
    gh, gw = -(-height // cell), -(-width // cell)
    grid = res.select("image").distinct().withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gh - 1).cast("long")))).withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(gw - 1).cast("long"))))
    grid = gaussian(fill_nearest(grid.join(res, ["image", "row", "col"], "left"), "value", ["image"]), 1.0, "value", ["image"])
    # Bilinear between cell centres: four corners as one grouped lookup.
    pix = depth.where("z > 0").withColumns({"y": F.greatest(F.lit(0.0), F.least(F.lit(gh - 1.0), (F.col("row") + 0.5) / height * gh - 0.5)), "x": F.greatest(F.lit(0.0), F.least(F.lit(gw - 1.0), (F.col("col") + 0.5) / width * gw - 0.5))})
    tiles = grid.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct(F.col("row") * gw + F.col("col"), "value"))).alias("grid"))
    fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
    at = lambda i, j: F.element_at("grid", (F.least(F.lit(gh - 1), F.floor("y") + i) * gw + F.least(F.lit(gw - 1), F.floor("x") + j)).cast("long"))
    corr = sum(((fy if i else 1 - fy) * (fx if j else 1 - fx)) * at(i, j) for i in (0, 1) for j in (0, 1))
    inv = 1 / F.col("z").cast("double")
    new = F.greatest(inv * (1 - most), F.least(inv * (1 + most), inv + F.coalesce(corr, F.lit(0.0))))
    fixed = pix.join(tiles, "image", "left").select("image", "row", "col", F.when(new > 0, 1 / new).otherwise(0.0).alias("z"))
    return fixed.unionByName(depth.where("NOT (z > 0)").select("image", "row", "col", F.col("z").cast("double").alias("z")))


def statistics(depth: DataFrame, keys=("image",)) -> DataFrame:
    """Valid share and percentiles of valid depths, one row per image."""
    ok = F.when(F.col("z") > 0, F.col("z").cast("double"))
    return depth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("z") > 0).cast("int")).alias("valid_frac"), F.min(ok).alias("z_min"), F.percentile(ok, 0.01).alias("p01"), F.percentile(ok, 0.5).alias("z_median"), F.percentile(ok, 0.99).alias("p99"), F.max(ok).alias("z_max"))


def fusion_pixels(depth: DataFrame, fx: float, voxel: float, cap: float, footprint: float, least_conf: float = 0.5) -> DataFrame:
    """Pixels fit for fusion: sure, near, fine enough for the voxel and not grazing. Depth: z, conf, grazing_ok."""
    return depth.where((F.col("conf") >= least_conf) & (F.col("z") > 0) & (F.col("z") < cap) & (F.col("z") <= footprint * voxel * fx) & F.col("grazing_ok"))


def integrate(samples: DataFrame, voxel: float, trunc: float) -> DataFrame:
    """Truncated signed distances along rays, averaged by voxel: vx, vy, vz, tsdf, weight, r, g, b.

    Samples: x, y, z (surface point), cam_x, cam_y, cam_z, w, r, g, b. Every ray is
    walked through the truncation band in half-voxel steps; a voxel takes one sample
    of a ray, the one nearest to its centre along it."""
    ray = [F.col(c) - F.col(f"cam_{c}") for c in "xyz"]
    s = samples.withColumn("__len", F.sqrt(sum(r * r for r in ray))).where("__len > 0").withColumns({f"d{c}": r / F.col("__len") for c, r in zip("xyz", ray)})
    n = int(np.ceil(2 * trunc / voxel))
    # A ray's voxels are told apart in its own row, so that no step of a ray is shuffled before it is added up.
    step = lambda k: F.struct(*[F.floor((F.col(c) + k * voxel / 2 * F.col(f"d{c}")) / voxel).cast("long").alias(f"v{c}") for c in "xyz"])
    steps = F.array(*[F.lit(k) for k in range(-n, n + 1) if abs(k * voxel / 2) <= trunc])
    s = s.withColumn("__v", F.explode(F.array_distinct(F.transform(steps, step)))).select("*", "__v.*").drop("__v")
    # The voxel's centre projected on the ray: its signed distance before the surface.
    along = sum(((F.col(f"v{c}") + 0.5) * voxel - F.col(c)) * F.col(f"d{c}") for c in "xyz")
    s = s.withColumn("sdf", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -along / trunc)))
    return s.groupBy("vx", "vy", "vz").agg((F.sum(F.col("w") * F.col("sdf")) / F.sum("w")).alias("tsdf"), F.sum("w").alias("weight"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "rgb"])


def surface_points(voxels: DataFrame, voxel: float, least_weight: float = 1.5) -> DataFrame:
    """Where the distance changes sign between neighbours along an axis: x, y, z, r, g, b (linear between the two)."""
    v = voxels.where(F.col("weight") >= least_weight)
    out = None
    for axis in "xyz":
        n = v.select(*[(F.col(f"v{c}") - (1 if c == axis else 0)).alias(f"v{c}") for c in "xyz"], F.col("tsdf").alias("t1"), *[F.col(c).alias(f"{c}1") for c in "rgb"])
        p = v.join(n, ["vx", "vy", "vz"]).where("(tsdf > 0) <> (t1 > 0)").withColumn("f", F.col("tsdf") / (F.col("tsdf") - F.col("t1")))
        p = p.select(*[((F.col(f"v{c}") + 0.5 + (F.col("f") if c == axis else 0)) * voxel).alias(c) for c in "xyz"], *[(F.col(c) + F.col("f") * (F.col(f"{c}1") - F.col(c))).alias(c) for c in "rgb"])
        out = p if out is None else out.unionByName(p)
    return out


def sharpness(pixels: DataFrame, value: str = "value", keys=("image",)) -> DataFrame:
    """Population variance of the four-neighbour Laplacian of each image's inner pixels."""
    from pyspark.sql import Window

    h, v = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
    lap = sum(f(value).over(w) for w in (h, v) for f in (F.lag, F.lead)) - 4 * F.col(value)
    return pixels.withColumn("__lap", lap).groupBy(*keys).agg(F.var_pop("__lap").alias("sharpness"))


def select_keyframes(candidates: DataFrame, key: str, sharp_cut: str = "cut", min_disp: float = 40.0, min_ratio: float = 0.4, max_gap: float = 2.0) -> DataFrame:
    """Key frames of every clip by a state machine over its frames in time order.

    Candidates: key, frame_index, t, sharpness, cut, step_px (median motion since
    the frame before), ratio (share of tracks that survive that step). Motion and
    tracks add up since the last key frame; when either, or the time, crosses its
    threshold, the next sharp frame is taken. A clip is one task: order is all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        chosen, disp, kept, pending, last = [], 0.0, 1.0, False, None
        for i, t, sharp, step, ratio in zip(pdf["frame_index"], pdf["t"], pdf["sharpness"] >= pdf[sharp_cut], pdf["step_px"], pdf["ratio"]):
            if last is None:
                if sharp:
                    chosen.append(i)
                    last = t
                continue
            disp, kept = disp + step, kept * ratio
            pending = pending or disp >= min_disp or kept < min_ratio or t - last >= max_gap
            if pending and sharp:
                chosen.append(i)
                disp, kept, pending, last = 0.0, 1.0, False, t
        return pd.DataFrame({key: pdf[key].iloc[0] if chosen else [], "frame_index": chosen})

    kind = candidates.schema[key].dataType.simpleString()
    return candidates.groupBy(key).applyInPandas(run, f"`{key}` {kind}, frame_index long")


def relaxed_keyframes(candidates: DataFrame, key: str, least: int = 20, most_rounds: int = 3, min_disp: float = 40.0, max_gap: float = 2.0, **kw) -> DataFrame:
    """Spacing halved, up to three times, for clips that have too few key frames: key, frame_index, relaxed."""
    todo, out = candidates, None
    for k in range(most_rounds + 1):
        got = select_keyframes(todo, key, min_disp=min_disp / 2**k, max_gap=max_gap / 2**k, **kw).withColumn("relaxed", F.lit(k))
        n = got.groupBy(key).count()
        enough = n.where(F.col("count") >= least) if k < most_rounds else n
        ready = got.join(enough.select(key), key, "left_semi")
        out = ready if out is None else out.unionByName(ready)
        todo = todo.join(enough.select(key), key, "left_anti")
    return out
