"""Runs against ground truth: camera positions, heights, buildings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import enu_to_geodetic, geodetic_to_enu
from ..functions.vectors import norm
from .cloud import nearest_within


def moved_frame(points: DataFrame, from_origin: tuple, to_origin: tuple) -> DataFrame:
    """Local x, y, z about one geodetic origin (lat, lon, height) to local coordinates about another."""
    geo = points.withColumns(dict(zip(("__la", "__lo", "__h"), enu_to_geodetic("x", "y", "z", *from_origin))))
    return geo.withColumns(dict(zip("xyz", geodetic_to_enu("__la", "__lo", "__h", *to_origin)))).drop("__la", "__lo", "__h")


def camera_rmse(found: DataFrame, truth: DataFrame, key: str = "name") -> DataFrame:
    """One row: n and rmse of positions joined by name."""
    t = truth.select(key, *[F.col(c).alias(f"t{c}") for c in "xyz"])
    err = norm(*[F.col(c) - F.col(f"t{c}") for c in "xyz"])
    return found.join(t, key).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"))


def height_errors(found: DataFrame, truth: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median and 90th percentile of absolute differences and the mean difference over cells that both know."""
    keys = keys or []
    both = found.join(truth.select(*keys, "row", "col", F.col("value").alias("truth")), [*keys, "row", "col"]).where("value IS NOT NULL AND truth IS NOT NULL")
    d = F.col("value") - F.col("truth")
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile(F.abs(d), 0.5).alias("median_abs"), F.percentile(F.abs(d), 0.9).alias("p90_abs"), F.avg(d).alias("bias"))


def building_errors(truth: DataFrame, found: DataFrame, cap: float = 10.0) -> DataFrame:
    """Each true building with the nearest found one within the cap (not one to one): relative area error, ridge height error. Columns: id, x, y, area, ridge."""
    t = truth.select(F.col("id").alias("truth_id"), "x", "y", F.col("area").alias("t_area"), F.col("ridge").alias("t_ridge"))
    near = nearest_within(t, found.select("id", "x", "y"), cap, "truth_id", "id")
    out = near.join(t, "truth_id").join(found.select("id", "area", "ridge"), "id")
    return out.select("truth_id", "id", "dist", (F.abs(F.col("area") - F.col("t_area")) / F.col("t_area")).alias("area_error"), F.abs(F.col("ridge") - F.col("t_ridge")).alias("ridge_error"))
