"""Raster cells and roof surfaces as expressions. Row 0 lies at ymax, the north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col


def cell(x, y, xmin, ymax, gsd) -> tuple[Column, Column]:
    """(row, col) of a map position."""
    return F.floor((col(ymax) - col(y)) / col(gsd)), F.floor((col(x) - col(xmin)) / col(gsd))


def cell_centre(row, column, xmin, ymax, gsd) -> tuple[Column, Column]:
    """Map position of a cell's centre."""
    return col(xmin) + (col(column) + 0.5) * col(gsd), col(ymax) - (col(row) + 0.5) * col(gsd)


def grid_spec(points, x="x", y="y", gsd: float = 1.0, pad: float = 2.0):
    """One row (xmin, ymax, gsd, width, height) that covers the points, snapped outward to whole cells."""
    lo = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    lo = lo.select(
        (F.floor((F.col("x0") - pad) / gsd) * gsd).alias("xmin"), (F.ceil((F.col("y1") + pad) / gsd) * gsd).alias("ymax"), F.lit(gsd).alias("gsd"), (F.col("x1") + pad).alias("xe"), (F.col("y0") - pad).alias("ys")
    )
    return lo.select("xmin", "ymax", "gsd", F.ceil((F.col("xe") - F.col("xmin")) / gsd).cast("int").alias("width"), F.ceil((F.col("ymax") - F.col("ys")) / gsd).cast("int").alias("height"))


def to_local(x, y, ox, oy, angle) -> tuple[Column, Column]:
    dx, dy, c, s = col(x) - col(ox), col(y) - col(oy), F.cos(col(angle)), F.sin(col(angle))
    return dx * c + dy * s, dy * c - dx * s


def roof_height(kind, u, v, p: Column) -> Column:
    """Height of a roof model in its own frame; p has the fields c, a, b, zr, s, v0, u0 that the kind uses."""
    u, v, kind = col(u), col(v), col(kind)
    return (
        F.when(kind == "flat", p["c"]).when(kind == "shed", p["a"] * u + p["b"] * v + p["c"])
        .when(kind == "gable_u", p["zr"] - p["s"] * F.abs(v - p["v0"])).when(kind == "gable_v", p["zr"] - p["s"] * F.abs(u - p["u0"]))
    )


def shade(dzdx, dzdy, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Illumination 0-255 of a slope under one light; 0 where the slope is unknown."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    gx, gy = col(dzdx), col(dzdy)
    slope, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    lit = F.lit(math.sin(alt)) * F.cos(slope) + F.lit(math.cos(alt)) * F.sin(slope) * F.cos(F.lit(math.pi / 2 - az) - aspect)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(255.0), lit * 255.0)), F.lit(0.0))
