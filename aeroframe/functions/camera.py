"""Cameras: quaternions, lens models, projection, intrinsics priors, affine depth."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col, repeat

# The diagonal of full frame in millimetres and the usual diagonal field of view.
FULL_FRAME_MM, DEFAULT_DFOV = 43.2666, 82.0
SHARED_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL")


def quaternion_matrix(w, x, y, z) -> Column:
    """Rotation matrix of a unit quaternion, as an array of 9."""
    w, x, y, z = map(col, (w, x, y, z))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def intrinsics(model: Column, params: Column) -> Column:
    """struct(fx, fy, cx, cy, k1, k2, p1, p2) of a lens model's parameter array."""
    shared, zero = model.isin(*SHARED_FOCAL), F.lit(0.0)
    p = lambda i: params[i]
    pick = lambda a, b: F.when(shared, p(a)).otherwise(p(b))
    k1 = F.when(model.isin("SIMPLE_RADIAL", "RADIAL"), p(3)).when(model == "OPENCV", p(4)).otherwise(zero)
    k2 = F.when(model == "RADIAL", p(4)).when(model == "OPENCV", p(5)).otherwise(zero)
    tangential = lambda i: F.when(model == "OPENCV", p(i)).otherwise(zero)
    return F.struct(
        p(0).alias("fx"), pick(0, 1).alias("fy"), pick(1, 2).alias("cx"), pick(2, 3).alias("cy"), k1.alias("k1"), k2.alias("k2"), tangential(6).alias("p1"), tangential(7).alias("p2")
    )


def distort(xn: Column, yn: Column, k: Column) -> tuple[Column, Column]:
    r2 = xn * xn + yn * yn
    d = 1 + k["k1"] * r2 + k["k2"] * r2 * r2
    return xn * d + 2 * k["p1"] * xn * yn + k["p2"] * (r2 + 2 * xn * xn), yn * d + k["p1"] * (r2 + 2 * yn * yn) + 2 * k["p2"] * xn * yn


def project(x, y, z, k: Column, sx=1.0, sy=1.0) -> tuple[Column, Column]:
    """Camera-frame point to array coordinates (pixel centres at whole numbers), through the lens; sx, sy rescale the image."""
    z = F.greatest(col(z), F.lit(1e-9))
    xd, yd = distort(col(x) / z, col(y) / z, k)
    u, v = k["fx"] * xd + k["cx"], k["fy"] * yd + k["cy"]
    place = lambda t, s: (t - 0.5) * F.lit(s) + F.lit(0.5 * (s - 1))
    return place(u, sx), place(v, sy)


def unproject(u, v, depth, k: Column, rounds: int = 8) -> tuple[Column, Column, Column]:
    """Pixel and depth to a camera-frame point; the lens is undone by a fixed number of substitutions."""
    z, start = col(depth), F.struct(((col(u) - k["cx"]) / k["fx"]).alias("x"), ((col(v) - k["cy"]) / k["fy"]).alias("y"))

    def step(p):
        xd, yd = distort(p["x"], p["y"], k)
        return F.struct((p["x"] + start["x"] - xd).alias("x"), (p["y"] + start["y"] - yd).alias("y"))

    p = repeat(rounds, start, step)
    return p["x"] * z, p["y"] * z, z


def unproject_pinhole(u, v, depth, k: Column) -> tuple[Column, Column, Column]:
    z = col(depth)
    return (col(u) - k["cx"]) / k["fx"] * z, (col(v) - k["cy"]) / k["fy"] * z, z


def camera_to_world(x, y, z, r_cw: Column, centre) -> tuple[Column, Column, Column]:
    """R^T p + C."""
    p = [col(c) for c in (x, y, z)]
    return tuple(r_cw[i] * p[0] + r_cw[3 + i] * p[1] + r_cw[6 + i] * p[2] + col(centre[i]) for i in range(3))


def focal_35mm(value) -> Column:
    """Tenths of a millimetre above 100 become millimetres; outside 8 to 300 it is no focal length."""
    v = col(value)
    v = F.when(v > 100, v / 10).otherwise(v)
    return F.when(v.between(8.0, 300.0), v)


def focal_prior(width, height, focal=None, dfov=None) -> Column:
    """struct(f, cx, cy, source, hfov_deg) from a 35 mm focal length, else a diagonal field of view."""
    w, h = col(width).cast("double"), col(height).cast("double")
    diag, f35 = F.sqrt(w * w + h * h), focal_35mm(focal) if focal is not None else F.lit(None).cast("double")
    fov = col(dfov).cast("double") if dfov is not None else F.lit(None).cast("double")
    by_fov = diag / 2 / F.tan(F.radians(F.coalesce(fov, F.lit(DEFAULT_DFOV))) / 2)
    f = F.when(f35.isNotNull(), f35 * diag / FULL_FRAME_MM).otherwise(by_fov)
    source = F.when(f35.isNotNull(), "telemetry_focal_len").when(fov.isNull(), "dfov_default").otherwise("dfov")
    return F.struct(f.alias("f"), (w / 2).alias("cx"), (h / 2).alias("cy"), source.alias("source"), F.degrees(2 * F.atan(w / (2 * f))).alias("hfov_deg"))


def focal_from_hfov(width, hfov) -> Column:
    return col(width) / 2 / F.tan(F.radians(col(hfov)) / 2)


def affine_depth(pred, mode, a, b, z_max) -> Column:
    """Metric depth of a relative prediction; 0 where it is not finite, not positive or beyond z_max."""
    est = col(a) * col(pred) + col(b)
    z = F.when(col(mode) == "disparity", F.when(est != 0, 1 / est)).otherwise(est)
    ok = z.isNotNull() & ~F.isnan(z) & (z > 0) & (F.abs(z) < F.lit(math.inf)) & (col(z_max).isNull() | (z <= col(z_max)))
    return F.when(ok, z).otherwise(0.0)
