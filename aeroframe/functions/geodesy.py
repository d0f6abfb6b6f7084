"""Frames and transforms: similarity, geodetic and local east-north-up, UTM, gimbal axes.

Angles come in degrees. Everything is a column expression and stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import col, let, mat_mul, mat_vec, repeat, transpose

# The WGS84 ellipsoid.
A = 6378137.0
E2 = 0.00669437999014
F_INV = 298.257223563


def apply_sim3(xyz, scale, rotation, translation) -> tuple[Column, Column, Column]:
    """scale * R x + t; rotation of 9 numbers, row by row."""
    x, y, z = map(col, xyz)
    return tuple(F.lit(scale) * (rotation[3 * i] * x + rotation[3 * i + 1] * y + rotation[3 * i + 2] * z) + F.lit(translation[i]) for i in range(3))


def pose_to_enu(r_cw: Column, t_cw: Column, scale, rotation: Column, translation) -> tuple[Column, Column]:
    """World-to-camera pose after the world moved by a similarity: R' = R_cw R^T, t' = s t_cw - R' t."""
    r_new = mat_mul(r_cw, transpose(rotation))
    moved = mat_vec(r_new, translation)
    return r_new, F.array(*[col(scale) * t_cw[i] - moved[i] for i in range(3)])


def camera_centre(r_cw: Column, t_cw: Column) -> tuple[Column, Column, Column]:
    """-R^T t."""
    return tuple(-(r_cw[i] * t_cw[0] + r_cw[3 + i] * t_cw[1] + r_cw[6 + i] * t_cw[2]) for i in range(3))


def geodetic_to_ecef(lat, lon, alt) -> tuple[Column, Column, Column]:
    la, lo, h = F.radians(col(lat)), F.radians(col(lon)), col(alt)
    n = F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * F.lit(1 - E2) + h) * F.sin(la)


def geodetic_to_enu(lat, lon, alt, lat0, lon0, alt0) -> tuple[Column, Column, Column]:
    """East, north, up in metres about the origin."""
    dx, dy, dz = (p - q for p, q in zip(geodetic_to_ecef(lat, lon, alt), geodetic_to_ecef(lat0, lon0, alt0)))
    la, lo = F.radians(col(lat0)), F.radians(col(lon0))
    flat = F.cos(lo) * dx + F.sin(lo) * dy
    return -F.sin(lo) * dx + F.cos(lo) * dy, -F.sin(la) * flat + F.cos(la) * dz, F.cos(la) * flat + F.sin(la) * dz


def enu_to_geodetic(e, n, u, lat0, lon0, alt0, rounds: int = 6) -> tuple[Column, Column, Column]:
    """The inverse; latitude by a fixed number of substitutions, which converge below a micrometre."""
    la0, lo0 = F.radians(col(lat0)), F.radians(col(lon0))
    e, n, u = map(col, (e, n, u))
    x0, y0, z0 = geodetic_to_ecef(lat0, lon0, alt0)
    out = F.cos(la0) * u - F.sin(la0) * n
    x, y, z = x0 - F.sin(lo0) * e + F.cos(lo0) * out, y0 + F.cos(lo0) * e + F.sin(lo0) * out, z0 + F.cos(la0) * n + F.sin(la0) * u
    radius = lambda la: F.lit(A) / F.sqrt(1 - F.lit(E2) * F.sin(la) * F.sin(la))

    def solve(c):
        p = F.sqrt(c["x"] * c["x"] + c["y"] * c["y"])
        return F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), p.alias("p"), repeat(rounds, F.atan2(c["z"], p * F.lit(1 - E2)), lambda la: F.atan2(c["z"] + F.lit(E2) * radius(la) * F.sin(la), p)).alias("la"))

    s = let(let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), solve), lambda c: F.array(
        F.degrees(c["la"]), F.degrees(F.atan2(c["y"], c["x"])), c["p"] * F.cos(c["la"]) + c["z"] * F.sin(c["la"]) - F.lit(A * A) / radius(c["la"])))
    return s[0], s[1], s[2]


def utm_epsg(lat, lon) -> Column:
    """Zone code by longitude alone, north or south by the latitude's sign."""
    zone = F.floor((col(lon) + 180) / 6) + 1
    return (F.when(col(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


# Third flattening and the Krueger series of the transverse Mercator projection.
_N = 1 / (2 * F_INV - 1)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _EAST0, _SOUTH0 = 0.9996, 500000.0, 10000000.0


def utm_forward(lat: float, lon: float, epsg: int) -> tuple[float, float]:
    """Easting and northing of one point, for the constants of a local frame."""
    zone, south = epsg % 100, epsg // 100 == 327
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = math.sinh(math.atanh(math.sin(phi)) - c * math.atanh(c * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.asinh(math.sin(lam) / math.hypot(t, math.cos(lam)))
    e = eta + sum(a * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
    n = xi + sum(a * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, a in enumerate(_ALPHA))
    return _EAST0 + _K0 * _RADIUS * e, _K0 * _RADIUS * n + (_SOUTH0 if south else 0.0)


def utm_inverse(east: float, north: float, epsg: int) -> tuple[float, float]:
    """Latitude and longitude of one point."""
    zone, south = epsg % 100, epsg // 100 == 327
    xi, eta = (north - (_SOUTH0 if south else 0.0)) / (_K0 * _RADIUS), (east - _EAST0) / (_K0 * _RADIUS)
    x = xi - sum(b * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
    y = eta - sum(b * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, b in enumerate(_BETA))
    chi = math.asin(math.sin(x) / math.cosh(y))
    phi = chi + sum(d * math.sin(2 * (j + 1) * chi) for j, d in enumerate(_DELTA))
    return math.degrees(phi), (zone * 6 - 183) + math.degrees(math.atan2(math.sinh(y), math.cos(x)))


def _enu_point_to_geodetic(e: float, n: float, lat0: float, lon0: float, h0: float) -> tuple[float, float]:
    la0, lo0 = math.radians(lat0), math.radians(lon0)
    nn = A / math.sqrt(1 - E2 * math.sin(la0) ** 2)
    x0, y0, z0 = (nn + h0) * math.cos(la0) * math.cos(lo0), (nn + h0) * math.cos(la0) * math.sin(lo0), (nn * (1 - E2) + h0) * math.sin(la0)
    x, y, z = x0 - math.sin(lo0) * e - math.sin(la0) * math.cos(lo0) * n, y0 + math.cos(lo0) * e - math.sin(la0) * math.sin(lo0) * n, z0 + math.cos(la0) * n
    p = math.hypot(x, y)
    la = math.atan2(z, p * (1 - E2))
    for _ in range(8):
        la = math.atan2(z + E2 * A / math.sqrt(1 - E2 * math.sin(la) ** 2) * math.sin(la), p)
    return math.degrees(la), math.degrees(math.atan2(y, x))


class LocalFrame:
    """Local metres to map metres by an affine map fitted at the origin and 500 m east and north of it.

    Without an origin (no positioning) map and local metres are the same."""

    STEP = 500.0

    def __init__(self, lat0: float | None = None, lon0: float | None = None, h0: float = 0.0, epsg: int | None = None):
        self.epsg, self.h0 = epsg, h0
        self.a, self.b = ((1.0, 0.0), (0.0, 1.0)), (0.0, 0.0)
        if epsg is not None:
            o, e, n = (utm_forward(*_enu_point_to_geodetic(x, y, lat0, lon0, h0), epsg) for x, y in ((0, 0), (self.STEP, 0), (0, self.STEP)))
            self.b = o
            self.a = (((e[0] - o[0]) / self.STEP, (n[0] - o[0]) / self.STEP), ((e[1] - o[1]) / self.STEP, (n[1] - o[1]) / self.STEP))

    def to_map(self, x, y) -> tuple[Column, Column]:
        x, y = col(x), col(y)
        return tuple(F.lit(self.a[i][0]) * x + F.lit(self.a[i][1]) * y + F.lit(self.b[i]) for i in range(2))

    def to_local(self, x, y) -> tuple[Column, Column]:
        (p, q), (r, s) = self.a
        det = p * s - q * r
        dx, dy = col(x) - F.lit(self.b[0]), col(y) - F.lit(self.b[1])
        return F.lit(s / det) * dx - F.lit(q / det) * dy, F.lit(p / det) * dy - F.lit(r / det) * dx

    def height(self, up) -> Column:
        return col(up) + F.lit(self.h0)

    def up(self, height) -> Column:
        return col(height) - F.lit(self.h0)


def gimbal_axis(yaw, pitch) -> tuple[Column, Column, Column]:
    """Unit optical axis; yaw clockwise from north, pitch -90 straight down."""
    y, p = F.radians(col(yaw)), F.radians(col(pitch))
    return F.sin(y) * F.cos(p), F.cos(y) * F.cos(p), F.sin(p)


def camera_rotation(yaw, pitch) -> Column:
    """Camera-to-world rotation whose columns are right, down and forward, as an array of 9."""
    y, p = F.radians(col(yaw)), F.radians(col(pitch))
    fwd = (F.sin(y) * F.cos(p), F.cos(y) * F.cos(p), F.sin(p))
    right = (F.cos(y), -F.sin(y), F.lit(0.0))
    down = (F.sin(y) * F.sin(p), F.cos(y) * F.sin(p), -F.cos(p))
    return F.array(*[axis[i] for i in range(3) for axis in (right, down, fwd)])


def wrap_degrees(x) -> Column:
    """To [-180, 180)."""
    return F.pmod(col(x) + 180.0, F.lit(360.0)) - 180.0


def compass(azimuth) -> Column:
    """One of eight winds."""
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    turn = F.floor((F.pmod(col(azimuth).cast("double"), F.lit(360.0)) + 22.5) / 45).cast("int")
    return F.element_at(names, turn % 8 + 1)
