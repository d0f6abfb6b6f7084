"""Points and poses out of tracks: linear triangulation and bundle adjustment of given models.

Models are told apart by their counted rows. One of at most MODEL observations, images
and points is a group: its observations meet its images once, and nothing between is
written. Larger ones are spread over all tasks, by the same sums. Their
observations are one table bucketed by point, so all that concerns one point stays
in its bucket: points are eliminated by sums over a bucket's rows, without moving an
observation. What is left is one system over the cameras. It is never formed:
conjugate gradients apply it to a vector by one scan of the linearised observations
and one small grouping by image. Vectors hold six numbers an image; they are
broadcast while the counted images are at most CAMERA_ROWS, else joined."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.camera import intrinsics, project, unproject
from ..functions.vectors import cross, dot, mat_mul, mat_vec, norm, transpose
from ..session import materialise, save_table, shared_dir
from .joins import dealt
from .visibility import CAMERA_ROWS

#: Observations, images or points of a model that is one group.
MODEL = 200_000
_LENS = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")

#: Squared pixels charged for an observation whose point is behind its camera.
BEHIND = 1e8
#: Places of a symmetric 3x3 matrix's six numbers.
_SIX = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
_PLACE = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]


def _inverse(s: Column) -> Column:
    """Inverse of a symmetric 3x3 matrix given by its six numbers; null where it has none."""
    a, b, c, d, e, f = (s[i] for i in range(6))
    co = [d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b]
    det = a * co[0] + b * co[1] + c * co[2]
    return F.when(det > 0, F.array(*[x / det for x in co]))


def _symmetric(s: Column, v: list[Column]) -> list[Column]:
    return [sum((s[_PLACE[i][j]] * v[j] for j in (1, 2)), s[_PLACE[i][0]] * v[0]) for i in range(3)]


def _posed(observations: DataFrame, images: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Complete observations with their image's pose and lens ``k``."""
    lens = cameras.select("camera_id", intrinsics(F.col("model"), F.col("params")).alias("k"))
    poses = images.select(*keys, "image_id", "camera_id", "r_cw", "t_cw").join(lens, "camera_id").drop("camera_id")
    o = observations.select(*keys, "image_id", "point_id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna()
    return o.join(poses, [*keys, "image_id"])


def _large(keys: list[str], *tables: DataFrame) -> DataFrame | None:
    """Keys of the models with more than MODEL rows in one of the tables; there are at most as many as MODEL goes into all rows."""
    found = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > MODEL).select(*keys) for t in tables]
    found = materialise(reduce(DataFrame.unionByName, found).distinct())
    return None if found.isEmpty() else found


def _of(df: DataFrame, large: DataFrame | None, keys: list[str], how: str) -> DataFrame:
    return df if large is None else df.join(F.broadcast(large), keys, how)


def _numbers(images: DataFrame, cameras: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Complete poses with their lens as an array ``k``."""
    lens = cameras.select("camera_id", intrinsics(F.col("model"), F.col("params")).alias("__k")).select("camera_id", F.array(*[F.col("__k")[c].cast("double") for c in _LENS]).alias("k"))
    return images.join(lens, "camera_id").select(*keys, F.col("image_id").alias("__image"), "r_cw", "t_cw", "k", *more).dropna()


def _lists(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


class _Group:
    """The observations of one model with their images and points as arrays, ordered by point, so that sums by point are sums of runs."""

    def __init__(self, seen: pa.Table, images: pa.Table, places: pa.Table | None = None):
        seen = seen.select(["image_id", "point_id", "u", "v"])
        images = images.sort_by("__image")
        keep = pc.is_in(seen.column("image_id"), value_set=images.column("__image").cast(seen.schema.field("image_id").type))
        if places is not None:
            places = places.sort_by("point_id")
            keep = pc.and_(keep, pc.is_in(seen.column("point_id"), value_set=places.column("point_id")))
        seen = seen.filter(keep).sort_by([(c, "ascending") for c in ("point_id", "image_id", "u", "v")])
        self.image_ids, self.n = images.column("__image"), len(seen)
        self.r, self.t, self.k = _lists(images.column("r_cw"), 9).reshape(-1, 3, 3), _lists(images.column("t_cw"), 3), _lists(images.column("k"), 8)
        self.point_ids = pc.unique(seen.column("point_id")) if places is None else places.column("point_id")
        find = lambda c, ids: pc.index_in(seen.column(c), value_set=ids.cast(seen.schema.field(c).type)).to_numpy().astype(np.int64)
        self.image, self.point = find("image_id", self.image_ids), find("point_id", self.point_ids)
        self.u, self.v = seen.column("u").to_numpy(), seen.column("v").to_numpy()
        self.begin = np.flatnonzero(np.diff(self.point, prepend=-1))
        self.of_run = self.point[self.begin]

    def by_point(self, a: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.point_ids), *a.shape[1:]))
        if self.n:
            out[self.of_run] = np.add.reduceat(a, self.begin, axis=0)
        return out

    def by_image(self, a: np.ndarray) -> np.ndarray:
        flat = a.reshape(self.n, -1)
        sums = [np.bincount(self.image, flat[:, i], len(self.image_ids)) for i in range(flat.shape[1])]
        return np.stack(sums, axis=1).reshape(-1, *a.shape[1:])

    def lens(self) -> np.ndarray:
        return self.k[self.image].T

    def seen_at(self, r: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point in the camera's frame, how far off it is seen along both axes of the image)."""
        y = np.einsum("nij,nj->ni", r[self.image], x[self.point]) + t[self.image]
        fx, fy, cx, cy, *bend = self.lens()
        z = np.maximum(y[:, 2], 1e-9)
        xd, yd = _bent(y[:, 0] / z, y[:, 1] / z, *bend)
        return y, fx * xd + cx - self.u, fy * yd + cy - self.v


def _bent(x, y, k1, k2, p1, p2):
    """As ``functions.camera.distort``."""
    r2 = x * x + y * y
    d = 1 + k1 * r2 + k2 * r2 * r2
    return x * d + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * d + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def _inverted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inverses, determinants) of symmetric 3x3 matrices; zeros where the determinant is not above 0."""
    co = np.cross(a[:, [1, 2, 0]], a[:, [2, 0, 1]])
    det = (a[:, 0] * co[:, 0]).sum(axis=1)
    ok = det > 0
    return np.where(ok, 1.0, 0.0)[:, None, None] * co / np.where(ok, det, 1.0)[:, None, None], det


def _least(least_angle: float) -> float:
    """What two rays at the angle spread."""
    return float(np.sin(np.radians(least_angle)) ** 2 / 4)


def _meet(g: _Group, least_angle: float) -> dict[str, np.ndarray]:
    """Points of one model by the rays of their tracks, in the order of their ids, and which of them hold."""
    fx, fy, cx, cy, *bend = g.lens()
    start = x, y = (g.u - cx) / fx, (g.v - cy) / fy
    for _ in range(8):
        xd, yd = _bent(x, y, *bend)
        x, y = x + start[0] - xd, y + start[1] - yd
    r = g.r[g.image]
    d = np.einsum("nij,ni->nj", r, np.stack([x, y, np.ones_like(x)], axis=1))
    d /= np.sqrt((d * d).sum(axis=1))[:, None]
    c = -np.einsum("nij,ni->nj", r, g.t[g.image])
    off = np.eye(3) - d[:, :, None] * d[:, None, :]
    views = np.bincount(g.point, minlength=len(g.point_ids))
    inverse, det = _inverted(g.by_point(off))
    at = np.einsum("pij,pj->pi", inverse, g.by_point(np.einsum("nij,nj->ni", off, c)))
    ok = (views > 1) & (det / np.maximum(views, 1) ** 3.0 >= _least(least_angle))
    y, du, dv = g.seen_at(g.r, g.t, at)
    behind = np.bincount(g.point, ~(y[:, 2] > 0), len(views))
    error = np.bincount(g.point, np.sqrt(du * du + dv * dv), len(views)) / np.maximum(views, 1)
    return {"views": views, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "error": error, "ok": ok & (behind == 0)}


def triangulate(observations: DataFrame, images: DataFrame, cameras: DataFrame, keys: tuple[str, ...] = (), least_angle: float = 1.0) -> DataFrame:
    """The point nearest to all rays of its track: keys, point_id, x, y, z, views, error (mean, pixels).

    Sums per point of what every ray takes off, and one 3x3 solution. Points seen
    once, whose rays spread less than two rays at ``least_angle`` degrees, or that
    come out behind a camera that sees them, are left out; so are observations with
    a null or of an unknown image. Observations are read twice, so they should be a written table."""
    names, keys = list(keys), list(keys) or ["__all"]
    whole = (lambda df: df) if names else (lambda df: df.withColumn("__all", F.lit(0)))
    o = whole(observations).select(*keys, "image_id", "point_id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna()
    large = _large(keys, o, whole(images))
    poses = _numbers(_of(whole(images), large, keys, "left_anti"), cameras, keys)
    kind = T.StructType([*[o.schema[c] for c in keys], o.schema["point_id"], *[T.StructField(c, T.DoubleType()) for c in "xyz"], T.StructField("views", T.LongType()), T.StructField("error", T.DoubleType())])

    def meet(key, seen, posed):
        g = _Group(seen, posed)
        found = _meet(g, least_angle) if g.n else {"ok": np.zeros(0, bool)}
        ok = np.flatnonzero(found["ok"])
        told = {k: pa.array([v.as_py()] * len(ok), seen.schema.field(k).type) for k, v in zip(keys, key)}
        told["point_id"] = g.point_ids.take(pa.array(ok))
        return pa.table(told | {c: pa.array(found[c][ok] if len(ok) else [], pa.int64() if c == "views" else pa.float64()) for c in ("x", "y", "z", "views", "error")})

    out = _met(_of(o, large, keys, "left_anti"), poses, keys).applyInArrow(meet, kind).select(*names, "point_id", "x", "y", "z", "views", "error")
    if large is None:
        return out
    return out.unionByName(_triangulate_large(_of(o, large, keys, "left_semi"), _of(whole(images), large, keys, "left_semi"), cameras, names, least_angle))


def _met(rows: DataFrame, poses: DataFrame, keys: list[str]):
    """Both tables by model; the keys of one get other names, as both may come from one table."""
    other = [f"__of_{k}" for k in keys]
    poses = poses.withColumnsRenamed(dict(zip(keys, other)))
    return dealt(rows, *keys).groupBy(*keys).cogroup(dealt(poses, *other).groupBy(*other))


def _triangulate_large(observations: DataFrame, images: DataFrame, cameras: DataFrame, keys: list[str], least_angle: float) -> DataFrame:
    """Models of any size: sums by point, then the errors at the points found."""
    o = _posed(observations, images, cameras, keys)
    x, y, _ = unproject("u", "v", F.lit(1.0), F.col("k"))
    r = transpose(F.col("r_cw"))
    o = o.withColumns({"__d": F.array(*mat_vec(r, (x, y, F.lit(1.0)))), "__c": F.array(*[-c for c in mat_vec(r, [F.col("t_cw")[i] for i in range(3)])])})
    o = o.withColumn("__n", norm(*[F.col("__d")[i] for i in range(3)]))
    d, c = [F.col("__d")[i] / F.col("__n") for i in range(3)], [F.col("__c")[i] for i in range(3)]
    off = [(1.0 if i == j else 0.0) - d[i] * d[j] for i, j in _SIX]
    taken = _symmetric(F.array(*off), c)
    sums = o.groupBy(*keys, "point_id").agg(F.array(*[F.sum(x) for x in off]).alias("__a"), F.array(*[F.sum(x) for x in taken]).alias("__b"), F.count(F.lit(1)).alias("views"))
    a = F.col("__a")
    det = a[0] * (a[3] * a[5] - a[4] * a[4]) + a[1] * (a[2] * a[4] - a[1] * a[5]) + a[2] * (a[1] * a[4] - a[2] * a[3])
    spread = _least(least_angle)
    sums = sums.where("views > 1").where(det / F.pow("views", F.lit(3)) >= spread).withColumn("__i", _inverse(a))
    at = _symmetric(F.col("__i"), [F.col("__b")[i] for i in range(3)])
    points = sums.select(*keys, "point_id", "views", *[p.alias(n) for p, n in zip(at, "xyz")])
    seen = _errors(o.join(points, [*keys, "point_id"]))
    per = seen.groupBy(*keys, "point_id").agg(*[F.first(n).alias(n) for n in "xyz"], F.first("views").alias("views"), F.avg("err").alias("error"), F.min("depth").alias("__z"))
    return per.where("__z > 0").drop("__z")


def _errors(posed: DataFrame) -> DataFrame:
    """Adds depth and err (pixels) to posed observations with their point."""
    cam = mat_vec(F.col("r_cw"), ("x", "y", "z"))
    cam = [cam[i] + F.col("t_cw")[i] for i in range(3)]
    u, v = project(*cam, F.col("k"))
    return posed.withColumn("depth", cam[2]).withColumn("err", norm(u + 0.5 - F.col("u"), v + 0.5 - F.col("v")))


def _linearise(posed: DataFrame, keys: list[str]) -> DataFrame:
    """Residuals e, and how they move with the pose (jc: a turn, then a shift, of the camera frame) and the point (jp)."""
    cam = mat_vec(F.col("r_cw"), ("x", "y", "z"))
    o = posed.withColumn("__y", F.array(*[cam[i] + F.col("t_cw")[i] for i in range(3)])).withColumn("__front", F.col("__y")[2] > 1e-9)
    y, k = [F.col("__y")[i] for i in range(3)], F.col("k")
    z = F.when(F.col("__front"), y[2]).otherwise(1.0)
    o = o.withColumns({"__x": y[0] / z, "__v": y[1] / z, "__z": z})
    x, v, z = F.col("__x"), F.col("__v"), F.col("__z")
    r2 = x * x + v * v
    ring, slope = 1 + k["k1"] * r2 + k["k2"] * r2 * r2, 2 * (k["k1"] + 2 * k["k2"] * r2)
    mixed = x * v * slope + 2 * k["p1"] * x + 2 * k["p2"] * v
    dx = (ring + x * x * slope + 2 * k["p1"] * v + 6 * k["p2"] * x, mixed)
    dv = (mixed, ring + v * v * slope + 6 * k["p1"] * v + 2 * k["p2"] * x)
    seen = F.when(F.col("__front"), 1.0).otherwise(0.0)
    for name, f, d in (("__gu", k["fx"], dx), ("__gv", k["fy"], dv)):
        a, b = f * d[0] * seen, f * d[1] * seen
        o = o.withColumn(name, F.array(a / z, b / z, -(a * x + b * v) / z))
    u, w = project(*y, k)
    o = o.withColumn("e", F.array(*[F.when(F.col("__front"), p + 0.5 - F.col(q)).otherwise(0.0) for p, q in ((u, "u"), (w, "v"))]))
    jc, jp = [], []
    for name in ("__gu", "__gv"):
        g = [F.col(name)[i] for i in range(3)]
        jc += [c * F.col("__free") for c in (*cross(y, g), *g)]
        jp += [dot(g, [F.col("r_cw")[3 * i + j] for i in range(3)]) for j in range(3)]
    return o.select(*keys, "point_id", "image_id", "lam", "e", F.array(*jc).alias("jc"), F.array(*jp).alias("jp"))


@F.pandas_udf(ArrayType(DoubleType()))
def _inverses(blocks: pd.Series) -> pd.Series:
    """Inverses of 6x6 blocks; a camera that nothing moves gets a block that leaves it alone."""
    if not len(blocks):
        return blocks
    return pd.Series(list(_block_inverses(np.stack(blocks.to_numpy()).reshape(-1, 6, 6)).reshape(-1, 36)))


def _block_inverses(a: np.ndarray) -> np.ndarray:
    idle = np.trace(a, axis1=1, axis2=2) <= 0
    a[idle] = np.eye(6)
    a = a + np.eye(6) * (1e-12 * np.trace(a, axis1=1, axis2=2))[:, None, None]
    return np.linalg.inv(a)


def _turn(w: list[Column]) -> Column:
    """Rotation matrix of a rotation vector."""
    t2 = dot(w, w)
    t, small = F.sqrt(t2), t2 < 1e-16
    a, b = F.when(small, 1.0).otherwise(F.sin(t) / t), F.when(small, 0.5).otherwise((1 - F.cos(t)) / t2)
    skew = {(0, 1): -w[2], (0, 2): w[1], (1, 0): w[2], (1, 2): -w[0], (2, 0): -w[1], (2, 1): w[0]}
    return F.array(*[b * w[i] * w[j] + (F.cos(t) if i == j else a * skew[i, j]) for i in range(3) for j in range(3)])


class _Model:
    """Tables of one adjustment: observations bucketed by point, and how wide vectors travel."""

    def __init__(self, observations, images, keys):
        self.spark, self.keys = observations.sparkSession, keys
        self.image, self.point = [*keys, "image_id"], [*keys, "point_id"]
        small = images.limit(CAMERA_ROWS + 1).count() <= CAMERA_ROWS
        self.sent = F.broadcast if small else (lambda df: df)
        self.buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.observations = self.bucketed(observations)

    def bucketed(self, df: DataFrame) -> DataFrame:
        name = f"adjust_{uuid.uuid4().hex}"
        rows = df.repartition(self.buckets, *self.point)
        save_table(rows.write.bucketBy(self.buckets, *self.point).sortBy(*self.point), name, shared_dir(self.spark))
        return self.spark.table(name)

    def posed(self, poses: DataFrame, points: DataFrame) -> DataFrame:
        return self.observations.join(points, self.point).join(self.sent(poses), self.image)

    def costs(self, poses: DataFrame, points: DataFrame) -> DataFrame:
        e = _errors(self.posed(poses, points))
        ok = F.col("depth") > 0
        squares = F.sum(F.when(ok, F.col("err") * F.col("err")).otherwise(BEHIND))
        return materialise(e.groupBy(*self.keys, "lam_id").agg(squares.alias("cost"), F.avg(F.when(ok, F.col("err"))).alias("error"), F.count(F.lit(1)).alias("observations")))

    def eliminated(self, o: DataFrame, t: tuple[str, str]) -> tuple[DataFrame, list[str]]:
        """What is left of two numbers an observation when its point follows as it likes."""
        w = "PARTITION BY " + ", ".join(f"`{c}`" for c in self.point)
        o = o.selectExpr("*", *[f"sum(jp[{i}]*{t[0]} + jp[{3 + i}]*{t[1]}) OVER ({w}) AS __p{i}" for i in range(3)])
        m = [" + ".join(f"vinv[{_PLACE[i][j]}]*__p{j}" for j in range(3)) for i in range(3)]
        return o, [f"({t[k]} - ({' + '.join(f'jp[{3 * k + i}]*({m[i]})' for i in range(3))}))" for k in (0, 1)]

    def moved(self, rows: DataFrame, p: DataFrame) -> DataFrame:
        """Observations with how far (__t0, __t1) the step p (image, step) moves them."""
        o = rows.join(self.sent(p), self.image)
        return o.selectExpr("*", *[" + ".join(f"jc[{6 * k + i}]*step[{i}]" for i in range(6)) + f" AS __t{k}" for k in (0, 1)])

    def by_image(self, o: DataFrame, s: list[str], name: str, *more: str) -> DataFrame:
        back = ", ".join(f"sum(jc[{i}]*__s0 + jc[{6 + i}]*__s1)" for i in range(6))
        o = o.selectExpr("*", *[f"{t} AS __s{k}" for k, t in enumerate(s)])
        return o.groupBy(*self.image).agg(*map(F.expr, (f"array({back}) AS {name}", *more)))


def _vector(text: str) -> str:
    """A text with # for the place, over six places."""
    return f"array({', '.join(text.replace('#', str(i)) for i in range(6))})"


def _sum(text: str) -> str:
    return f"sum({' + '.join(text.replace('#', str(i)) for i in range(6))})"


_SOLVED = "array(" + ", ".join(" + ".join(f"inv[{6 * i + j}]*r[{j}]" for j in range(6)) for i in range(6)) + ") AS z"


def _shift(m: _Model, rows: DataFrame, steps: int) -> DataFrame:
    """The cameras' step (image, step) by preconditioned conjugate gradients, with one table written and one sum over a model a step.

    Both sums that a step needs are taken of the same table: the length of its
    direction follows from the step before."""
    o, s = m.eliminated(rows, ("e[0]", "e[1]"))
    blocks = ", ".join(f"sum(jc[{i}]*jc[{j}] + jc[{6 + i}]*jc[{6 + j}])" for i in range(6) for j in range(6))
    start = m.by_image(o, s, "pull", f"array({blocks}) AS block", "first(lam) AS lam")
    start = start.selectExpr(*m.image, "block", f"array({', '.join(f'block[{7 * i}]*lam' for i in range(6))}) AS damp", f"{_vector('-pull[#]')} AS r")
    damped = ", ".join(f"block[{6 * i + j}]" + (f" + damp[{i}]" if i == j else "") for i in range(6) for j in range(6))
    start = start.withColumn("inv", _inverses(F.expr(f"array({damped})")))
    none = _vector("0D")
    state = materialise(start.selectExpr(*m.image, "0 AS lam_id", "damp", "inv", f"{none} AS x", "r", _SOLVED, f"{none} AS p", f"{none} AS s", "0D AS len", "0D AS by"))
    whole = [*m.keys, "lam_id"]
    for _ in range(steps):
        o, s = m.eliminated(m.moved(rows, state.selectExpr(*m.image, "z AS step")), ("__t0", "__t1"))
        w = m.by_image(o, s, "__w")
        state = materialise(state.join(m.sent(w), m.image).selectExpr(*m.image, "lam_id", "damp", "inv", "x", "r", "z", "p", "s", "len", "by", f"{_vector('__w[#] + damp[#]*z[#]')} AS w"))
        sums = state.groupBy(*whole).agg(*map(F.expr, (_sum("r[#]*z[#]") + " AS len2", _sum("w[#]*z[#]") + " AS wz", "first(len) AS len1", "first(by) AS by1")))
        sums = sums.selectExpr(*whole, "len2", "if(len1 > 0, len2/len1, 0D) AS keep", "wz - if(by1 > 0, if(len1 > 0, len2/len1, 0D)*len2/by1, 0D) AS pull2")
        sums = sums.selectExpr(*whole, "len2", "keep", "if(pull2 > 0, len2/pull2, 0D) AS by2")
        state = state.join(m.sent(sums), whole).selectExpr(*m.image, "lam_id", "damp", "inv", "x", "r", f"{_vector('z[#] + keep*p[#]')} AS p", f"{_vector('w[#] + keep*s[#]')} AS s", "len2 AS len", "by2 AS by")
        state = state.selectExpr(*m.image, "lam_id", "damp", "inv", f"{_vector('x[#] + by*p[#]')} AS x", f"{_vector('r[#] - by*s[#]')} AS r", "p", "s", "len", "by")
        state = state.selectExpr(*m.image, "lam_id", "damp", "inv", "x", "r", _SOLVED, "p", "s", "len", "by")
    return materialise(state.selectExpr(*m.image, "x AS step"))


def _followed(m: _Model, rows: DataFrame, step: DataFrame) -> DataFrame:
    """How far each point goes when the cameras take their step: point, dx, dy, dz."""
    o = m.moved(rows, step)
    per = o.groupBy(*m.point).agg(F.expr("first(vinv) AS vinv"), *[F.expr(f"sum(jp[{i}]*(__t0 + e[0]) + jp[{3 + i}]*(__t1 + e[1])) AS g{i}") for i in range(3)])
    return per.selectExpr(*m.point, *[f"-({' + '.join(f'vinv[{_PLACE[i][j]}]*g{j}' for j in range(3))}) AS d{n}" for i, n in enumerate("xyz")])


def _adjust_group(g: _Group, free: np.ndarray, x: np.ndarray, rounds: int, steps: int, damping: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """One model: its turns, shifts and points after all rounds, and (error before, error after, rounds taken). As ``_adjust_large``, sum by sum."""

    def costs(r, t, x):
        y, du, dv = g.seen_at(r, t, x)
        squares, front = du * du + dv * dv, y[:, 2] > 0
        return float(np.where(front, squares, BEHIND).sum()), float(np.sqrt(squares[front]).mean()) if front.any() else None

    r, t, lam, taken = g.r, g.t, damping, 0
    cost, error = costs(r, t, x)
    before = error
    fx, fy, _, _, k1, k2, p1, p2 = g.lens()
    for _ in range(rounds):
        y, du, dv = g.seen_at(r, t, x)
        front = y[:, 2] > 1e-9
        z = np.where(front, y[:, 2], 1.0)
        a, b = y[:, 0] / z, y[:, 1] / z
        r2 = a * a + b * b
        ring, slope = 1 + k1 * r2 + k2 * r2 * r2, 2 * (k1 + 2 * k2 * r2)
        mixed = a * b * slope + 2 * p1 * a + 2 * p2 * b
        da, db = (ring + a * a * slope + 2 * p1 * b + 6 * p2 * a, mixed), (mixed, ring + b * b * slope + 6 * p1 * b + 2 * p2 * a)
        e = np.stack([du, dv], axis=1) * front[:, None]
        at = np.stack([np.stack([f * m[0] / z, f * m[1] / z, -f * (m[0] * a + m[1] * b) / z], axis=1) for f, m in ((fx, da), (fy, db))], axis=1) * front[:, None, None]
        jc = np.concatenate([np.cross(y[:, None], at), at], axis=2) * free[g.image][:, None, None]
        jp = np.einsum("nki,nij->nkj", at, r[g.image])
        grown = g.by_point(np.einsum("nki,nkj->nij", jp, jp))
        grown[:, range(3), range(3)] = grown[:, range(3), range(3)] * (1 + lam) + 1e-12
        vinv = _inverted(grown)[0]

        def left(s):
            held = np.einsum("pij,pj->pi", vinv, g.by_point(np.einsum("nk,nki->ni", s, jp)))
            return g.by_image(np.einsum("nk,nki->ni", s - np.einsum("nki,ni->nk", jp, held[g.point]), jc))

        moved = lambda step: np.einsum("nki,ni->nk", jc, step[g.image])
        block = g.by_image(np.einsum("nki,nkj->nij", jc, jc))
        damp = block[:, range(6), range(6)] * lam
        inv = _block_inverses(block + damp[:, :, None] * np.eye(6))
        solved = lambda q: np.einsum("cij,cj->ci", inv, q)
        rest = -left(e)
        step, p, s, last, by, q = np.zeros_like(rest), 0.0, 0.0, 0.0, 0.0, solved(rest)
        for _ in range(steps):
            w = left(moved(q)) + damp * q
            now = float((rest * q).sum())
            keep = now / last if last > 0 else 0.0
            pull = float((w * q).sum()) - (keep * now / by if by > 0 else 0.0)
            by = now / pull if pull > 0 else 0.0
            p, s, last = q + keep * p, w + keep * s, now
            step, rest = step + by * p, rest - by * s
            q = solved(rest)
        turn = _turns(step[:, :3])
        r_new, t_new = turn @ r, np.einsum("cij,cj->ci", turn, t) + step[:, 3:]
        x_new = x - np.einsum("pij,pj->pi", vinv, g.by_point(np.einsum("nk,nki->ni", moved(step) + e, jp)))
        cost_new, error_new = costs(r_new, t_new, x_new)
        if cost_new < cost:
            r, t, x, cost, error, lam, taken = r_new, t_new, x_new, cost_new, error_new, lam / 10, taken + 1
        else:
            lam *= 10
    return r, t, x, [before, error, taken]


def _turns(w: np.ndarray) -> np.ndarray:
    """As ``_turn``."""
    t2 = (w * w).sum(axis=1)
    small = t2 < 1e-16
    t = np.sqrt(np.where(small, 1.0, t2))
    a, b = np.where(small, 1.0, np.sin(t) / t), np.where(small, 0.5, (1 - np.cos(t)) / np.where(small, 1.0, t2))
    skew = np.zeros((len(w), 3, 3))
    skew[:, [2, 0, 1], [1, 2, 0]], skew[:, [1, 2, 0], [2, 0, 1]] = w, -w
    return b[:, None, None] * w[:, :, None] * w[:, None, :] + np.where(small, np.cos(np.sqrt(t2)), np.cos(t))[:, None, None] * np.eye(3) + a[:, None, None] * skew


def adjust(images: DataFrame, points: DataFrame, observations: DataFrame, cameras: DataFrame, keys: tuple[str, ...] = (), rounds: int = 6, steps: int = 10, damping: float = 1e-3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Damped Gauss-Newton over poses and points by squared pixel errors: (images, points, report).

    images: keys, image_id, camera_id, r_cw, t_cw and, if some poses shall stay, a
    boolean ``fixed``; points: keys, point_id, x, y, z; observations: keys, image_id,
    point_id, u, v; cameras as read from a model. Further columns are handed on.
    Each model (keys) has a damping of its own: a round that makes its squares
    smaller is taken and the damping divided by 10, else it is refused and the
    damping multiplied by 10. The report has a row a model: observations,
    error_before and error_after (mean, pixels, of what is in front), taken (rounds).

    Observations with a null, of unknown images or of unknown points take no part;
    what has none stays as it is, and a point seen once only follows its ray. An
    observation from behind has no pull. Lenses are not adjusted. All tables are read
    more than once, so they should be written ones."""
    names, keys = list(keys), list(keys) or ["__all"]
    whole = (lambda df: df) if names else (lambda df: df.withColumn("__all", F.lit(0)))
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in images.columns else F.lit(False)
    places = whole(points).select(*keys, "point_id", *[F.col(n).cast("double").alias(n) for n in "xyz"]).dropna()
    o = whole(observations).select(*keys, "image_id", "point_id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna()
    large = _large(keys, o, whole(images), places)
    poses = _numbers(_of(whole(images), large, keys, "left_anti"), cameras, keys, F.when(fixed, 0.0).otherwise(1.0).alias("free"))
    nothing = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    at = places.select(*keys, nothing("image_id", o), F.col("point_id").cast(o.schema["point_id"].dataType).alias("point_id"), nothing("u", o), nothing("v", o), F.array("x", "y", "z").alias("at"))
    rows = o.withColumn("at", F.lit(None).cast("array<double>")).unionByName(at)
    three, five = T.ArrayType(T.DoubleType()), [T.StructField(c, t) for c, t in (("observations", T.LongType()), ("error_before", T.DoubleType()), ("error_after", T.DoubleType()), ("taken", T.IntegerType()))]
    free = lambda f: T.StructField(f.name, f.dataType)
    kind = T.StructType([*[free(o.schema[c]) for c in keys], T.StructField("image_id", poses.schema["__image"].dataType), free(at.schema["point_id"]), *[T.StructField(c, three) for c in ("r_cw", "t_cw", "at")], *five])
    out_names = [f.name for f in kind]

    def solve(key, seen, posed):
        pts = seen.filter(pc.is_valid(seen.column("at")))
        g = _Group(seen.filter(pc.is_null(seen.column("at"))), posed, pts)
        types = {c: seen.schema.field(c).type for c in [*keys, "point_id"]} | {"image_id": posed.schema.field("__image").type, "observations": pa.int64(), "error_before": pa.float64(), "error_after": pa.float64(), "taken": pa.int32()} | {c: pa.list_(pa.float64()) for c in ("r_cw", "t_cw", "at")}
        kinds = pa.schema([(c, types[c]) for c in out_names])
        if not g.n:
            return kinds.empty_table()
        r, t, x, told = _adjust_group(g, posed.sort_by("__image").column("free").to_numpy(), _lists(pts.sort_by("point_id").column("at"), 3), rounds, steps, float(damping))
        listed = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), a.size // len(a)).cast(pa.list_(pa.float64()))
        found = [{"image_id": g.image_ids, "r_cw": listed(r), "t_cw": listed(t)}, {"point_id": g.point_ids, "at": listed(x)}, dict(zip(("observations", "error_before", "error_after", "taken"), ([n] for n in (g.n, *told))))]
        tables = []
        for part in found:
            n = len(next(iter(part.values())))
            part |= {k: [v.as_py()] * n for k, v in zip(keys, key)}
            tables.append(pa.table([part[c] if isinstance(part.get(c), (pa.Array, pa.ChunkedArray)) else pa.array(part.get(c, [None] * n), types[c]) for c in out_names], kinds))
        return pa.concat_tables(tables)

    found = materialise(_met(_of(rows, large, keys, "left_anti"), poses, keys).applyInArrow(solve, kind))
    posed = found.where("image_id IS NOT NULL").select(*keys, "image_id", F.col("r_cw").alias("__r"), F.col("t_cw").alias("__t"))
    placed = found.where("point_id IS NOT NULL").select(*keys, "point_id", *[F.col("at")[i].alias(f"__{n}") for i, n in enumerate("xyz")])
    report = found.where("observations IS NOT NULL").select(*names, "observations", "error_before", "error_after", "taken")
    if large is not None:
        told = [_of(df, large, keys, "left_semi").drop("__all") for df in (whole(images), places, o)]
        p, q, r = _adjust_large(*told, cameras, names, rounds, steps, damping)
        posed, placed, report = (a.unionByName(whole(b)) for a, b in ((posed, p), (placed, q), (whole(report), r)))
        report = report.drop("__all")
    images = whole(images).join(posed, [*keys, "image_id"], "left").withColumns({"r_cw": F.coalesce("__r", "r_cw"), "t_cw": F.coalesce("__t", "t_cw")}).drop("__r", "__t", "__all")
    points = whole(points).join(placed, [*keys, "point_id"], "left").withColumns({n: F.coalesce(f"__{n}", n) for n in "xyz"}).drop("__x", "__y", "__z", "__all")
    return images, points, report


def _adjust_large(images: DataFrame, points: DataFrame, observations: DataFrame, cameras: DataFrame, keys: list[str], rounds: int, steps: int, damping: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models of any size: (image with __r and __t, point with __x, __y and __z, report)."""
    lens = cameras.select("camera_id", intrinsics(F.col("model"), F.col("params")).alias("k"))
    fixed = F.coalesce(F.col("fixed"), F.lit(False)) if "fixed" in images.columns else F.lit(False)
    poses = images.withColumn("__free", F.when(fixed, 0.0).otherwise(1.0)).join(lens, "camera_id")
    poses = materialise(poses.select(*keys, "image_id", "r_cw", "t_cw", "k", "__free", F.lit(0).alias("lam_id")).dropna())
    places = materialise(points.select(*keys, "point_id", *[F.col(n).cast("double").alias(n) for n in "xyz"]).dropna())
    o = observations.select(*keys, "image_id", "point_id", F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).dropna()
    m = _Model(o.join(places.select(*keys, "point_id"), [*keys, "point_id"], "left_semi"), poses, keys)
    whole = [*keys, "lam_id"]
    now = m.costs(poses, places)
    report = now.select(*whole, "observations", F.col("error").alias("error_before"))
    scenes = materialise(now.select(*whole, "cost", "error", F.lit(float(damping)).alias("lam"), F.lit(0).alias("taken")))
    for _ in range(rounds):
        posed = m.posed(poses, places).join(m.sent(scenes.select(*whole, "lam")), whole)
        rows = _linearise(posed, keys)
        w = Window.partitionBy(*m.point)
        jp = [F.col("jp")[i] for i in range(6)]
        rows = rows.withColumns({f"__v{i}{j}": F.sum(jp[i] * jp[j] + jp[3 + i] * jp[3 + j]).over(w) for i, j in _SIX})
        # A point's own damping keeps the matrix of a single ray invertible.
        grown = [F.col(f"__v{i}{j}") * (1 + F.col("lam")) + 1e-12 if i == j else F.col(f"__v{i}{j}") for i, j in _SIX]
        vinv = F.coalesce(_inverse(F.array(*grown)), F.array(*[F.lit(0.0)] * 6))
        rows = m.bucketed(rows.withColumn("vinv", vinv).select(*m.point, "image_id", "lam", "e", "jc", "jp", "vinv"))
        step = _shift(m, rows, steps)
        d = [F.col("step")[i] for i in range(6)]
        turn = _turn(d[:3])
        new = poses.join(step, m.image, "left").withColumn("step", F.coalesce("step", F.array(*[F.lit(0.0)] * 6))).withColumn("__e", turn)
        shifted = mat_vec(F.col("__e"), [F.col("t_cw")[i] for i in range(3)])
        new = new.withColumns({"r2": mat_mul(F.col("__e"), F.col("r_cw")), "t2": F.array(*[shifted[i] + d[3 + i] for i in range(3)])})
        new = materialise(new.drop("step", "__e"))
        went = materialise(places.join(_followed(m, rows, step), m.point, "left").fillna(0.0, ["dx", "dy", "dz"]))
        tried = m.costs(
            new.select(*m.image, F.col("r2").alias("r_cw"), F.col("t2").alias("t_cw"), "k", "__free", "lam_id"),
            went.select(*m.point, *[(F.col(n) + F.col(f"d{n}")).alias(n) for n in "xyz"]),
        )
        judged = scenes.join(tried.select(*whole, F.col("cost").alias("c2"), F.col("error").alias("e2")), whole).withColumn("better", F.col("c2") < F.col("cost"))
        judged = materialise(judged)
        told = m.sent(judged.select(*whole, "better"))
        better = F.coalesce(F.col("better"), F.lit(False))
        scenes = judged.select(*whole, F.least("cost", "c2").alias("cost"), F.when(F.col("better"), F.col("e2")).otherwise(F.col("error")).alias("error"),
                               F.when(F.col("better"), F.col("lam") / 10).otherwise(F.col("lam") * 10).alias("lam"), (F.col("taken") + F.col("better").cast("int")).alias("taken"))
        poses = materialise(new.join(told, whole, "left").select(*m.image, F.when(better, F.col("r2")).otherwise(F.col("r_cw")).alias("r_cw"), F.when(better, F.col("t2")).otherwise(F.col("t_cw")).alias("t_cw"), "k", "__free", "lam_id"))
        places = went.withColumn("lam_id", F.lit(0)).join(told, whole, "left")
        places = materialise(places.select(*m.point, *[F.when(better, F.col(n) + F.col(f"d{n}")).otherwise(F.col(n)).alias(n) for n in "xyz"]))
    report = report.join(scenes.select(*whole, F.col("error").alias("error_after"), "taken"), whole).drop("lam_id")
    found = poses.select(*m.image, F.col("r_cw").alias("__r"), F.col("t_cw").alias("__t"))
    return found, places.select(*m.point, *[F.col(n).alias(f"__{n}") for n in "xyz"]), report
