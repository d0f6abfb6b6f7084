"""Grids as tables of cells (keys, row, col, value); a missing cell or null is a hole.

Rectangular minimum and maximum filters are separable: one window over the
columns of a row, one over the rows of a column, frames by index so that gaps
count. Filters with other shapes join an offset table or run an array kernel per
tile with a halo. A tile key in ``keys`` bounds every window's partition."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .joins import dealt, sorted_join


def rasterise_max(points: DataFrame, row, column, z: str = "z", keys: list[str] | None = None) -> DataFrame:
    """Highest point of every cell that has one."""
    return points.groupBy(*(keys or []), row.alias("row"), column.alias("col")).agg(F.max(z).alias("value"))


def dense(cells: DataFrame, height: int, width: int, every: DataFrame | None = None) -> DataFrame:
    """All cells of a grid, of one for each row of ``every`` (distinct keys) where given; those that were absent hold null."""
    if every is None:
        keys, every = [], cells.sparkSession.range(height * width).select(F.expr(f"id div {width}").alias("row"), (F.col("id") % width).alias("col"))
    else:
        keys, at = every.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height * width - 1).cast("long")))
        every = every.withColumn("__at", at).select(*keys, F.expr(f"__at div {width}").alias("row"), (F.col("__at") % width).alias("col"))
    return sorted_join(every, cells.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"), [*keys, "row", "col"], "left")


def _pass(df: DataFrame, agg, value: str, keys: list[str], along: str, across: str, before: int, after: int) -> DataFrame:
    w = Window.partitionBy(*keys, across).orderBy(along).rangeBetween(-before, after)
    return df.withColumn(value, agg(value).over(w))


def box(df: DataFrame, agg, size: int, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Square filter of odd size by two passes; the frame is cut at the border, which equals reflection for minima and maxima."""
    r = size // 2
    return _pass(_pass(df, agg, value, keys or [], "col", "row", r, r), agg, value, keys or [], "row", "col", r, r)


def erode(df, size, value="value", keys=None):
    return box(df, F.min, size, value, keys)


def dilate(df, size, value="value", keys=None):
    return box(df, F.max, size, value, keys)


def opening(df, size, value="value", keys=None):
    return dilate(erode(df, size, value, keys), size, value, keys)


def closing(df, size, value="value", keys=None):
    return erode(dilate(df, size, value, keys), size, value, keys)


def cross_filter(df: DataFrame, agg, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Minimum or maximum over a cell and its four neighbours, on a dense grid."""
    keys = keys or []
    a = _pass(df.withColumn("__h", F.col(value)), agg, "__h", keys, "col", "row", 1, 1)
    a = _pass(a.withColumn("__v", F.col(value)), agg, "__v", keys, "row", "col", 1, 1)
    both = F.least if agg is F.min else F.greatest
    return a.withColumn(value, both("__h", "__v")).drop("__h", "__v")


def binary_opening(df: DataFrame, rounds: int = 1, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Four-neighbour opening of a 0/1 column; the outside counts as 0 when it shrinks."""
    keys = keys or []
    for _ in range(rounds):
        n = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
        df = df.withColumn(value, F.least(value, *[F.coalesce(f(value).over(w), F.lit(0)) for w in n for f in (F.lag, F.lead)]))
    for _ in range(rounds):
        df = cross_filter(df, F.max, value, keys)
    return df


def disk_filter(df: DataFrame, agg, radius: int, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Minimum or maximum over a disk: each value is sent to the cells it reaches, then grouped."""
    keys = keys or []
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    sent = df.select(*keys, "row", "col", value, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])).alias("o"))
    got = sent.groupBy(*keys, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col")).agg(agg(value).alias(value))
    return sorted_join(df.drop(value), got, [*keys, "row", "col"])


def fill_low(df: DataFrame, rounds: int, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Holes next to known cells take the lowest of their eight neighbours, once a round; larger holes keep their middle."""
    for k in range(rounds):
        low = erode(df.withColumn("__low", F.col(value)), 3, "__low", keys)
        df = low.withColumn(value, F.coalesce(value, "__low")).drop("__low")
        if k % 4 == 3:
            df = materialise(df)
    return df


def fill_nearest(df: DataFrame, value: str = "value", keys: list[str] | None = None, max_distance: float | None = None) -> DataFrame:
    """Holes take the value of the nearest known cell (Euclidean; ties to the smaller row, then column).

    One pass finds the nearest known cell of every column above and below, the
    second, a kernel over 16 rows at a time, the best of each row's candidates."""
    keys = keys or []
    up = Window.partitionBy(*keys, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "col").orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.struct("row", F.col(value).cast("double").alias("v")))
    c = df.withColumns({"__u": F.last(at, ignorenulls=True).over(up), "__d": F.last(at, ignorenulls=True).over(down)})
    near = F.when(F.col("__u").isNull() | (F.col("__d.row") - F.col("row") < F.col("row") - F.col("__u.row")), F.col("__d")).otherwise(F.col("__u"))
    c = c.withColumn("__n", near).select(*keys, "row", "col", F.col("__n.row").cast("double").alias("nr"), F.col("__n.v").alias("nv"))
    limit = math.inf if max_distance is None else max_distance

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], kind="stable")
        row, x, nr, v = (pdf[c].to_numpy(float) for c in ("row", "col", "nr", "nv"))
        out = np.full(len(x), np.nan)
        ends = np.flatnonzero(np.diff(row, append=np.inf)) + 1
        for lo, hi in zip(np.r_[0, ends[:-1]], ends):
            known = lo + np.flatnonzero(~np.isnan(nr[lo:hi]))
            if not len(known):
                continue
            # Ties go to the first candidate: the smaller row, then the smaller column.
            known = known[np.lexsort((x[known], nr[known]))]
            kx, kd, kv = x[known], (nr[known] - row[lo]) ** 2, v[known]
            for at_ in range(lo, hi, 512):
                part = slice(at_, min(at_ + 512, hi))
                d = (x[part, None] - kx) ** 2 + kd
                best = d.argmin(axis=1)
                out[part] = np.where(d[np.arange(len(d)), best] <= limit * limit, kv[best], np.nan)
        pdf["value"] = out
        return pdf[[*keys, "row", "col", "value"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.select(*keys, "row", "col").schema) + ", value double"
    got = c.groupBy(*keys, F.floor(F.col("row") / 16).alias("__block")).applyInPandas(rows, schema)
    got = got.select(*keys, "row", "col", F.when(~F.isnan("value"), F.col("value")).alias("__f"))
    return sorted_join(df, got, [*keys, "row", "col"]).withColumn(value, F.coalesce(F.col(value), "__f")).drop("__f")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def tile_kernel(df: DataFrame, kernel, halo: int, tile: int = 256, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Run an array function over tiles with a halo: array in (NaN for holes), array of the same shape out.

    Cells near a tile's edge are sent to the neighbours that need them; every
    task holds one tile."""
    keys = keys or []
    spread = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    box_ = df.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    src = df.select(*keys, "row", "col", F.col(value).cast("double").alias("v")).withColumn("tr", spread("row")).withColumn("tc", spread("col"))
    src = src.join(box_, keys) if keys else src.crossJoin(box_)  # Spark broadcasts the boxes where they are small
    src = src.where("tr BETWEEN floor(r0 / %d) AND floor(r1 / %d) AND tc BETWEEN floor(c0 / %d) AND floor(c1 / %d)" % (tile, tile, tile, tile))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        a = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), np.nan)
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        a[r, c] = pdf["v"].to_numpy()
        pdf["value"] = kernel(a)[r, c]
        mine = (pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])
        return pdf.loc[mine, [*keys, "row", "col", "value"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, "row", "col").schema) + ", value double"
    out = src.groupBy(*keys, "tr", "tc").applyInPandas(run, schema)
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).withColumnRenamed("value", value)


def _blur(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    r = len(w) // 2
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = sum(wi * np.take(p, range(i, i + a.shape[axis]), axis=axis) for i, wi in enumerate(w))
    return a


def _median(a: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    p = np.pad(a, r, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), axis=(2, 3))


def gaussian(df, sigma, value="value", keys=None, tile=256):
    """Gaussian blur cut at four sigma, mirrored at the border."""
    w = gaussian_weights(sigma)
    return tile_kernel(df, lambda a: _blur(a, w), len(w) // 2, tile, value, keys)


def odd_cells(metres: float, gsd: float) -> int:
    return max(3, int(round(metres / gsd)) | 1)


def roughness(df, gsd, value="value", keys=None, tile=256):
    """Distance from the median surface of a 1.5 m window, lightly blurred."""
    k, w = odd_cells(1.5, gsd), gaussian_weights(max(1.0, 0.25 / gsd))
    return tile_kernel(df, lambda a: _blur(np.abs(a - _median(a, k)), w), k // 2 + len(w) // 2 + 1, tile, value, keys)


def curvature(df, gsd, value="value", keys=None, tile=256):
    """|Laplacian of Gaussian| of the median surface, per metre."""
    k, sigma = odd_cells(1.5, gsd), max(1.0, 0.5 / gsd)
    w = gaussian_weights(sigma)
    x = np.arange(len(w)) - len(w) // 2
    w2 = w * (x**2 / sigma**4 - 1 / sigma**2)

    def one(a, wr, wc):
        r = len(w) // 2
        p = np.pad(a, ((r, r), (0, 0)), mode="symmetric")
        a = sum(wi * p[i : i + a.shape[0]] for i, wi in enumerate(wr))
        p = np.pad(a, ((0, 0), (r, r)), mode="symmetric")
        return sum(wi * p[:, i : i + a.shape[1]] for i, wi in enumerate(wc))

    def kernel(a):
        m = _median(a, k)
        return np.abs(one(m, w2, w) + one(m, w, w2)) / gsd**2

    return tile_kernel(df, kernel, k // 2 + len(w) // 2 + 1, tile, value, keys)


def window_sizes(gsd: float, max_window_m: float) -> list[int]:
    """3, 5, 9, 17, ... cells while they do not exceed the largest window."""
    out, k = [], 0
    while (2 * 2**k + 1) * gsd <= max_window_m:
        out.append(2 * 2**k + 1)
        k += 1
    return out


#: Cells of the rectangle around a grid that is one group, and its columns.
GRID_CELLS, GRID_WIDTH = 1 << 20, 4096


def _by_extent(df: DataFrame, keys: list[str], value: str) -> DataFrame | None:
    """Keys of the grids that are no single group: their rectangle has more than GRID_CELLS cells or GRID_WIDTH columns, or a value is NaN, which is no hole."""
    side = lambda c: F.max(c).cast("double") - F.min(c) + 1
    found = df.groupBy(*keys).agg((side("row") * side("col")).alias("__area"), side("col").alias("__wide"), F.count_if(F.isnan(F.col(value).cast("double"))).alias("__nan"))
    found = materialise(found.where((F.col("__area") > GRID_CELLS) | (F.col("__wide") > GRID_WIDTH) | (F.col("__nan") > 0)).select(*keys))
    return None if found.isEmpty() else found


def _each_grid(df: DataFrame, keys: list[str] | None, value: str, kernel, out: T.StructField, beyond) -> DataFrame:
    """Adds a column: ``kernel`` (values, NaN for holes; which cells there are; the columns of the table) for grids that are one group, ``beyond`` (table, keys) for the others. The table is read twice."""
    by = keys or ["__all"]
    df = df if keys else df.withColumn("__all", F.lit(0))
    large = _by_extent(df, by, value)

    def run(key, t):
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        row, col = row - row.min(), col - col.min()
        a, there = np.full((row.max() + 1, col.max() + 1), np.nan), np.zeros((row.max() + 1, col.max() + 1), bool)
        a[row, col], there[row, col] = t.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False), True

        def spread(c):
            m = np.zeros(a.shape, bool)
            m[row, col] = t.column(c).fill_null(False).to_numpy(zero_copy_only=False)
            return m

        found = kernel(a, there, spread)[row, col]
        return t.append_column(out.name, pa.array(found, from_pandas=True))

    small = df if large is None else df.join(large, by, "left_anti")
    got = dealt(small, *by).groupBy(*by).applyInArrow(run, T.StructType([*small.schema.fields, out]))
    if large is not None:
        told = df.join(large, by, "left_semi").select(*df.columns)
        got = got.select(*df.columns, out.name).unionByName(beyond(told, keys).select(*df.columns, out.name))
    return got.select(*[c for c in df.columns if c != "__all"], out.name)


def _slide(a: np.ndarray, there: np.ndarray, best, size: int) -> np.ndarray:
    """As ``box``: fmin or fmax over a square, one axis after the other; what is no cell stays none."""
    r = size // 2
    for axis in (1, 0):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], constant_values=np.nan)
        n = a.shape[axis]
        a = p[:, :n] if axis else p[:n]
        for i in range(1, 2 * r + 1):
            a = best(a, p[:, i : i + n] if axis else p[i : i + n])
        a = np.where(there, a, np.nan)
    return a


def _nearest(a: np.ndarray, there: np.ndarray) -> np.ndarray:
    """As ``fill_nearest``: holes take the nearest known value, ties to the smaller row, then column."""
    h, w = a.shape
    row, known = np.arange(h)[:, None], ~np.isnan(a)
    up = np.maximum.accumulate(np.where(known, row, -1), axis=0)
    down = np.minimum.accumulate(np.where(known, row, h)[::-1], axis=0)[::-1]
    near = np.where((up < 0) | ((down < h) & (down - row < row - up)), down, up)
    usable = there & (near < h)
    rest = np.int64(h) * w
    cost = np.where(usable, (near - row).astype(np.int64) ** 2 * rest + near * w + np.arange(w), np.iinfo(np.int64).max // 2)
    out = a.copy()
    for i in np.flatnonzero((there & ~known).any(axis=1) & usable.any(axis=1)):
        holes, some = np.flatnonzero(there[i] & ~known[i]), np.flatnonzero(usable[i])
        for lo in range(0, len(holes), 512):
            part = holes[lo : lo + 512]
            at = some[((part[:, None] - some) ** 2 * rest + cost[i, some]).argmin(axis=1)]
            out[i, part] = a[near[i, at], at]
    return out


def ground_filter(dsm: DataFrame, gsd: float, max_window_m: float = 40.0, slope: float = 0.15, dh0: float = 0.3, dh_max: float = 3.0, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Progressive morphological filter on a dense grid: adds ``ground``.

    Growing openings take off what stands out by more than the terrain's slope
    allows. Holes are filled for the filter and are no ground. Grids of at most
    GRID_CELLS are a group each; for larger ones each round's surface is written,
    so a lost executor costs one round."""
    rounds, prev = [], 1
    for w in window_sizes(gsd, max_window_m):
        rounds.append((w, min(dh_max, dh0 + slope * (w - prev) * gsd)))
        prev = w

    def kernel(a, there, _):
        ground, s = ~np.isnan(a), _nearest(a, there)
        for w, allowed in rounds:
            o = _slide(_slide(s, there, np.fmin, w), there, np.fmax, w)
            ground, s = ground & (s - o <= allowed), o
        return ground

    return materialise(_each_grid(materialise(dsm), keys, value, kernel, T.StructField("ground", T.BooleanType()), lambda df, by: _ground_by_rounds(df, rounds, value, by)))


def _ground_by_rounds(dsm: DataFrame, rounds: list[tuple[int, float]], value: str, keys: list[str] | None) -> DataFrame:
    keys = keys or []
    df = dsm.withColumn("__s", F.col(value).cast("double"))
    df = materialise(fill_nearest(df, "__s", keys).withColumn("ground", F.col(value).isNotNull()))
    for w, allowed in rounds:
        df = opening(df.withColumn("__o", F.col("__s")), w, "__o", keys)
        df = materialise(df.withColumn("ground", F.col("ground") & (F.col("__s") - F.col("__o") <= allowed)).withColumn("__s", F.col("__o")).drop("__o"))
    return df.drop("__s")


def terrain(dsm: DataFrame, gsd: float, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Ground cells spread to all others by nearness, then blurred: keys, row, col, dtm. Needs ``ground``. The grids are read twice, so they should be a written table."""
    sigma = max(1.0, 1.0 / gsd)
    weights = gaussian_weights(sigma)

    def beyond(df, by):
        g = df.withColumn("dtm", F.when(F.col("ground"), F.col(value).cast("double")))
        found = gaussian(fill_nearest(g, "dtm", by), sigma, "dtm", by).select(*(by or []), "row", "col", "dtm")
        return sorted_join(df, found, [*(by or []), "row", "col"])

    def kernel(a, there, spread):
        return _blur(_nearest(np.where(spread("ground"), a, np.nan), there), weights)

    return _each_grid(dsm, keys, value, kernel, T.StructField("dtm", T.DoubleType()), beyond).select(*(keys or []), "row", "col", "dtm")


def gradients(df: DataFrame, gsd: float, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Adds dzdx and dzdy (per metre), central inside, one-sided at borders and holes."""
    keys = keys or []
    out = {}
    for name, along, across in (("dzdx", "col", "row"), ("dzdy", "row", "col")):
        w = Window.partitionBy(*keys, across).orderBy(along)
        a, b = F.lag(value).over(w), F.lead(value).over(w)
        out[name] = F.coalesce((b - a) / (2 * gsd), (b - F.col(value)) / gsd, (F.col(value) - a) / gsd)
    return df.withColumns(out)


def bilinear(points: DataFrame, grid: DataFrame, row: str = "y", column: str = "x", value: str = "value", id_col: str = "id") -> DataFrame:
    """Adds ``sampled``: the grid between cell centres at whole numbers, clamped at its border.

    A point becomes its four corners and one equi-join fetches them."""
    box_ = grid.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    p = points.crossJoin(box_)
    y, x = F.greatest(F.col("r0"), F.least(F.col("r1"), F.col(row))), F.greatest(F.col("c0"), F.least(F.col("c1"), F.col(column)))
    p = p.withColumns({"__y": y.cast("double"), "__x": x.cast("double")})
    fy, fx = F.col("__y") - F.floor("__y"), F.col("__x") - F.floor("__x")
    corner = [F.struct(F.least(F.col("r1"), F.floor("__y") + i).cast("long").alias("row"), F.least(F.col("c1"), F.floor("__x") + j).cast("long").alias("col"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)]
    c = p.select(id_col, F.explode(F.array(*corner)).alias("k")).select(id_col, "k.*")
    g = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).alias("__v"))
    got = c.join(g, ["row", "col"], "left").groupBy(id_col).agg(F.sum(F.col("w") * F.col("__v")).alias("sampled"))
    return points.join(got, id_col)


def hull_spans(corners: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last) of the cells of a filled hull, its outline drawn too. Corners (col, row) are whole cells."""
    spans: dict[int, list[float]] = {}
    for (x0, y0), (x1, y1) in zip(corners, np.roll(corners, -1, axis=0)):
        steps = int(max(abs(x1 - x0), abs(y1 - y0), 1))
        for t in range(steps + 1):
            x, y = np.floor(x0 + (x1 - x0) * t / steps + 0.5), np.floor(y0 + (y1 - y0) * t / steps + 0.5)
            s = spans.setdefault(int(y), [x, x])
            s[0], s[1] = min(s[0], x), max(s[1], x)
    return [(y, int(a), int(b)) for y, (a, b) in sorted(spans.items())]


def hull_fraction(observed: DataFrame) -> float:
    """Share of observed cells among all cells in the convex hull of the largest closed component. Rows (row, col, value 0/1), dense."""
    from .components import grid_components
    from .kernels import convex_hull

    seen = observed.where("value = 1")
    size = observed.agg(F.max("row").alias("r"), F.max("col").alias("c"), F.count_if(F.col("value") == 1).alias("n")).first()
    if size["n"] < 3:
        return 0.0
    # Outside the grid counts as empty, so the closing leaves no cell within two of its border.
    closed = closing(observed, 5).where("value = 1").where(F.col("row").between(2, size["r"] - 2) & F.col("col").between(2, size["c"] - 2))
    parts = grid_components(closed)
    top = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "component").limit(1)
    # A hull's corners are among each row's first and last cell: bounded by the grid's height.
    ends = parts.join(top.select("component"), "component", "left_semi").groupBy("row").agg(F.min("col").alias("a"), F.max("col").alias("b")).collect()
    if not ends:
        return 0.0
    pts = np.array(sorted({(r[c], r["row"]) for r in ends for c in ("a", "b")}), float)
    flat = len(np.unique(pts[:, 0])) == 1 or len(np.unique(pts[:, 1])) == 1
    spans = hull_spans(pts[[0, -1]] if flat else np.asarray(convex_hull(pts), float))
    rows = observed.sparkSession.createDataFrame(spans, "row long, first long, last long")
    inside = seen.select("row", "col").join(F.broadcast(rows), "row").where("col BETWEEN first AND last").count()
    return inside / sum(b - a + 1 for _, a, b in spans)


def mask_iou(cells: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Intersection over union of two 0/1 columns, 0 where both are empty."""
    both, either = F.count_if((F.col(a) == 1) & (F.col(b) == 1)), F.count_if((F.col(a) == 1) | (F.col(b) == 1))
    return cells.groupBy(*keys).agg(F.when(either > 0, both / either).otherwise(0.0).alias("iou"))


def masked_fractions(masks: DataFrame, key: str = "image", flag: str = "dynamic") -> DataFrame:
    """The share of each image's pixels that its mask covers. Masks: key, row, col, flag; every pixel listed."""
    return masks.groupBy(key).agg(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("int")).alias("masked_fraction"))


def mask_report(masks: DataFrame, key: str = "image", flag: str = "dynamic") -> DataFrame:
    """One row over all images: how many there are, and the mean and the greatest share that is masked (0 without images)."""
    f = F.col("masked_fraction")
    return masked_fractions(masks, key, flag).agg(F.count(F.lit(1)).alias("num_masks"), F.coalesce(F.avg(f), F.lit(0.0)).alias("mean_masked_fraction"), F.coalesce(F.max(f), F.lit(0.0)).alias("max_masked_fraction"))
