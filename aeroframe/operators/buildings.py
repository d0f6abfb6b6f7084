"""Buildings: extraction from height grids, records, footprints, roofs, facades, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geodesy import compass
from ..functions.grids import roof_height, to_local
from ..functions.vectors import norm
from ..session import materialise
from . import kernels
from .components import grid_components
from .gates import first_reason
from .joins import few
from .mesh import ridge_points, ring_edges, wall_quads
from .quantiles import grouped_percentiles
from .raster import binary_opening, curvature, dilate, disk_filter, roughness

# Extraction defaults.
CONFIG = {"min_height_m": 2.5, "min_area_m2": 12.0, "max_roughness_m": 0.35, "max_curvature": 0.6, "max_exg": 0.1}


def records(cells: DataFrame, gsd: float, key: str = "component") -> DataFrame:
    """One record per labelled area. Cells: key, h (height above ground), ground, observed (0/1); null heights are left out of the measures."""
    return cells.groupBy(key).agg(
        (F.count(F.lit(1)) * gsd * gsd).alias("area_m2"), F.percentile("h", 0.2).alias("eave_height_m"), F.percentile("h", 0.95).alias("ridge_height_m"), F.avg("h").alias("mean_height_m"),
        (F.sum(F.greatest(F.col("h"), F.lit(0.0))) * gsd * gsd).alias("volume_m3"), F.percentile("ground", 0.5).alias("ground_height_m"), F.avg("observed").alias("roof_observed_frac"),
    )


def rejection(area, greenness, rough, curve, colour_known, config: dict | None = None):
    """Why an area is no building, the first reason that holds, or null."""
    c = CONFIG | (config or {})
    return first_reason({
        "small": area < c["min_area_m2"], "vegetation": colour_known & (greenness > c["max_exg"]), "rough": (rough > c["max_roughness_m"]) | (~colour_known & (curve > c["max_curvature"])),
    })


def extract(grid: DataFrame, gsd: float, config: dict | None = None, tile: int = 256) -> DataFrame:
    """Cells of buildings on a dense grid: row, col, component, h, ground, observed, rough.

    Grid: row, col, dsm, dtm, observed and, where there is an ortho, exg. Tall,
    smooth and not green cells are opened and labelled; labels grow back over what is
    tall around them but not over tree crowns. Each area is then cut at half its
    eave height and keeps its largest part."""
    c = CONFIG | (config or {})
    if "exg" not in grid.columns:
        grid = grid.withColumn("exg", F.lit(None).cast("double"))
    g = grid.withColumn("h", F.col("dsm") - F.col("dtm"))
    rough = roughness(g.select("row", "col", "dsm"), gsd, "dsm", tile=tile).withColumnRenamed("dsm", "rough")
    curve = curvature(g.select("row", "col", "dsm"), gsd, "dsm", tile=tile).withColumnRenamed("dsm", "curve")
    g = materialise(g.join(rough, ["row", "col"]).join(curve, ["row", "col"]))
    known, green = F.col("exg").isNotNull(), F.coalesce(F.col("exg") > c["max_exg"], F.lit(False))
    tall = F.coalesce(F.col("h") >= c["min_height_m"], F.lit(False))
    core = tall & F.coalesce(F.col("rough") <= c["max_roughness_m"], F.lit(False)) & ~green & (known | F.coalesce(F.col("curve") <= c["max_curvature"], F.lit(False)))
    crown = tall & (green | (~known & F.coalesce(F.col("curve") > 2 * c["max_curvature"], F.lit(False))) | F.coalesce(F.col("rough") > 3 * c["max_roughness_m"], F.lit(False)))
    g = g.withColumns({"tall": tall, "core": core.cast("int"), "crown": crown.cast("int")})
    g = materialise(binary_opening(g, max(1, round(0.5 / gsd)), "core"))
    radius = max(1, round(1.0 / gsd))
    trees = disk_filter(disk_filter(g.select("row", "col", "crown"), F.min, radius, "crown"), F.max, radius, "crown")
    labels = grid_components(g.where("core = 1"))
    g = g.drop("crown").join(trees, ["row", "col"]).join(labels, ["row", "col"], "left")
    reach = max(1, int(np.ceil(1.5 / gsd)))
    g = dilate(g.withColumn("near", F.col("component")), 2 * reach + 1, "near")
    g = g.withColumn("label", F.coalesce("component", F.when(F.col("tall") & (F.col("crown") == 0), F.col("near")))).where("label IS NOT NULL")
    g = materialise(g.select("row", "col", "label", "h", "dtm", "observed", "rough", "curve", "exg"))
    per = g.groupBy("label").agg((F.count(F.lit(1)) * gsd * gsd).alias("area"), F.percentile("exg", 0.5).alias("green"), F.percentile("rough", 0.5).alias("mid_rough"), F.percentile("curve", 0.5).alias("mid_curve"), F.percentile("h", 0.2).alias("eave"))
    per = per.withColumn("reason", rejection(F.col("area"), F.col("green"), F.col("mid_rough"), F.col("mid_curve"), F.col("green").isNotNull(), c)).where("reason IS NULL")
    cut = g.join(per.select("label", "eave"), "label").where(F.col("h") >= F.greatest(F.lit(float(c["min_height_m"])), F.col("eave") / 2))
    # Parts are found inside a label: rows of different labels are set apart.
    parts = grid_components(cut.select("row", "col"))
    cut = cut.join(parts, ["row", "col"])
    best = cut.groupBy("label", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max_by("component", F.struct("n", F.negative("component"))).alias("component"), F.max("n").alias("n")).where(F.col("n") * gsd * gsd >= c["min_area_m2"])
    return cut.join(best.select("label", "component"), ["label", "component"], "left_semi").select("row", "col", "component", "h", F.col("dtm").alias("ground"), F.col("observed").cast("int").alias("observed"), "rough")


RING = "array<struct<x:double,y:double>>"


def footprints(cells: DataFrame, xmin: float, ymax: float, gsd: float, key: str = "component") -> DataFrame:
    """key, ring (map metres, counter-clockwise), shape, iou, angle, length, width. One building's mask a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        mask = np.zeros((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), bool)
        mask[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = True
        ring, shape, score = kernels.regular_footprint(mask, gsd)
        xy = np.column_stack([xmin + (ring[:, 0] + c0) * gsd, ymax - (ring[:, 1] + r0) * gsd])
        if kernels.signed_area(xy) < 0:
            xy = xy[::-1]
        length, width, angle, _ = kernels.min_rectangle(xy)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in xy]], "shape": [shape], "iou": [score], "angle": [float(angle)], "length_m": [length], "width_m": [width]})

    return cells.groupBy(key).applyInPandas(run, f"{key} long, ring {RING}, shape string, iou double, angle double, length_m double, width_m double")


def roofs(samples: DataFrame, key: str = "component", gable: bool = True, penalty: float = 0.04) -> DataFrame:
    """Roof model of each building from samples (key, u, v, z): kind, params, residual. Samples of one roof a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind, params, r = kernels.fit_roof(*(pdf[c].to_numpy(float) for c in "uvz"), gable, penalty)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "kind": [kind], "params": [params], "residual": [r]})

    return samples.groupBy(key).applyInPandas(run, f"{key} long, kind string, params map<string,double>, residual double")


def roof_samples(cells: DataFrame, xmin: float, ymax: float, gsd: float, frames: DataFrame, most: int = 6000, key: str = "component") -> DataFrame:
    """At most about ``most`` cells of each building in its own frame: key, u, v, z. Every n-th cell by hash, not a draw. Frames: key, ox, oy, angle."""
    n = cells.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("step"))
    c = cells.join(n, key).where(F.pmod(F.xxhash64("row", "col"), "step") == 0).join(frames, key)
    dx, dy = F.lit(xmin) + (F.col("col") + 0.5) * gsd - F.col("ox"), F.lit(ymax) - (F.col("row") + 0.5) * gsd - F.col("oy")
    return c.select(key, (dx * F.cos("angle") + dy * F.sin("angle")).alias("u"), (dy * F.cos("angle") - dx * F.sin("angle")).alias("v"), (F.col("h") + F.col("ground")).alias("z"))


def roof_meshes(buildings: DataFrame, key: str = "component") -> DataFrame:
    """Roof triangles, split at the ridge: key, grp, k and three corners. Buildings: key, ring in the roof's frame, kind, params."""

    def run(batches):
        for b in batches:
            out = []
            for i, ring, kind, p in zip(b[key], b["ring"], b["kind"], b["params"]):
                p = dict(p)
                xy = np.array([(q["x"], q["y"]) for q in ring])
                parts = kernels.split_ring(xy, 1, p["v0"]) if kind == "gable_u" else kernels.split_ring(xy, 0, p["u0"]) if kind == "gable_v" else [xy]
                for g, part in enumerate(parts):
                    u, v = part[:, 0], part[:, 1]
                    z = {"flat": lambda: np.full(len(u), p["c"]), "shed": lambda: p["a"] * u + p["b"] * v + p["c"], "gable_u": lambda: p["zr"] - p["s"] * np.abs(v - p["v0"]), "gable_v": lambda: p["zr"] - p["s"] * np.abs(u - p["u0"])}[kind]()
                    for k, t in enumerate(kernels.triangulate(part)):
                        out.append((i, g, k, *[float(w) for c in t for w in (u[c], v[c], z[c])]))
            yield pd.DataFrame(out, columns=[key, "grp", "k", *[f"{c}{n}" for n in range(3) for c in "xyz"]])

    return buildings.select(key, "ring", "kind", "params").mapInPandas(run, f"{key} long, grp int, k int, " + ", ".join(f"{c}{n} double" for n in range(3) for c in "xyz"))


PARAMETERS = ("c", "a", "b", "zr", "s", "v0", "u0")


def regular_buildings(cells: DataFrame, grid: DataFrame, xmin: float, ymax: float, gsd: float, key: str = "component") -> DataFrame:
    """Whole buildings: key, ring (map metres), shape, iou, angle, ox, oy, corners (of the ring in the roof's frame, ridge ends put in), kind, params, residual, base_z, ground_z, eave_m, ridge_m, area_m2.

    Cells as ``extract`` gives them; grid: row, col, dtm. Walls stand on the lowest
    tenth of the terrain round the outline and heights count from its median. A roof
    that would dip to within half a metre of the base is flat at the median sample."""
    fp = footprints(cells, xmin, ymax, gsd, key)
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[c]) / F.size("ring")
    fp = materialise(fp.withColumns({"ox": mean("x"), "oy": mean("y")}))
    samples = materialise(roof_samples(cells, xmin, ymax, gsd, fp.select(key, "ox", "oy", "angle"), key=key))
    models = roofs(samples, key).join(samples.groupBy(key).agg(F.percentile("z", 0.5).alias("mid_z")), key)
    # Terrain in a band round the outline, under the building where there is none.
    reach = max(1, round(1.0 / gsd))
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if abs(i) + abs(j) <= reach]
    own = cells.select(key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    near = own.select(key, F.explode(F.array(*[F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in steps])).alias("c")).select(key, "c.*").distinct()
    terrain = grid.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "dtm").where("dtm IS NOT NULL")
    band = near.join(own, [key, "row", "col"], "left_anti").join(terrain, ["row", "col"])
    heights = lambda df, p: df.groupBy(key).agg(F.percentile("dtm", 0.1).alias(f"{p}base"), F.percentile("dtm", 0.5).alias(f"{p}ground"))
    below = heights(own.join(terrain, ["row", "col"]), "under_").join(heights(band, ""), key, "left")
    below = below.select(key, F.coalesce("base", "under_base").alias("base_z"), F.coalesce("ground", "under_ground").alias("ground_z"))
    b = fp.join(models, key).join(below, key)
    u, v = to_local(F.col("p.x"), F.col("p.y"), "ox", "oy", "angle")
    rings = b.select(key, "kind", "params", F.posexplode("ring").alias("k", "p"), "ox", "oy", "angle").withColumns({"u": u, "v": v})
    rings = rings.groupBy(key).agg(F.first("kind").alias("kind"), F.first("params").alias("params"), F.transform(F.sort_array(F.collect_list(F.struct("k", "u", "v"))), lambda c: F.struct(c["u"].alias("x"), c["v"].alias("y"))).alias("ring"))
    e = ring_edges(rings, key).join(rings.select(key, F.try_element_at("params", F.lit("v0")).alias("v0"), F.try_element_at("params", F.lit("u0")).alias("u0")), key)
    parts = [ridge_points(e.where(cond), axis, at, key) for cond, axis, at in (("v0 IS NOT NULL", "y", F.col("v0")), ("u0 IS NOT NULL", "x", F.col("u0")), ("v0 IS NULL AND u0 IS NULL", "x", F.lit(float("-inf"))))]
    corners = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).alias("corners"))
    p = F.struct(*[F.try_element_at("params", F.lit(n)).alias(n) for n in PARAMETERS])
    b = b.join(corners, key).withColumn("tops", F.transform("corners", lambda c: roof_height(F.col("kind"), c["x"], c["y"], p)))
    dips = F.array_min("tops") <= F.col("base_z") + 0.5
    flat = F.greatest(F.col("mid_z"), F.col("base_z") + 0.5)
    b = b.withColumns({"kind": F.when(dips, "flat").otherwise(F.col("kind")), "params": F.when(dips, F.create_map(F.lit("c"), flat)).otherwise(F.col("params")), "tops": F.when(dips, F.transform("tops", lambda _: flat)).otherwise(F.col("tops"))})
    area = F.abs(F.aggregate(F.sequence(F.lit(0), F.size("ring") - 1), F.lit(0.0), lambda a, i: a + F.get("ring", i)["x"] * F.get("ring", (i + 1) % F.size("ring"))["y"] - F.get("ring", (i + 1) % F.size("ring"))["x"] * F.get("ring", i)["y"])) / 2
    return b.select(key, "ring", "shape", "iou", "angle", "ox", "oy", "corners", "tops", "kind", "params", "residual", "base_z", "ground_z", (F.array_min("tops") - F.col("ground_z")).alias("eave_m"), (F.array_max("tops") - F.col("ground_z")).alias("ridge_m"), area.alias("area_m2"))


def building_walls(buildings: DataFrame, cell: float = 2.0, key: str = "component") -> DataFrame:
    """Wall cells of ``regular_buildings``, in the roof's frame."""
    n = F.size("corners")
    e = buildings.select(key, "base_z", "corners", "tops", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    a, b = F.get("corners", F.col("k")), F.get("corners", (F.col("k") + 1) % n)
    e = e.select(key, "k", "base_z", a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), F.get("tops", F.col("k")).alias("z0"), F.get("tops", (F.col("k") + 1) % n).alias("z1"))
    return wall_quads(e.withColumn("len", norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), cell, key)


def cloud_metrics(points: DataFrame, key: str) -> DataFrame:
    """Measures of classified clouds, one row per key: heights by percentiles, hull area and perimeter, smallest rectangle.

    Points: key, x, y, z, r, g, b. Building points are the red ones, else those 3.5 m
    over the datum (the 15th percentile), else the top three tenths; stray ones
    beyond the 2nd and 98th percentiles are left out. Percentiles are found by sorting
    over all tasks, filters are aggregates, whose rows by key are written and go to the points:
    points are read again for each, and neither moved nor sorted by key. The hull's kernel sees
    the extreme points of narrow strips only."""
    base = points.groupBy(key).agg(F.count_if((F.col("r") > 180) & (F.col("g") < 120) & (F.col("b") < 120)).alias("red"))
    base = base.join(grouped_percentiles(points, key, "z", {"datum": 0.15, "z70": 0.7}), key, "left")
    p = points.join(few(base), key)
    p = p.withColumns({"is_red": (F.col("r") > 180) & (F.col("g") < 120) & (F.col("b") < 120), "high": F.col("z") - F.col("datum") > 3.5})
    n = p.groupBy(key).agg(F.count_if("high").alias("n_high"))
    p = p.join(few(n), key).where(F.when(F.col("red") >= 10, F.coalesce("is_red", F.lit(False))).when(F.col("n_high") >= 10, F.col("high")).otherwise(F.col("z") > F.col("z70")))
    lim = p.select(key).distinct()
    for c in "xy":
        lim = lim.join(grouped_percentiles(p, key, c, {f"{c}{q}": q / 100 for q in (2, 98)}), key, "left")
    inside = F.col("x").between(F.col("x2"), F.col("x98")) & F.col("y").between(F.col("y2"), F.col("y98"))
    p = p.join(few(lim), key).withColumn("inside", inside)
    m = p.groupBy(key).agg(F.count_if("inside").alias("n_in"))
    p = p.join(few(m), key).where((F.col("n_in") < 10) | F.col("inside"))
    rel = F.col("z") - F.col("datum")
    out = p.groupBy(key).agg(F.max(rel).alias("peak_height"), F.avg(rel).alias("mean_height"), F.first("datum").alias("ground_level"), F.count(F.lit(1)).alias("n_points"))
    eaves = grouped_percentiles(p, key, rel, {"eave_height": 0.3})
    out = out.join(few(eaves), key, "left").select(key, "peak_height", "mean_height", "eave_height", "ground_level", "n_points")
    # A hull of hulls: a task keeps the corners of what it has seen of each key, then a key's corners meet.
    def corners(batches):
        seen: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False, dropna=False):
                xy = part[["x", "y"]].to_numpy(float)
                seen[k] = kernels.convex_hull(np.concatenate([seen[k], xy]) if k in seen else xy)
        for k, xy in seen.items():
            yield pd.DataFrame({key: [k] * len(xy), "x": xy[:, 0], "y": xy[:, 1]})

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].to_numpy(float)
        h = kernels.convex_hull(xy)
        w, d, _, _ = kernels.min_rectangle(xy)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "footprint_area": [kernels.polygon_area(h)], "perimeter": [kernels.perimeter(h)], "rectangle_area": [w * d]})

    kind = points.schema[key].dataType.simpleString()
    shape = p.select(key, "x", "y").mapInPandas(corners, f"`{key}` {kind}, x double, y double").groupBy(key).applyInPandas(hull, f"`{key}` {kind}, footprint_area double, perimeter double, rectangle_area double")
    return out.join(few(shape), key).withColumn("volume", F.col("footprint_area") * F.col("mean_height"))


def facade_type(label, width, height, bottom):
    """door, garage door or window by label and size in metres, else null."""
    door = label.isin("a door", "a garage door", "an entrance") & width.between(0.6, 3.5) & height.between(1.6, 3.6) & (bottom <= 0.9)
    window = (label == "a window") & width.between(0.3, 3.0) & height.between(0.4, 3.0) & (bottom > 0.3)
    return F.when(door, F.when((label == "a garage door") | (width > 2.4), "garage door").otherwise("door")).when(window, "window")


def floors(windows: DataFrame, doors: DataFrame, eaves: DataFrame, key: str = "building_id", gap: float = 1.2) -> DataFrame:
    """Storeys by rows of windows (mid heights ``mid_m``), one more for a door under high windows; else eave height over 3 m, halves to even."""
    from .interpolate import gap_islands

    rows = gap_islands(windows, [key], "mid_m", gap).groupBy(key).agg(F.max("island").alias("rows"), F.count(F.lit(1)).alias("n"), F.min("mid_m").alias("low")).where("n >= 2")
    rows = rows.join(doors.select(key).distinct().withColumn("door", F.lit(True)), key, "left").withColumn("rows", F.col("rows") + (F.coalesce("door", F.lit(False)) & (F.col("low") > 2.5)).cast("int"))
    by_eave = F.when(F.col("eave_height_m") > 0, F.greatest(F.lit(1), F.rint(F.col("eave_height_m") / 3).cast("int")))
    return eaves.join(rows.select(key, "rows"), key, "left").select(key, F.coalesce("rows", by_eave).alias("floors"), F.when(F.col("rows").isNotNull(), "window rows").otherwise("eave height / 3 m").alias("method"))


def axis_facing(angle):
    """Azimuth of a direction (radians, counter-clockwise from east), clockwise from north in [0, 180), and its wind."""
    az = F.pmod(90 - F.degrees(angle), F.lit(180.0))
    return az, compass(az)


def suppress(detections: DataFrame, keys: list[str], most_overlap: float = 0.4) -> DataFrame:
    """Greedy suppression: by falling score (ties by label and box), a box stays if it overlaps no kept one by more. Boxes of one image are folded in an expression."""
    box = F.struct(F.negative("score").alias("neg"), "label", "x0", "y0", "x1", "y1")
    boxes = detections.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("boxes"))

    def overlap(a, b):
        w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
        return (union > 0) & (w * h > most_overlap * union)

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: overlap(b, k)), acc).otherwise(F.array_append(acc, b)))
    return boxes.select(*keys, F.explode(kept).alias("b")).select(*keys, "b.label", F.negative("b.neg").alias("score"), "b.x0", "b.y0", "b.x1", "b.y1")


def facade_summary(buildings: DataFrame, openings: DataFrame, texels: DataFrame, key: str = "building_id") -> DataFrame:
    """One row per building: doors, garage doors, windows, floors and how they were found, median roof and wall colours by name.

    Openings: key, label, width, height, bottom (metres). Texels: key, part (roof or wall), r, g, b, seen ones only. Buildings: key, eave_height_m."""
    from ..functions.colour import colour_name

    o = openings.withColumn("type", facade_type(F.col("label"), F.col("width"), F.col("height"), F.col("bottom"))).where("type IS NOT NULL")
    n = o.groupBy(key).agg(*[F.count_if(F.col("type") == t).alias(c) for t, c in (("door", "doors"), ("garage door", "garage_doors"), ("window", "windows"))])
    windows = o.where("type = 'window'").select(key, (F.col("bottom") + F.col("height") / 2).alias("mid_m"))
    storeys = floors(windows, o.where("type <> 'window'").select(key), buildings.select(key, "eave_height_m"), key)
    mid = texels.groupBy(key).agg(*[F.percentile(F.when(F.col("part") == p, F.col(c)), 0.5).alias(f"{p}_{c}") for p in ("roof", "wall") for c in "rgb"])
    named = mid.select(key, *[F.when(F.col(f"{p}_r").isNotNull(), colour_name(*[f"{p}_{c}" for c in "rgb"])).alias(f"{p}_colour") for p in ("roof", "wall")])
    out = buildings.select(key).join(n, key, "left").join(storeys, key, "left").join(named, key, "left")
    return out.na.fill(0, ["doors", "garage_doors", "windows"])
