"""Triangle meshes: edges, areas, coverage, observed faces, walls, cuts, decimals of packing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cross, norm
from ..session import materialise
from .cloud import fitting_cell
from .joins import sorted_join


def corners(faces: DataFrame, vertices: DataFrame, cols=("x", "y", "z")) -> DataFrame:
    """Faces with their three corners' columns as structs a, b, c."""
    for v, n in (("v0", "a"), ("v1", "b"), ("v2", "c")):
        faces = sorted_join(faces, vertices.select(F.col("vid").alias(v), F.struct(*cols).alias(n)), v)
    return faces


def face_area():
    """Area of a face from its corners."""
    d = lambda p: [F.col(p)[k] - F.col("a")[k] for k in "xyz"]
    return norm(*cross(d("b"), d("c"))) / 2


def boundary_edges(faces: DataFrame) -> DataFrame:
    """Edges of exactly one face, smaller vertex first."""
    e = F.explode(F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))]))
    return faces.select(e.alias("e")).groupBy("e.p", "e.q").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("p", "q")


def coverage(faces: DataFrame, vertices: DataFrame, least_views: int = 2) -> DataFrame:
    """Share of the area whose vertices all have ``least_views`` views: one row. Vertices: vid, x, y, z, views."""
    f = corners(faces, vertices, ("x", "y", "z", "views")).withColumn("area", face_area()).withColumn("views", F.least("a.views", "b.views", "c.views"))
    return f.agg(F.coalesce(F.sum(F.when(F.col("views") >= least_views, F.col("area"))) / F.sum("area"), F.lit(0.0)).alias("coverage"))


def faces_on_grid(faces: DataFrame, vertices: DataFrame, observed: DataFrame, xmin: float, ymax: float, gsd: float, height: int, width: int) -> DataFrame:
    """fid, observed: the flag of the cell under the face's centre, clipped to the grid."""
    f = corners(faces, vertices)
    mid = lambda k: (F.col("a")[k] + F.col("b")[k] + F.col("c")[k]) / 3
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(c)))
    f = f.select("fid", clip((F.lit(ymax) - mid("y")) / gsd, height).cast("long").alias("row"), clip((mid("x") - F.lit(xmin)) / gsd, width).cast("long").alias("col"))
    o = observed.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "observed")
    return f.join(o, ["row", "col"], "left").select("fid", F.coalesce("observed", F.lit(False)).alias("observed"))


def flat_colours(faces: DataFrame, vertices: DataFrame, palette: dict[int, tuple[int, int, int]]) -> DataFrame:
    """Every face with vertices of its own in its provenance's colour: vid, x, y, z, r, g, b."""
    f = corners(faces, vertices)
    rgb = F.element_at(F.create_map(*[v for k, c in palette.items() for v in (F.lit(k), F.array(*map(F.lit, c)))]), F.col("provenance"))
    rows = f.withColumn("rgb", rgb).select("fid", "rgb", F.posexplode(F.array("a", "b", "c")).alias("k", "p"))
    return rows.select((F.col("fid") * 3 + F.col("k")).alias("vid"), "p.x", "p.y", "p.z", *[F.col("rgb")[i].alias(c) for i, c in enumerate("rgb")])


def join_parts(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Meshes one after the other, vertex and face numbers moved on."""
    vs, fs, vo, fo = None, None, 0, 0
    for v, f in parts:
        n = v.agg(F.max("vid").alias("v")).first()["v"]
        m = f.agg(F.max("fid").alias("f")).first()["f"]
        v2 = v.withColumn("vid", F.col("vid") + vo)
        f2 = f.withColumns({"fid": F.col("fid") + fo, **{c: F.col(c) + vo for c in ("v0", "v1", "v2")}})
        vs, fs = (v2, f2) if vs is None else (vs.unionByName(v2), fs.unionByName(f2))
        vo, fo = vo + (n if n is not None else -1) + 1, fo + (m if m is not None else -1) + 1
    return vs, fs


def inside_ring(x, y, ring) -> "F.Column":
    """Even-odd test of a point against an array of (x, y). The ring's border is not inside."""
    n = F.size(ring)
    ends = lambda i: (F.get(ring, i), F.get(ring, (i + 1) % n))

    def crosses(i):
        p, q = ends(i)
        return ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    def on_edge(i):
        p, q = ends(i)
        level = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        return level & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    edges = F.sequence(F.lit(0), n - 1)
    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, on_edge)


def in_rings(points: DataFrame, rings: DataFrame, cell: float = 50.0) -> DataFrame:
    """Points with the id of each ring they lie in: points' columns, ring_id. Rings: ring_id, ring.

    Rings are entered under every cell their box touches and points under one, so
    the exact test runs on an equi-join."""
    box = {f"{f}{c}": F.expr(f"array_{n}(transform(ring, p -> p.{c}))") for c in "xy" for f, n in (("lo", "min"), ("hi", "max"))}
    r = rings.withColumns(box)
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"lo{c}") / cell), F.floor(F.col(f"hi{c}") / cell)))
    r = r.withColumn("__cx", span("x")).withColumn("__cy", span("y"))
    p = points.withColumns({"__cx": F.floor(F.col("x") / cell), "__cy": F.floor(F.col("y") / cell)})
    hit = p.join(r, ["__cx", "__cy"]).where((F.col("x").between(F.col("lox"), F.col("hix"))) & (F.col("y").between(F.col("loy"), F.col("hiy"))))
    return hit.where(inside_ring(F.col("x"), F.col("y"), F.col("ring"))).select(*points.columns, "ring_id")


def cut_buildings(faces: DataFrame, vertices: DataFrame, rings: DataFrame, above: float = 0.8) -> DataFrame:
    """Faces that no building replaces: their centre outside all rings, or not above a ring's base by ``above``. Rings: ring_id, ring (already widened), base_z."""
    f = corners(faces, vertices)
    mid = f.select("fid", *[((F.col("a")[k] + F.col("b")[k] + F.col("c")[k]) / 3).alias(k) for k in "xyz"])
    gone = in_rings(mid, rings).join(rings.select("ring_id", "base_z"), "ring_id").where(F.col("z") > F.col("base_z") + above)
    return faces.join(gone.select("fid").distinct(), "fid", "left_anti")


#: Surface points that share a cell at the start of a search.
CROWD = 3


def nearest_colours(points: DataFrame, surface: DataFrame, radius: float = 0.9, neutral=(170, 165, 158)) -> DataFrame:
    """Colour of the nearest surface point within the radius, the least on ties; others get 0.6 of the median of what was found and 0.4 neutral.

    A point looks in its own and the 26 cells round it, which start small where the surface is
    dense; what finds nothing within a cell's side looks again in cells twice as large, until
    they are as large as the radius. Points at one place are met once, and so are surface points
    at one place, with their least colour."""
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, m), "ijk")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1)]))
    at = lambda df, cell: df.withColumns({f"c{c}": F.floor(F.col(c) / cell) for c in "xyz"})
    seen = surface.groupBy("x", "y", "z").agg(F.min(F.struct("r", "g", "b")).alias("rgb"))
    seen = materialise(seen)
    cell = min(radius, fitting_cell(seen, radius, "xyz", CROWD))
    todo, hit = points.select("x", "y", "z").distinct(), None
    while True:
        q = at(todo, cell).withColumn("o", near).withColumns({f"c{c}": F.col(f"c{c}") + F.col(f"o.{n}") for c, n in zip("xyz", "ijk")}).drop("o")
        s = at(seen, cell).select("cx", "cy", "cz", *[F.col(c).alias(f"s{c}") for c in "xyz"], "rgb")
        d = norm(*[F.col(c) - F.col(f"s{c}") for c in "xyz"])
        found = sorted_join(q, s, ["cx", "cy", "cz"]).withColumn("d", d).where(F.col("d") <= cell).groupBy("x", "y", "z").agg(F.min_by("rgb", F.struct("d", "rgb")).alias("rgb"))
        last = cell >= radius
        found = found if last and hit is None else materialise(found)
        hit = found if hit is None else hit.unionByName(found)
        if not last:
            todo = materialise(sorted_join(todo, found.select("x", "y", "z"), ["x", "y", "z"], "left_anti"))
            last = todo.isEmpty()
        if last:
            break
        cell = min(2 * cell, radius)
    rows = materialise(sorted_join(points, hit, ["x", "y", "z"], "left"))
    mid = rows.agg(*[F.coalesce(F.percentile(f"rgb.{c}", 0.5), F.lit(float(n))).alias(f"m{c}") for c, n in zip("rgb", neutral)])
    out = rows.crossJoin(F.broadcast(mid))
    return out.select(*points.columns, *[F.coalesce(F.col(f"rgb.{c}").cast("double"), 0.6 * F.col(f"m{c}") + 0.4 * n).alias(c) for c, n in zip("rgb", neutral)], F.col("rgb").isNotNull().alias("seen"))


def ortho_fill(texels: DataFrame, ortho: DataFrame) -> DataFrame:
    """Unseen texels take the ortho's colour where it has one. Texels: row, col, seen, r, g, b."""
    o = ortho.where("alpha > 0").select("row", "col", F.struct("r", "g", "b").alias("o"))
    t = texels.join(o, ["row", "col"], "left")
    use = ~F.col("seen") & F.col("o").isNotNull()
    return t.withColumns({**{c: F.when(use, F.col(f"o.{c}")).otherwise(F.col(c)) for c in "rgb"}, "filled": use}).drop("o")


def fill_provenance(observed, kind, has_donor):
    """How a surface's texture came about, by the share of it that was seen."""
    return F.when(observed >= 0.999, "observed").when(observed > 0.9, "observed").when(observed >= 0.25, "inpainted").when((kind == "wall") & has_donor, "generated").otherwise("neutral")


def shelf_pack(sizes: DataFrame, key: str, side: int = 4096) -> DataFrame:
    """Rectangles (id, w, h) of one atlas each in rows of falling height: key, id, x, y. Sequential inside an atlas."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "id"], ascending=[False, True], kind="stable")
        x = y = row = 0
        out = []
        for i, w, h in zip(pdf["id"], pdf["w"], pdf["h"]):
            if x and x + w > side:
                x, y, row = 0, y + row, 0
            out.append((i, x, y))
            x, row = x + w, max(row, h)
        got = pd.DataFrame(out, columns=["id", "x", "y"])
        got.insert(0, key, pdf[key].iloc[0])
        return got

    kind = sizes.schema[key].dataType.simpleString()
    return sizes.groupBy(key).applyInPandas(run, f"`{key}` {kind}, id long, x long, y long")


def ring_edges(rings: DataFrame, key: str = "ring_id") -> DataFrame:
    """key, k, x0, y0, x1, y1, len: consecutive corners, the last with the first."""
    r = rings.select(key, F.col("ring"), F.posexplode("ring").alias("k", "p"))
    q = F.get("ring", (F.col("k") + 1) % F.size("ring"))
    r = r.select(key, "k", F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))
    return r.withColumn("len", norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def ring_measures(rings: DataFrame, key: str = "ring_id") -> DataFrame:
    """Area, perimeter and direction (radians, modulo a right angle) of rings, from sums over their edges."""
    e = ring_edges(rings, key)
    a = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return e.groupBy(key).agg(
        (F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("signed_area"), F.sum("len").alias("perimeter"),
        (F.atan2(F.sum(F.col("len") * F.sin(4 * a)), F.sum(F.col("len") * F.cos(4 * a))) / 4).alias("angle"),
    ).withColumn("area", F.abs("signed_area"))


def ring_pixels(rings: DataFrame, xmin: float, ymax: float, gsd: float, key: str = "ring_id") -> DataFrame:
    """Rings in map metres in the pixels of a raster, to a tenth: key, px (array of px, py)."""
    place = lambda p: F.struct(F.round((p["x"] - xmin) / gsd, 1).alias("px"), F.round((F.lit(ymax) - p["y"]) / gsd, 1).alias("py"))
    return rings.select(key, F.transform("ring", place).alias("px"))


def plane_axes(nx, ny, nz, angle) -> tuple[list, list]:
    """Axes of a surface's plane: the level direction ``angle`` laid into it, and the normal's cross product with that."""
    n, h = [F.col(c) if isinstance(c, str) else c for c in (nx, ny, nz)], [F.cos(angle), F.sin(angle)]
    along = h[0] * n[0] + h[1] * n[1]
    e1 = [h[0] - along * n[0], h[1] - along * n[1], -along * n[2]]
    size = norm(*e1)
    e1 = [c / size for c in e1]
    return e1, list(cross(n, e1))


def patch_texels(patches: DataFrame, texel: float, key: str = "id", pad: int = 2) -> DataFrame:
    """Texel centres of flat patches: key, row, col, x, y, z. Patches: key, o, e1, e2 (arrays of 3), s0, s1, t0, t1 (extent along both axes)."""
    n = lambda a, b: F.greatest(F.lit(4), F.ceil((F.col(b) - F.col(a)) / texel) + 2 * pad).cast("int")
    p = patches.withColumn("col", F.explode(F.sequence(F.lit(0), n("s0", "s1") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), n("t0", "t1") - 1)))
    s, t = (F.col("col") - pad + 0.5) * texel + F.col("s0"), F.col("t1") - (F.col("row") - pad + 0.5) * texel
    return p.select(key, "row", "col", *[(F.col("o")[i] + s * F.col("e1")[i] + t * F.col("e2")[i]).alias(c) for i, c in enumerate("xyz")])


def counter_clockwise(ring, signed_area):
    return F.when(signed_area < 0, F.reverse(ring)).otherwise(ring)


def ridge_points(edges: DataFrame, axis: str, at, key: str = "ring_id") -> DataFrame:
    """Ring corners in order with the points where edges cross the ridge line put between: key, pos, x, y."""
    p, q = F.col(f"{axis}0") - at, F.col(f"{axis}1") - at
    t = p / (p - q)
    cut = F.when(p * q < 0, F.struct((F.col("k") + 0.5).alias("pos"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y")))
    own = F.struct(F.col("k").cast("double").alias("pos"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return edges.select(key, F.explode(F.array_compact(F.array(own, cut))).alias("c")).select(key, "c.*")


def wall_quads(edges: DataFrame, cell: float = 0.6, key: str = "ring_id") -> DataFrame:
    """Walls cut into cells: key, k, i, j and the quad's corners. Edges need z0, z1 (roof heights at both ends) and base_z."""
    e = edges.where("len >= 1e-6").withColumns({"nu": F.greatest(F.lit(1), F.ceil(F.col("len") / cell)).cast("int"), "nv": F.greatest(F.lit(1), F.ceil(F.greatest(F.greatest("z0", "z1") - F.col("base_z"), F.lit(0.1)) / cell)).cast("int")})
    e = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nu") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))

    def corner(di, dj):
        s, f = (F.col("i") + di) / F.col("nu"), (F.col("j") + dj) / F.col("nv")
        top = F.col("z0") + s * (F.col("z1") - F.col("z0"))
        return F.struct((F.col("x0") + s * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + s * (F.col("y1") - F.col("y0"))).alias("y"), (F.col("base_z") + f * (top - F.col("base_z"))).alias("z"))

    return e.select(key, "k", "i", "j", corner(0, 0).alias("p00"), corner(1, 0).alias("p10"), corner(1, 1).alias("p11"), corner(0, 1).alias("p01"))
