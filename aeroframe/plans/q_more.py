"""Queries over frames, gates, meshes, grids, series and files that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import camera, colour, geodesy
from ..operators import components, depth, estimate, gates, interpolate, mesh, raster, visibility
from ..operators.joins import dealt
from ..session import shared_dir
from ..sources import files, reconstruction, telemetry
from .registry import CAMS, FRAMES, GRID, GRIDS, SAMPLES, SPOTS, Views, query, twin

_R = (0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6)


def _rounded(df, places: int, *keep: str):
    return df.select(*keep, *[F.round(c, places).alias(c) for c in df.columns if c not in keep])


# frames and cameras
@query(f"""WITH c AS (SELECT s_suppkey, cos(radians(s_suppkey*10)) AS c, sin(radians(s_suppkey*10)) AS s FROM supplier),
  r AS (SELECT s_suppkey, c*{_R[0]} - s*{_R[1]} AS r0, s*{_R[3]} + c*{_R[4]} AS r4, {_R[8]}::double AS r8, c*{_R[0]} - s*{_R[1]} AS a0, c*{_R[3]} - s*{_R[4]} AS a1, c*{_R[6]} - s*{_R[7]} AS a2 FROM c)
  SELECT s_suppkey, round(r0, 8) AS r0, round(r4, 8) AS r4, round(r8, 8) AS r8, round(2.5*1 - (a0*100 + a1*250 + a2*50), 6) AS t0 FROM r""")
def pose_enu(spark, d):
    """Poses after the world moved by a similarity."""
    c, s = F.cos(F.radians(F.col("s_suppkey") * 10)), F.sin(F.radians(F.col("s_suppkey") * 10))
    one, nil = F.lit(1.0), F.lit(0.0)
    r, t = geodesy.pose_to_enu(F.array(c, -s, nil, s, c, nil, nil, nil, one), F.array(one, one * 2, one * 20), 2.5, F.array(*map(F.lit, _R)), [F.lit(v) for v in (100.0, 250.0, 50.0)])
    return Views(spark, d).table("supplier").select("s_suppkey", *[F.round(r[i], 8).alias(f"r{i}") for i in (0, 4, 8)], F.round(t[0], 6).alias("t0"))


@query(f"SELECT id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM ({SPOTS})")
def map_round_trip(spark, d):
    """Local metres to map metres of a zone and back."""
    f = geodesy.LocalFrame(47.05, 8.03, 400.0, 32632)
    s = Views(spark, d).spots()
    e, n = f.to_map("x", "y")
    s = s.withColumns({"e": e, "n": n, "h": f.height("z")})
    x, y = f.to_local("e", "n")
    return s.select("id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(f.up("h"), 5).alias("z"))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice/100 - 640)/800*l_quantity, 8) AS x, round((l_discount*5000 - 480)/810*l_quantity, 8) AS y FROM lineitem")
def pinhole_unprojection(spark, d):
    k = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("fx", 800), ("fy", 810), ("cx", 640), ("cy", 480))])
    x, y, _ = camera.unproject_pinhole(F.col("l_extendedprice") / 100, F.col("l_discount") * 5000, "l_quantity", k)
    return Views(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", F.round(x, 8).alias("x"), F.round(y, 8).alias("y"))


@query(f"SELECT id, round({_R[0]}*x + {_R[3]}*y + {_R[6]}*z + 5, 6) AS x, round({_R[1]}*x + {_R[4]}*y + {_R[7]}*z + 6, 6) AS y, round({_R[2]}*x + {_R[5]}*y + {_R[8]}*z + 7, 6) AS z FROM ({SPOTS})")
def camera_world(spark, d):
    p = camera.camera_to_world("x", "y", "z", F.array(*map(F.lit, _R)), [F.lit(v) for v in (5.0, 6.0, 7.0)])
    return Views(spark, d).spots().select("id", *[F.round(v, 6).alias(c) for v, c in zip(p, "xyz")])


@query("""WITH a AS (SELECT s_suppkey, radians((s_suppkey*37)%360) AS y, radians(-((s_suppkey*7)%90)) AS p FROM supplier)
  SELECT s_suppkey, round(cos(y), 8) AS rx, round(-sin(y), 8) AS ry, round(sin(y)*sin(p), 8) AS dx, round(cos(y)*sin(p), 8) AS dy, round(-cos(p), 8) AS dz, round(sin(y)*cos(p), 8) AS fx, round(sin(p), 8) AS fz FROM a""")
def camera_axes(spark, d):
    r = geodesy.camera_rotation(F.expr("(s_suppkey*37)%360"), F.expr("-((s_suppkey*7)%90)"))
    names = {"rx": 0, "ry": 3, "dx": 1, "dy": 4, "dz": 7, "fx": 2, "fz": 8}
    return Views(spark, d).table("supplier").select("s_suppkey", *[F.round(r[i], 8).alias(n) for n, i in names.items()])


@query(f"SELECT id, cast(x AS float) AS gx, cast(z AS float) AS gy, cast(-y AS float) AS gz FROM ({SPOTS})")
def gltf_axes(spark, d):
    return Views(spark, d).spots().select("id", *[v.alias(n) for v, n in zip(files.to_gltf("x", "y", "z"), ("gx", "gy", "gz"))])


@query(f"SELECT id, b > r*1.12 AND b >= g AND b > 120 AS sky FROM ({SPOTS})")
def sky_pixels(spark, d):
    return Views(spark, d).spots().select("id", colour.is_sky("r", "g", "b").alias("sky"))


# gates
_METRICS = "SELECT s_suppkey, s_suppkey%10/10.0::double AS a, CASE WHEN s_suppkey%7 > 0 THEN s_suppkey%7/2.0::double END AS b, s_suppkey*40 AS n FROM supplier"


def _gated(g):
    return g.select("s_suppkey", "passed", F.array_join("failures", ",").alias("failures"))


def _gate_sql(**checks: str) -> str:
    listed = ", ".join(f"CASE WHEN {c} THEN NULL ELSE '{n}' END" for n, c in checks.items())
    return f"WITH m AS ({_METRICS}), f AS (SELECT s_suppkey, list_filter([{listed}], lambda x: x IS NOT NULL) AS f FROM m) SELECT s_suppkey, len(f) = 0 AS passed, array_to_string(f, ',') AS failures FROM f"


def _metrics(spark, d, **names: str):
    m = Views(spark, d).table("supplier").select("s_suppkey", (F.col("s_suppkey") % 10 / 10.0).alias("a"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey") % 7 / 2.0).alias("b"), (F.col("s_suppkey") * 40).alias("n"))
    return m.select("s_suppkey", *[F.col(c).alias(n) for n, c in names.items()])


@query(_gate_sql(registered="a >= 0.8", reprojection="b <= 1.5"))
def sfm_gates(spark, d):
    return _gated(gates.sfm_gate(_metrics(spark, d, registered_ratio="a", reproj_px="b"), keys=["s_suppkey"]))


@query(_gate_sql(holdout_rmse="coalesce(b <= 3.0, false)", up_error="coalesce(b*1.2 <= 3.0, true)"))
def georef_gates(spark, d):
    m = _metrics(spark, d, rmse_holdout_m="b").withColumn("up_error_deg", F.col("rmse_holdout_m") * 1.2)
    return _gated(gates.georef_gate(m, keys=["s_suppkey"]))


@query(_gate_sql(accepted="a >= 0.5", consistency="b/3 >= 0.5"))
def depth_gates(spark, d):
    m = _metrics(spark, d, accepted_ratio="a", consistency="b").withColumn("consistency", F.col("consistency") / 3)
    return _gated(gates.depth_gate(m, keys=["s_suppkey"]))


@query(_gate_sql(kept_faces="a >= 0.6", faces="n > 1000"))
def fusion_gates(spark, d):
    return _gated(gates.fusion_gate(_metrics(spark, d, kept_face_ratio="a", faces="n"), keys=["s_suppkey"]))


@query(_gate_sql(observed_cells="n >= 1000", hull_fraction="a >= 0.08", ortho="b IS NULL OR b > 0.5").replace("SELECT s_suppkey, len(f) = 0", "SELECT s_suppkey, a < 0.3 AS warning, len(f) = 0").replace("FROM f\"", "").replace("(SELECT s_suppkey, list_filter", "(SELECT s_suppkey, a, list_filter"))
def products_gates(spark, d):
    g = gates.products_gate(_metrics(spark, d, observed_cells="n", hull_frac="a", ortho_frac="b"), keys=["s_suppkey"])
    return g.select("s_suppkey", "passed", F.array_join("failures", ",").alias("failures"), "warning")


@query(f"WITH m AS ({_METRICS}) SELECT s_suppkey AS run_id, 'sfm' AS stage, a >= 0.8 AND coalesce(b <= 1.5, false) AS passed, unnest(['registered', 'reprojection']) AS \"check\", unnest([a >= 0.8, coalesce(b <= 1.5, false)]) AS ok FROM m")
def check_rows(spark, d):
    g = gates.sfm_gate(_metrics(spark, d, registered_ratio="a", reproj_px="b"), keys=["s_suppkey"])
    return gates.stage_rows(g.withColumnRenamed("s_suppkey", "run_id").withColumn("stage", F.lit("sfm")))


@query("""SELECT p.user_id, p.event_id FROM events p JOIN (SELECT user_id, event_id, value FROM events) t ON p.event_id = t.event_id AND p.user_id = t.user_id WHERE t.event_id % 5 > 0 AND (t.event_id % 4 > 0) AND coalesce(CASE WHEN t.event_id % 3 = 0 THEN t.value > 10 END, true)""")
def usable_frames(spark, d):
    e = Views(spark, d).table("events")
    t = e.select("user_id", F.col("event_id").alias("name"), F.when(F.col("event_id") % 5 > 0, 47.0).alias("lat"), F.when(F.col("event_id") % 4 > 0, 9.0).alias("alt"), F.when(F.col("event_id") % 3 == 0, F.col("value") > 10).alias("in_span"))
    return gates.usable_frames(e.select("user_id", F.col("event_id").alias("name")), t, ["user_id"], 1).select("user_id", F.col("name").alias("event_id"))


# depth and visibility
@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax*20 >= 0.5 AND l_quantity > 0 AND l_quantity < 40 AND l_quantity <= 0.01*0.5*6000 AND l_partkey % 3 > 0")
def fusion_pixels(spark, d):
    t = Views(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 20).alias("conf"), F.col("l_quantity").alias("z"), (F.col("l_partkey") % 3 > 0).alias("grazing_ok"))
    return depth.fusion_pixels(t, 6000.0, 0.5, 40.0, 0.01).select("l_orderkey", "l_linenumber")


_DEPTH = "SELECT l_suppkey AS image, cast(l_partkey%24 as int) AS row, cast(l_orderkey%32 as int) AS col, max(l_quantity+30) AS z FROM lineitem GROUP BY 1, 2, 3"


def _depth(spark, d):
    t = Views(spark, d).table("lineitem")
    return t.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 24).cast("int").alias("row"), (F.col("l_orderkey") % 32).cast("int").alias("col")).agg(F.max(F.col("l_quantity") + 30).alias("z"))


def _nadir(spark, d):
    down = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, -1, 0, 0, 0, -1)])
    return Views(spark, d).cams().select(
        F.col("cam_order").alias("image"), "cam_order", "cam_x", "cam_y", "cam_z", F.lit(20.0).alias("fx"), F.lit(20.0).alias("fy"), F.lit(16.0).alias("cx"), F.lit(12.0).alias("cy"),
        F.lit(32).alias("width"), F.lit(24).alias("height"), down.alias("r_cw"), F.array(-F.col("cam_x"), F.col("cam_y"), F.col("cam_z")).alias("t_cw"),
    )


@query(f"""WITH d AS ({_DEPTH}), c AS ({CAMS}), p AS (SELECT d.image, d.row, d.col, j.cam_order AS neighbour, i.cam_x + (d.col+0.5-16)/20*d.z - j.cam_x AS dx, i.cam_y - (d.row+0.5-12)/20*d.z - j.cam_y AS dy, j.cam_z - i.cam_z + d.z AS zj
    FROM d JOIN c i ON i.cam_order = d.image JOIN c j ON abs(j.cam_order - d.image) = 1 WHERE d.z > 0),
  q AS (SELECT *, round_even(20*dx/zj+16-0.5, 0) AS pc, round_even(-20*dy/zj+12-0.5, 0) AS pr FROM p WHERE zj > 0), k AS (SELECT q.*, e.z AS dj, e.z > 0 AND NOT e.z < zj*0.97 AS vis FROM q JOIN d e ON e.image = neighbour AND e.row = pr AND e.col = pc)
  SELECT image, row, col, count(*) FILTER (WHERE vis) AS seen, count(*) FILTER (WHERE vis AND abs(dj-zj) <= 0.03*zj) AS agree FROM k GROUP BY 1, 2, 3""")
def pixel_reprojection(spark, d):
    """Every pixel of an image looked up in its neighbours' depth maps."""
    cams = _nadir(spark, d)
    pairs = visibility.neighbour_pairs(cams.select("image"), 1, "image").select("image", "neighbour")
    return visibility.consistency(visibility.reproject(_depth(spark, d), cams, pairs))



@query(f"""WITH d AS ({_DEPTH}), p AS (SELECT s.id, c.cam_order AS image, cam_z - z AS pz, 20*(x-cam_x)/(cam_z-z)+16-0.5 AS u, 20*(cam_y-y)/(cam_z-z)+12-0.5 AS v, sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)+(cam_z-z)*(cam_z-z)) AS dist FROM ({SPOTS}) s, ({CAMS}) c WHERE cam_z - z > 0.1),
  h AS (SELECT p.id, p.image, pz/dist*20/dist AS score FROM p JOIN d ON d.image = p.image AND d.row = round_even(v, 0) AND d.col = round_even(u, 0) WHERE round_even(u, 0) BETWEEN 0 AND 31 AND round_even(v, 0) BETWEEN 0 AND 23 AND d.z > 0 AND d.z >= pz - greatest(0.8, 0.05*pz) AND pz/dist >= 0.12)
  SELECT id, image, round(score, 10) AS score FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, image) = 1""")
def texel_views(spark, d):
    """The best camera of texels that face up."""
    t = Views(spark, d).spots().select("id", "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return visibility.texel_views(t, _nadir(spark, d), _depth(spark, d)).select("id", "image", F.round("score", 10).alias("score"))


# meshes, rings, grids
@query(f"""WITH p AS (SELECT id, x/sqrt(x*x+y*y+(z+1)*(z+1)) AS nx, y/sqrt(x*x+y*y+(z+1)*(z+1)) AS ny, (z+1)/sqrt(x*x+y*y+(z+1)*(z+1)) AS nz, radians(id%90) AS a FROM ({SPOTS})), h AS (SELECT *, cos(a)*nx + sin(a)*ny AS w FROM p),
  e AS (SELECT *, cos(a) - w*nx AS hx, sin(a) - w*ny AS hy, -w*nz AS hz FROM h), u AS (SELECT *, hx/sqrt(hx*hx+hy*hy+hz*hz) AS ux, hy/sqrt(hx*hx+hy*hy+hz*hz) AS uy, hz/sqrt(hx*hx+hy*hy+hz*hz) AS uz FROM e)
  SELECT id, round(ux, 8) AS ux, round(uz, 8) AS uz, round(ny*uz - nz*uy, 8) AS vx, round(nx*uy - ny*ux, 8) AS vz FROM u""")
def plane_axes(spark, d):
    """Axes of surfaces in their own planes."""
    s = Views(spark, d).spots()
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + (F.col("z") + 1) * (F.col("z") + 1))
    s = s.select("id", (F.col("x") / n).alias("nx"), (F.col("y") / n).alias("ny"), ((F.col("z") + 1) / n).alias("nz"))
    u, v = mesh.plane_axes("nx", "ny", "nz", F.radians(F.col("id") % 90))
    return s.select("id", F.round(u[0], 8).alias("ux"), F.round(u[2], 8).alias("uz"), F.round(v[0], 8).alias("vx"), F.round(v[2], 8).alias("vz"))


@query(f"""WITH p AS (SELECT id, s_ AS col, t_ AS row, x + (s_ - 1.5)*0.5 + 1 AS px, z + 2 - (t_ - 1.5)*0.5 AS pz FROM ({SPOTS}), (SELECT unnest(range(8)) AS s_) a, (SELECT unnest(range(8)) AS t_) b) SELECT id, cast(row AS int) AS row, cast(col AS int) AS col, round(px, 6) AS x, round(pz, 6) AS z FROM p""")
def patch_texels(spark, d):
    """Texel centres of upright patches of two by two metres."""
    axis = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    p = Views(spark, d).spots().select("id", F.array("x", "y", "z").alias("o"), axis(1, 0, 0).alias("e1"), axis(0, 0, 1).alias("e2"), F.lit(1.0).alias("s0"), F.lit(3.0).alias("s1"), F.lit(0.0).alias("t0"), F.lit(2.0).alias("t1"))
    return mesh.patch_texels(p, 0.5).select("id", "row", "col", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))


_FACES = "SELECT o_orderkey AS fid, o_custkey AS v0, (o_orderkey*7)%1500 AS v1, (o_orderkey*13)%1500 AS v2 FROM orders"
_VERT = "SELECT c_custkey AS vid, cast((c_custkey*37)%1000 as double)/10 AS x, cast((c_custkey*53)%997 as double)/10 AS y, c_acctbal/1000 AS z FROM customer"


@query(f"""WITH RECURSIVE f AS ({_FACES}), e AS (SELECT fid, least(a, b) AS p, greatest(a, b) AS q FROM (SELECT fid, v0 AS a, v1 AS b FROM f UNION ALL SELECT fid, v1, v2 FROM f UNION ALL SELECT fid, v2, v0 FROM f)),
  l AS (SELECT DISTINCT a.fid AS a, b.fid AS b FROM e a JOIN e b ON a.p = b.p AND a.q = b.q AND a.fid <> b.fid), r(fid, c) AS (SELECT fid, fid FROM f UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.fid), m AS (SELECT fid, min(c) AS component FROM r GROUP BY fid)
  SELECT fid, component FROM m QUALIFY count(*) OVER (PARTITION BY component) >= 2""")
def face_groups(spark, d):
    """Faces that share an edge with another, with their component."""
    return components.face_components(Views(spark, d).of(_FACES), alone=False)


@query(f"""WITH f AS ({_FACES}), v AS ({_VERT}) SELECT fid*3 + k AS vid, x, y, z, CASE fid%3 WHEN 0 THEN 10 WHEN 1 THEN 40 ELSE 70 END AS r, CASE fid%3 WHEN 0 THEN 20 WHEN 1 THEN 50 ELSE 80 END AS g
  FROM (SELECT f.fid, unnest([0,1,2]) AS k, unnest([a.x,b.x,c.x]) AS x, unnest([a.y,b.y,c.y]) AS y, unnest([a.z,b.z,c.z]) AS z FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2)""")
def face_colours(spark, d):
    v = Views(spark, d)
    f = v.of(_FACES).withColumn("provenance", (F.col("fid") % 3).cast("int"))
    return mesh.flat_colours(f, v.of(_VERT), {0: (10, 20, 30), 1: (40, 50, 60), 2: (70, 80, 90)}).select("vid", "x", "y", "z", "r", "g")


@query(f"""WITH q AS (SELECT id, x, y, z FROM ({SPOTS}) WHERE id % 3 = 0), s AS (SELECT x AS sx, y AS sy, z AS sz, r, g, b FROM ({SPOTS}) WHERE id % 3 = 1), h AS (SELECT q.id, r, g, b FROM q JOIN s ON sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)+(z-sz)*(z-sz)) <= 4
    QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)+(z-sz)*(z-sz)), r, g, b) = 1), m AS (SELECT quantile_cont(r, 0.5) AS mr, quantile_cont(g, 0.5) AS mg, quantile_cont(b, 0.5) AS mb FROM h)
  SELECT q.id, round(coalesce(r, 0.6*coalesce(mr, 170) + 0.4*170), 6) AS r, round(coalesce(g, 0.6*coalesce(mg, 165) + 0.4*165), 6) AS g, round(coalesce(b, 0.6*coalesce(mb, 158) + 0.4*158), 6) AS b, h.id IS NOT NULL AS seen FROM q LEFT JOIN h ON h.id = q.id, m""")
def vertex_colours(spark, d):
    s = Views(spark, d).spots()
    return _rounded(mesh.nearest_colours(s.where("id % 3 = 0").select("id", "x", "y", "z"), s.where("id % 3 = 1"), 4.0).select("id", "r", "g", "b", "seen"), 6, "id", "seen").select("id", "r", "g", "b", "seen")


_RING = f"SELECT vid // 8 AS ring_id, vid, x, y FROM ({_VERT})"
_EDGE = f"SELECT ring_id, row_number() OVER w - 1 AS k, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM ({_RING}) WINDOW w AS (PARTITION BY ring_id ORDER BY vid)"


def _rings(spark, d):
    p = Views(spark, d).of(_VERT)
    return p.groupBy(F.expr("vid div 8").alias("ring_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("vid", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("ring"))


@query(f"""WITH e AS ({_EDGE}) SELECT ring_id, cast(k AS double) AS pos, round(x0, 6) AS x, round(y0, 6) AS y FROM e UNION ALL SELECT ring_id, k+0.5, round(x0 + (y0-50)/((y0-50)-(y1-50))*(x1-x0), 6), round(y0 + (y0-50)/((y0-50)-(y1-50))*(y1-y0), 6) FROM e WHERE (y0-50)*(y1-50) < 0""")
def ridge_cuts(spark, d):
    return _rounded(mesh.ridge_points(mesh.ring_edges(_rings(spark, d)), "y", 50.0), 6, "ring_id", "pos")


@query(f"SELECT ring_id, round(x*2 + 7, 1) AS px, round((100 - y)*2, 1) AS py, cast(row_number() OVER (PARTITION BY ring_id ORDER BY vid) - 1 AS int) AS k FROM ({_RING})")
def ring_pixels(spark, d):
    """Footprints in the pixels of a raster."""
    r = mesh.ring_pixels(_rings(spark, d), -3.5, 100.0, 0.5)
    return r.select("ring_id", F.posexplode("px").alias("k", "p")).select("ring_id", "k", "p.px", "p.py")


@query(f"""WITH f AS ({_FACES}), v AS ({_VERT}), m AS (SELECT fid, (a.x+b.x+c.x)/3 AS x, (a.y+b.y+c.y)/3 AS y, (a.z+b.z+c.z)/3 AS z FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2)
  SELECT f.fid FROM f LEFT JOIN m USING (fid) WHERE NOT coalesce(m.x > 20 AND m.x < 60 AND m.y > 30 AND m.y < 80 AND m.z > 3.8, false)""")
def faces_left(spark, d):
    """Faces that no building replaces."""
    v = Views(spark, d)
    pt = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = v.table("region").where("r_regionkey = 0").select(F.lit(1).alias("ring_id"), F.array(pt(20, 30), pt(60, 30), pt(60, 80), pt(20, 80)).alias("ring"), F.lit(3.0).alias("base_z"))
    return mesh.cut_buildings(v.of(_FACES), v.of(_VERT), ring).select("fid")


@query(f"WITH p AS (SELECT var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM ({SPOTS})) SELECT round(sqrt(((a+c)/2 - sqrt(((a-c)/2)*((a-c)/2) + b*b))/((a+c)/2 + sqrt(((a-c)/2)*((a-c)/2) + b*b))), 8) AS ratio FROM p")
def scatter(spark, d):
    """How far from a line positions in the plane lie."""
    s = Views(spark, d).spots().withColumn("z", F.lit(1.0))
    return s.agg(F.count(F.lit(1)).alias("n")).select(F.round(F.lit(estimate.scatter_ratio(s)), 8).alias("ratio"))


# series
@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN round(cast(o_orderkey%24 as double)*3600 + (o_orderkey%60)*60 + o_orderkey%59, 3) ELSE 0 END AS seconds FROM orders")
def clock_or_zero(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.format_string("%02d:%02d:%02d.000", k % 24, k % 60, k % 59)).when(k % 3 == 1, "noon")
    return Views(spark, d).table("orders").select("o_orderkey", F.round(telemetry.clock_seconds_or_zero(text), 3).alias("seconds"))


_WRAP = "(({x} + 180) % 360 + 360) % 360 - 180"
_ANGLES = f"""s0 AS (SELECT user_id, seq, t, {_WRAP.format(x='value*37')} AS v FROM ({SAMPLES}) WHERE value IS NOT NULL), s1 AS (SELECT *, v - lag(v) OVER w AS st FROM s0 WINDOW w AS (PARTITION BY user_id ORDER BY t, seq)),
  s AS (SELECT user_id, seq, t, v + sum(CASE WHEN st IS NULL OR abs(st) < 180 THEN 0 ELSE {_WRAP.format(x='st')} - st END) OVER (PARTITION BY user_id ORDER BY t, seq) AS v FROM s1), f AS ({FRAMES}),
  l AS (SELECT user_id, t, arg_max(v, seq) AS v FROM s GROUP BY ALL), r AS (SELECT user_id, t, arg_min(v, seq) AS v FROM s GROUP BY ALL),
  a AS (SELECT f.*, l.t AS ta, l.v AS va FROM f ASOF LEFT JOIN l ON f.user_id = l.user_id AND f.t >= l.t), b AS (SELECT a.*, r.t AS tb, r.v AS vb FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)"""


_SIDES = f"""s AS ({SAMPLES}), f AS ({FRAMES}), l AS (SELECT user_id, t, arg_max(value, seq) AS v FROM s WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT user_id, t, arg_min(value, seq) AS v FROM s WHERE value IS NOT NULL GROUP BY ALL),
  a AS (SELECT f.*, l.t AS ta, l.v AS va FROM f ASOF LEFT JOIN l ON f.user_id = l.user_id AND f.t >= l.t), b AS (SELECT a.*, r.t AS tb, r.v AS vb FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)"""


_KEY = f"""c AS (SELECT user_id, event_id AS i, t, sharp, step, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM (SELECT user_id, event_id, epoch_us(ts)/1e6 AS t, value % 9 AS step, value >= quantile_cont(value, 0.15) OVER (PARTITION BY user_id) AS sharp FROM events WHERE event_type = 'view'))"""


@query(f"""WITH RECURSIVE {_KEY}, r AS (SELECT user_id, i, n, sharp AS taken, CASE WHEN sharp THEN t END AS last, 0.0::double AS disp, 1.0::double AS kept, false AS pending FROM c WHERE n = 1
  UNION ALL SELECT c.user_id, c.i, c.n, CASE WHEN r.last IS NULL THEN c.sharp ELSE hit AND c.sharp END, CASE WHEN (r.last IS NULL AND c.sharp) OR (r.last IS NOT NULL AND hit AND c.sharp) THEN c.t ELSE r.last END,
    CASE WHEN r.last IS NULL OR (hit AND c.sharp) THEN 0.0 ELSE r.disp + c.step END, CASE WHEN r.last IS NULL OR (hit AND c.sharp) THEN 1.0 ELSE r.kept*0.97 END, CASE WHEN r.last IS NULL OR (hit AND c.sharp) THEN false ELSE hit END
  FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1, LATERAL (SELECT coalesce(r.pending OR r.disp + c.step >= 40 OR r.kept*0.97 < 0.4 OR c.t - r.last >= 86400, false) AS hit) h)
  SELECT user_id, i AS frame_index FROM r WHERE taken""")
def keyframe_states(spark, d):
    """Key frames of every clip by the state machine, without relaxation."""
    e = Views(spark, d).samples("view").withColumnRenamed("seq", "frame_index")
    e = e.withColumns({"sharpness": F.col("value"), "step_px": F.col("value") % 9, "ratio": F.lit(0.97)})
    cut = e.groupBy("user_id").agg(F.percentile("sharpness", 0.15).alias("cut"))
    return depth.select_keyframes(e.join(cut, "user_id").orderBy("frame_index"), "user_id", max_gap=86400.0)


@query("SELECT o.o_orderkey, count(e.event_id) AS n FROM orders o LEFT JOIN events e ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate AND e.ts < o.o_orderdate + INTERVAL 7 DAY GROUP BY 1")
def events_in_interval(spark, d):
    """Interval join: rows of a key within some time after another's."""
    v = Views(spark, d)
    o = v.table("orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("from"))
    return interpolate.interval_counts(o, v.table("events"), ["user_id"], "from", "ts", 7 * 86400, "o_orderkey")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())" )
def grouping_sets_report(spark, d):
    v = Views(spark, d)
    return spark.sql("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {t} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())", t=v.table("lineitem"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_report(spark, d):
    return Views(spark, d).table("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, date_trunc('month', ts)::date AS period, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS hi, true AS near FROM events GROUP BY 1, 2""")
def sketch_rollup(spark, d):
    """Daily sketches rolled up to months; ``near``: the estimated number of users lies within three per cent of the exact one."""
    from ..operators.sketches import daily_sketches, rolled_up

    e = Views(spark, d).table("events")
    month = F.trunc(F.col("day"), "month")
    got = rolled_up(daily_sketches(e, ["event_type", "user_id"], "ts", "user_id", "value").drop("user_id"), ["event_type"], month)
    exact = e.groupBy("event_type", F.trunc(F.to_date("ts"), "month").alias("period")).agg(F.countDistinct("user_id").alias("users"))
    near = F.abs(F.col("distinct") - F.col("users")) <= F.greatest(F.lit(1.0), 0.03 * F.col("users"))
    return got.join(exact, ["event_type", "period"]).select("event_type", "period", "n", F.round("mean", 6).alias("mean"), "hi", near.alias("near"))


@query("""SELECT c_custkey, cast(CASE WHEN c_custkey%120-60 >= 0 THEN 32600 ELSE 32700 END + floor(((c_custkey*7)%360-180+180)/6.0)+1 AS int) AS zone, ['N','NE','E','SE','S','SW','W','NW'][1 + cast(floor(((c_custkey*17)%360 + 22.5)/45) AS int) % 8] AS wind FROM customer""")
def sql_functions(spark, d):
    """The library's expressions as functions of SQL text."""
    from ..session import register_functions

    register_functions(spark)
    return spark.sql("SELECT c_custkey, aero_utm_epsg(c_custkey%120-60, (c_custkey*7)%360-180) AS zone, aero_compass(c_custkey*17) AS wind FROM {t}", t=Views(spark, d).table("customer"))


# files: written to the shared folder and read back
_LOG = "SELECT event_id, event_id/10.0::double AS t, 47 + event_id%1000/10000.0::double AS lat, 8 + event_id%700/10000.0::double AS lon, user_id AS alt, event_id%360 - 180 AS yaw FROM events"


def _log(spark, d):
    e = Views(spark, d).table("events")
    return e.select((F.col("event_id") / 10).alias("t"), (47 + F.col("event_id") % 1000 / 10000).alias("lat"), (8 + F.col("event_id") % 700 / 10000).alias("lon"), F.col("user_id").cast("double").alias("alt"), (F.col("event_id") % 360 - 180).cast("double").alias("yaw"))


def _log_file(spark, d) -> str:
    where = f"{shared_dir(spark)}/log.csv"
    names = {"t": "time(millisecond)", "lat": "Latitude", "lon": "Longitude", "alt": "height(m)", "yaw": "gimbal yaw"}
    log = _log(spark, d).withColumn("t", F.col("t") * 1000)
    files.write_csv(log.select(*[F.col(c).alias(n) for c, n in names.items()]), where)
    return where


@query(f"SELECT round(t, 4) AS t, round(lat, 7) AS lat, round(lon, 7) AS lon, cast(alt AS double) AS rel_alt, cast(yaw AS double) AS gimbal_yaw FROM ({_LOG})")
def flight_log_file(spark, d):
    got = telemetry.read_telemetry(spark, _log_file(spark, d))
    return got.select(F.round("t", 4).alias("t"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "rel_alt", "gimbal_yaw")


@query(f"SELECT round(t*1000, 3) AS t, round(lat, 7) AS lat, round(lon, 7) AS lon, 50.0::double AS alt, -60.0::double AS gimbal_pitch, cast(yaw AS double) AS gimbal_yaw FROM ({_LOG})")
def old_flight_log_file(spark, d):
    got = telemetry.read_old_flight_log(spark, _log_file(spark, d))
    return got.select(F.round("t", 3).alias("t"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "alt", "gimbal_pitch", "gimbal_yaw")


_SRT = "SELECT cast(event_id % 40000 AS double)/10 AS t, 47+cast(event_id%1000 as double)/10000 AS lat, 8+cast(event_id%700 as double)/10000 AS lon, cast(user_id AS double) AS alt FROM events"


def _srt_files(spark, d) -> str:
    e = Views(spark, d).table("events")
    n = lambda m, q: (F.col("event_id") % m).cast("double") / q
    zero = F.lit(0.0)
    s = e.select(F.col("event_id").alias("seq"), n(40000, 10).alias("t"), F.lit(0.1).alias("dt"), (47 + n(1000, 10000)).alias("lat"), (8 + n(700, 10000)).alias("lon"), F.col("user_id").cast("double").alias("rel_alt"), (400 + F.col("user_id")).cast("double").alias("abs_alt"), zero.alias("gimbal_yaw"), (zero - 60).alias("gimbal_pitch"), zero.alias("gimbal_roll"))
    where = shared_dir(spark)
    # Dealt: few bytes of events make much text.
    files.srt_text(dealt(s)).select(F.concat("block", F.lit("\n")).alias("value")).write.text(where)
    return where


@query(f"SELECT round(t, 3) AS t, round(lat, 7) AS lat, round(lon, 7) AS lon, alt AS rel_alt FROM ({_SRT})")
def srt_files(spark, d):
    return telemetry.read_srt(spark, _srt_files(spark, d)).select(F.round("t", 3).alias("t"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "rel_alt")


@query(f"SELECT round(t + 0.05, 3) AS t, round(lat, 7) AS lat, round(lon, 7) AS lon, alt FROM ({_SRT})")
def srt_files_midpoint(spark, d):
    return telemetry.read_srt_midpoint(spark, _srt_files(spark, d)).select(F.round("t", 3).alias("t"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "alt")


def _text(df, line) -> str:
    where = shared_dir(df.sparkSession)
    df.select(line.alias("value")).write.text(where)
    return where


@query(f"SELECT id AS point_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, r, g, b, cast(id%5 AS int) AS track_len FROM ({SPOTS})")
def points_text_file(spark, d):
    s = Views(spark, d).spots()
    line = F.concat(F.format_string("%d %.4f %.4f %.4f %d %d %d 0.5", "id", "x", "y", "z", "r", "g", "b"), F.repeat(F.lit(" 7 1"), (F.col("id") % 5).cast("int")))
    return _rounded(reconstruction.read_points_text(spark, _text(s, line)).drop("error"), 4, "point_id", "r", "g", "b", "track_len")


@query("SELECT s_suppkey AS camera_id, ['SIMPLE_PINHOLE','RADIAL'][1+s_suppkey%2] AS model, cast(640+s_suppkey AS int) AS width, 480 AS height, CASE WHEN s_suppkey%2 = 0 THEN 3 ELSE 5 END AS n, 800.5::double AS f FROM supplier")
def cameras_text_file(spark, d):
    s, k = Views(spark, d).table("supplier"), F.col("s_suppkey")
    line = F.concat(k.cast("string"), F.when(k % 2 == 0, " SIMPLE_PINHOLE ").otherwise(" RADIAL "), (640 + k).cast("string"), F.lit(" 480 800.5 320 240"), F.when(k % 2 == 0, "").otherwise(" 0.01 0.002"))
    got = reconstruction.read_cameras_text(spark, _text(s, line))
    return got.select(F.col("camera_id").cast("long").alias("camera_id"), "model", "width", "height", F.size("params").alias("n"), F.col("params")[0].alias("f"))


_POSES = "SELECT s_suppkey AS image_id, 'img ' || s_suppkey || '.jpg' AS name, s_suppkey%3 AS camera_id, s_acctbal/100 AS tx, s_suppkey%4 AS n FROM supplier"


@query(f"SELECT cast(image_id AS int) AS image_id, name, cast(camera_id AS int) AS camera_id, round(tx, 2) AS tx, round(-tx, 2) AS cx, cast(n AS bigint) AS n FROM ({_POSES})")
def images_text_file(spark, d):
    """Poses and keypoints in two lines an image; the second may be empty."""
    k = F.col("s_suppkey")
    pose = F.format_string("%d 1 0 0 0 %.2f 2 20 %d img %d.jpg", k, F.col("s_acctbal") / 100, k % 3, k)
    points = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i <= k % 4, F.format_string("%d.5 7.25 %d", i, i - 2))), " ")
    where = _text(Views(spark, d).table("supplier"), F.concat(pose, F.lit("\n"), points))
    seen = reconstruction.read_observations_text(spark, where).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    got = reconstruction.read_images_text(spark, where).join(seen, "image_id", "left")
    return got.select("image_id", "name", "camera_id", F.round(F.col("t_cw")[0], 2).alias("tx"), F.round(F.col("centre")[0], 2).alias("cx"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT id AS idx, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, r, g, b FROM ({SPOTS})")
def ply_file(spark, d):
    s = Views(spark, d).spots().withColumn("idx", F.col("id"))
    where = f"{shared_dir(spark)}/cloud.ply"
    files.write_ply(s, where)
    return _rounded(reconstruction.read_ply_points(spark, where).drop("source"), 4, "idx", "r", "g", "b")


@query("SELECT n_nationkey AS id, n_name AS name, cast(5 AS int) AS corners, round(n_nationkey*1.5::double, 3) AS x0 FROM nation")
def geojson_file(spark, d):
    pt = lambda dx, dy: F.struct((F.col("n_nationkey") * 1.5 + dx).alias("x"), (F.col("n_nationkey") * 0.5 + dy).alias("y"))
    b = Views(spark, d).table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(pt(0, 0), pt(1, 0), pt(1, 1), pt(0, 1)).alias("ring_lonlat"))
    where = f"{shared_dir(spark)}/buildings.geojson"
    files.write_geojson(b, where, True)
    f = spark.read.json(where, multiLine=True).select(F.explode("features").alias("f"))
    ring = F.col("f.geometry.coordinates")[0]
    return f.select(F.col("f.properties.id").cast("int").alias("id"), F.col("f.properties.name").alias("name"), F.size(ring).alias("corners"), F.round(ring[0][0], 3).alias("x0"))


@query(f"SELECT row, col, coalesce(cast(value AS float), -9999::float) AS value FROM ({GRID})")
def raster_file(spark, d):
    where = shared_dir(spark)
    files.write_raster(Views(spark, d).grid(), where)
    return spark.read.parquet(where).select("row", "col", "value")


@query(f"SELECT row, col, cast(cast(value AS float) AS double) AS value, (3 + (col+0.5)*2)::double AS x, (100 - (row+0.5)*2)::double AS y FROM ({GRID})")
def geotiff_file(spark, d):
    from ..sources.rasters import read_geotiff, write_geotiff

    where = f"{shared_dir(spark)}/surface.tif"
    write_geotiff(Views(spark, d).grid(), where, 50, 50, 3.0, 100.0, 2.0, 32632)
    return read_geotiff(spark, where).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value", "x", "y")


@query(f"SELECT id, cast(round_even((x-x0)/0.001, 0) AS int) AS x, cast(round_even((y-y0)/0.001, 0) AS int) AS y, cast(r*257 AS int) AS r FROM ({SPOTS}), (SELECT min(x) AS x0, min(y) AS y0 FROM ({SPOTS}))")
def las_file(spark, d):
    """A cloud written as LAS by many tasks and read back in ranges."""
    where = f"{shared_dir(spark)}/cloud.las"
    s = Views(spark, d).spots()
    files.write_las(s, where)
    low = s.agg(*[F.min(c).alias(c) for c in "xyz"]).first()
    got = reconstruction.read_las(spark, where, ["x", "y", "z", "r"])
    got = got.select(*[F.rint((F.col(c) - low[c]) / 0.001).cast("int").alias(c) for c in "xyz"], "r").distinct()
    lo = s.agg(*[F.min(c).alias(f"lo{c}") for c in "xyz"]).first()
    ids = s.select("id", *[F.rint((F.col(c) - lo[f"lo{c}"]) / 0.001).cast("int").alias(c) for c in "xyz"])
    return ids.join(got, ["x", "y", "z"]).select("id", "x", "y", "r")


@query("SELECT l_suppkey AS image, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1, 2")
def depth_array_file(spark, d):
    """Counts written as one depth array and read back."""
    n = Views(spark, d).table("lineitem").groupBy(F.col("l_suppkey").alias("col"), F.col("l_linenumber").alias("row")).agg(F.count(F.lit(1)).alias("depth"))
    size = n.agg(F.max("col").alias("w"), F.max("row").alias("h")).first()
    where = f"{shared_dir(spark)}/counts.bin"
    files.write_depth_array(n, where, size["w"] + 1, size["h"] + 1)
    got = reconstruction.read_depth_arrays(spark, where, columns=["row", "col", "depth"]).where("depth > 0")
    return got.select(F.col("col").cast("long").alias("image"), F.col("row").alias("k"), F.col("depth").cast("long").alias("n"))


# twins of older queries
twin("grazing_filter", f"""WITH g AS (SELECT row, col, 30 - coalesce(value, 30) AS z FROM ({GRID})), n AS (SELECT g.row, g.col, g.z, l.z AS zl, r.z AS zr, u.z AS zu, o.z AS zd FROM g LEFT JOIN g l ON l.row = g.row AND l.col = g.col-1 AND l.z > 0 LEFT JOIN g r ON r.row = g.row AND r.col = g.col+1 AND r.z > 0
    LEFT JOIN g u ON u.row = g.row-1 AND u.col = g.col AND u.z > 0 LEFT JOIN g o ON o.row = g.row+1 AND o.col = g.col AND o.z > 0),
  v AS (SELECT *, (col+1.5-25)/40*zr - (col-0.5-25)/40*zl AS ax, (row+0.5-25)/40*zr - (row+0.5-25)/40*zl AS ay, zr - zl AS az, (col+0.5-25)/40*zd - (col+0.5-25)/40*zu AS bx, (row+1.5-25)/40*zd - (row-0.5-25)/40*zu AS by_, zd - zu AS bz, (col+0.5-25)/40*z AS px, (row+0.5-25)/40*z AS py FROM n),
  w AS (SELECT *, ay*bz - az*by_ AS n1, az*bx - ax*bz AS n2, ax*by_ - ay*bx AS n3 FROM v)
  SELECT cast(row AS int) AS row, cast(col AS int) AS col, z > 0 AND zl IS NOT NULL AND zr IS NOT NULL AND zu IS NOT NULL AND zd IS NOT NULL AND coalesce(abs(n1*px + n2*py + n3*z)/nullif(sqrt(n1*n1+n2*n2+n3*n3)*sqrt(px*px+py*py+z*z), 0) >= 0.2, false) AS grazing_ok FROM w""")

twin("wall_meshes", f"""WITH e AS ({_EDGE}), l AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len FROM e), n AS (SELECT *, cast(greatest(1, ceil(len/2)) AS bigint) AS nu FROM l WHERE len >= 1e-6),
  q AS (SELECT *, unnest(range(1, nu+1))/nu::double AS s FROM n), c AS (SELECT *, f.f/4::double AS f1, (f.f-1)/4::double AS f0 FROM q, (SELECT unnest(range(1, 5)) AS f) f)
  SELECT ring_id, count(*) AS quads, round(sum(x0+s*(x1-x0)), 3) AS x, round(sum(y0+s*(y1-y0)), 3) AS y, round(sum(2+f1*(6+s)), 3) AS top, round(sum(2+f0*(6+s)), 3) AS low FROM c GROUP BY ring_id""")

twin("interp_angle", f"WITH {_ANGLES}, o AS (SELECT user_id, event_id, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb-va)*(t-ta)/(tb-ta) END AS v FROM b) SELECT user_id, event_id, round({_WRAP.format(x='v')}, 3) AS value FROM o")

_SYNC = ", ".join(f"round_even(v/{k + 0.7}::double, {places}) AS {f}" for k, (f, (places, _)) in enumerate(interpolate.SYNC_FIELDS.items()))
twin("synchronised_frames", f"""WITH {_SIDES}, p AS (SELECT user_id, min(t)-0.5 AS lo, max(t)+0.5 AS hi FROM s GROUP BY user_id), o AS (SELECT user_id, event_id, t, CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb-va)*(t-ta)/(tb-ta) END AS v FROM b)
  SELECT o.user_id, printf('frame_%06d', event_id) AS name, round_even(o.t, 4) AS t, coalesce(o.t BETWEEN lo AND hi, false) AS in_span, {_SYNC}, round_even(v/2.7::double, 4) AS alt, CASE WHEN v IS NULL THEN 'none' ELSE 'abs_alt' END AS alt_source FROM o LEFT JOIN p USING (user_id)""")

_SHARED = f"""f AS ({_FACES}), e AS (SELECT fid, least(a, b) AS p, greatest(a, b) AS q FROM (SELECT fid, v0 AS a, v1 AS b FROM f UNION ALL SELECT fid, v1, v2 FROM f UNION ALL SELECT fid, v2, v0 FROM f)),
  l AS (SELECT DISTINCT a.fid AS a, b.fid AS b FROM e a JOIN e b ON a.p = b.p AND a.q = b.q AND a.fid <> b.fid), r(fid, c) AS (SELECT fid, fid FROM f UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.fid), m AS (SELECT fid, min(c) AS component FROM r GROUP BY fid)"""
twin("mesh_components", f"WITH RECURSIVE {_SHARED} SELECT fid, component FROM m QUALIFY count(*) OVER (PARTITION BY component) >= 0.001*(SELECT count(*) FROM f)")

twin("keyframes", f"""WITH RECURSIVE {_KEY}, h AS (SELECT 0 AS k UNION ALL SELECT k+1 FROM h WHERE k < 3), r AS (SELECT k, user_id, i, n, sharp AS taken, CASE WHEN sharp THEN t END AS last, 0.0::double AS disp, 1.0::double AS kept, false AS pending FROM c, h WHERE n = 1
  UNION ALL SELECT r.k, c.user_id, c.i, c.n, CASE WHEN r.last IS NULL THEN c.sharp ELSE hit AND c.sharp END, CASE WHEN (r.last IS NULL AND c.sharp) OR (r.last IS NOT NULL AND hit AND c.sharp) THEN c.t ELSE r.last END,
    CASE WHEN r.last IS NULL OR (hit AND c.sharp) THEN 0.0 ELSE r.disp + c.step END, CASE WHEN r.last IS NULL OR (hit AND c.sharp) THEN 1.0 ELSE r.kept*0.97 END, CASE WHEN r.last IS NULL OR (hit AND c.sharp) THEN false ELSE hit END
  FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1, LATERAL (SELECT coalesce(r.pending OR r.disp + c.step >= 40/(2.0::double)**r.k OR r.kept*0.97 < 0.4 OR c.t - r.last >= 86400/(2.0::double)**r.k, false) AS hit) x),
  s AS (SELECT k, user_id, i FROM r WHERE taken), p AS (SELECT user_id, min(k) AS k FROM (SELECT user_id, k FROM s GROUP BY 1, 2 HAVING count(*) >= 4 OR k = 3) GROUP BY 1)
  SELECT s.user_id, s.i AS frame_index, s.k AS relaxed FROM s JOIN p ON s.user_id = p.user_id AND s.k = p.k""")

twin("suppressed_boxes", """WITH RECURSIVE b AS (SELECT l_orderkey//16 AS image, l_returnflag AS label, l_discount AS score, l_quantity AS x0, l_tax*100 AS y0, l_quantity+9 AS x1, l_tax*100+7 AS y1, row_number() OVER (PARTITION BY l_orderkey//16 ORDER BY -l_discount, l_returnflag, l_quantity, l_tax*100) AS n FROM lineitem),
  r AS (SELECT DISTINCT image, 0::bigint AS n, []::STRUCT(label VARCHAR, score DOUBLE, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM b
  UNION ALL SELECT r.image, b.n, CASE WHEN len(list_filter(r.kept, lambda k: greatest(0, least(k.x1, b.x1)-greatest(k.x0, b.x0))*greatest(0, least(k.y1, b.y1)-greatest(k.y0, b.y0))
      > 0.4*((k.x1-k.x0)*(k.y1-k.y0)+(b.x1-b.x0)*(b.y1-b.y0)-greatest(0, least(k.x1, b.x1)-greatest(k.x0, b.x0))*greatest(0, least(k.y1, b.y1)-greatest(k.y0, b.y0))))) > 0 THEN r.kept
      ELSE list_append(r.kept, {'label': b.label, 'score': b.score, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}) END FROM r JOIN b ON b.image = r.image AND b.n = r.n + 1),
  l AS (SELECT image, arg_max(kept, n) AS kept FROM r GROUP BY image)
  SELECT image, k.label, k.score, k.x0, k.y0, k.x1, k.y1 FROM (SELECT image, unnest(kept) AS k FROM l)""")

twin("atlas_packing", """WITH RECURSIVE b AS (SELECT p_partkey//200 AS atlas, p_partkey AS id, cast(p_size*7+1 AS bigint) AS w, cast(p_size*3+2 AS bigint) AS h, row_number() OVER (PARTITION BY p_partkey//200 ORDER BY p_size*3+2 DESC, p_partkey) AS n FROM part),
  r AS (SELECT atlas, id, n, 0::bigint AS x, 0::bigint AS y, w AS nx, h AS row FROM b WHERE n = 1
  UNION ALL SELECT b.atlas, b.id, b.n, CASE WHEN over THEN 0 ELSE r.nx END, CASE WHEN over THEN r.y + r.row ELSE r.y END, CASE WHEN over THEN b.w ELSE r.nx + b.w END, CASE WHEN over THEN b.h ELSE greatest(r.row, b.h) END
  FROM r JOIN b ON b.atlas = r.atlas AND b.n = r.n + 1, LATERAL (SELECT r.nx > 0 AND r.nx + b.w > 2048 AS over) o)
  SELECT atlas, id, x, y FROM r""")

_OPEN = """e{k} AS (SELECT a.survey, a.row, a.col, min(b.s) AS s FROM s{k} a JOIN s{k} b ON a.survey = b.survey AND abs(a.row-b.row) <= {r} AND abs(a.col-b.col) <= {r} GROUP BY 1, 2, 3), o{k} AS (SELECT a.survey, a.row, a.col, max(b.s) AS s FROM e{k} a JOIN e{k} b ON a.survey = b.survey AND abs(a.row-b.row) <= {r} AND abs(a.col-b.col) <= {r} GROUP BY 1, 2, 3),
  s{n} AS (SELECT s.survey, s.row, s.col, o.s, s.ground AND s.s - o.s <= {allowed} AS ground FROM s{k} s JOIN o{k} o ON o.survey = s.survey AND o.row = s.row AND o.col = s.col)"""
_GROUND = f"""g AS ({GRIDS}), s0 AS (SELECT a.survey, a.row, a.col, arg_min(b.value, ((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))*10000 + b.row*100 + b.col) AS s, any_value(a.value) IS NOT NULL AS ground FROM g a JOIN g b USING (survey) WHERE b.value IS NOT NULL GROUP BY 1, 2, 3),
  """ + ",\n  ".join(_OPEN.format(k=k, n=k + 1, r=r, allowed=allowed) for k, (r, allowed) in enumerate(((1, 0.9), (2, 0.9), (4, 1.5))))
twin("ground_filter", f"WITH {_GROUND} SELECT survey, row, col, ground FROM s3")

_MIRROR = "CASE WHEN {i} < 0 THEN -({i})-1 WHEN {i} > 49 THEN 99-({i}) ELSE {i} END"


def _blurred(src: str, out: str, down=None, across=None) -> str:
    """A separable filter over the grid ``src`` (row, col, v), mirrored at its border."""
    w = raster.gaussian_weights(1.0).tolist()
    at = lambda ws: f"(SELECT unnest({list(map(float, ws))}::double[]) AS w, unnest(range(-{len(w) // 2}, {len(w) // 2 + 1})) AS o)"
    return (f"{out}_ AS (SELECT a.survey, a.row, a.col, sum(w*b.v) AS v FROM {src} a CROSS JOIN {at(down or w)} k JOIN {src} b ON b.survey = a.survey AND b.col = a.col AND b.row = {_MIRROR.format(i='a.row+o')} GROUP BY 1, 2, 3), "
            f"{out} AS (SELECT a.survey, a.row, a.col, sum(w*b.v) AS v FROM {out}_ a CROSS JOIN {at(across or w)} k JOIN {out}_ b ON b.survey = a.survey AND b.row = a.row AND b.col = {_MIRROR.format(i='a.col+o')} GROUP BY 1, 2, 3)")  # fmt: skip


twin("terrain", f"""WITH {_GROUND}, t AS (SELECT survey, row, col, CASE WHEN ground THEN value END AS v FROM s3 JOIN g USING (survey, row, col)),
  n AS (SELECT a.survey, a.row, a.col, arg_min(b.v, ((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))*10000 + b.row*100 + b.col) AS v FROM t a JOIN t b USING (survey) WHERE b.v IS NOT NULL GROUP BY 1, 2, 3), {_blurred("n", "d")} SELECT survey, row, col, round(v, 6) AS dtm FROM d""")

_MIDDLE = f"""g AS (SELECT survey, row, col, coalesce(value, 0) AS v FROM ({GRIDS})), m AS (SELECT a.survey, a.row, a.col, any_value(a.v) AS a, quantile_cont(b.v, 0.5) AS v FROM g a, (SELECT unnest([-1,0,1]) AS i) x, (SELECT unnest([-1,0,1]) AS j) y
  JOIN g b ON b.survey = a.survey AND b.row = {_MIRROR.format(i='a.row+i')} AND b.col = {_MIRROR.format(i='a.col+j')} GROUP BY 1, 2, 3)"""


@query(f"WITH {_MIDDLE}, h AS (SELECT survey, row, col, abs(a-v) AS v FROM m), {_blurred('h', 'd')} SELECT survey, row, col, round(v, 8) AS rough FROM d")
def surface_roughness(spark, d):
    g = Views(spark, d).grids().withColumn("value", F.coalesce("value", F.lit(0.0)))
    return raster.roughness(g, 2.0, keys=["survey"]).select("survey", "row", "col", F.round("value", 8).alias("rough"))


_W = raster.gaussian_weights(1.0).tolist()
_W2 = [w * ((i - len(_W) // 2) ** 2 - 1) for i, w in enumerate(_W)]


@query(f"WITH {_MIDDLE}, {_blurred('m', 'p', _W2, _W)}, {_blurred('m', 'q', _W, _W2)} SELECT survey, row, col, round(abs(p.v + q.v)/4, 8) AS curve FROM p JOIN q USING (survey, row, col)")
def surface_curvature(spark, d):
    g = Views(spark, d).grids().withColumn("value", F.coalesce("value", F.lit(0.0)))
    return raster.curvature(g, 2.0, keys=["survey"]).select("survey", "row", "col", F.round("value", 8).alias("curve"))


def _colour_sql(r: str, g: str, b: str) -> str:
    """The name of a colour of 0-255 channels."""
    hi, lo = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    light, span = f"(({hi})+({lo}))/510.0::double", f"(({hi})-({lo}))"
    sat = f"CASE WHEN {span} = 0 THEN 0 WHEN {light} <= 0.5 THEN {span}/(({hi})+({lo})) ELSE {span}/(510.0::double-({hi})-({lo})) END"
    hue = f"(((CASE WHEN {span} = 0 THEN 0 WHEN {r} = {hi} THEN ({g}-{b})/{span} WHEN {g} = {hi} THEN 2+({b}-{r})/{span} ELSE 4+({r}-{g})/{span} END)*60) % 360 + 360) % 360"
    return f"""(SELECT CASE WHEN x IS NULL THEN NULL WHEN l > 0.82 THEN 'white' WHEN l < 0.18 THEN 'black' WHEN s < 0.18 THEN CASE WHEN l < 0.6 THEN 'grey' ELSE 'light grey' END WHEN h < 18 OR h >= 340 THEN 'red' WHEN h < 40 THEN CASE WHEN l < 0.55 THEN 'terracotta' ELSE 'orange' END
      WHEN h < 65 THEN CASE WHEN s > 0.35 THEN 'yellow' ELSE 'beige' END WHEN h < 170 THEN 'green' WHEN h < 260 THEN 'blue' ELSE 'purple' END FROM (SELECT {r} AS x, {light} AS l, {sat} AS s, {hue} AS h))"""


_MEDIANS = ", ".join(f"quantile_cont(CASE WHEN id%3 {op} 0 THEN cast({c} AS double) END, 0.5) AS {part}_{c}" for part, op in (("roof", "="), ("wall", "<>")) for c in "rgb")
twin("facade_report", f"""WITH a AS (SELECT l_suppkey%50 AS building_id, ['a window','a door','a garage door','an entrance'][1+l_linenumber%4] AS lab, l_quantity/12 AS w, l_extendedprice/5000 AS h, l_discount*20 AS b FROM lineitem),
  o AS (SELECT building_id, b + h/2 AS mid, CASE WHEN lab IN ('a door','a garage door','an entrance') AND w BETWEEN 0.6 AND 3.5 AND h BETWEEN 1.6 AND 3.6 AND b <= 0.9 THEN CASE WHEN lab = 'a garage door' OR w > 2.4 THEN 'garage door' ELSE 'door' END
    WHEN lab = 'a window' AND w BETWEEN 0.3 AND 3.0 AND h BETWEEN 0.4 AND 3.0 AND b > 0.3 THEN 'window' END AS kind FROM a),
  n AS (SELECT building_id, count(*) FILTER (WHERE kind = 'door') AS doors, count(*) FILTER (WHERE kind = 'garage door') AS garage_doors, count(*) FILTER (WHERE kind = 'window') AS windows FROM o GROUP BY 1),
  c AS (SELECT building_id, mid, CASE WHEN mid - lag(mid) OVER (PARTITION BY building_id ORDER BY mid) > 1.2 THEN 1 ELSE 0 END AS cut FROM o WHERE kind = 'window'), r AS (SELECT building_id, 1+sum(cut) AS rows, min(mid) AS low FROM c GROUP BY 1 HAVING count(*) >= 2),
  f AS (SELECT building_id, rows + CASE WHEN low > 2.5 AND doors + garage_doors > 0 THEN 1 ELSE 0 END AS rows FROM r JOIN n USING (building_id)), m AS (SELECT id%50 AS building_id, {_MEDIANS} FROM ({SPOTS}) GROUP BY 1)
  SELECT n.building_id, doors, garage_doors, windows, cast(coalesce(rows, CASE WHEN n.building_id > 0 THEN greatest(1, round_even(n.building_id/5.0::double/3, 0)) END) AS bigint) AS floors, CASE WHEN rows IS NULL THEN 'eave height / 3 m' ELSE 'window rows' END AS method,
    {_colour_sql("roof_r", "roof_g", "roof_b")} AS roof_colour, {_colour_sql("wall_r", "wall_g", "wall_b")} AS wall_colour FROM n LEFT JOIN f USING (building_id) LEFT JOIN m USING (building_id)""")
