"""Queries over frames, cameras, rasters and meshes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import camera, geodesy, grids
from ..operators import buildings, components, depth, estimate, mesh, raster, visibility
from .registry import GRID, GRIDS, SPOTS, Views, query

_R = "[0.36,0.48,-0.8,-0.8,0.6,0.0,0.48,0.64,0.6]"


def _rotation():
    return [0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6]


@query(f"SELECT id, round(2.5*(0.36*x+0.48*y-0.8*z)+100, 6) AS x, round(2.5*(-0.8*x+0.6*y)+250, 6) AS y, round(2.5*(0.48*x+0.64*y+0.6*z)+50, 6) AS z FROM ({SPOTS})")
def sim3_apply(spark, d):
    from ..sources.files import transform_points

    return transform_points(Views(spark, d).spots(), 2.5, _rotation(), [100.0, 250.0, 50.0]).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


_GEO = "SELECT c_custkey, 47+cast(c_custkey%100 as double)/1000 AS lat, 8+cast(c_custkey%77 as double)/1000 AS lon, c_acctbal/100 AS alt FROM customer"
_ECEF = "(6378137.0::double/sqrt(1-0.00669437999014::double*sin(radians({la}))*sin(radians({la}))))"


def _ecef(la, lo, h):
    n = _ECEF.format(la=la)
    return f"({n}+{h})*cos(radians({la}))*cos(radians({lo}))", f"({n}+{h})*cos(radians({la}))*sin(radians({lo}))", f"({n}*(1-0.00669437999014::double)+{h})*sin(radians({la}))"


_D = [f"({p} - {q})" for p, q in zip(_ecef("lat", "lon", "alt"), _ecef("47.05::double", "8.03::double", "400.0::double"))]
_FLAT = f"(cos(radians(8.03::double))*{_D[0]} + sin(radians(8.03::double))*{_D[1]})"


@query(f"""SELECT c_custkey, round(-sin(radians(8.03::double))*{_D[0]} + cos(radians(8.03::double))*{_D[1]}, 4) AS e, round(-sin(radians(47.05::double))*{_FLAT} + cos(radians(47.05::double))*{_D[2]}, 4) AS n,
  round(cos(radians(47.05::double))*{_FLAT} + sin(radians(47.05::double))*{_D[2]}, 4) AS u FROM ({_GEO})""")
def enu_convert(spark, d):
    e, n, u = geodesy.geodetic_to_enu("lat", "lon", "alt", 47.05, 8.03, 400.0)
    return Views(spark, d).of(_GEO).select("c_custkey", F.round(e, 4).alias("e"), F.round(n, 4).alias("n"), F.round(u, 4).alias("u"))


@query(f"SELECT c_custkey, round(lat, 8) AS lat, round(lon, 8) AS lon, round(alt, 4) AS alt FROM ({_GEO})")
def enu_round_trip(spark, d):
    g = Views(spark, d).of(_GEO).withColumns(dict(zip("enu", geodesy.geodetic_to_enu("lat", "lon", "alt", 47.05, 8.03, 400.0))))
    la, lo, h = geodesy.enu_to_geodetic("e", "n", "u", 47.05, 8.03, 400.0)
    return g.select("c_custkey", F.round(la, 8).alias("lat"), F.round(lo, 8).alias("lon"), F.round(h, 4).alias("alt"))


@query("""SELECT s_suppkey, round(sin(radians((s_suppkey*37)%360))*cos(radians(-((s_suppkey*7)%90))), 8) AS ax, round(cos(radians((s_suppkey*37)%360))*cos(radians(-((s_suppkey*7)%90))), 8) AS ay, round(sin(radians(-((s_suppkey*7)%90))), 8) AS az FROM supplier""")
def gimbal_axis(spark, d):
    a = geodesy.gimbal_axis(F.expr("(s_suppkey*37)%360"), F.expr("-((s_suppkey*7)%90)"))
    return Views(spark, d).table("supplier").select("s_suppkey", *[F.round(v, 8).alias(c) for v, c in zip(a, ("ax", "ay", "az"))])


@query("""WITH p AS (SELECT c_custkey, c_custkey%120-60 AS lat, (c_custkey*7)%360-180 AS lon FROM customer) SELECT c_custkey, cast(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon+180)/6.0)+1 AS int) AS epsg FROM p""")
def utm_zone(spark, d):
    return Views(spark, d).table("customer").select("c_custkey", geodesy.utm_epsg(F.expr("c_custkey%120-60"), F.expr("(c_custkey*7)%360-180")).alias("epsg"))


@query("SELECT o_orderkey, ['N','NE','E','SE','S','SW','W','NW'][1 + cast(floor(((o_orderkey*17)%360 + 22.5)/45) AS int) % 8] AS wind FROM orders")
def compass(spark, d):
    return Views(spark, d).table("orders").select("o_orderkey", geodesy.compass(F.expr("o_orderkey*17")).alias("wind"))


_Q = "SELECT s_suppkey, cast(s_suppkey%7+1 as double) AS w, cast(s_suppkey%5 as double) AS x, cast(s_suppkey%3 as double)-1 AS y, cast(s_suppkey%11 as double)-5 AS z, s_acctbal/100 AS t FROM supplier"
_U = f"SELECT s_suppkey, w/l AS w, x/l AS x, y/l AS y, z/l AS z, t FROM (SELECT *, sqrt(w*w+x*x+y*y+z*z) AS l FROM ({_Q}))"


@query(f"SELECT s_suppkey, round(1-2*(y*y+z*z), 8) AS r00, round(2*(x*y-z*w), 8) AS r01, round(2*(y*z-x*w), 8) AS r12, round(-((1-2*(y*y+z*z))*t + 2*(x*y+z*w)*2*t + 2*(x*z-y*w)*3*t), 4) AS cx FROM ({_U})")
def camera_pose(spark, d):
    q = Views(spark, d).of(_Q)
    n = F.sqrt(sum(F.col(c) * F.col(c) for c in "wxyz"))
    r = camera.quaternion_matrix(*[F.col(c) / n for c in "wxyz"])
    q = q.withColumns({"r": r, "tv": F.array(F.col("t"), 2 * F.col("t"), 3 * F.col("t"))})
    return q.select("s_suppkey", *[F.round(F.col("r")[i], 8).alias(c) for i, c in ((0, "r00"), (1, "r01"), (5, "r12"))], F.round(geodesy.camera_centre(F.col("r"), F.col("tv"))[0], 4).alias("cx"))


_LENS = """SELECT id, ['SIMPLE_PINHOLE','PINHOLE','SIMPLE_RADIAL','RADIAL','OPENCV'][1+id%5] AS model, (x-50)/40 AS xn, (y-50)/40 AS yn FROM (SELECT p_partkey AS id, cast((p_partkey*37)%1000 as double)/10 AS x, cast((p_partkey*53)%997 as double)/10 AS y FROM part)"""


@query(f"""WITH p AS (SELECT *, xn*xn+yn*yn AS r2 FROM ({_LENS})), k AS (SELECT *, 1 + CASE WHEN model IN ('SIMPLE_RADIAL','RADIAL','OPENCV') THEN 0.05 ELSE 0 END*r2 + CASE WHEN model IN ('RADIAL','OPENCV') THEN -0.01 ELSE 0 END*r2*r2 AS d FROM p),
  q AS (SELECT *, CASE WHEN model = 'OPENCV' THEN xn*d+2*0.001*xn*yn+0.002*(r2+2*xn*xn) ELSE xn*d END AS xd, CASE WHEN model = 'OPENCV' THEN yn*d+0.001*(r2+2*yn*yn)+2*0.002*xn*yn ELSE yn*d END AS yd FROM k)
  SELECT id, round(800*xd+640-0.5, 6) AS u, round(CASE WHEN model IN ('PINHOLE','OPENCV') THEN 810 ELSE 800 END*yd+480-0.5, 6) AS v FROM q""")
def lens_projection(spark, d):
    k = camera.intrinsics(F.col("model"), F.col("params"))
    return _lenses(spark, d).select("id", *[F.round(c, 6).alias(n) for c, n in zip(camera.project(F.col("xn") * 7, F.col("yn") * 7, F.lit(7.0), k), "uv")])


def _lenses(spark, d):
    p = Views(spark, d).spots().select("id", ((F.col("x") - 50) / 40).alias("xn"), ((F.col("y") - 50) / 40).alias("yn"))
    rows = {"SIMPLE_PINHOLE": [800, 640, 480], "PINHOLE": [800, 810, 640, 480], "SIMPLE_RADIAL": [800, 640, 480, 0.05], "RADIAL": [800, 640, 480, 0.05, -0.01], "OPENCV": [800, 810, 640, 480, 0.05, -0.01, 0.001, 0.002]}
    lens = F.array(*[F.struct(F.lit(n).alias("model"), F.array(*[F.lit(float(v)) for v in ps]).alias("params")) for n, ps in rows.items()])
    return p.withColumn("l", F.element_at(lens, (F.col("id") % 5 + 1).cast("int"))).select("id", "xn", "yn", "l.*")


@query(f"SELECT id, round(xn*7, 5) AS x, round(yn*7, 5) AS y FROM ({_LENS}) WHERE abs(xn) < 0.5 AND abs(yn) < 0.5")
def unprojection(spark, d):
    """A projected point and its depth give the point back, through every lens."""
    k = camera.intrinsics(F.col("model"), F.col("params"))
    u, v = camera.project(F.col("xn") * 7, F.col("yn") * 7, F.lit(7.0), k)
    p = _lenses(spark, d).where("abs(xn) < 0.5 AND abs(yn) < 0.5").withColumns({"u": u + 0.5, "v": v + 0.5})
    x, y, _ = camera.unproject("u", "v", F.lit(7.0), k, 14)
    return p.select("id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


@query("""WITH s AS (SELECT p_partkey, 640.0::double+p_size AS w, 480.0::double AS h, CASE WHEN p_partkey%4=0 THEN NULL WHEN p_size*9 > 100 THEN p_size*0.9::double ELSE p_size*9.0::double END AS f FROM part), q AS (SELECT *, CASE WHEN f BETWEEN 8 AND 300 THEN f END AS f35, sqrt(w*w+h*h) AS dg FROM s)
  SELECT p_partkey, round(CASE WHEN f35 IS NOT NULL THEN f35*dg/43.2666 ELSE dg/2/tan(radians(82.0::double)/2) END, 6) AS f, CASE WHEN f35 IS NULL THEN 'dfov_default' ELSE 'telemetry_focal_len' END AS source FROM q""")
def focal_prior(spark, d):
    p = Views(spark, d).table("part").withColumn("k", camera.focal_prior(640 + F.col("p_size"), F.lit(480), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 9.0)))
    return p.select("p_partkey", F.round("k.f", 6).alias("f"), "k.source")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity/10-1 AS p FROM lineitem), e AS (SELECT *, 0.2*p+0.05 AS est FROM s) SELECT l_orderkey, l_linenumber, round(CASE WHEN est > 0 AND 1/est <= 15 THEN 1/est ELSE 0 END, 6) AS z FROM e""")
def affine_depth(spark, d):
    t = Views(spark, d).table("lineitem").withColumn("p", F.col("l_quantity") / 10 - 1)
    return t.select("l_orderkey", "l_linenumber", F.round(camera.affine_depth("p", F.lit("disparity"), F.lit(0.2), F.lit(0.05), F.lit(15.0)), 6).alias("z"))


@query(f"""SELECT id, round(CASE id%4 WHEN 0 THEN 7.5 WHEN 1 THEN 0.1*x+0.2*y+3 WHEN 2 THEN 12-0.4*abs(y-50) ELSE 12-0.4*abs(x-40) END, 6) AS h FROM ({SPOTS})""")
def roof_heights(spark, d):
    p = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("a", 0.1), ("b", 0.2), ("zr", 12), ("s", 0.4), ("v0", 50), ("u0", 40))], F.when(F.col("id") % 4 == 0, 7.5).otherwise(3.0).alias("c"))
    kind = F.element_at(F.array(*map(F.lit, ("flat", "shed", "gable_u", "gable_v"))), (F.col("id") % 4 + 1).cast("int"))
    return Views(spark, d).spots().select("id", F.round(grids.roof_height(kind, "x", "y", p), 6).alias("h"))


_OBS = """o AS (SELECT l_suppkey AS image_id, l_linenumber AS kp, CASE WHEN l_linenumber < 7 THEN l_partkey END AS point_id, l_extendedprice/100 AS u, l_quantity*10 AS v FROM lineitem),
  q AS (SELECT o.*, cos(radians(image_id*10))*x - sin(radians(image_id*10))*y + 1 AS cx, sin(radians(image_id*10))*x + cos(radians(image_id*10))*y + 2 AS cy, z + 20 AS cz FROM o JOIN s ON s.id = point_id)"""


def _model(spark, d):
    v = Views(spark, d)
    obs = v.table("lineitem").select(F.col("l_suppkey").alias("image_id"), F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).alias("point_id"), (F.col("l_extendedprice") / 100).alias("u"), (F.col("l_quantity") * 10).alias("v"))
    c, s = F.cos(F.radians(F.col("s_suppkey") * 10)), F.sin(F.radians(F.col("s_suppkey") * 10))
    one, nil = F.lit(1.0), F.lit(0.0)
    images = v.table("supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_suppkey") % 2).cast("int").alias("camera_id"), F.array(c, -s, nil, s, c, nil, nil, nil, one).alias("r_cw"), F.array(one, one * 2, one * 20).alias("t_cw"))
    cams = v.table("region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.array(*[F.lit(float(x)) for x in (800, 810, 640, 480)]).alias("params"))
    return obs, v.spots().withColumnRenamed("id", "point_id"), images, cams


@query(f"WITH s AS ({SPOTS}), {_OBS} SELECT image_id, count(*) AS n, round(sum(cz), 4) AS z FROM q WHERE cz > 0 GROUP BY image_id")
def anchor_depths(spark, d):
    obs, pts, images, _ = _model(spark, d)
    return visibility.anchors(obs, pts, images).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query(f"WITH s AS ({SPOTS}), {_OBS} SELECT image_id, round(avg(sqrt((800*cx/cz+640-u)*(800*cx/cz+640-u)+(810*cy/cz+480-v)*(810*cy/cz+480-v))), 4) AS err FROM q GROUP BY image_id")
def reprojection_error(spark, d):
    return visibility.reprojection_errors(*_model(spark, d)).groupBy("image_id").agg(F.round(F.avg("err"), 4).alias("err"))


@query("SELECT l_suppkey AS image_id, count(*) FILTER (WHERE l_linenumber < 7) AS n_points FROM lineitem GROUP BY 1")
def pose_table(spark, d):
    from ..sources.reconstruction import pose_table as table

    obs, _, images, _ = _model(spark, d)
    return table(images.withColumn("name", F.col("image_id").cast("string")), obs).where("n_points > 0 OR image_id IS NOT NULL").select("image_id", "n_points").join(obs.select("image_id").distinct(), "image_id", "left_semi")


@query("""WITH p AS (SELECT l_suppkey%20 AS grp, l_quantity AS x, l_discount*100 AS y, l_tax*100 AS z, l_extendedprice/1000 AS e FROM lineitem)
  SELECT grp, count(*) AS n, round(avg(x), 6) AS m_x, round(var_pop(x)+var_pop(y)+var_pop(z), 5) AS var_x, round(covar_pop(e, y), 6) AS c_01 FROM p GROUP BY grp""")
def similarity_moments(spark, d):
    return estimate.moments(_pairs(spark, d), ["grp"]).select("grp", "n", F.round("m_x", 6).alias("m_x"), F.round("var_x", 5).alias("var_x"), F.round("c_01", 6).alias("c_01"))


def _pairs(spark, d):
    t = Views(spark, d).table("lineitem")
    return t.select((F.col("l_suppkey") % 20).alias("grp"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_extendedprice") / 1000).alias("ex"), (F.col("l_quantity") * 2 + F.col("l_tax")).alias("ey"), F.col("l_linenumber").cast("double").alias("ez"))


@query()
def similarities(spark, d):
    return estimate.similarities(_pairs(spark, d), ["grp"])


@query(f"""WITH g AS ({GRIDS}), e AS (SELECT survey, row, col, min(value) OVER (PARTITION BY survey, row ORDER BY col RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value FROM g)
  SELECT survey, row, col, min(value) OVER (PARTITION BY survey, col ORDER BY row RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS value FROM e""")
def erode3(spark, d):
    return raster.erode(Views(spark, d).grids(), 3, keys=["survey"])


@query(f"SELECT a.survey, a.row, a.col, max(b.value) AS value FROM ({GRIDS}) a LEFT JOIN ({GRIDS}) b ON a.survey = b.survey AND abs(a.row-b.row) <= 2 AND abs(a.col-b.col) <= 2 GROUP BY 1, 2, 3")
def dilate5(spark, d):
    return raster.dilate(Views(spark, d).grids(), 5, keys=["survey"])


@query(f"""WITH g AS ({GRIDS}), e AS (SELECT a.survey, a.row, a.col, min(b.value) AS value FROM g a LEFT JOIN g b ON a.survey = b.survey AND abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2, 3)
  SELECT a.survey, a.row, a.col, max(b.value) AS value FROM e a LEFT JOIN e b ON a.survey = b.survey AND abs(a.row-b.row) <= 1 AND abs(a.col-b.col) <= 1 GROUP BY 1, 2, 3""")
def opening3(spark, d):
    return raster.opening(Views(spark, d).grids(), 3, keys=["survey"])


_DISK = "SELECT a.survey, a.row, a.col, max(b.value) AS value FROM ({g}) a LEFT JOIN ({g}) b ON a.survey = b.survey AND (a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col) <= 9 GROUP BY 1, 2, 3"


@query(_DISK.format(g=GRIDS))
def disk_dilate(spark, d):
    return raster.disk_filter(Views(spark, d).grids(), F.max, 3, keys=["survey"])


@query(f"""WITH g AS ({GRIDS}), a AS (SELECT p.survey, p.row, p.col, coalesce(any_value(p.value), min(q.value)) AS value FROM g p LEFT JOIN g q ON p.survey = q.survey AND abs(p.row-q.row) <= 1 AND abs(p.col-q.col) <= 1 GROUP BY 1, 2, 3)
  SELECT p.survey, p.row, p.col, coalesce(any_value(p.value), min(q.value)) AS value FROM a p LEFT JOIN a q ON p.survey = q.survey AND abs(p.row-q.row) <= 1 AND abs(p.col-q.col) <= 1 GROUP BY 1, 2, 3""")
def fill_low(spark, d):
    return raster.fill_low(Views(spark, d).grids(), 2, keys=["survey"])


@query(f"""WITH g AS ({GRIDS}) SELECT a.survey, a.row, a.col, arg_min(b.value, ((a.row-b.row)*(a.row-b.row)+(a.col-b.col)*(a.col-b.col))*10000 + b.row*100 + b.col) AS value FROM g a JOIN g b USING (survey) WHERE b.value IS NOT NULL GROUP BY 1, 2, 3""")
def fill_nearest(spark, d):
    return raster.fill_nearest(Views(spark, d).grids(), keys=["survey"]).select("survey", "row", "col", "value")


@query()
def ground_filter(spark, d):
    return raster.ground_filter(Views(spark, d).grids(), 2.0, 20.0, keys=["survey"]).select("survey", "row", "col", "ground")


@query()
def terrain(spark, d):
    return raster.terrain(raster.ground_filter(Views(spark, d).grids(), 2.0, 20.0, keys=["survey"]), 2.0, keys=["survey"]).select("survey", "row", "col", F.round("dtm", 6).alias("dtm"))


@query()
def building_extraction(spark, d):
    """Blocks on a sloping site by height and greenness, through the whole extraction."""
    g = Views(spark, d).grid()
    block = (F.floor(F.col("row") / 25) + F.floor(F.col("col") / 25)) % 2 == 0
    inner = block & (F.col("row") % 25).between(4, 20) & (F.col("col") % 25).between(4, 20)
    dtm = F.col("row") * 0.05
    # A block is as high as a third of its cells' mean value.
    height = F.avg("value").over(Window.partitionBy(F.floor(F.col("row") / 25), F.floor(F.col("col") / 25))) / 3
    g = g.select("row", "col", (dtm + F.when(inner, height).otherwise(0.0)).alias("dsm"), dtm.alias("dtm"), F.col("value").isNotNull().alias("observed"))
    found = buildings.extract(g, 1.0)
    return buildings.records(found, 1.0).join(buildings.footprints(found, 0.0, 50.0, 1.0).select("component", "shape", "iou"), "component")


# Surveys one below the other, 50 empty rows between them.
_CELLS = f"SELECT survey*100+row AS row, col FROM ({GRIDS}) WHERE value > 19.5"


@query(f"""WITH RECURSIVE c AS ({_CELLS}), r(row, col, k) AS (SELECT row, col, row*1000+col FROM c UNION SELECT c.row, c.col, r.k FROM r JOIN c ON abs(c.row-r.row)+abs(c.col-r.col) = 1)
  SELECT row, col, min(k) AS component FROM r GROUP BY 1, 2""")
def grid_components(spark, d):
    return components.grid_components(Views(spark, d).grids().where("value > 19.5").withColumn("row", F.expr("survey*100 + row")), 1000)


@query(f"""WITH g AS ({GRIDS}), p AS (SELECT *, lag(value) OVER x AS a, lead(value) OVER x AS b, lag(value) OVER y AS c, lead(value) OVER y AS e FROM g WINDOW x AS (PARTITION BY survey, row ORDER BY col), y AS (PARTITION BY survey, col ORDER BY row)),
  s AS (SELECT survey, row, col, coalesce((b-a)/4, (b-value)/2, (value-a)/2) AS gx, coalesce((e-c)/4, (e-value)/2, (value-c)/2) AS gy FROM p)
  SELECT survey, row, col, round(coalesce(greatest(0, least(255, 255*(sin(radians(45))*cos(atan(sqrt(gx*gx+gy*gy))) + cos(radians(45))*sin(atan(sqrt(gx*gx+gy*gy)))*cos(pi()/2-radians(315)-atan2(gy, -gx))))), 0), 4) AS shade FROM s""")
def hillshade(spark, d):
    g = raster.gradients(Views(spark, d).grids(), 2.0, keys=["survey"])
    return g.select("survey", "row", "col", F.round(grids.shade("dzdx", "dzdy"), 4).alias("shade"))


@query(f"""WITH g AS (SELECT row, col, coalesce(value, 0) AS value FROM ({GRID})), p AS (SELECT id, least(x/2, 49) AS x, least(y/2, 49) AS y FROM ({SPOTS})), c AS (SELECT id, x, y, unnest([0,0,1,1]) AS i, unnest([0,1,0,1]) AS j FROM p)
  SELECT id, round(sum((CASE WHEN i = 1 THEN y-floor(y) ELSE 1-(y-floor(y)) END)*(CASE WHEN j = 1 THEN x-floor(x) ELSE 1-(x-floor(x)) END)*value), 10) AS sampled
  FROM c JOIN g ON g.row = least(49, floor(y)+i) AND g.col = least(49, floor(x)+j) GROUP BY id""")
def bilinear_sample(spark, d):
    v = Views(spark, d)
    g = v.grid().withColumn("value", F.coalesce("value", F.lit(0.0)))
    return raster.bilinear(v.spots().select("id", (F.col("x") / 2).alias("x"), (F.col("y") / 2).alias("y")), g).select("id", F.round("sampled", 10).alias("sampled"))


@query("SELECT l_suppkey, round(count(*) FILTER (WHERE l_partkey%3=0 AND l_orderkey%2=0)/count(*) FILTER (WHERE l_partkey%3=0 OR l_orderkey%2=0)::double, 8) AS iou FROM lineitem GROUP BY 1")
def mask_overlap(spark, d):
    t = Views(spark, d).table("lineitem").withColumns({"a": (F.col("l_partkey") % 3 == 0).cast("int"), "b": (F.col("l_orderkey") % 2 == 0).cast("int")})
    return raster.mask_iou(t, "a", "b", ["l_suppkey"]).withColumn("iou", F.round("iou", 8))


_FACES = "SELECT o_orderkey AS fid, o_custkey AS v0, (o_orderkey*7)%1500 AS v1, (o_orderkey*13)%1500 AS v2 FROM orders"
_VERT = "SELECT c_custkey AS vid, cast((c_custkey*37)%1000 as double)/10 AS x, cast((c_custkey*53)%997 as double)/10 AS y, c_acctbal/1000 AS z, c_nationkey%4 AS views FROM customer"


def _mesh(spark, d):
    v = Views(spark, d)
    return v.of(_FACES), v.of(_VERT)


@query(f"WITH f AS ({_FACES}), e AS (SELECT v0 a, v1 b FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f) SELECT least(a, b) AS p, greatest(a, b) AS q FROM e GROUP BY 1, 2 HAVING count(*) = 1")
def edges_once(spark, d):
    return mesh.boundary_edges(_mesh(spark, d)[0])


@query(f"""WITH f AS ({_FACES}), v AS ({_VERT}), t AS (SELECT a.x ax, a.y ay, a.z az, b.x bx, b.y by_, b.z bz, c.x cx, c.y cy, c.z cz, least(a.views, b.views, c.views) AS views FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2),
  n AS (SELECT views, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS n1, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS n2, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS n3 FROM t)
  SELECT round(sum(CASE WHEN views >= 2 THEN sqrt(n1*n1+n2*n2+n3*n3)/2 END)/sum(sqrt(n1*n1+n2*n2+n3*n3)/2), 8) AS coverage FROM n""")
def area_coverage(spark, d):
    return mesh.coverage(*_mesh(spark, d)).select(F.round("coverage", 8).alias("coverage"))


@query()
def mesh_components(spark, d):
    f, _ = _mesh(spark, d)
    return components.large_components(components.face_components(f), 0.001)


@query(f"""WITH f AS ({_FACES}), v AS ({_VERT}), m AS (SELECT fid, (a.x+b.x+c.x)/3 AS x, (a.y+b.y+c.y)/3 AS y FROM f JOIN v a ON a.vid = v0 JOIN v b ON b.vid = v1 JOIN v c ON c.vid = v2)
  SELECT fid, coalesce(g.value IS NOT NULL, false) AS observed FROM m LEFT JOIN ({GRID}) g ON g.row = greatest(0, least(49, floor((100-y)/2))) AND g.col = greatest(0, least(49, floor(x/2)))""")
def faces_on_grid(spark, d):
    f, v = _mesh(spark, d)
    g = Views(spark, d).grid().select("row", "col", F.col("value").isNotNull().alias("observed"))
    return mesh.faces_on_grid(f, v, g, 0.0, 100.0, 2.0, 50, 50)


_POLY = f"SELECT vid // 8 AS ring_id, vid, x, y FROM ({_VERT})"


@query(f"""WITH p AS ({_POLY}), e AS (SELECT ring_id, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM p WINDOW w AS (PARTITION BY ring_id ORDER BY vid)),
  l AS (SELECT *, sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) AS len, atan2(y1-y0, x1-x0) AS a FROM e)
  SELECT ring_id, round(abs(sum(x0*y1-x1*y0)/2), 6) AS area, round(sum(len), 6) AS perimeter, round(atan2(sum(len*sin(4*a)), sum(len*cos(4*a)))/4, 6) AS angle FROM l GROUP BY ring_id""")
def ring_measures(spark, d):
    p = Views(spark, d).of(_VERT)
    rings = p.groupBy(F.expr("vid div 8").alias("ring_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("vid", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("ring"))
    return mesh.ring_measures(rings).select("ring_id", *[F.round(c, 6).alias(c) for c in ("area", "perimeter", "angle")])


@query()
def wall_meshes(spark, d):
    p = Views(spark, d).of(_VERT)
    rings = p.groupBy(F.expr("vid div 8").alias("ring_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("vid", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("ring"))
    e = mesh.ring_edges(rings).withColumns({"z0": F.lit(8.0), "z1": F.lit(9.0), "base_z": F.lit(2.0)})
    q = mesh.wall_quads(e, 2.0).groupBy("ring_id")
    corner = {"x": "p11.x", "y": "p11.y", "top": "p11.z", "low": "p10.z"}
    return q.agg(F.count(F.lit(1)).alias("quads"), *[F.round(F.sum(c), 3).alias(n) for n, c in corner.items()])


@query("""SELECT l_suppkey AS image, count(*) AS n, round(avg(CASE WHEN z > 0 THEN 1 ELSE 0 END), 8) AS valid_frac, min(CASE WHEN z > 0 THEN z END) AS z_min, round(quantile_cont(CASE WHEN z > 0 THEN z END, 0.5), 6) AS z_median, round(quantile_cont(CASE WHEN z > 0 THEN z END, 0.99), 6) AS p99
  FROM (SELECT l_suppkey, l_extendedprice/1000 - 5 AS z FROM lineitem) GROUP BY 1""")
def depth_statistics(spark, d):
    t = Views(spark, d).table("lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_extendedprice") / 1000 - 5).alias("z"))
    s = depth.statistics(t)
    return s.select("image", "n", F.round("valid_frac", 8).alias("valid_frac"), "z_min", F.round("z_median", 6).alias("z_median"), F.round("p99", 6).alias("p99"))


@query("""WITH a AS (SELECT l_suppkey AS image, cast(floor((l_quantity*20-0.5)/24) AS bigint) AS row, cast(floor((l_extendedprice/100-0.5)/24) AS bigint) AS col, 1/(l_tax*100+10) - 1/(l_discount*100+11) AS res FROM lineitem)
  SELECT image, row, col, round(quantile_cont(res, 0.5), 10) AS value FROM a GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def depth_residual_grid(spark, d):
    t = Views(spark, d).table("lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_extendedprice") / 100).alias("u"), (F.col("l_quantity") * 20).alias("v"), (F.col("l_tax") * 100 + 10).alias("z"), (F.col("l_discount") * 100 + 11).alias("d"))
    return depth.cell_residuals(t).withColumn("value", F.round("value", 10))


@query("""WITH p AS (SELECT l_suppkey AS image, l_partkey AS row, l_linenumber AS col, l_quantity AS zj, l_quantity + l_tax*40 - l_discount*30 AS dj FROM lineitem), q AS (SELECT *, dj > 0 AND NOT dj < zj*(1-0.03) AS vis FROM p)
  SELECT image, row, col, count(*) FILTER (WHERE vis) AS seen, count(*) FILTER (WHERE vis AND abs(dj-zj) <= 0.03*zj) AS agree FROM q GROUP BY 1, 2, 3""")
def depth_consistency(spark, d):
    t = Views(spark, d).table("lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("zj"), (F.col("l_quantity") + F.col("l_tax") * 40 - F.col("l_discount") * 30).alias("dj"))
    return visibility.consistency(t)


@query()
def grazing_filter(spark, d):
    g = Views(spark, d).grid().select(F.lit("a").alias("image"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), (30 - F.coalesce("value", F.lit(30.0))).alias("z"))
    return visibility.grazing_ok(g, 40.0, 40.0, 25.0, 25.0).select("row", "col", "grazing_ok")


@query(f"""WITH g AS ({GRIDS}), v AS (SELECT survey, row, col, coalesce(value, 0) AS value FROM g), l AS (SELECT survey, lag(value) OVER x + lead(value) OVER x + lag(value) OVER y + lead(value) OVER y - 4*value AS lap FROM v WINDOW x AS (PARTITION BY survey, row ORDER BY col), y AS (PARTITION BY survey, col ORDER BY row))
  SELECT survey, round(var_pop(lap), 4) AS sharpness FROM l GROUP BY survey""")
def laplacian_sharpness(spark, d):
    g = Views(spark, d).grids().select("survey", "row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))
    return depth.sharpness(g, keys=("survey",)).select("survey", F.round("sharpness", 4).alias("sharpness"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN lab IN ('a door','a garage door','an entrance') AND w BETWEEN 0.6 AND 3.5 AND h BETWEEN 1.6 AND 3.6 AND b <= 0.9 THEN CASE WHEN lab = 'a garage door' OR w > 2.4 THEN 'garage door' ELSE 'door' END
   WHEN lab = 'a window' AND w BETWEEN 0.3 AND 3.0 AND h BETWEEN 0.4 AND 3.0 AND b > 0.3 THEN 'window' END AS kind
  FROM (SELECT l_orderkey, l_linenumber, ['a window','a door','a garage door','an entrance'][1+l_linenumber%4] AS lab, l_quantity/12 AS w, l_extendedprice/5000 AS h, l_discount*20 AS b FROM lineitem)""")
def facade_types(spark, d):
    lab = F.element_at(F.array(*map(F.lit, ("a window", "a door", "a garage door", "an entrance"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    t = Views(spark, d).table("lineitem")
    return t.select("l_orderkey", "l_linenumber", buildings.facade_type(lab, F.col("l_quantity") / 12, F.col("l_extendedprice") / 5000, F.col("l_discount") * 20).alias("kind"))


@query("""SELECT p_partkey, CASE WHEN f > 0.9 THEN 'observed' WHEN f >= 0.25 THEN 'inpainted' WHEN p_partkey%2=0 AND p_partkey%3=0 THEN 'generated' ELSE 'neutral' END AS provenance FROM (SELECT p_partkey, p_size/50.0::double AS f FROM part)""")
def texture_provenance(spark, d):
    k = F.when(F.col("p_partkey") % 2 == 0, "wall").otherwise("roof")
    return Views(spark, d).table("part").select("p_partkey", mesh.fill_provenance(F.col("p_size") / 50, k, F.col("p_partkey") % 3 == 0).alias("provenance"))


@query()
def suppressed_boxes(spark, d):
    t = Views(spark, d).table("lineitem").select(F.expr("l_orderkey div 16").alias("image"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("score"), (F.col("l_quantity")).alias("x0"), (F.col("l_tax") * 100).alias("y0"), (F.col("l_quantity") + 9).alias("x1"), (F.col("l_tax") * 100 + 7).alias("y1"))
    return buildings.suppress(t, ["image"])


@query()
def atlas_packing(spark, d):
    t = Views(spark, d).table("part").select(F.expr("p_partkey div 200").alias("atlas"), F.col("p_partkey").alias("id"), (F.col("p_size") * 7 + 1).cast("long").alias("w"), (F.col("p_size") * 3 + 2).cast("long").alias("h"))
    return mesh.shelf_pack(t, "atlas", 2048)


@query()
def roof_models(spark, d):
    s = Views(spark, d).spots()
    s = s.withColumn("component", F.expr("id div 50"))
    k = F.col("component") % 4
    roof = F.when(k == 0, 9 - 0.4 * F.abs(F.col("y") % 20 - 10)).when(k == 1, F.lit(7.0)).when(k == 2, 8 - 0.3 * F.abs(F.col("x") % 20 - 9)).otherwise(5 + 0.2 * (F.col("x") % 20))
    return buildings.roofs(s.select("component", (F.col("x") % 20).alias("u"), (F.col("y") % 20).alias("v"), roof.alias("z")))


@query(f"""WITH t AS (SELECT row, col, value IS NULL AS hole, row%7 AS r FROM ({GRID})) SELECT row, col, cast(CASE WHEN hole AND col%3 > 0 THEN row+col ELSE r END AS bigint) AS r, hole AND col%3 > 0 AS filled FROM t""")
def ortho_fill(spark, d):
    g = Views(spark, d).grid()
    tex = g.select("row", "col", F.col("value").isNotNull().alias("seen"), *[(F.col("row") % 7).alias(c) for c in "rgb"])
    ortho = g.select("row", "col", *[(F.col("row") + F.col("col")).alias(c) for c in "rgb"], F.when(F.col("col") % 3 > 0, 255).otherwise(0).alias("alpha"))
    return mesh.ortho_fill(tex, ortho).select("row", "col", "r", "filled")


@query()
def affine_fit(spark, d):
    a = Views(spark, d).spots().select("id", (37 / (F.col("x") + 20) + 0.12).alias("p"), F.when(F.col("id") % 20 == 0, F.lit(5.0)).otherwise(F.col("x") + 20).alias("z"))
    f = estimate.fit_affine(a, 60)
    return a.agg(F.count(F.lit(1)).alias("anchors")).select("anchors", F.lit(f["mode"]).alias("mode"), F.lit(f["a"]).alias("a"), F.lit(f["b"]).alias("b"), F.lit(f["n_inliers"]).alias("inliers"))


@query(f"""WITH g AS (SELECT row, col, value, 17 + (row*7+col*3)%11/4.0::double AS truth FROM ({GRID}) WHERE value IS NOT NULL) SELECT count(*) AS n, round(quantile_cont(abs(value-truth), 0.5), 8) AS median_abs, round(quantile_cont(abs(value-truth), 0.9), 8) AS p90_abs, round(avg(value-truth), 8) AS bias FROM g""")
def height_evaluation(spark, d):
    from ..operators.evaluate import height_errors

    g = Views(spark, d).grid()
    truth = g.select("row", "col", (17 + F.expr("(row*7+col*3)%11") / 4).alias("value"))
    return height_errors(g, truth).select("n", *[F.round(c, 8).alias(c) for c in ("median_abs", "p90_abs", "bias")])


@query(f"""WITH t AS (SELECT s_suppkey AS truth_id, cast((s_suppkey*29)%100 as double) AS x, cast((s_suppkey*43)%100 as double) AS y, 50.0::double+s_suppkey%9 AS area, 8.0::double+s_suppkey%5 AS ridge FROM supplier),
  p AS (SELECT truth_id, s.id, sqrt((t.x-s.x)*(t.x-s.x)+(t.y-s.y)*(t.y-s.y)) AS dist, abs(s.r+1-t.area)/t.area AS area_error, abs(s.z-t.ridge) AS ridge_error FROM t, ({SPOTS}) s)
  SELECT truth_id, id, round(area_error, 8) AS area_error, round(ridge_error, 8) AS ridge_error FROM p WHERE dist <= 10 QUALIFY row_number() OVER (PARTITION BY truth_id ORDER BY dist, id) = 1""")
def building_evaluation(spark, d):
    from ..operators.evaluate import building_errors

    v = Views(spark, d)
    truth = v.cams().select(F.col("cam_order").alias("id"), F.col("cam_x").alias("x"), F.col("cam_y").alias("y"), (50.0 + F.col("cam_order") % 9).alias("area"), (8.0 + F.col("cam_order") % 5).alias("ridge"))
    found = v.spots().select("id", "x", "y", (F.col("r") + 1).cast("double").alias("area"), F.col("z").alias("ridge"))
    return building_errors(truth, found).select("truth_id", "id", F.round("area_error", 8).alias("area_error"), F.round("ridge_error", 8).alias("ridge_error"))


@query(f"""SELECT count(*) AS n, round(sqrt(avg((id%3*0.1::double)*(id%3*0.1::double) + (id%5*0.2::double)*(id%5*0.2::double))), 4) AS rmse FROM ({SPOTS})""")
def camera_evaluation(spark, d):
    """Positions carried to another origin and back have no error but that which is added to them on the way."""
    from ..operators.evaluate import camera_rmse, moved_frame

    p = Views(spark, d).spots().select(F.col("id").cast("string").alias("name"), "x", "y", "z")
    a, b = (47.05, 8.03, 400.0), (47.06, 8.01, 420.0)
    found = moved_frame(moved_frame(p, a, b), b, a).withColumns({"x": F.col("x") + F.col("name").cast("long") % 3 * 0.1, "z": F.col("z") - F.col("name").cast("long") % 5 * 0.2})
    return camera_rmse(found, p).select("n", F.round("rmse", 4).alias("rmse"))


@query()
def facade_report(spark, d):
    v = Views(spark, d)
    t = v.table("lineitem")
    key = (F.col("l_suppkey") % 50).alias("building_id")
    lab = F.element_at(F.array(*map(F.lit, ("a window", "a door", "a garage door", "an entrance"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    openings = t.select(key, lab.alias("label"), (F.col("l_quantity") / 12).alias("width"), (F.col("l_extendedprice") / 5000).alias("height"), (F.col("l_discount") * 20).alias("bottom"))
    texels = v.spots().select((F.col("id") % 50).alias("building_id"), F.when(F.col("id") % 3 == 0, "roof").otherwise("wall").alias("part"), "r", "g", "b")
    walls = t.select(key).distinct().withColumn("eave_height_m", F.col("building_id") / 5.0)
    return buildings.facade_summary(walls, openings, texels)
