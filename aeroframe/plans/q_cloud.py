"""Queries over points: rasters of highest points, voxels, neighbours, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, grids
from ..operators import buildings, cloud, estimate, gates, mesh, raster, visibility
from .registry import CAMS, PTS, SPOTS, Views, query


@query(f"SELECT cast(floor((100-y)/2) AS bigint) AS row, cast(floor(x/2) AS bigint) AS col, max(z) AS value FROM ({PTS}) GROUP BY 1, 2")
def raster_max(spark, d):
    row, col = grids.cell("x", "y", 0.0, 100.0, 2.0)
    return raster.rasterise_max(Views(spark, d).pts(), row, col)


@query(f"SELECT l_orderkey, l_linenumber, x, y, z - min(z) OVER (PARTITION BY floor(x/10), floor(y/10)) AS hag FROM ({PTS})")
def hag(spark, d):
    return cloud.height_above_ground(Views(spark, d).pts()).select("l_orderkey", "l_linenumber", "x", "y", "hag")


@query(f"""SELECT cast(floor(x/5) AS bigint) AS vx, cast(floor(y/5) AS bigint) AS vy, cast(floor(z/5) AS bigint) AS vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n
  FROM ({PTS}) GROUP BY 1, 2, 3""")
def voxel_mean(spark, d):
    return cloud.voxel_mean(Views(spark, d).pts(), 5.0).select("vx", "vy", "vz", *[F.round(c, 6).alias(c) for c in "xyz"], "n")


@query(f"""SELECT cast(round_even(x/4, 0) AS bigint) AS vx, cast(round_even(y/4, 0) AS bigint) AS vy, cast(round_even(z/4, 0) AS bigint) AS vz, min(id) AS id FROM ({SPOTS}) GROUP BY 1, 2, 3""")
def voxel_first(spark, d):
    return cloud.voxel_first(Views(spark, d).spots(), 4.0).select("vx", "vy", "vz", "id")


@query(f"""WITH s AS ({SPOTS}), m AS (SELECT quantile_cont(x, 0.5) mx, quantile_cont(y, 0.5) my, quantile_cont(z, 0.5) mz FROM s),
  q AS (SELECT s.*, sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) AS dist FROM s, m), l AS (SELECT avg(dist) + 1.2*stddev_pop(dist) AS lim FROM q)
  SELECT id, round(dist, 6) AS dist FROM q, l WHERE dist < lim""")
def sor_global(spark, d):
    return cloud.outliers_global(Views(spark, d).spots(), 1.2).select("id", F.round("dist", 6).alias("dist"))


_KNN = f"""n AS (SELECT a.id, b.id AS nid, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dist FROM ({SPOTS}) a, ({SPOTS}) b),
  k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, nid) AS rank FROM n QUALIFY rank <= 6)"""


@query(f"WITH {_KNN} SELECT id, cast(rank AS int) AS rank, round(dist, 6) AS dist FROM k")
def knn(spark, d):
    return cloud.nearest_neighbours(Views(spark, d).spots(), 6, 25.0).select("id", "rank", F.round("dist", 6).alias("dist"))


@query(f"WITH {_KNN}, m AS (SELECT id, avg(dist) AS m FROM k GROUP BY id), l AS (SELECT avg(m)+stddev_samp(m) AS lim FROM m) SELECT s.id, s.x, s.y, s.z FROM ({SPOTS}) s JOIN m USING (id), l WHERE m < lim")
def sor_neighbours(spark, d):
    s = Views(spark, d).spots()
    return cloud.outliers_knn(s, cloud.nearest_neighbours(s, 6, 25.0), 1.0).select("id", "x", "y", "z")


@query(f"""WITH {_KNN} SELECT k.id, round(covar_samp(s.x, s.x), 4) AS xx, round(covar_samp(s.x, s.y), 4) AS xy, round(covar_samp(s.z, s.z), 4) AS zz
  FROM k JOIN ({SPOTS}) s ON s.id = k.nid GROUP BY k.id""")
def neighbour_covariance(spark, d):
    s = Views(spark, d).spots()
    return cloud.covariances(s, cloud.nearest_neighbours(s, 6, 25.0)).select("id", *[F.round(c, 4).alias(c) for c in ("xx", "xy", "zz")])


@query()
def shape_features(spark, d):
    s = Views(spark, d).spots()
    return cloud.shape_features(cloud.covariances(s, cloud.nearest_neighbours(s, 6, 25.0)))


@query()
def classify_cloud(spark, d):
    return cloud.classify_cloud(Views(spark, d).spots(), 8, 25.0).select("id", "hag", "planarity", "class")


@query(f"""WITH h AS (SELECT *, z - min(z) OVER (PARTITION BY floor(x/10), floor(y/10)) AS hag, cast(l_linenumber as double)/8 AS pl, cast((l_partkey*7)%100 as double)/100 AS sc, cast((l_suppkey*13)%100 as double)/100 AS nz FROM ({PTS})),
  c AS (SELECT l_suppkey, CASE WHEN hag < 1.2 THEN CASE WHEN pl > 0.65 AND nz > 0.75 THEN 11 ELSE 2 END WHEN hag >= 3.5 THEN CASE WHEN pl > 0.55 AND nz > 0.6 THEN 6 ELSE 5 END WHEN sc > 0.25 THEN 5 ELSE 6 END AS cls FROM h)
  SELECT l_suppkey, count(*) FILTER (WHERE cls = 2) AS ground, count(*) FILTER (WHERE cls = 5) AS vegetation, count(*) FILTER (WHERE cls = 6) AS building, count(*) FILTER (WHERE cls = 11) AS road FROM c GROUP BY l_suppkey""")
def class_hist(spark, d):
    p = cloud.height_above_ground(Views(spark, d).pts())
    frac = lambda e: F.expr(e).cast("double") / 100
    cls = cloud.classify(F.col("hag"), F.col("l_linenumber").cast("double") / 8, frac("(l_partkey*7)%100"), frac("(l_suppkey*13)%100"))
    return cloud.class_histogram(p.withColumn("class", cls), keys=["l_suppkey"])


_BLOCKS = f"SELECT cast(floor(x/20)*5+floor(y/20) AS bigint) AS component, z - 3 AS h, cast(l_linenumber as double) AS ground, l_partkey%2 AS observed FROM ({PTS})"


@query(f"""SELECT component, round(count(*)*0.25::double, 4) AS area_m2, round(quantile_cont(h, 0.2), 6) AS eave_height_m, round(quantile_cont(h, 0.95), 6) AS ridge_height_m, round(avg(h), 6) AS mean_height_m,
  round(sum(greatest(h, 0))*0.25, 4) AS volume_m3, quantile_cont(ground, 0.5) AS ground_height_m, round(avg(observed), 6) AS roof_observed_frac FROM ({_BLOCKS}) GROUP BY component""")
def building_record(spark, d):
    p = Views(spark, d).pts()
    cells = p.select((F.floor(F.col("x") / 20) * 5 + F.floor(F.col("y") / 20)).alias("component"), (F.col("z") - 3).alias("h"), F.col("l_linenumber").cast("double").alias("ground"), (F.col("l_partkey") % 2).alias("observed"))
    r = buildings.records(cells, 0.5)
    places = {"area_m2": 4, "volume_m3": 4}
    return r.select("component", *[F.round(c, places.get(c, 6)).alias(c) for c in r.columns[1:]])


@query(f"""WITH s AS (SELECT p_partkey, cast(p_size as double) AS area, cast((p_partkey*37)%100 as double)/300 AS exg, cast((p_partkey*53)%100 as double)/200 AS rough, cast((p_partkey*71)%100 as double)/80 AS curve, p_partkey%3=0 AS known FROM part),
  r AS (SELECT CASE WHEN area < 12 THEN 'small' WHEN known AND exg > 0.1 THEN 'vegetation' WHEN rough > 0.35 OR (NOT known AND curve > 0.6) THEN 'rough' ELSE 'kept' END AS reason FROM s) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def rejection_reasons(spark, d):
    frac = lambda k, q: F.expr(f"(p_partkey*{k})%100").cast("double") / q
    r = buildings.rejection(F.col("p_size").cast("double"), frac(37, 300), frac(53, 200), frac(71, 80), F.col("p_partkey") % 3 == 0)
    return Views(spark, d).table("part").select(F.coalesce(r, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH p AS (SELECT s.id, c.cam_order, (cam_z-z)/sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)+(cam_z-z)*(cam_z-z))/(1+0.01*sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)+(cam_z-z)*(cam_z-z))) AS score FROM ({SPOTS}) s, ({CAMS}) c)
  SELECT id, cam_order, round(score, 8) AS score FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cam_order) = 1""")
def best_view(spark, d):
    v = Views(spark, d)
    return visibility.best_cameras(v.spots(), v.cams(), "id").select("id", "cam_order", F.round("score", 8).alias("score"))


@query(f"""WITH p AS (SELECT s.id, c.cam_order, (cam_z-z)/sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)+(cam_z-z)*(cam_z-z))/(1+0.01*sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)+(cam_z-z)*(cam_z-z))) AS score FROM ({SPOTS}) s, ({CAMS}) c)
  SELECT id, cast(row_number() OVER (PARTITION BY id ORDER BY score DESC, cam_order) AS int) AS rank, cam_order FROM p QUALIFY rank <= 5""")
def topk_views(spark, d):
    v = Views(spark, d)
    return visibility.best_cameras(v.spots(), v.cams(), "id", 5).select("id", "rank", "cam_order")


@query(f"""WITH f AS (SELECT id AS fid, x, y, z FROM ({SPOTS})), p AS (SELECT fid, 1.0*(cam_z-z)/sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)+(cam_z-z)*(cam_z-z)) > cos(radians(20)) AS hit FROM f, ({CAMS}) c WHERE cam_order % 10 = 0)
  SELECT fid, bool_or(hit) AS covered FROM p GROUP BY fid""")
def face_coverage(spark, d):
    v = Views(spark, d)
    f = v.spots().select(F.col("id").alias("fid"), "x", "y", "z", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return visibility.face_coverage(f, v.cams(), 20.0, 10)


_DEPTH = "SELECT l_suppkey AS image, cast(l_partkey%24 as int) AS row, cast(l_orderkey%32 as int) AS col, max(l_quantity+30) AS z FROM lineitem GROUP BY 1, 2, 3"


@query(f"""WITH d AS ({_DEPTH}), p AS (SELECT s.id, c.cam_order AS image, cam_z - z AS pz, 20*(x-cam_x)/(cam_z-z)+16-0.5 AS u, 20*(cam_y-y)/(cam_z-z)+12-0.5 AS v FROM ({SPOTS}) s, ({CAMS}) c WHERE cam_z - z > 0),
  q AS (SELECT *, cast(round_even(u, 0) AS int) AS pcol, cast(round_even(v, 0) AS int) AS prow FROM p),
  h AS (SELECT q.id, count(*) AS n FROM q JOIN d ON d.image = q.image AND d.row = prow AND d.col = pcol WHERE pcol BETWEEN 0 AND 31 AND prow BETWEEN 0 AND 23 AND d.z > 0 AND abs(d.z - pz) <= greatest(0.3, 0.03*pz) GROUP BY q.id)
  SELECT s.id, coalesce(n, 0) AS views FROM ({SPOTS}) s LEFT JOIN h USING (id)""")
def view_count(spark, d):
    v = Views(spark, d)
    depth = v.table("lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 24).cast("int").alias("row"), (F.col("l_orderkey") % 32).cast("int").alias("col")).agg(F.max(F.col("l_quantity") + 30).alias("z"))
    down = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, -1, 0, 0, 0, -1)])
    cams = v.cams().select(
        F.col("cam_order").alias("image"), "cam_order", "cam_x", "cam_y", "cam_z", F.lit(20.0).alias("fx"), F.lit(20.0).alias("fy"), F.lit(16.0).alias("cx"), F.lit(12.0).alias("cy"),
        F.lit(32).alias("width"), F.lit(24).alias("height"), down.alias("r_cw"), F.array(-F.col("cam_x"), F.col("cam_y"), F.col("cam_z")).alias("t_cw"),
    )
    return visibility.view_counts(v.spots(), cams, depth).select("id", "views")


@query(f"""WITH p AS (SELECT c.cam_order, s.id, sqrt((cam_x-x)*(cam_x-x)+(cam_y-y)*(cam_y-y)) AS dist FROM ({CAMS}) c, ({SPOTS}) s)
  SELECT cam_order, id, round(dist, 8) AS dist FROM p WHERE dist <= 3 QUALIFY row_number() OVER (PARTITION BY cam_order ORDER BY dist, id) = 1""")
def nearest_match_cap(spark, d):
    v = Views(spark, d)
    gt = v.cams().select("cam_order", F.col("cam_x").alias("x"), F.col("cam_y").alias("y"))
    return cloud.nearest_within(gt, v.spots(), 3.0, "cam_order", "id").withColumn("dist", F.round("dist", 8))


_RINGS = "SELECT r_regionkey AS ring_id, 8.0+r_regionkey*17 AS cx, 30.0+r_regionkey*9 AS cy FROM region"


@query(f"""WITH r AS ({_RINGS}), e AS (SELECT ring_id, unnest([{{'x0':cx-7,'y0':cy-5,'x1':cx+9,'y1':cy-8}},{{'x0':cx+9,'y0':cy-8,'x1':cx+2,'y1':cy+1}},{{'x0':cx+2,'y0':cy+1,'x1':cx+6,'y1':cy+11}},{{'x0':cx+6,'y0':cy+11,'x1':cx-7,'y1':cy-5}}]) AS e FROM r),
  h AS (SELECT s.id, ring_id, count(*) FILTER (WHERE (e.y0 > y) <> (e.y1 > y) AND x < (e.x1-e.x0)*(y-e.y0)/(e.y1-e.y0)+e.x0) % 2 = 1
      AND count(*) FILTER (WHERE (e.x1-e.x0)*(y-e.y0) = (e.y1-e.y0)*(x-e.x0) AND x BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND y BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1)) = 0 AS inside FROM ({SPOTS}) s, e GROUP BY s.id, ring_id) SELECT id, ring_id FROM h WHERE inside""")
def pip_filter(spark, d):
    v = Views(spark, d)
    pt = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    rings = v.of(_RINGS.replace("8.0", "8.0D").replace("30.0", "30.0D")).select("ring_id", F.array(pt(-7, -5), pt(9, -8), pt(2, 1), pt(6, 11)).alias("ring"))
    return mesh.in_rings(v.spots(), rings).select("id", "ring_id")


@query(f"""SELECT id, CASE WHEN l > 0.82 THEN 'white' WHEN l < 0.18 THEN 'black' WHEN s < 0.18 THEN CASE WHEN l < 0.6 THEN 'grey' ELSE 'light grey' END WHEN h < 18 OR h >= 340 THEN 'red'
   WHEN h < 40 THEN CASE WHEN l < 0.55 THEN 'terracotta' ELSE 'orange' END WHEN h < 65 THEN CASE WHEN s > 0.35 THEN 'yellow' ELSE 'beige' END WHEN h < 170 THEN 'green' WHEN h < 260 THEN 'blue' ELSE 'purple' END AS name,
   '#' || lower(printf('%02x', r) || printf('%02x', g) || printf('%02x', b)) AS hex, round((2.0*g-r-b)/(r+g+b+1e-6), 8) AS exg
  FROM (SELECT *, CASE WHEN mx = mn THEN 0 ELSE ((CASE WHEN r = mx THEN (g-b)/(mx-mn)::double WHEN g = mx THEN 2+(b-r)/(mx-mn)::double ELSE 4+(r-g)/(mx-mn)::double END)*60 + 360) % 360 END AS h,
     CASE WHEN mx = mn THEN 0 WHEN l <= 0.5 THEN (mx-mn)/(mx+mn)::double ELSE (mx-mn)/(510-mx-mn)::double END AS s
   FROM (SELECT id, r, g, b, greatest(r,g,b) AS mx, least(r,g,b) AS mn, (greatest(r,g,b)+least(r,g,b))/510.0::double AS l FROM ({SPOTS})))""")
def colour_names(spark, d):
    return Views(spark, d).spots().select("id", colour.colour_name("r", "g", "b").alias("name"), colour.hex_colour("r", "g", "b").alias("hex"), F.round(colour.excess_green("r", "g", "b"), 8).alias("exg"))


@query(f"""WITH h AS (SELECT cast(n_nationkey*7%40 as double)/20-1 AS nx, cast(n_regionkey*11%30 as double)/15-1 AS ny, 1.0::double AS nz, -cast(n_nationkey%7 as double)*10 AS d, n_nationkey AS round FROM nation)
  SELECT round, count(*) FILTER (WHERE abs(nx*x+ny*y+nz*z+d) < 5) AS inliers FROM ({PTS}), h GROUP BY round""")
def plane_score(spark, d):
    v = Views(spark, d)
    h = v.table("nation").selectExpr("cast(n_nationkey*7%40 as double)/20-1 AS nx", "cast(n_regionkey*11%30 as double)/15-1 AS ny", "1.0D AS nz", "-cast(n_nationkey%7 as double)*10 AS d", "n_nationkey AS round")
    return estimate.plane_scores(v.pts(), h, 5.0).select("round", "inliers")


@query()
def plane_fit(spark, d):
    s = Views(spark, d).spots().withColumn("z", F.when(F.col("id") % 4 > 0, 0.1 * F.col("x") + 0.2 * F.col("y") + F.col("z") / 100).otherwise(F.col("z") * 3))
    n, off, inl = estimate.fit_plane(s, 0.5)
    return inl.agg(F.count(F.lit(1)).alias("inliers")).select("inliers", *[F.lit(float(v)).alias(c) for v, c in zip((*n, off), ("nx", "ny", "nz", "d"))])


@query()
def cloud_metrics(spark, d):
    p = Views(spark, d).pts().select((F.col("l_suppkey") % 10).alias("site"), "x", "y", "z", *[F.lit(0).alias(c) for c in "rgb"])
    return buildings.cloud_metrics(p, "site")


@query(f"SELECT id, cast(round_even((x-0)/0.001, 0) AS int) AS x, cast(round_even((y-0)/0.001, 0) AS int) AS y, r*257 AS r, b*257 AS b FROM ({SPOTS})")
def las_records(spark, d):
    s = Views(spark, d).spots()
    return s.select("id").join(_las(s), "id")


def _las(s):
    from ..sources.files import las_fields

    one = las_fields(s.withColumn("class", F.col("id").cast("int")), 0.0, 0.0, 0.0)
    return one.select(F.col("class").cast("long").alias("id"), "x", "y", "r", "b")


@query()
def tsdf_fusion(spark, d):
    from ..operators.depth import integrate, surface_points

    v = Views(spark, d)
    s = v.spots().withColumn("z", F.sin(F.col("x") / 10) * 3).withColumns({"cam_x": F.col("x"), "cam_y": F.col("y"), "cam_z": F.lit(50.0), "w": F.lit(2.0)})
    return surface_points(integrate(s, 1.0, 3.0), 1.0)


@query("SELECT cast(n_nationkey AS bigint) AS nation, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def sql_surface(spark, d):
    """Tables as views, queried by SQL text."""
    from ..session import register_views

    v = Views(spark, d)
    register_views(spark, {"aero_nation": v.table("nation"), "aero_supplier": v.table("supplier")})
    return spark.sql("SELECT cast(n_nationkey AS bigint) AS nation, count(*) AS suppliers FROM aero_nation JOIN aero_supplier ON s_nationkey = n_nationkey GROUP BY 1")


@query("""WITH m AS (SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 10 THEN 1 ELSE 0 END), 6) AS coverage FROM events GROUP BY event_type)
  SELECT event_type, n >= 1500 AND coverage >= 0.4 AS passed, array_to_string(list_filter([CASE WHEN n >= 1500 THEN NULL ELSE 'enough' END, CASE WHEN coverage >= 0.4 THEN NULL ELSE 'coverage' END], lambda x: x IS NOT NULL), ',') AS failures FROM m""")
def gate_report(spark, d):
    m = Views(spark, d).table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 10).cast("int")), 6).alias("coverage"))
    g = gates.gate(m, {"enough": F.col("n") >= 1500, "coverage": F.col("coverage") >= 0.4}, ["n", "coverage"], ["event_type"])
    return g.select("event_type", "passed", F.array_join("failures", ",").alias("failures"))
