"""Operators against known truth: telemetry text, frames, rasters, meshes, stages, streams, files."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.functions import geodesy
from aeroframe.operators import buildings, cloud, components, estimate, interpolate, kernels, raster
from aeroframe.plans import config, stages
from aeroframe.session import ship
from aeroframe.sources import files, reconstruction, telemetry


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


OLD = "1\n00:00:01,000 --> 00:00:01,500\n<font size=\"36\">[latitude: 47.5] [longitude: 8.25] [altitude: 61.0] [gimbal_pitch: -90.0]</font>\n\n2\n00:00:02,000 --> 00:00:02,500\n[latitude: 0.0] [longitude: 0.0]\n"
NEW = "1\n00:00:00,000 --> 00:00:00,100\n<font>FrameCnt: 7, DiffTime: 33ms\n[iso: 100] [latitude: 47.1] [longitude: 8.2] [rel_alt: 60.0 abs_alt: 512.5] [gb_yaw: 179.0 gb_pitch: -60.0 gb_roll: 0.0]</font>\n"
TUPLES = "1\n00:00:03,000 --> 00:00:04,000\nGPS(47.9,8.9,12) BAROMETER:55.5\n\n2\n00:00:04,000 --> 00:00:05,000\nGPS (8.7, 47.7, 14) H 33.0m\n"


def test_subtitle_dialects(spark, tmp_path):
    for name, text in (("a", OLD), ("b", NEW), ("c", TUPLES)):
        (tmp_path / f"{name}.srt").write_text(text.replace("\n", "\r\n") if name == "b" else text)
    got = {(r.source[-5], r.t): r for r in telemetry.read_srt(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", 1.0), ("b", 0.0), ("c", 3.0), ("c", 4.0)}
    assert (got["a", 1.0].lat, got["a", 1.0].rel_alt, got["a", 1.0].gimbal_pitch) == (47.5, 61.0, -90.0)
    assert (got["b", 0.0].abs_alt, got["b", 0.0].rel_alt, got["b", 0.0].frame_cnt, got["b", 0.0].gimbal_yaw) == (512.5, 60.0, 7.0, 179.0)
    assert (got["c", 3.0].lat, got["c", 3.0].lon, got["c", 3.0].rel_alt) == (47.9, 8.9, 55.5)
    assert (got["c", 4.0].lat, got["c", 4.0].lon, got["c", 4.0].rel_alt) == (47.7, 8.7, 33.0)


def test_flight_log(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("time(millisecond),latitude,longitude,relative_altitude(m),height above\n500,47.0,8.0,12.5,x\n,47.1,8.1,bad,y\nx,47.2,8.2,3,z\n1500,,8.3,3,z\n")
    got = telemetry.read_telemetry(spark, str(p)).collect()
    assert [(r.t, r.lat, r.rel_alt) for r in got] == [(0.5, 47.0, 12.5), (1.0, 47.1, None)]


def test_synchronise_wraps_yaw_and_clamps(spark):
    s = [(1, i, float(i), 47 + i / 1000, 8.0, None, 60.0 + i, 170.0 + 4 * i if 170 + 4 * i < 180 else 170.0 + 4 * i - 360, -60.0, 0.0, None) for i in range(10)]
    samples = spark.createDataFrame(s, "run int, seq long, t double, lat double, lon double, abs_alt double, rel_alt double, gimbal_yaw double, gimbal_pitch double, gimbal_roll double, focal_len double")
    frames = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.75), (1, "c", 20.0), (2, "d", 1.0)], "run int, name string, t double")
    got = {r.name: r for r in interpolate.synchronise(samples, frames, ["run"]).collect()}
    assert (got["a"].gimbal_yaw, got["a"].lat, got["a"].in_span) == (178.0, 47.002, True)
    assert (got["b"].gimbal_yaw, got["b"].alt, got["b"].alt_source) == (-179.0, 62.75, "rel_alt")
    assert (got["c"].rel_alt, got["c"].in_span) == (69.0, False) and got["d"].lat is None and got["d"].alt_source == "none"


def test_local_frame_and_projection():
    for lat, lon in ((47.05, 8.03), (-33.9, 151.2), (0.5, -70.0)):
        epsg = (32600 if lat >= 0 else 32700) + math.floor((lon + 180) / 6) + 1
        e, n = geodesy.utm_forward(lat, lon, epsg)
        back = geodesy.utm_inverse(e, n, epsg)
        assert abs(back[0] - lat) < 1e-7 and abs(back[1] - lon) < 1e-7
    # A published point of reference: the CN Tower, 43.642567 N 79.387139 W, lies in zone 17 at about (630084, 4833439).
    e, n = geodesy.utm_forward(43.642567, -79.387139, 32617)
    assert abs(e - 630084) < 1.5 and abs(n - 4833439) < 1.5


def test_similarity_and_frame(spark):
    rng = np.random.default_rng(1)
    r, s, t = kernels.rotation_matrix(np.array([0.2, -0.4, 1.1])), 2.7, np.array([5.0, -3.0, 12.0])
    x = rng.uniform(-20, 20, (40, 3))
    y = s * x @ r.T + t + rng.normal(0, 0.05, (40, 3))
    y[3] += 40
    axes = np.stack([[0, 0.5, -0.866]] * 40) @ r  # optical axes in the source frame
    gim = np.degrees(np.arctan2(0, 0.5)), np.degrees(np.arcsin(-0.866))
    rows = [(i, f"f{i}", *map(float, x[i]), *map(float, y[i]), *map(float, axes[i]), float(gim[0]), float(gim[1])) for i in range(40)]
    frames = spark.createDataFrame(rows, "idx int, name string, x double, y double, z double, ex double, ey double, ez double, ax double, ay double, az double, gimbal_yaw double, gimbal_pitch double")
    got = estimate.solve_frame(frames, config={"ransac_iters": 100})
    assert abs(got["scale"] - s) < 0.02 and got["num_inliers"] == 39 and got["rmse_fit_m"] < 0.3 and got["orientation_prior"] == "gimbal"
    assert np.abs(np.array(got["rotation"]).reshape(3, 3) - r).max() < 0.02
    line = frames.withColumns({c: F.col("idx").cast("double") * k for c, k in (("x", 1.0), ("y", 2.0), ("z", 0.0), ("ex", 2.0), ("ey", 4.0), ("ez", 0.0))}).withColumn("gimbal_yaw", F.lit(None).cast("double"))
    with pytest.raises(ValueError):
        estimate.solve_frame(line)
    with pytest.raises(ValueError):
        estimate.solve_frame(frames.limit(3))


def test_raster_filters_match_arrays(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(0, 10, (23, 31))
    df = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(23) for j in range(31)], "row long, col long, value double")

    def arr(d, c="value"):
        out = np.full(a.shape, np.nan)
        for x in d.collect():
            out[x["row"], x["col"]] = np.nan if x[c] is None else x[c]
        return out

    w = raster.gaussian_weights(1.0)
    assert np.allclose(arr(raster.gaussian(df, 1.0, tile=10)), raster._blur(a, w))
    k = raster._median(a, 3)
    rough = raster._blur(np.abs(a - k), raster.gaussian_weights(1.0))
    assert np.allclose(arr(raster.roughness(df, 1.0, tile=9)), rough)
    assert raster.window_sizes(1.0, 17.0) == [3, 5, 9, 17]


def test_ground_keeps_terrain_and_drops_a_block(spark):
    rows = [(i, j, 0.05 * i + (8.0 if 10 <= i < 18 and 12 <= j < 20 else 0.0)) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(rows, "row long, col long, value double")
    got = {(r.row, r.col): r.ground for r in raster.ground_filter(df, 1.0, 20.0).collect()}
    assert not any(got[i, j] for i in range(11, 17) for j in range(13, 19)) and got[2, 2] and got[30, 30] and got[25, 5]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(500,)], "id long")
                                                                       .unionByName(spark.createDataFrame([(i,) for e in edges for i in e], "id long"))).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 140)) and got[201] == 200 and got[500] == 500


def test_footprints_and_roofs(spark):
    mask = np.zeros((40, 50), bool)
    mask[5:35, 8:24] = True
    ring, shape, score = kernels.regular_footprint(mask, 0.5)
    assert shape == "rectangle" and len(ring) == 4 and score > 0.99
    mask[5:20, 24:44] = True
    ring, shape, score = kernels.regular_footprint(mask, 0.5)
    assert len(ring) == 6 and score > 0.97 and abs(kernels.polygon_area(ring) - mask.sum()) / mask.sum() < 0.03
    tris = kernels.triangulate(ring)
    assert abs(sum(kernels.polygon_area(ring[t]) for t in tris) - kernels.polygon_area(ring)) < 1e-6
    rng = np.random.default_rng(3)
    u, v = rng.uniform(0, 30, 800), rng.uniform(0, 16, 800)
    kind, p, r = kernels.fit_roof(u, v, 11 - 0.5 * np.abs(v - 8) + rng.normal(0, 0.02, 800))
    assert kind == "gable_u" and abs(p["v0"] - 8) < 0.3 and abs(p["zr"] - 11) < 0.2 and r < 0.1
    assert kernels.fit_roof(u, v, np.full(800, 6.0))[0] == "flat"


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(0, 50, (150, 3)), rng.normal(5, 0.1, (60, 3)), [[400.0, 0, 0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    got = {}
    for r in cloud.nearest_neighbours(df, 4, 10.0, block=32).collect():
        got.setdefault(r.id, []).append((r["rank"], r.dist))
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, :4]
    assert len(got) == len(x) and all(np.allclose([v for _, v in sorted(got[i])], d[i]) for i in range(len(x)))


def test_stage_runner(spark, tmp_path):
    calls = []

    def one(r):
        calls.append("one")
        df = spark.range(3)
        return {"t": df}, df.agg(F.lit(True).alias("passed")).select("passed", F.array().cast("array<string>").alias("failures"), F.lit("{}").alias("metrics"))

    def two(r):
        calls.append("two")
        n = r.table("one", "t").agg(F.count(F.lit(1)).alias("n"))
        return {}, n.select((F.col("n") > 5).alias("passed"), F.array(F.lit("few")).alias("failures"), F.lit("{}").alias("metrics"))

    plan = [stages.Stage("one", one), stages.Stage("two", two, ["one"]), stages.Stage("three", two, ["two"])]
    r = stages.Runner(spark, str(tmp_path / "run"), {})
    assert r.run(plan)["status"] == "PARTIAL" and calls == ["one", "two"]
    got = r.run(plan)
    assert calls == ["one", "two", "two"] and got["stages"]["one"]["cached"] and got["stages"]["two"]["failures"] == ["few"]
    assert r.run(plan, until="one")["status"] == "PARTIAL_SUCCESS"
    r.run(plan, until="one", force=True)
    assert calls.count("one") == 2
    with pytest.raises(stages.GateFailure):
        r.table("two", "x")


def test_products_run(spark, tmp_path):
    pts = spark.range(6400).select((F.col("id") % 80 * 0.5 + 0.1).alias("x"), (F.floor(F.col("id") / 80) * 0.5 + 0.1).alias("y"))
    roof = F.col("x").between(12, 26) & F.col("y").between(10, 24)
    pts.withColumn("z", 0.02 * F.col("x") + F.when(roof, 7.0).otherwise(0.0)).write.parquet(str(tmp_path / "run/fusion/points"))
    spark.createDataFrame([("fusion", True, [], "{}", 0.0, "k")], stages.GATE).write.json(str(tmp_path / "run/fusion/gate"))
    r = stages.Runner(spark, str(tmp_path / "run"), config.override(config.DEFAULTS, ["products.gsd=0.5", "products.max_window_m=20", "completion.max_curvature=3"]))
    got = r.run(stages.STAGES)
    assert got["status"] == "SUCCESS", got
    b = r.table("completion", "buildings").collect()
    assert len(b) == 1 and abs(b[0].area_m2 - 14 * 14) < 40 and abs(b[0].ridge_height_m - 7) < 0.6


def test_settings():
    c = config.override({"a": {"b": 1, "c": 2}}, ["a.b=2.5", "a.d=true", "e.f=[1,2]", "g=text"])
    assert c == {"a": {"b": 2.5, "c": 2, "d": True}, "e": {"f": [1, 2]}, "g": "text"}
    assert config.stable_hash({"x": 1, "y": 2}) == config.stable_hash({"y": 2, "x": 1})


def test_text_and_binary_models(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 500 510 320 240\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 1 2 3 1 a b.jpg\n10 20 7 30 40 -1\n2 0.7071067811865476 0 0 0.7071067811865476 0 0 1 1 c.jpg\n\n")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 10 20 30 0.5 1 0 2 1\n")
    m = reconstruction.read_model(spark, str(tmp_path))
    im = {r.name: r for r in m["images"].collect()}
    assert im["a b.jpg"].centre == [-1.0, -2.0, -3.0] and im["c.jpg"].camera_id == 1
    assert [(r.image_id, r.kp_idx, r.u, r.point_id) for r in m["observations"].orderBy("kp_idx").collect()] == [(1, 0, 10.0, 7), (1, 1, 30.0, None)]
    p = m["points3d"].first()
    assert (p.point_id, p.z, p.g, p.track_len) == (7, 3.0, 20, 2) and m["cameras"].first().params == [500.0, 510.0, 320.0, 240.0]
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<QiiQQ4d", 1, 1, 1, 640, 480, 500, 510, 320, 240))
    assert reconstruction.read_binary(spark, str(tmp_path / "cameras.bin"), "cameras").first().model == "PINHOLE"
    (tmp_path / "images.bin").write_bytes(struct.pack("<Qi7di", 1, 5, 1, 0, 0, 0, 1, 2, 3, 1) + b"x.jpg\0" + struct.pack("<Q2dq", 1, 1.0, 2.0, 7))
    assert reconstruction.read_binary(spark, str(tmp_path / "images.bin"), "images").first().name == "x.jpg"
    data = b"3&2&1&" + struct.pack("<6f", *range(6))
    two = b"2&1&2&" + struct.pack("<4f", *range(4))
    (tmp_path / "two.bin").write_bytes(two)
    cells = lambda name, last: sorted(tuple(r)[1:] for r in reconstruction.read_depth_arrays(spark, str(tmp_path / name), last).collect())
    assert cells("two.bin", False) == [(0, 0, 0, 0.0), (0, 0, 1, 2.0), (0, 1, 0, 1.0), (0, 1, 1, 3.0)]
    assert cells("two.bin", True) == [(0, 0, 0, 0.0), (0, 0, 1, 1.0), (0, 1, 0, 2.0), (0, 1, 1, 3.0)]
    (tmp_path / "d.bin").write_bytes(data)
    assert cells("d.bin", False) == cells("d.bin", True) and cells("d.bin", False)[4] == (1, 1, 0, 4.0)


def test_files_round_trip(spark, tmp_path):
    pts = spark.createDataFrame([(i, i * 1.5, 2.0 - i, 0.25 * i, 10 * i, 20, 30, 6) for i in range(5)], "idx long, x double, y double, z double, r int, g int, b int, class int")
    files.write_ply(pts, str(tmp_path / "a.ply"))
    back = reconstruction.read_ply_points(spark, str(tmp_path / "a.ply")).orderBy("idx").collect()
    assert [(r.x, r.y, r.z, r.r) for r in back] == [(i * 1.5, 2.0 - i, 0.25 * i, 10 * i) for i in range(5)]
    files.write_las(pts, str(tmp_path / "a.las"))
    raw = (tmp_path / "a.las").read_bytes()
    assert raw[:4] == b"LASF" and len(raw) == 375 + 36 * 5 and struct.unpack_from("<Q", raw, 247)[0] == 5
    head = b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "m.ply").write_bytes(head + struct.pack("<9f", *range(9)) + struct.pack("<B3i", 3, 0, 1, 2))
    assert reconstruction.read_ply_faces(spark, str(tmp_path / "m.ply")).first().v2 == 2
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    files.write_glb(v, spark.createDataFrame([(0, 1, 2)], "v0 long, v1 long, v2 long"), str(tmp_path / "m.glb"))
    glb = (tmp_path / "m.glb").read_bytes()
    assert glb[:4] == b"glTF" and struct.unpack_from("<I", glb, 8)[0] == len(glb)
    with pytest.raises(ValueError):
        files.write_csv(pts.limit(0), str(tmp_path / "c"))
    (tmp_path / "m.obj").write_text("# o\nv 1 2 3 0.5\nvt 0 1\nf 1 1 1\n")
    lines = [r.line for r in files.transform_obj(spark, str(tmp_path / "m.obj"), 2.0, [1, 0, 0, 0, 1, 0, 0, 0, 1], [1.0, 0.0, 0.0]).orderBy("n").collect()]
    assert lines[:4] == ["# o", "v 3.000000 4.000000 6.000000 0.5", "vt 0 1", "f 1 1 1"]
    b = spark.createDataFrame([(2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "id int, ring_lonlat array<struct<x:double,y:double>>")
    files.write_geojson(b, str(tmp_path / "b.json"), True)
    assert spark.read.json(str(tmp_path / "b.json")).first().features[0].geometry.coordinates[0][3] == [0.0, 0.0]
    assert os.path.exists(tmp_path / "b.json")


def test_streams_equal_batches(spark, tmp_path):
    from aeroframe.streaming import telemetry as live

    e = spark.range(200).select(F.timestamp_seconds(F.col("id") * 40).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"), "id")
    for i in range(4):
        e.where(f"id div 50 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    live.run_once(live.windowed(src, "ts", ["k"], "v", "5 minutes", late="1 hour"), str(tmp_path / "ck"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/{i}"))
    got = {tuple(r) for r in spark.read.parquet(f"{out}/*").collect()}
    assert got and got <= {tuple(r) for r in live.windowed(e, "ts", ["k"], "v", "5 minutes").collect()}
    text = files.srt_text(files.flight(spark, 20)).orderBy("seq").collect()
    (tmp_path / "srt").mkdir()
    (tmp_path / "srt/a.srt").write_text("\n\n".join(r.block for r in text))
    live.run_once(live.srt_stream(spark, str(tmp_path / "srt")), str(tmp_path / "ck2"), lambda b, i: b.write.mode("overwrite").parquet(f"{out}_srt/{i}"))
    assert spark.read.parquet(f"{out}_srt/*").count() == 20 == telemetry.read_srt(spark, str(tmp_path / "srt")).count()


def test_records_and_suppression(spark):
    rows = [(1, "w", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "w", 0.8, 1.0, 1.0, 11.0, 11.0), (1, "w", 0.7, 20.0, 20.0, 30.0, 30.0), (2, "w", 0.5, 0.0, 0.0, 0.0, 0.0)]
    got = buildings.suppress(spark.createDataFrame(rows, "image int, label string, score double, x0 double, y0 double, x1 double, y1 double"), ["image"]).collect()
    assert sorted((r.image, r.score) for r in got) == [(1, 0.7), (1, 0.9), (2, 0.5)]


def test_hull_fraction(spark):
    def hull(cells, n=12):
        have = set(cells)
        return raster.hull_fraction(spark.createDataFrame([(r, c, int((r, c) in have)) for r in range(n) for c in range(n)], "row long, col long, value int"))

    square = [(r, c) for r in range(3, 9) for c in range(3, 9)]
    assert hull(square) == 1.0 and hull([x for x in square if x != (5, 5)]) == 35 / 36
    # A far cell is no part of the hull; a triangle fills its own.
    assert hull([*square, (11, 11)]) == 1.0 and hull([(3, 3), (3, 4)]) == 0.0
    assert raster.hull_spans(np.array([(0, 0), (4, 0), (0, 4)], float)) == [(0, 0, 4), (1, 0, 3), (2, 0, 2), (3, 0, 1), (4, 0, 0)]


def test_products_gate_is_measured(spark, tmp_path):
    pts = spark.range(6400).select((F.col("id") % 80 * 0.5 + 0.1).alias("x"), (F.floor(F.col("id") / 80) * 0.5 + 0.1).alias("y"), F.lit(1.0).alias("z"))
    pts.write.parquet(str(tmp_path / "run/fusion/points"))
    spark.createDataFrame([("fusion", True, [], "{}", 0.0, "k")], stages.GATE).write.json(str(tmp_path / "run/fusion/gate"))
    r = stages.Runner(spark, str(tmp_path / "run"), config.override(config.DEFAULTS, ["products.gsd=0.5", "products.max_window_m=1"]))
    _, gate = stages.products_stage(r)
    m = gate.first()
    assert m.passed and '"hull_frac":1.0' in m.metrics and "ortho_frac" not in m.metrics
    spark.createDataFrame([(5, 5, 255), (5, 6, 0)], "row long, col long, alpha int").write.parquet(str(tmp_path / "run/fusion/ortho"))
    assert stages.products_stage(r)[1].first().failures == ["ortho"]
