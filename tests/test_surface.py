"""Meshes out of voxels, byte-range files, filled holes and equalised pixels on shapes whose answer is known."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.functions.colour import lab_to_rgb, rgb_to_lab
from aeroframe.operators import contrast, pyramid, surface
from aeroframe.operators.joins import numbered_as_is
from aeroframe.plans.queries import QUERIES
from aeroframe.session import scratch, shared_dir, ship
from aeroframe.sources import files, rasters, reconstruction, records

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def voxels(spark, low, high, distance):
    """Voxels of a box with a distance (an expression of x, y, z in voxels)."""
    df = spark.range(1)
    for c, a, b in zip("xyz", low, high):
        df = df.withColumn(f"v{c}", F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long"))))
    x, y, z = (F.col(f"v{c}") + 0.5 for c in "xyz")
    return df.select("vx", "vy", "vz", distance(x, y, z).alias("tsdf"), F.lit(2.0).alias("weight"), F.lit(1.0).alias("r"), F.col("vx").cast("double").alias("g"), F.lit(3.0).alias("b"))


def arrays(vertices, faces):
    v = vertices.toPandas().set_index("vid")
    f = faces.toPandas()
    return v[list("xyz")], [v.loc[f[c], list("xyz")].to_numpy() for c in ("v0", "v1", "v2")], f


def test_a_ball_is_closed_and_right(spark):
    ball = voxels(spark, (-14, -14, -14), (13, 13, 13), lambda x, y, z: F.sqrt(x * x + y * y + z * z) - 10)
    vertices, faces = surface.surface_mesh(ball, 0.5, tile=8)
    r = surface.mesh_report(vertices, faces).first()
    assert r.rim_edges == 0 and r.odd_edges == 0 and r.vertices - r.edges + r.faces == 2
    assert abs(r.area_m2 / (4 * np.pi * 25) - 1) < 0.01
    v, (a, b, c), _ = arrays(vertices, faces)
    assert abs((np.cross(a, b) * c).sum() / 6 / (4 / 3 * np.pi * 125) - 1) < 0.01  # positive: faces look outwards
    assert np.abs(np.linalg.norm(v, axis=1) - 5).max() < 0.02
    other_v, other_f = surface.surface_mesh(ball, 0.5, tile=5)
    assert sorted(map(tuple, faces.collect())) == sorted(map(tuple, other_f.collect())) and sorted(map(tuple, vertices.collect())) == sorted(map(tuple, other_v.collect()))


def test_a_slanted_plane_and_what_is_not_known(spark):
    plane = voxels(spark, (0, 0, -8), (19, 11, 12), lambda x, y, z: (z - 0.3 * x - 1.0) / np.sqrt(1.09))
    r = surface.mesh_report(*surface.surface_mesh(plane, 1.0, tile=4)).first()
    assert abs(r.area_m2 - 19 * 11 * np.sqrt(1.09)) < 1e-6 and r.odd_edges == 0 and r.rim_edges > 0
    holed = plane.withColumn("weight", F.when((F.col("vx") == 10) & (F.col("vy") == 5), 1.0).otherwise(2.0))
    less = surface.mesh_report(*surface.surface_mesh(holed, 1.0, tile=4)).first()
    assert abs(r.area_m2 - less.area_m2 - 4 * np.sqrt(1.09)) < 1e-6
    assert surface.mesh_report(*surface.surface_mesh(plane.limit(0), 1.0)).first().faces == 0
    at_zero = voxels(spark, (0, 0, 0), (5, 5, 5), lambda x, y, z: z - 2.5)  # voxels exactly on the surface
    exact = surface.mesh_report(*surface.surface_mesh(at_zero, 1.0, tile=2)).first()
    assert exact.odd_edges == 0 and abs(exact.area_m2 - 25) < 1e-9
    with pytest.raises(Exception, match="out of reach"):
        surface.surface_mesh(plane.withColumn("vx", F.col("vx") + surface.REACH), 1.0)


def test_small_parts_go(spark):
    both = lambda x, y, z: F.least(F.sqrt(x * x + y * y + z * z) - 6, F.sqrt((x - 12) * (x - 12) + y * y + z * z) - 1.3)
    v, f = surface.fused_mesh(voxels(spark, (-9, -9, -9), (15, 8, 8), both), 1.0, least_share=0.1)
    assert v.agg(F.max("x")).first()[0] < 7 and surface.mesh_report(v, f).first().rim_edges == 0
    assert surface.used_vertices(v, f).count() == v.count()


def test_registered_balls_have_no_odd_edge(spark):
    """Some reach out of their grid, and half of them have a column that is not known."""
    faces = QUERIES["tsdf_mesh"](spark, DATA)
    edge = F.explode(F.array(F.struct("obj", F.col("a").alias("p"), F.col("b").alias("q")), F.struct("obj", F.col("b").alias("p"), F.col("c").alias("q")), F.struct("obj", F.col("a").alias("p"), F.col("c").alias("q")))).alias("e")
    assert [r.n for r in faces.select(edge).groupBy("e").agg(F.count(F.lit(1)).alias("n")).select("n").distinct().orderBy("n").collect()] == [1, 2]


# files


def test_las_in_ranges(spark, tmp_path):
    pts = spark.range(0, 5000, 1, 7).select((F.col("id") * 0.25).alias("x"), (1000 - F.col("id") * 0.5).alias("y"), (F.col("id") % 11).cast("double").alias("z"), *[(F.col("id") % k).cast("int").alias(c) for k, c in ((251, "r"), (97, "g"), (13, "b"))], (F.col("id") % 5).cast("int").alias("class"))
    for name in ("a.las", "b.las"):
        files.write_las(pts, str(tmp_path / name))
    assert sorted(os.listdir(tmp_path)) == ["a.las", "b.las"] and (tmp_path / "a.las").stat().st_size == 375 + 36 * 5000
    got = records.read_records(spark, str(tmp_path), "las", split=36 * 700)
    assert got.rdd.getNumPartitions() == 16
    want = sorted((r.x, r.y, r.z, r.r * 257, r["class"]) for r in pts.collect())
    for name in ("a.las", "b.las"):
        rows = got.where(F.col("source").endswith(name)).collect()
        assert sorted((round(r.x, 3), round(r.y, 3), round(r.z, 3), r.r, r["class"]) for r in rows) == want and sorted(r.idx for r in rows) == list(range(5000))
    few = reconstruction.read_las(spark, str(tmp_path / "a.las"), ["z", "class"])
    assert few.columns == ["z", "class"] and few.count() == 5000
    files.write_las(pts.limit(0), str(tmp_path / "none.las"))
    assert reconstruction.read_las(spark, str(tmp_path / "none.las")).count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select((F.col("id") * 4).alias("pos"), F.when(F.col("id") < 9, F.lit(b"abcd")).otherwise(F.raise_error("no").cast("binary")).alias("data"))
    with pytest.raises(Exception):
        records.write_blocks(bad, str(tmp_path / "x.bin"), b"", 40)
    short = spark.range(3).select((F.col("id") * 4).alias("pos"), F.lit(b"abcd").alias("data"))
    with pytest.raises(Exception, match="expected"):
        records.write_blocks(short, str(tmp_path / "x.bin"), b"", 40)
    assert os.listdir(tmp_path) == []
    records.write_blocks(short, str(tmp_path / "x.bin"), b"", 12)
    assert (tmp_path / "x.bin").read_bytes() == b"abcd" * 3


def test_a_file_longer_than_a_row_may_be(spark, tmp_path):
    """Two gigabytes do not fit in one binary row; ranges do not care. The file is sparse."""
    with open(tmp_path / "big.bin", "wb") as f:
        f.write(b"30000&20000&1&")
        f.seek(14 + 4 * (599_999_999))
        f.write(struct.pack("<f", 7.0))
    df = records.read_records(spark, str(tmp_path / "big.bin"), "depth", ["row", "col", "depth"], split=400_000_000)
    assert df.rdd.getNumPartitions() == 6
    part = records.RecordReader({"kind": "depth", "files": "[]"}, df.schema)
    layout = records.depth_layout(b"30000&20000&1&x", 14 + 4 * 600_000_000, False)
    last = list(part.read(records.Range(str(tmp_path / "big.bin"), layout, 599_999_000, 1000)))[-1]
    assert last.to_pylist()[-1] == {"row": 19_999, "col": 29_999, "depth": 7.0}


def test_binary_clouds_and_meshes_in_ranges(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 3\nproperty double x\nproperty double y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
    for form, order in (("binary_little_endian 1.0", "<"), ("binary_big_endian 1.0", ">")):
        body = b"".join(struct.pack(f"{order}ddfBBB", i, -i, 0.5 * i, 10 * i, 2, 3) for i in range(3))
        path = tmp_path / f"{form[7:10]}.ply"
        path.write_bytes(head.format(form).encode() + body + struct.pack(f"{order}B3iB3i", 3, 0, 1, 2, 3, 2, 1, 0))
        assert [tuple(r)[1:] for r in reconstruction.read_ply_points(spark, str(path)).orderBy("idx").collect()] == [(i, float(i), -float(i), 0.5 * i, 10 * i, 2, 3) for i in range(3)]
        assert [tuple(r)[1:] for r in reconstruction.read_ply_faces(spark, str(path)).orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 2, 1, 0)]
        quad = tmp_path / f"{form[7:10]}4.ply"
        quad.write_bytes(head.format(form).replace("face 2", "face 1").encode() + body + struct.pack(f"{order}B4i", 4, 0, 1, 2, 0))
        assert [tuple(r)[1:] for r in reconstruction.read_ply_faces(spark, str(quad)).orderBy("fid").collect()] == [(0, 0, 1, 2), (1, 0, 2, 0)]
    assert reconstruction.read_ply_points(spark, str(tmp_path), ["x"]).count() == 12


def test_rasters_and_depth_arrays_in_ranges(spark, tmp_path):
    cells = spark.range(60).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), F.when(F.col("id") % 7 > 0, F.col("id") * 0.5).alias("value"))
    rasters.write_geotiff(cells, str(tmp_path / "a.tif"), 10, 6, 100.0, 50.0, 0.5, 32632)
    got = records.read_records(spark, str(tmp_path / "a.tif"), "raster", split=4 * 13)
    assert got.rdd.getNumPartitions() == 5
    assert sorted(((r.row, r.col, r.value) for r in got.collect()), key=str) == sorted(((r.row, r.col, r.value) for r in cells.collect()), key=str)
    r = got.where("row = 2 AND col = 3").first()
    assert (r.x, r.y) == (101.75, 48.75)
    files.write_depth_array(cells, str(tmp_path / "d.bin"), 10, 6, "value")
    assert sorted(r.depth for r in reconstruction.read_depth_arrays(spark, str(tmp_path / "d.bin")).collect()) == sorted((r.value or 0.0) for r in cells.collect())


def test_a_mesh_container(spark, tmp_path):
    import json

    v = spark.range(50).select((F.col("id") * 3 + 1).alias("vid"), *[(F.col("id") * k).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    f = spark.range(30).select(*[((F.col("id") + k) * 3 + 1).alias(f"v{k}") for k in range(3)])
    files.write_glb(v, f, str(tmp_path / "m.glb"))
    raw = (tmp_path / "m.glb").read_bytes()
    n = struct.unpack_from("<I", raw, 12)[0]
    doc, body = json.loads(raw[20 : 20 + n]), raw[28 + n :]
    assert len(raw) == struct.unpack_from("<I", raw, 8)[0] and doc["accessors"][0]["count"] == 50
    xyz = np.frombuffer(body[:600], "<f4").reshape(50, 3)
    assert (xyz[:, 0] == np.arange(50)).all() and (xyz[:, 2] == -2 * np.arange(50)).all()
    assert sorted(map(tuple, np.frombuffer(body[600:], "<u4").reshape(30, 3).tolist())) == [(i, i + 1, i + 2) for i in range(30)]


def test_rows_numbered_where_they_lie(spark):
    df = numbered_as_is(spark.range(0, 1000, 1, 6).where("id % 3 > 0").withColumnRenamed("id", "v"))
    assert sorted(r.i for r in df.collect()) == list(range(666))


# pixels


def brute_pyramid(v):
    """The same on an array, level by level."""
    known = ~np.isnan(v)
    levels = [(np.where(known, v, 0.0), known.astype(float))]
    while max(levels[-1][0].shape) > 1:
        x, w = levels[-1]
        h, k = -(-x.shape[0] // 2), -(-x.shape[1] // 2)
        s, n = np.zeros((h, k)), np.zeros((h, k))
        for i in range(x.shape[0]):
            for j in range(x.shape[1]):
                s[i // 2, j // 2] += x[i, j] * w[i, j]
                n[i // 2, j // 2] += w[i, j]
        levels.append((np.divide(s, n, out=np.zeros_like(s), where=n > 0), np.minimum(n, 1)))
    full = levels[-1][0]
    for x, w in reversed(levels[:-1]):
        out = x.copy()
        for i, j in np.argwhere(w < 1):
            got = [(a * b, full[p, q]) for p, a in ((i // 2, 0.75), (i // 2 + 2 * (i % 2) - 1, 0.25)) for q, b in ((j // 2, 0.75), (j // 2 + 2 * (j % 2) - 1, 0.25)) if 0 <= p < full.shape[0] and 0 <= q < full.shape[1]]
            out[i, j] = w[i, j] * x[i, j] + (1 - w[i, j]) * sum(a * f for a, f in got) / sum(a for a, _ in got)
        full = out
    return full


def test_holes_of_any_width(spark):
    rng = np.random.default_rng(3)
    v = np.add.outer(np.arange(45.0), 0.5 * np.arange(33.0)) + rng.normal(size=(45, 33))
    v[4:38, 6:31] = np.nan
    rows = [(i, j, None if np.isnan(v[i, j]) else float(v[i, j])) for i in range(45) for j in range(33)]
    with scratch(spark):
        got = {(r.row, r.col): r.value for r in pyramid.fill_pyramid(spark.createDataFrame(rows, "row int, col int, value double")).collect()}
    want = brute_pyramid(v)
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(45) for j in range(33)) and np.nanmin(v) <= min(got.values()) and max(got.values()) <= np.nanmax(v)
    assert np.abs(np.diff(want[4:38, 6:31], axis=0)).max() < 8  # no seams
    none = spark.createDataFrame([(0, 0, None), (3, 1, None)], "row int, col int, value double")
    assert [r.value for r in pyramid.fill_pyramid(none).collect()] == [None, None]
    assert pyramid.fill_pyramid(none.limit(0)).count() == 0


def test_smaller_images(spark):
    px = spark.range(12 * 8).select(F.lit("a").alias("image"), F.floor(F.col("id") / 8).alias("row"), (F.col("id") % 8).alias("col"), F.col("id").cast("double").alias("value"))
    sizes = spark.createDataFrame([("a", 12, 8)], "image string, height int, width int")
    got = {(r.row, r.col): r.value for r in pyramid.resize_area(px, sizes, 6).collect()}
    v = np.arange(96.0).reshape(12, 8)
    assert got == {(i, j): v[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].mean() for i in range(6) for j in range(4)}
    assert pyramid.resize_area(px, sizes, 50).count() == 96


def test_equalised_tiles(spark):
    rng = np.random.default_rng(9)
    v = np.clip(rng.normal(90, 9, (40, 24)), 0, 255).astype(int)
    px = spark.createDataFrame([("a", i, j, int(v[i, j])) for i in range(40) for j in range(24)], "image string, row int, col int, value int")
    sizes = spark.createDataFrame([("a", 40, 24)], "image string, height int, width int")
    got = np.zeros((40, 24))
    for r in contrast.equalise(px, sizes, 40.0, 2).collect():
        got[r.row, r.col] = r.value
    curves = {}
    for a in range(2):
        for b in range(2):
            n = np.bincount(v[20 * a : 20 * a + 20, 12 * b : 12 * b + 12].ravel(), minlength=256)
            limit = max(1, 240 * 40 // 256)
            over = np.maximum(n - limit, 0).sum()
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            for k in range(rest):
                n[k * max(256 // rest, 1)] += 1
            curves[a, b] = np.minimum(np.rint(np.cumsum(n) * 255.0 / 240), 255)
    for i in range(40):
        for j in range(24):
            fr, fc = i / 20 - 0.5, j / 12 - 0.5
            r0, c0 = int(np.floor(fr)), int(np.floor(fc))
            ar, ac = fr - r0, fc - c0
            on = lambda a, b: curves[min(max(a, 0), 1), min(max(b, 0), 1)][v[i, j]]  # noqa: B023, E731
            want = (on(r0, c0) * (1 - ac) + on(r0, c0 + 1) * ac) * (1 - ar) + (on(r0 + 1, c0) * (1 - ac) + on(r0 + 1, c0 + 1) * ac) * ar
            assert abs(got[i, j] - want) <= 0.5 + 1e-9
    assert got.std() > 2 * v.std()


def test_lightness_and_back(spark):
    df = spark.createDataFrame([(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)], "r int, g int, b int")
    lab = df.select("*", *[c.alias(n) for c, n in zip(rgb_to_lab("r", "g", "b"), ("l", "A", "B_"))])
    back = lab.select("r", "g", "b", "l", *[c.alias(n) for c, n in zip(lab_to_rgb("l", "A", "B_"), ("r1", "g1", "b1"))]).collect()
    assert all(abs(x.r - x.r1) <= 1 and abs(x.g - x.g1) <= 1 and abs(x.b - x.b1) <= 1 for x in back)
    assert max(x.l for x in back) == pytest.approx(100, abs=0.01) and min(x.l for x in back) == pytest.approx(0, abs=1e-9)
    px = df.select(F.lit("a").alias("image"), F.monotonically_increasing_id().alias("id"), "r", "g", "b").withColumns({"row": F.floor(F.col("id") / 18), "col": F.col("id") % 18})
    assert contrast.enhanced(px, spark.createDataFrame([("a", 12, 18)], "image string, height int, width int")).columns == ["image", "row", "col", "r", "g", "b"]
