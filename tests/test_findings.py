"""Cases that a review found: ties, crowded places, tables whose rows are made by generators."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from aeroframe.plans.queries import ORACLES, QUERIES


@pytest.fixture
def tables(tmp_path):
    """Writes tables by SQL into a folder; gives it with a connection that sees them."""

    def write(**texts):
        con = duckdb.connect()
        for name, text in texts.items():
            con.sql(f"COPY ({text}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return write


def both(spark, name, where, con):
    """Rows of a query and of its SQL twin, in one order of columns."""
    df = QUERIES[name](spark, where)
    cols = ", ".join(df.columns)
    return sorted(map(tuple, df.collect()), key=repr), sorted(con.sql(f"SELECT {cols} FROM ({ORACLES[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["angle_unwrap", "interp_angle"])
def test_steps_of_half_a_turn(spark, tables, name):
    """A step of exactly half a turn up goes down instead, as in the twin; so do the values after it."""
    at = datetime.datetime(2024, 1, 1)
    values = [0.0, 180 / 37, 0.0, 180 / 37, 90 / 37, 0.0]
    rows = [f"({2 * i}, TIMESTAMP '{at + datetime.timedelta(seconds=10 * i)}', 7, 'click', {v!r}::double)" for i, v in enumerate(values)]
    rows += [f"({2 * i + 1}, TIMESTAMP '{at + datetime.timedelta(seconds=10 * i + 4)}', 7, 'view', {v!r}::double)" for i, v in enumerate(values)]
    where, con = tables(events=f"SELECT * FROM (VALUES {', '.join(rows)}) t(event_id, ts, user_id, event_type, value)")
    got, expected = both(spark, name, where, con)
    assert got == expected


@pytest.mark.parametrize("name", ["disk_dilate", "grid_components", "pyramid_fill", "tile_equalise", "image_resize", "mesh_decimation"])
def test_generated_rows_are_not_broadcast(spark, name, tmp_path):
    """Rows that generators make are estimated too small; with no row count in sight a broadcast of them grows with the table."""
    spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(3).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 2000").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_dense_clouds_are_searched_in_small_cells(spark):
    """Work follows the points, not their density; the neighbours are those of all pairs."""
    import numpy as np

    from aeroframe.operators import cloud

    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.uniform(0, 20, (1500, 3)), rng.uniform(0, 200, (20, 3)), np.zeros((3, 3))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id long, x double, y double, z double")
    assert cloud.fitting_cell(df, 200.0, "xyz", 24) < 20
    d = np.sqrt(((xyz[:, None] - xyz) ** 2).sum(axis=2))
    expected = {(i, r + 1): int(j) for i, row in enumerate(d) for r, j in enumerate(np.lexsort((np.arange(len(row)), row))[:5])}
    assert {(r["id"], r["rank"]): r["nid"] for r in cloud.nearest_neighbours(df, 5, 200.0).collect()} == expected


def test_pairs_of_frames_are_dealt(spark, tmp_path):
    """Few bytes make much work: pairs of frames stay dealt to all tasks; patches, over borders too, are sampled as place by place."""
    import numpy as np

    from aeroframe.operators import tracking

    plan = QUERIES["frame_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert any("__pair" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())
    rng = np.random.default_rng(3)
    image = rng.integers(0, 255, (40, 50)).astype(np.float32)
    x, y = rng.uniform(-9, 45, (30, 1)) + np.arange(21), rng.uniform(-9, 35, (30, 1)) + np.arange(21)
    expected = tracking.sample(image, np.broadcast_to(x[:, None, :], (30, 21, 21)), np.broadcast_to(y[:, :, None], (30, 21, 21)))
    assert (tracking.patches(image, x, y) == expected.reshape(30, -1)).all()


def test_points_and_cameras_are_never_paired_as_rows(spark, monkeypatch):
    """Blocks of points meet depth tiles, several of them an image; counts and best views are those of all pairs, masks and sky included."""
    import numpy as np

    from aeroframe.operators import visibility

    monkeypatch.setattr(visibility, "GROUP_POINTS", 60)
    monkeypatch.setattr(visibility, "GROUP_TILES", 9)
    rng = np.random.default_rng(2)
    n, side = 200, 70
    xyz = np.column_stack([rng.uniform(0, 40, (n, 2)), rng.uniform(0, 5, n)])
    pts = spark.createDataFrame([(i, *map(float, p), 0.0, 0.0, 1.0, i % 2 == 0) for i, p in enumerate(xyz)], "id long, x double, y double, z double, nx double, ny double, nz double, roof boolean")
    cams, maps, rgb, hidden, views, best = [], [], [], [], np.zeros(n, int), {}
    for k in range(6):
        turn, tilt, at = rng.uniform(0, 6), rng.uniform(-0.3, 0.3), [*rng.uniform(5, 35, 2), 30.0]
        r = np.array([[1, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]]) @ [[np.cos(turn), np.sin(turn), 0], [np.sin(turn), -np.cos(turn), 0], [0, 0, -1]]
        t = -r @ at
        cams.append((f"c{k}", k, *map(float, at), 60.0, 62.0, 35.0, 34.0, side, side - 9, r.ravel().tolist(), t.tolist()))
        d, sky, gone = rng.choice([0.0, 27.0, 29.0, 33.0], (side, side)), rng.random((side, side)) < 0.3, rng.random((side, side)) < 0.1
        maps += [(f"c{k}", i, j, float(d[i, j])) for i in range(side) for j in range(side)]
        rgb += [(f"c{k}", i, j, 100, 100, 200 if sky[i, j] else 50) for i in range(side) for j in range(side)]
        hidden += [(f"c{k}", int(i), int(j), True) for i, j in zip(*np.nonzero(gone))]
        for i, p in enumerate(xyz):
            x, y, z = r @ p + t
            col, row = int(np.rint(60 * x / z + 35 - 0.5)), int(np.rint(62 * y / z + 34 - 0.5))
            if z <= 0 or not (0 <= col < side and 0 <= row < side - 9) or d[row, col] <= 0:
                continue
            views[i] += abs(d[row, col] - z) <= max(0.3, 0.03 * z)
            ray = at - p
            dist = np.sqrt((ray**2).sum())
            if d[row, col] >= z - max(0.8, 0.05 * z) and ray[2] / dist >= 0.12 and not gone[row, col] and not (i % 2 == 0 and sky[row, col]):
                best[i] = max(best.get(i, (-1.0,)), (round(ray[2] / dist * 60 / dist, 9), -k, row, col))
    c = spark.createDataFrame(cams, "image string, cam_order long, cam_x double, cam_y double, cam_z double, fx double, fy double, cx double, cy double, width int, height int, r_cw array<double>, t_cw array<double>")
    pixel = "image string, row int, col int, "
    depth, colours, masks = (spark.createDataFrame(rows, pixel + more) for rows, more in ((maps, "z double"), (rgb, "r int, g int, b int"), (hidden, "dynamic boolean")))
    found = visibility.view_counts(pts, c, depth)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["views"] for r in found.collect()} == dict(enumerate(views.tolist()))
    got = visibility.texel_views(pts, c, depth, "id", colours, masks).collect()
    assert {r["id"]: (round(r["score"], 9), -int(r["image"][1:]), r["prow"], r["pcol"]) for r in got} == best


def test_percentiles_of_large_groups_are_sorted_not_held(spark):
    """Percentiles by key are Spark's own, and no aggregate of cloud_metrics holds the values of a group."""
    from aeroframe.operators.quantiles import grouped_percentiles

    df = spark.range(2000).selectExpr("id % 3 AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE (id * 7919 % 501) / 3D END AS v").union(spark.sql("SELECT 9L, 4D"))
    shares = {"a": 0.0, "b": 0.15, "c": 0.5, "d": 0.98, "e": 1.0}
    expected = df.groupBy("k").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()])
    assert sorted(map(tuple, grouped_percentiles(df, "k", "v", shares).collect())) == sorted(map(tuple, expected.collect()))
    plan = QUERIES["cloud_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan


def test_covered_faces_are_found_by_boxes(spark):
    """Faces are not multiplied by cameras; what is covered is what all pairs say, for faces of any direction and length of normal."""
    import numpy as np

    from aeroframe.operators import visibility

    rng = np.random.default_rng(6)
    xyz, normal = np.column_stack([rng.uniform(0, 90, (600, 2)), rng.uniform(0, 9, 600)]), rng.normal(0, 0.4, (600, 3)) + [0, 0, 1]
    cams = np.column_stack([rng.uniform(0, 90, (150, 2)), rng.uniform(20, 60, 150)])
    normal[:300] = [0, 0, 1]
    faces = spark.createDataFrame([(i, *map(float, [*p, *n])) for i, (p, n) in enumerate(zip(xyz, normal))] + [(600, None, 1.0, 1.0, 0.0, 0.0, 1.0)], "fid long, x double, y double, z double, nx double, ny double, nz double")
    table = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cams)], "cam_order long, cam_x double, cam_y double, cam_z double")
    for angle, every in ((6.0, 1), (40.0, 50)):
        found = visibility.face_coverage(faces, table, angle, every)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        ray = cams[None, ::every] - xyz[:, None]
        expected = ((ray * normal[:, None]).sum(axis=2) / np.sqrt((ray**2).sum(axis=2)) > np.cos(np.radians(angle))).any(axis=1)
        assert 0 < expected.sum() < 600
        assert {r["fid"]: r["covered"] for r in found.collect()} == dict(enumerate([*expected.tolist(), False]))


def test_steps_of_rays_are_not_shuffled(spark):
    """A ray's voxels are told apart in its row: the only shuffle is the sum by voxel."""
    from aeroframe.operators import depth

    s = spark.range(50).selectExpr("id % 7 * 1D AS x", "id % 5 * 1D AS y", "id % 3 * 0.4D AS z", "3D AS cam_x", "2D AS cam_y", "40D AS cam_z", "2D AS w", *[f"id * 1D AS {c}" for c in "rgb"])
    df = depth.integrate(s, 1.0, 3.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "__ray" not in plan
    assert df.count() > 0


def test_small_tiles_are_meshed_together(spark, monkeypatch):
    """Tiles cost no group each; where a batch ends inside a tile, the tile waits for its rest, and the surface is the same."""
    from aeroframe.operators import surface

    text = "SELECT id div 343 AS obj, id div 49 % 7 - 3 AS vx, id div 7 % 7 - 3 AS vy, id % 7 - 3 AS vz FROM range(1029)"
    ball = spark.sql(f"SELECT *, sqrt(vx*vx + vy*vy + vz*vz) - 2.3D - obj * 0.1D AS tsdf, 2D AS weight, vx * 1D AS r, 0D AS g, 0D AS b FROM ({text})")
    found = []
    for voxels, tile in ((50_000, 16), (70, 2)):
        monkeypatch.setattr(surface, "VOXELS", voxels)
        found.append([sorted(map(tuple, df.collect())) for df in surface.surface_mesh(ball, 0.5, keys=("obj",), tile=tile)])
    assert found[0] == found[1] and len(found[0][0]) > 100
    calls = []
    monkeypatch.setattr(surface, "materialise", lambda df: calls.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    surface.surface_mesh(ball, 0.5, keys=("obj",))
    assert "MapInArrow" in calls[0] and "FlatMapGroups" not in calls[0]


def test_small_images_are_aggregated_where_they_are_matched(spark, monkeypatch):
    """Costs of small images are not rows; images above VOLUME go to bands and come to the same, beside small ones too."""
    import numpy as np

    from aeroframe.operators import stereo

    rng, eye = np.random.default_rng(4), np.eye(3).ravel().tolist()
    frames = [(f"{k}{n}", 9 + k % 2, 12, bytearray(rng.integers(0, 255, (9 + k % 2) * 12).astype(np.uint8).tobytes()), 20.0, 20.0, 6.0, 5.0, eye, [-s, 0.0, 0.0]) for k in range(4) for n, s in (("a", 0.0), ("b", 1.0), ("c", 2.0))]
    frames = spark.createDataFrame(frames, "image string, height int, width int, pixels binary, fx double, fy double, cx double, cy double, r_cw array<double>, t_cw array<double>")
    pairs = spark.createDataFrame([(f"{k}a", f"{k}{n}") for k in range(4) for n in "bc"] + [("3c", "gone"), ("gone", "3a")], "image string, other string")
    found = []
    for volume, batch in ((1 << 24, 1 << 20), (9 * 12 * 8, 1), (0, 1)):
        monkeypatch.setattr(stereo, "VOLUME", volume)
        monkeypatch.setattr(stereo, "BATCH", batch)
        df = stereo.dense_depth(frames, pairs, 7.0, 14.0, 8, step=3.0, jump=20.0)
        if volume == 1 << 24:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "costs" not in plan
        found.append({(r["image"], r["row"], r["col"]): (r["z"], r["cost"]) for r in df.collect()})
    assert len(found[0]) == 12 * (9 + 10 + 9 + 10)
    for other in found[1:]:
        assert other.keys() == found[0].keys() and all(np.allclose(other[k], v, rtol=1e-5) for k, v in found[0].items())


def test_small_grids_are_filtered_as_groups(spark, monkeypatch):
    """Ground and terrain of small grids take no windows; grids above GRID_CELLS or with a NaN go the long way and come to the same, holes, gaps and grids without a value included."""
    from aeroframe.operators import raster

    cells = spark.range(4 * 26 * 31).selectExpr("id div 806 AS g", "id div 31 % 26 - 3 AS row", "id % 31 + 5 AS col", "CASE WHEN id div 806 = 2 OR (id * 7919) % 11 < 4 THEN NULL ELSE (id * 31 % 97) / 20D + CASE WHEN id % 31 BETWEEN 8 AND 14 AND id div 31 % 26 BETWEEN 5 AND 11 THEN 9D ELSE 0D END END AS value")
    cells = cells.unionByName(spark.sql("SELECT 9L AS g, 0L AS row, 0L AS col, 2D AS value UNION ALL SELECT 9L, 0L, 1L, double('NaN')"))
    found = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(raster, "GRID_CELLS", most)
        calls, box = [], raster.opening
        monkeypatch.setattr(raster, "opening", lambda *a: calls.append(a) or box(*a))
        ground = raster.ground_filter(cells.where("g < 4") if most else cells, 1.0, 9.0, keys=["g"])
        assert bool(calls) == (most == 0)
        dtm = raster.terrain(ground, 1.0, keys=["g"])
        found.append([{(r["g"], r["row"], r["col"]): r[c] for r in df.where("g < 4").collect()} for df, c in ((ground, "ground"), (dtm, "dtm"))])
        monkeypatch.setattr(raster, "opening", box)
    assert found[0] == found[1] and len(found[0][0]) == 4 * 806 and 0 < sum(found[0][0].values()) < 3000
    monkeypatch.setattr(raster, "GRID_CELLS", 1 << 20)
    mixed = raster.ground_filter(cells, 1.0, 9.0, keys=["g"])
    assert {(r["g"], r["row"], r["col"]): r["ground"] for r in mixed.where("g < 4").collect()} == found[0][0] and mixed.where("g = 9").count() == 2
    one = cells.where("g = 1").drop("g")
    assert {(1, r["row"], r["col"]): r["ground"] for r in raster.ground_filter(one, 1.0, 9.0).collect()} == {k: v for k, v in found[0][0].items() if k[0] == 1}


def test_faces_are_tied_by_hubs_of_edges(spark, monkeypatch):
    """Rounds see the hubs of shared edges, not the faces on them; components are those of all pairs, for ids that repeat or are null and for edges without length too."""
    import random

    from aeroframe.operators import components

    seen, rounds = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges, *more: seen.append(edges.distinct().count()) or rounds(edges, *more))
    fan = spark.range(3000).selectExpr("id AS fid", "id + 10 AS v0", "1L AS v1", "2L AS v2")
    assert components.face_components(fan).select("component").distinct().collect() == [(0,)] and seen == [0]
    rng = random.Random(8)
    rows = [(rng.randrange(160), *[rng.randrange(40) for _ in "abc"]) for _ in range(180)] + [(None, 1, 2, 3), (None, 2, 3, 4), (500, 9000, 9001, 9002), (501, 9100, 9100, 9100), (502, 9100, 9100, 9100)]
    top = {f: f for f, *_ in rows if f is not None}

    def root(f):
        return f if top[f] == f else root(top[f])

    edges = {}
    for f, a, b, c in rows:
        for e in ((a, b), (b, c), (c, a)):
            if f is not None:
                edges.setdefault(tuple(sorted(e)), set()).add(f)
    for group in edges.values():
        for f in group:
            x, y = root(f), root(min(group))
            top[max(x, y)] = min(x, y)
    sharing = {f for group in edges.values() if len(group) > 1 for f in group}
    faces = spark.createDataFrame(rows, "fid long, v0 long, v1 long, v2 long")
    expected = {(f, root(f)) for f in top}
    assert len({c for _, c in expected}) > 5 and 500 not in sharing and 502 in sharing
    for most in (components.HUBS, 0):
        monkeypatch.setattr(components, "HUBS", most)
        assert sorted(map(tuple, components.face_components(faces, alone=False).collect())) == sorted(p for p in expected if p[0] in sharing)
        assert sorted(map(tuple, components.face_components(faces).where("fid IS NOT NULL").collect())) == sorted(expected)


def test_pixels_meet_neighbours_by_tiles(spark):
    """Pixels and their neighbours' pixels are joined as tiles, not as rows; what is found is what each pixel by itself finds, over tiles' borders, from behind, for gaps, repeats and depths that are no numbers."""
    import math

    import numpy as np

    from aeroframe.operators import visibility

    rng, cams, maps = np.random.default_rng(12), [], []
    turned = lambda a, b: np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]]) @ [[math.cos(b), math.sin(b), 0], [math.sin(b), -math.cos(b), 0], [0, 0, -1]]
    for k, (a, b) in enumerate([(0.1, 0.3), (-0.2, 0.5), (1.3, 0.2), (3.0, 0.0), (0.0, 0.4)]):
        r, at = turned(a, b), rng.uniform(0, 8, 3) + [0, 0, 30]
        cams.append((f"c{k}", *map(float, at), 60.0, 62.0, 35.0, 22.0, 70, 45, r.ravel().tolist(), (-r @ at).tolist()))
        for i in range(45):
            for j in range(70):
                z = float(rng.uniform(20, 40))
                maps += [(f"c{k}", i, j, {3: None, 4: math.nan, 5: 0.0, 6: -1.0, 7: math.inf}.get(int(rng.integers(0, 60)), z))] * (0 if rng.random() < 0.1 else 1)
    maps += [("c1", 20, 30, 33.0), ("c1", 20, 30, 34.0), ("c0", 20, 30, 33.0), ("c0", None, 3, 30.0), (None, 3, 3, 30.0)]
    pairs = [(f"c{a}", f"c{b}") for a in range(5) for b in range(5) if a != b] + [("c0", "gone"), ("gone", "c0")]
    by, expected = {}, []
    for image, i, j, z in maps:
        by.setdefault((image, i, j), []).append(z)
    cam = {c[0]: c for c in cams}
    for image, i, j, z in maps:
        if z is None or not 0 < z < math.inf or image is None or i is None:
            continue
        for a, b in pairs:
            if a == image and b in cam:
                p, q = cam[a], cam[b]
                c = ((j + 0.5 - p[6]) / p[4] * z, (i + 0.5 - p[7]) / p[5] * z, z)
                w = [p[10][n] * c[0] + p[10][3 + n] * c[1] + p[10][6 + n] * c[2] + p[1 + n] for n in range(3)]
                x, y, zj = (q[10][3 * n] * w[0] + q[10][3 * n + 1] * w[1] + q[10][3 * n + 2] * w[2] + q[11][n] for n in range(3))
                if zj > 0:
                    place = (b, round(q[5] * y / zj + q[7] - 0.5), round(q[4] * x / zj + q[6] - 0.5))
                    expected += [(image, i, j, b, zj, dj) for dj in by.get(place, [])]
    table = spark.createDataFrame(cams, "image string, cam_x double, cam_y double, cam_z double, fx double, fy double, cx double, cy double, width int, height int, r_cw array<double>, t_cw array<double>")
    depth = spark.createDataFrame(maps, "image string, row int, col int, z double")
    found = visibility.reproject(depth, table, spark.createDataFrame(pairs, "image string, neighbour string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "prow" not in plan
    assert found.schema.simpleString() == "struct<image:string,row:int,col:int,neighbour:string,zj:double,dj:double>"
    got = list(map(tuple, found.collect()))
    assert len(got) > 3000 and {r[3] for r in got} >= {"c0", "c1", "c4"} and sum(r[5] is None for r in got) > 5
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_frames_are_never_broadcast(spark):
    """Frames look small where few bytes make them; none goes to the driver, and steps over the ends of groups are those of each pair."""
    import numpy as np

    from aeroframe.operators import tracking

    plan = QUERIES["frame_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    rng, rows = np.random.default_rng(1), []
    wide = np.kron(rng.integers(0, 250, (20, 40)), np.ones((5, 5)))
    for i in range(2 * tracking.BLOCK + 1):
        h = 60 if i != 5 else 64
        rows.append((1, i, float(i), h, 90, bytearray(wide[:h, 3 * i : 3 * i + 90].astype(np.uint8).tobytes())))
    df = spark.createDataFrame(rows, "clip long, frame_index long, t double, height int, width int, pixels binary")
    got = {r["frame_index"]: (r["step_px"], r["ratio"], r["tracks"]) for r in tracking.frame_steps(df).collect()}
    images = [np.frombuffer(r[5], np.uint8).reshape(r[3], r[4]) for r in rows]
    assert got.pop(0) == (None, 0.0, 0) and len(got) == 2 * tracking.BLOCK
    for i, found in got.items():
        expected = tracking.pair_step(images[i - 1], images[i])
        assert np.allclose(found, expected, atol=1e-4) and abs(found[0] - 3) < 0.1


def test_colours_of_dense_surfaces_come_from_small_cells(spark, monkeypatch):
    """Pairs follow the points, not the surface's density; colours are those of all pairs, ties, copies and lone points included."""
    import numpy as np

    from aeroframe.operators import mesh

    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.integers(0, 12, (900, 3)) / 4, rng.uniform(0, 60, (40, 3))])
    rgb, near = rng.integers(0, 6, (len(xyz), 3)), np.concatenate([rng.integers(0, 12, (300, 3)) / 4, rng.uniform(0, 60, (60, 3))])
    surface = spark.createDataFrame([(*map(float, p), *map(int, c)) for p, c in zip(xyz, rgb)], "x double, y double, z double, r int, g int, b int")
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(near)] + [(len(near), None, 1.0, 1.0)], "id long, x double, y double, z double")
    joined, join = [], mesh.sorted_join
    monkeypatch.setattr(mesh, "sorted_join", lambda a, b, on, *how: joined.append(join(a, b, on, *how)) or joined[-1])
    got = {r["id"]: (r["seen"], r["r"], r["g"], r["b"]) for r in mesh.nearest_colours(points, surface, 4.0).collect()}
    assert len(got) == len(near) + 1
    pairs = sum(df.count() for df in joined if "cx" in df.columns)
    assert pairs < len(near) * len(xyz) / 4
    best = {}
    for i, p in enumerate(near):
        d = np.sqrt(((p - xyz) ** 2).sum(axis=1))
        if d.min() <= 4:
            best[i] = min(tuple(map(int, c)) for c in rgb[d == d.min()])
    mid = np.median(list(best.values()), axis=0)
    for i, (seen, *colour) in got.items():
        assert seen == (i in best) and np.allclose(colour, best.get(i, 0.6 * mid + 0.4 * np.array([170, 165, 158])))
    assert 0 < len(best) < len(near)


def test_subtitles_are_read_by_pieces(spark, tmp_path):
    """No row holds a file; blocks cut by the ends of pieces, tags over lines, open brackets, blank pieces and odd bytes come out as from the whole text."""
    import random

    from aeroframe.sources import telemetry

    rng = random.Random(4)
    words = ["a", "GPS(8.1,47.2,3)", "[latitude: 47.1]", "<b>", "</font>", "<>", "x > y", "00:00:01,000 --> 00:00:02,000", "é", "H 5m"]
    for n in range(6):
        lines = []
        for _ in range(rng.randrange(1, 90)):
            lines.append("" if rng.random() < 0.4 else rng.choice(["", " ", "\t"]) + " ".join(rng.choices(words + ["<i", "<", "b>"] * (n % 3 == 1), k=rng.randrange(0, 4))))
        text = ("\r\n" if n % 2 else "\n").join(lines * (1 + n)) + rng.choice(["", "\n", "\n\n"])
        (tmp_path / f"{n}.srt").write_bytes(text.encode() + (b"\xff\xc3 1\n\nend <open\n\n2" if n > 2 else b""))
    (tmp_path / "empty.srt").write_bytes(b"")
    (tmp_path / "blank.srt").write_bytes(b"one\ntwo\n" + b" \n" * 300 + b"three\nfour" + b"\n" * 200 + b"five")
    (tmp_path / "solid.srt").write_bytes(b"word\n" * 300)
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.posexplode(telemetry.blocks(telemetry.strip_tags(F.col("value")))).alias("seq", "block"))
    expected = sorted((r["source"], r["seq"], r["block"].strip()) for r in whole.collect() if r["block"].strip())
    assert len(expected) > 60
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in ("128m", "97b", "500b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            found = telemetry.file_blocks(spark, str(tmp_path))
            assert sorted((r["source"], r["seq"], r["block"].strip()) for r in found.collect()) == expected
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 9 or most == "128m"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_clouds_are_not_sorted_by_key(spark, monkeypatch):
    """Points of a few large clouds stay where they are read; the measures are those of joins that sort them."""
    from aeroframe.operators import buildings, joins

    text = "SELECT id % 3 AS site, id * 37 % 101 / 7D AS x, id * 53 % 97 / 5D AS y, id * 29 % 211 / 9D AS z, 0 AS r, 0 AS g, 0 AS b FROM range(4000)"
    found = []
    for most in (joins.FEW_ROWS, 0):
        monkeypatch.setattr(joins, "FEW_ROWS", most)
        df = buildings.cloud_metrics(spark.sql(text), "site")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (most == 0)
        found.append(sorted(df.collect()))
    assert len(found[0]) == 3 and all(abs(x - y) < 1e-9 for a, b in zip(*found) for x, y in zip(a, b))


def test_boxes_of_points_meet_only_depths_in_reach():
    """Of the pairs of points and tiles few are projected; what agrees is what all pairs say, odd depths and points included, and best tiles are found from the best on."""
    import numpy as np
    import pyarrow as pa

    from aeroframe.operators import visibility

    rng = np.random.default_rng(11)
    n, side, tile = 30_000, 24, visibility.TILE
    xyz = np.column_stack([rng.uniform(0, 20, (n, 2)), rng.uniform(0, 20, n)])
    xyz[5], xyz[6] = np.nan, [1, np.nan, 2]
    rows = []
    for k in range(60):
        tilt, at = rng.uniform(-0.2, 0.2) if k % 3 else 0.0, np.array([*rng.uniform(0, 20, 2), 60.0 if k else 10.0])
        r = np.array([[1, 0, 0], [0, np.cos(tilt), -np.sin(tilt)], [0, np.sin(tilt), np.cos(tilt)]]) @ [[1, 0, 0], [0, -1, 0], [0, 0, -1]]
        places = np.sort(rng.choice(side * tile, 300, replace=False))
        places = places[places % tile < side]
        depths = rng.choice([31.0, 38.0, 45.0, 52.0, 59.5, 66.0, 73.0, 80.0, *([np.inf] if k == 7 else [])], len(places)) if k != 9 else np.full(len(places), 50.0)
        rows.append({"r_cw": r.ravel().tolist(), "t_cw": (-r @ at).tolist(), "fx": 20.0, "fy": 21.0, "cx": 12.0, "cy": 11.0, "far": float(depths.max() * 1.2), "tc": 0, "tr": 0, "width": side, "height": side, "places": places.tolist(), "depths": depths.tolist()})
    tiles, pts = pa.Table.from_pylist(rows), pa.table({c: xyz[:, i] for i, c in enumerate("xyz")})
    agrees, clear = (lambda d, z: np.abs(d - z) <= np.maximum(0.3, 0.03 * z)), (lambda d, z: d >= z - np.maximum(0.8, 0.05 * z))
    all_hits = []
    for test in (agrees, clear):
        hit = np.zeros((len(rows), n), bool)
        for i, t in enumerate(rows):
            grid = np.full(tile * tile, np.nan)
            grid[t["places"]] = t["depths"]
            x, y, z = np.array(t["r_cw"]).reshape(3, 3) @ xyz.T + np.array(t["t_cw"])[:, None]
            with np.errstate(invalid="ignore", divide="ignore"):
                col, row = np.rint(20 * x / z + 12 - 0.5), np.rint(21 * y / z + 11 - 0.5)
                ok = (z > 0) & (z <= t["far"]) & (col >= 0) & (col < side) & (row >= 0) & (row < side)
                hit[i, ok] = test(grid[(row * tile + col)[ok].astype(int)], z[ok])
        all_hits.append(hit)
    looked, got = [0], np.zeros((len(rows), n), bool)

    def hits(k, g, hit, place):
        got[np.ix_(g, k)] = hit
        looked[0] += hit.size

    def reach(near, away):
        slack = np.maximum(0.3, 0.03 * away)
        return near - slack, away + slack

    visibility._meet(pts, tiles, agrees, reach, hits)
    assert (got == all_hits[0]).all() and got.sum() > 1000 and looked[0] < 0.5 * got.size
    got[:], looked[0] = False, 0
    open_ended = lambda near, away: (near - np.maximum(0.8, 0.05 * near), np.full_like(away, np.inf))
    visibility._meet(pts, tiles, clear, open_ended, hits)
    assert (got == all_hits[1]).all() and got.sum() > 10000
    seen = []
    visibility._meet(pts, tiles, clear, open_ended, lambda k, g, hit, place: seen.append(len(g)), lambda k, low, high, g: (g[::-1], lambda at: at == 0))
    assert sum(seen) < 40 * len(seen)
