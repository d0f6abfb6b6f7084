"""Results that SQL has no form for, against small independent computations."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import buildings, cloud, depth, joins, kernels, quantiles
from aeroframe.plans.queries import QUERIES
from aeroframe.session import scratch, shared_dir, ship

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def spots():
    p = np.array(pq.read_table(f"{DATA}/part.parquet")["p_partkey"].to_pylist())
    return p, np.column_stack([p * 37 % 1000 / 10, p * 53 % 997 / 10, p * 29 % 211 / 10])


def jarvis(xy):
    """Corners of the hull by wrapping."""
    at = start = min(range(len(xy)), key=lambda i: tuple(xy[i]))
    out = []
    while True:
        out.append(at)
        nxt = (at + 1) % len(xy)
        for j in range(len(xy)):
            turn = (xy[nxt] - xy[at])[0] * (xy[j] - xy[at])[1] - (xy[nxt] - xy[at])[1] * (xy[j] - xy[at])[0]
            if turn < 0 or (turn == 0 and np.linalg.norm(xy[j] - xy[at]) > np.linalg.norm(xy[nxt] - xy[at])):
                nxt = j
        at = nxt
        if at == start:
            return xy[out]


def test_shape_features_and_classes(spark):
    ids, x = spots()
    d = np.linalg.norm(x[:, None] - x, axis=2)
    near = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)
    shape = {}
    for k, name in ((6, "shape_features"), (8, "classify_cloud")):
        for i, n in enumerate(near[:, :k]):
            val, vec = np.linalg.eigh(np.cov(x[n].T))
            lam = np.maximum(val[::-1], 1e-6)
            shape[name, ids[i]] = (lam[1] - lam[2]) / lam[0], lam[2] / lam[0], abs(vec[2, 0])
    for r in QUERIES["shape_features"](spark, DATA).collect():
        assert np.allclose((r.planarity, r.scattering, r.normal_z), shape["shape_features", r.id], atol=1e-6)
    low = {}
    for p in x:
        c = tuple(np.floor(p[:2] / 10))
        low[c] = min(low.get(c, np.inf), p[2])
    got = QUERIES["classify_cloud"](spark, DATA).collect()
    at = {i: p for i, p in zip(ids, x)}
    for r in got:
        hag = at[r.id][2] - low[tuple(np.floor(at[r.id][:2] / 10))]
        flat, spread, nz = shape["classify_cloud", r.id]
        want = (11 if flat > 0.65 and nz > 0.75 else 2) if hag < 1.2 else (6 if flat > 0.55 and nz > 0.6 else 5) if hag >= 3.5 else 5 if spread > 0.25 else 6
        assert abs(r.hag - hag) < 1e-9 and r["class"] == want
    assert len(got) == len(ids)


def test_cloud_measures(spark):
    t = pq.read_table(f"{DATA}/lineitem.parquet").to_pandas()
    x, y, z = (t.l_partkey * 37 + t.l_linenumber * 11) % 1000 / 10, (t.l_orderkey * 53 + t.l_suppkey * 17) % 1000 / 10, t.l_extendedprice / 5000
    for r in QUERIES["cloud_metrics"](spark, DATA).collect():
        m = (t.l_suppkey % 10 == r.site).to_numpy()
        p = np.column_stack([x, y, z])[m].astype(float)
        datum, z70 = np.percentile(p[:, 2], [15, 70])
        high = p[:, 2] - datum > 3.5
        p = p[high] if high.sum() >= 10 else p[p[:, 2] > z70]
        lo, hi = np.percentile(p[:, :2], [2, 98], axis=0)
        inside = ((p[:, :2] >= lo) & (p[:, :2] <= hi)).all(axis=1)
        p = p[inside] if inside.sum() >= 10 else p
        h = jarvis(p[:, :2])
        area = abs((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum()) / 2
        assert r.n_points == len(p) and np.isclose(r.footprint_area, area) and np.isclose(r.perimeter, np.linalg.norm(np.roll(h, -1, 0) - h, axis=1).sum())
        rel = p[:, 2] - datum
        assert np.allclose((r.peak_height, r.mean_height, r.eave_height, r.volume), (rel.max(), rel.mean(), np.percentile(rel, 30), area * rel.mean()))


def test_similarity_of_every_group(spark):
    t = pq.read_table(f"{DATA}/lineitem.parquet").to_pandas()
    x = np.column_stack([t.l_quantity, t.l_discount * 100, t.l_tax * 100]).astype(float)
    y = np.column_stack([t.l_extendedprice / 1000, t.l_quantity * 2 + t.l_tax, t.l_linenumber]).astype(float)
    got = QUERIES["similarities"](spark, DATA).collect()
    assert {r.grp for r in got} == set(t.l_suppkey % 20)
    for r in got:
        m = (t.l_suppkey % 20 == r.grp).to_numpy()
        a, b = x[m] - x[m].mean(0), y[m] - y[m].mean(0)
        rot, s = np.array(r.rotation).reshape(3, 3), r.scale
        assert np.allclose(rot @ rot.T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.det(rot), 1)
        # Least squares: no small turn or stretch does better.
        cost = lambda q, k: ((b - k * a @ q.T) ** 2).sum()
        for turn in np.eye(3):
            for eps in (1e-3, -1e-3):
                assert cost(rot, s) <= cost(kernels.rotation_matrix(eps * turn) @ rot, s) + 1e-6
        assert cost(rot, s) <= min(cost(rot, s * 1.001), cost(rot, s * 0.999)) + 1e-6
        assert np.allclose(r.translation, y[m].mean(0) - s * rot @ x[m].mean(0))


def test_consensus_fits(spark):
    r = QUERIES["plane_fit"](spark, DATA).first()
    ids, x = spots()
    z = np.where(ids % 4 > 0, 0.1 * x[:, 0] + 0.2 * x[:, 1] + x[:, 2] / 100, x[:, 2] * 3)
    n = np.array([r.nx, r.ny, r.nz])
    want = np.array([-0.1, -0.2, 1.0]) / np.linalg.norm([0.1, 0.2, 1.0])
    assert abs(abs(n @ want) - 1) < 1e-4
    off = np.abs(np.column_stack([x[:, :2], z]) @ n + r.d)
    assert (off < 0.5).sum() >= (ids % 4 > 0).sum() and abs(r.inliers - (off < 0.5).sum()) <= 0.02 * len(ids)
    r = QUERIES["affine_fit"](spark, DATA).first()
    assert r["mode"] == "disparity" and np.allclose((r.a, r.b), (1 / 37, -0.12 / 37), rtol=1e-6)
    assert r.anchors == len(ids) and r.inliers >= len(ids) * 0.95 - 1


def test_roofs_of_known_kinds(spark):
    got = QUERIES["roof_models"](spark, DATA).collect()
    want = {0: ("gable_u", {"zr": 9.0, "s": 0.4, "v0": 10.0}), 1: ("flat", {"c": 7.0}), 2: ("gable_v", {"zr": 8.0, "s": 0.3, "u0": 9.0}), 3: ("shed", {"a": 0.2, "b": 0.0, "c": 5.0})}
    assert got
    for r in got:
        kind, p = want[r.component % 4]
        assert r.kind == kind and all(abs(r.params[k] - v) < 0.35 for k, v in p.items()) and r.residual < 0.15, r


def test_fused_surface(spark):
    pts = QUERIES["tsdf_fusion"](spark, DATA).select("x", "y", "z").collect()
    assert pts and all(abs(p.z - 3 * np.sin(p.x / 10)) < 1.0 for p in pts)
    # A plane under nadir rays is found where it is.
    flat = spark.range(400).select((F.col("id") % 20 + 0.5).alias("x"), (F.floor(F.col("id") / 20) + 0.5).alias("y"), F.lit(2.3).alias("z"), F.lit(1.0).alias("w"), *[F.lit(c).alias(c) for c in ()])
    flat = flat.withColumns({"cam_x": F.col("x"), "cam_y": F.col("y"), "cam_z": F.lit(40.0), "r": F.lit(10.0), "g": F.lit(20.0), "b": F.lit(30.0)})
    z = [p.z for p in depth.surface_points(depth.integrate(flat, 1.0, 3.0), 1.0, 0.5).collect()]
    assert len(z) == 400 and all(abs(v - 2.3) < 1e-6 for v in z)


def test_extracted_buildings(spark):
    got = QUERIES["building_extraction"](spark, DATA).collect()
    assert len(got) == 2
    for r in got:
        assert r["shape"] == "rectangle" and r.iou > 0.9 and abs(r.area_m2 - 17 * 17) < 45 and abs(r.ridge_height_m - 20 / 3) < 1.5


def test_regular_buildings(spark):
    n, gsd = 120, 0.25
    g = spark.range(n * n).select(F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"))
    inside = F.col("row").between(30, 89) & F.col("col").between(20, 99)
    y = (F.col("row") - 59.5) * gsd
    dtm = F.lit(2.0) + F.col("col") * 0.002
    g = g.select("row", "col", dtm.alias("dtm"), F.when(inside, 9 - 0.4 * F.abs(y)).alias("roof"))
    cells = g.where("roof IS NOT NULL").select("row", "col", F.lit(7).cast("long").alias("component"), (F.col("roof") - F.col("dtm")).alias("h"), F.col("dtm").alias("ground"), F.lit(1).alias("observed"))
    b = buildings.regular_buildings(cells, g, 100.0, 200.0, gsd)
    r = b.first()
    assert (r["shape"], r.kind) == ("rectangle", "gable_u") and abs(r.area_m2 - 300) < 12 and abs(r.base_z - 2.04) < 0.1 and abs(r.ridge_m - 6.9) < 0.3 and abs(r.eave_m - 3.9) < 0.4
    assert len(r.corners) == 6 and abs(max(r.tops) - 9) < 0.2
    roof = buildings.roof_meshes(b.select("component", F.col("corners").alias("ring"), "kind", "params")).collect()
    tri = [np.array([[t[f"{c}{k}"] for c in "xyz"] for k in range(3)]) for t in roof]
    flat = sum(kernels.polygon_area(t[:, :2]) for t in tri)
    assert {t.grp for t in roof} == {0, 1} and abs(flat - r.area_m2) < 0.5
    assert buildings.building_walls(b).count() > 6
    low = buildings.regular_buildings(cells.withColumn("h", F.lit(0.2)), g, 100.0, 200.0, gsd).first()
    assert low.kind == "flat" and min(low.tops) >= low.base_z + 0.5


def test_percentiles_of_long_columns(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 30_000), np.full(9_000, 0.25), rng.exponential(5, 20_000)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    shares = [0.0, 0.05, 0.5, 0.71, 0.995, 1.0]
    assert np.allclose(quantiles.exact_percentiles(df, "x", shares, small=100, narrow=300), np.percentile(x, [100 * s for s in shares]), rtol=0, atol=1e-12)
    assert np.allclose(quantiles.exact_percentiles(df, F.col("x") * 2, shares), np.percentile(2 * x, [100 * s for s in shares]))
    assert quantiles.exact_percentiles(df.limit(0), "x", [0.5]) == [None]


def test_even_join_is_a_join(spark):
    rows = [(k, i) for i, k in enumerate([1] * 900 + [None] * 700 + [2] * 300 + list(range(3, 60)))]
    a, b = spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (40, "w"), (None, "n"), (99, "u")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got, want = joins.even_join(a, b, ["k"], ["i"], how, 100), a.join(b, "k", how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = joins.even_join(a, b, ["k"], ["i"], "left", 100)._jdf.queryExecution().toString()
    assert "__salt" in plan
    n = joins.numbered(a.select("i"), "i", "n").collect()
    assert all(r.n == r.i + 1 for r in n) and len(n) == len(rows)


def test_scratch_deletes_what_was_written_inside(spark, tmp_path):
    with scratch(spark):
        where = shared_dir(spark)
        spark.range(3).write.parquet(where)
        assert spark.read.parquet(where).count() == 3
        kept = spark.range(5).toPandas()
    assert len(kept) == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(where)


def test_right_angled_outlines_at_any_angle():
    y, x = np.mgrid[:200, :200] + 0.5
    for t in (0.0, 0.3, 0.6):
        u, v = (x - 100) * np.cos(t) + (y - 100) * np.sin(t), (y - 100) * np.cos(t) - (x - 100) * np.sin(t)
        mask = ((abs(u) < 60) & (abs(v) < 25)) | ((u > -60) & (u < -20) & (v > -25) & (v < 70))
        ring, shape, score = kernels.regular_footprint(mask, 0.25)
        e = np.roll(ring, -1, axis=0) - ring
        e /= np.linalg.norm(e, axis=1)[:, None]
        assert shape == "right_angled" and len(ring) == 6 and score > 0.97 and np.abs((e * np.roll(e, 1, axis=0)).sum(axis=1)).max() < 0.01
    tri = (y > 20) & (y < 150) & (abs(x - 100) < (y - 20) * 0.5)
    assert kernels.regular_footprint(tri, 0.25)[1] == "triangle"
    notched = np.array([[0, 0], [10, 0], [10, 6], [6, 6], [6, 5.5], [4, 5.5], [4, 6], [0, 6]], float)
    assert len(kernels.simplify_orthogonal(notched, 1.0)) == 4
    x = np.column_stack([np.arange(50.0), np.ones(50)])
    z = np.where(np.arange(50) % 9 == 0, 40.0, 2 * x[:, 0] + 1)
    assert np.allclose(kernels.trimmed_fit(x, z)[0], (2, 1)) and np.allclose(kernels.huber_fit(x, z)[0], (2, 1), atol=0.05)


def test_nearest_match_uses_cells(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0), (3, 50.0, 0.0)], "t long, x double, y double")
    b = spark.createDataFrame([(10, 0.5, 0.0), (11, -0.5, 0.0), (12, 7.0, 5.0)], "f long, x double, y double")
    assert sorted(map(tuple, cloud.nearest_within(a, b, 3.0, "t", "f").collect())) == [(1, 10, 0.5), (2, 12, 2.0)]


def test_best_cameras_in_arrays_and_in_blocks(spark, monkeypatch):
    from aeroframe.operators import visibility

    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 50, (60, 3)))], "id long, x double, y double, z double")
    cams = rng.uniform(0, 50, (40, 3)) + [0, 0, 60]
    cams[7] = cams[3]
    table = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cams)], "cam_order long, cam_x double, cam_y double, cam_z double")
    for k in (1, 5):
        monkeypatch.setattr(visibility, "CAMERA_BLOCK", 16)
        got = sorted((r.id, r["rank"], r.cam_order, round(r.score, 9)) for r in visibility.best_cameras(pts, table, "id", k).collect())
        assert got == sorted((r.id, r["rank"], r.cam_order, round(r.score, 9)) for r in visibility._best_of_blocks(pts, table, "id", k).collect())
        assert len(got) == 60 * k and not any(c == 7 for _, n, c, _ in got if n == 1)
