"""Triangulation and bundle adjustment against a dense solution and against made scenes whose answer is known."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import adjust
from aeroframe.plans import q_surface
from aeroframe.plans.queries import QUERIES
from aeroframe.session import ship

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OPENCV = [800.0, 810.0, 500.0, 400.0, -0.05, 0.01, 0.001, -0.002]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def turned(w):
    t = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k if t < 1e-12 else np.eye(3) + np.sin(t) / t * k + (1 - np.cos(t)) / t**2 * k @ k


def sight(r, t, x, p):
    y = r @ x + t
    a, b = y[:2] / y[2]
    fx, fy, cx, cy, k1, k2, p1, p2 = p
    r2 = a * a + b * b
    d = 1 + k1 * r2 + k2 * r2 * r2
    return np.array([fx * (a * d + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)) + cx, fy * (b * d + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b) + cy])


def dense(poses, points, seen, p, rounds=12):
    """Mean error after Gauss-Newton on one whole matrix of differences; poses: id -> (r, t, fixed)."""
    poses, points = dict(poses), dict(points)
    ci = {k: 6 * i for i, k in enumerate(poses)}
    pi = {k: 6 * len(poses) + 3 * i for i, k in enumerate(points)}
    for _ in range(rounds):
        n = 6 * len(poses) + 3 * len(points)
        h, g = np.zeros((n, n)), np.zeros(n)
        for im, pt, u, v in seen:
            r, t, fixed = poses[im]
            x, e = points[pt], sight(r, t, points[pt], p) - (u, v)
            j = np.zeros((2, 9))
            for k in range(9):
                d = np.zeros(9)
                d[k] = 1e-6
                m = turned(d[:3])
                plus = sight(m @ r, m @ t + d[3:6], x + d[6:], p)
                m = turned(-d[:3])
                j[:, k] = (plus - sight(m @ r, m @ t - d[3:6], x - d[6:], p)) / 2e-6
            j[:, :6] *= not fixed
            at = np.r_[ci[im] : ci[im] + 6, pi[pt] : pi[pt] + 3]
            h[np.ix_(at, at)] += j.T @ j
            g[at] += j.T @ e
        h[np.diag_indices(n)] += 1e-9 * np.maximum(h.diagonal(), 1e-3)
        step = -np.linalg.solve(h, g)
        for k, (r, t, fixed) in poses.items():
            d = step[ci[k] : ci[k] + 6]
            m = turned(d[:3])
            poses[k] = (m @ r, m @ t + d[3:], fixed)
        for k in points:
            points[k] = points[k] + step[pi[k] : pi[k] + 3]
        if np.abs(step).max() < 1e-9:
            break
    return float(np.mean([np.linalg.norm(sight(poses[i][0], poses[i][1], points[q], p) - (u, v)) for i, q, u, v in seen]))


def test_registered_scenes_come_to_the_dense_solution(spark):
    got = {r["scene"]: r for r in QUERIES["adjusted_models"](spark, DATA).collect()}
    seen, images, lens = q_surface._sights(spark, DATA, 1)
    points = adjust.triangulate(seen, images, lens, ("scene",)).where("scene = 0").collect()
    known = {r["point_id"] for r in points}
    rows = [(r["image_id"], r["point_id"], r["u"], r["v"]) for r in seen.where("scene = 0").collect() if r["point_id"] in known]
    poses = {r["image_id"]: (np.reshape(r["r_cw"], (3, 3)), np.array(r["t_cw"]), r["fixed"]) for r in images.where("scene = 0").collect()}
    if len(rows) > 5000:
        pytest.skip("the dense matrix is for small tables")
    want = dense(poses, {r["point_id"]: np.array([r["x"], r["y"], r["z"]]) for r in points}, rows, [900.0, 900.0, 960.0, 540.0, 0, 0, 0, 0], 6)
    assert got[0]["observations"] == len(rows)
    assert got[0]["error_before"] > 1 and abs(got[0]["error_after"] - want) < 2e-3, (got[0], want)
    assert all(r["error_after"] < 0.1 for r in got.values())


def made(seed, turn=0.004, shift=0.1):
    """A scene through a bent lens: (images as they were guessed, points, sights without noise, true poses)."""
    rng = np.random.default_rng(seed)
    points = {i: np.array([*rng.uniform(-20, 20, 2), rng.uniform(0, 8)]) for i in range(40)}
    true, guess, seen = {}, [], []
    for i in range(6):
        r = turned(rng.normal(0, 0.08, 3)) @ np.diag([1.0, -1.0, -1.0])
        t = -r @ np.array([*rng.uniform(-15, 15, 2), rng.uniform(45, 55)])
        true[i] = (r, t)
        w, d = (rng.normal(0, turn, 3), rng.normal(0, shift, 3)) if i > 1 else (np.zeros(3), np.zeros(3))
        guess.append((i, 7, (turned(w) @ r).ravel().tolist(), (turned(w) @ t + d).tolist(), i < 2))
        seen += [(i, k, *map(float, sight(r, t, x, OPENCV))) for k, x in points.items()]
    return guess, points, seen, true


def tables(spark, scenes, more=()):
    images = spark.createDataFrame([(s, *row, f"n{s}") for s, m in scenes.items() for row in m[0]], "scene int, image_id long, camera_id int, r_cw array<double>, t_cw array<double>, fixed boolean, name string")
    points = spark.createDataFrame([(s, k, *map(float, x)) for s, m in scenes.items() for k, x in m[1].items()], "scene int, point_id long, x double, y double, z double")
    seen = spark.createDataFrame([(s, *row) for s, m in scenes.items() for row in m[2]] + list(more), "scene int, image_id long, point_id long, u double, v double")
    lens = spark.createDataFrame([(7, "OPENCV", OPENCV)], "camera_id int, model string, params array<double>")
    return images, points, seen, lens


def test_a_bent_lens_and_moved_poses(spark):
    """Exact sights: the true poses come back, known ones stay, rows with gaps or of unknown images change nothing."""
    scenes = {1: made(1), 2: made(2)}
    images, points, seen, lens = tables(spark, scenes, [(1, None, 3, 5.0, 5.0), (1, 2, 3, None, 5.0), (2, 99, 3, 1.0, 1.0), (None, 2, 3, 1.0, 1.0), (2, 1, 77, 500.0, 400.0)])
    start = adjust.triangulate(seen, images, lens, ("scene",))
    assert start.count() == 80  # a point seen once has no place
    im, pts, report = adjust.adjust(images, start, seen, lens, ("scene",), rounds=4, steps=14)
    report = {r["scene"]: r for r in report.collect()}
    for s, r in report.items():
        assert r["observations"] == 240 and r["error_before"] > 0.5 and r["error_after"] < 1e-2, r
    for row in im.collect():
        r, t = scenes[row["scene"]][3][row["image_id"]]
        assert np.allclose(row["r_cw"], r.ravel(), atol=1e-4) and np.allclose(row["t_cw"], t, atol=5e-3)
        assert row["name"] == f"n{row['scene']}"
        if row["fixed"]:
            assert np.allclose(row["r_cw"], r.ravel(), atol=1e-12)
    for row in pts.collect():
        assert np.allclose([row["x"], row["y"], row["z"]], scenes[row["scene"]][1][row["point_id"]], atol=1e-2)


def test_exact_points_from_exact_poses(spark):
    g, points, seen, true = made(5, 0.0, 0.0)
    images, _, rows, lens = tables(spark, {0: (g, points, seen, true)})
    got = adjust.triangulate(rows, images, lens).collect()
    assert len(got) == 40 and all(r["views"] == 6 and r["error"] < 1e-4 for r in got)
    assert all(np.allclose([r["x"], r["y"], r["z"]], points[r["point_id"]], atol=1e-5) for r in got)
    assert adjust.triangulate(rows.where("image_id = 0"), images, lens).count() == 0
    one = images.where("image_id = 0")
    twice = one.unionByName(one.withColumn("image_id", F.lit(9).cast("long")))
    same = rows.where("image_id = 0").unionByName(rows.where("image_id = 0").withColumn("image_id", F.lit(9).cast("long")))
    assert adjust.triangulate(same, twice, lens).count() == 0  # two rays of one place do not meet
    assert adjust.triangulate(rows.limit(0), images, lens).count() == 0


def test_empty_and_single_models(spark):
    g, points, seen, true = made(6)
    images, pts, rows, lens = tables(spark, {0: (g, points, seen, true)})
    im, p, report = adjust.adjust(images, pts, rows.limit(0), lens, rounds=1, steps=1)
    assert report.count() == 0 and im.count() == 6 and p.count() == 40
    same = {r["image_id"]: r["t_cw"] for r in im.collect()}
    assert all(same[row[0]] == row[3] for row in g)


def test_small_models_are_groups_and_write_no_linearised_tables(spark, monkeypatch):
    """Models of few rows write nothing between rounds; those above MODEL go over all tasks and come to the same, beside small ones too."""
    scenes = {1: made(1), 2: made(2)}
    images, points, seen, lens = tables(spark, scenes)
    seen = seen.where("scene = 1 OR point_id < 20")
    calls, save = [], adjust.save_table
    monkeypatch.setattr(adjust, "save_table", lambda *a: calls.append(a) or save(*a))
    found = []
    for most in (200_000, 150):
        monkeypatch.setattr(adjust, "MODEL", most)
        start = adjust.triangulate(seen, images, lens, ("scene",))
        got = adjust.adjust(images, start, seen, lens, ("scene",), rounds=1, steps=3)
        found.append([{tuple(r[k] for k in ids): [*np.ravel([r[c] for c in values])] for r in df.collect() for values in [columns]} for df, ids, columns in (
            (start, ("scene", "point_id"), ("x", "y", "z", "views", "error")), (got[0], ("scene", "image_id"), ("t_cw",)), (got[1], ("scene", "point_id"), ("x", "y", "z")), (got[2], ("scene",), ("observations", "error_before", "error_after", "taken")))])
        assert bool(calls) == (most < 200_000)
    assert len(found[0][0]) == 60 and len(found[0][3]) == 2
    for other in found[1:]:
        for a, b in zip(found[0], other):
            assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    one = seen.where("scene = 1").drop("scene")
    monkeypatch.setattr(adjust, "MODEL", 10)
    whole = [adjust.triangulate(one, images.where("scene = 1").drop("scene"), lens)]
    monkeypatch.setattr(adjust, "MODEL", 200_000)
    whole.append(adjust.triangulate(one, images.where("scene = 1").drop("scene"), lens))
    a, b = ({r["point_id"]: [r["x"], r["y"], r["z"]] for r in df.collect()} for df in whole)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
