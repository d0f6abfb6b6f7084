"""Tracking between frames, key frames out of pixels, live interpolation, the table function, decimation."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import decimate, depth, interpolate, stereo, surface, tracking
from aeroframe.plans.queries import QUERIES
from aeroframe.session import register_functions, ship
from aeroframe.streaming import interpolation

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def texture(h, w, seed=0):
    """Blocks of many sizes, smoothed: like a picture, coarse parts have most of the contrast."""
    rng = np.random.default_rng(seed)
    t = sum(np.kron(rng.integers(0, 200, (h // k + 2, w // k + 2)) * np.sqrt(k / 40), np.ones((k, k)))[: h + 9, : w + 9] for k in (5, 10, 20, 40)) / 2
    for _ in range(3):
        t = sum(np.roll(t, (i, j), (0, 1)) for i in range(2) for j in range(2)) / 4
    return np.clip(t[4 : h + 4, 4 : w + 4], 0, 255)


def test_a_shifted_texture_gives_its_shift():
    wide = texture(200, 400)
    for dx, dy in ((0, 0), (3, 0), (11, -6), (25, 9)):
        step, ratio, n = tracking.pair_step(wide[20:160, 40:260], wide[20 + dy : 160 + dy, 40 + dx : 260 + dx], 300)
        assert abs(step - np.hypot(dx, dy)) < 0.1 and ratio > 0.6 and n > 30, (dx, dy, step, ratio)
    assert tracking.pair_step(np.full((60, 60), 7.0), np.full((60, 60), 9.0)) == (None, 0.0, 0)
    step, ratio, _ = tracking.pair_step(wide[:120, :160], texture(120, 160, 9), 200)
    assert ratio < 0.3


def test_corners_are_apart_and_best_first():
    p = tracking.corner_points(texture(120, 160), 100)
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + np.eye(len(p)) * 99
    assert 20 < len(p) <= 100 and d.min() >= tracking.SPACING


def clip(n, speed, hover, blurred=None):
    wide, x, out = texture(90, 160 + speed * n + 10, 2), 0, []
    for i in range(n):
        x += 0 if hover[0] <= i < hover[1] else speed
        frame = wide[:, x : x + 160]
        if i == blurred:
            frame = sum(np.roll(frame, (a, b), (0, 1)) for a in range(-4, 5) for b in range(-4, 5)) / 81
        out.append((1, i, i / 10, 90, 160, np.rint(frame).astype(np.uint8).tobytes()))
    return out


def chosen(spark, frames, relax=False):
    df = spark.createDataFrame(frames, "clip long, frame_index long, t double, height int, width int, pixels binary")
    steps = tracking.frame_steps(df, corners=150)
    sharp = {f[1]: float(np.var(np.diff(np.frombuffer(f[5], np.uint8).astype(float), 2))) for f in frames}
    cut = float(np.percentile(list(sharp.values()), 10))
    scores = spark.createDataFrame(list(sharp.items()), "frame_index long, sharpness double")
    c = steps.join(scores, "frame_index").withColumn("cut", F.lit(cut))
    if relax:
        return depth.relaxed_keyframes(c, "clip", 12, min_disp=26.0, max_gap=10.0)
    return depth.select_keyframes(c, "clip", min_disp=13.0, max_gap=10.0)


def test_key_frames_skip_a_hover_and_a_blurred_frame(spark):
    got = sorted(r.frame_index for r in chosen(spark, clip(40, 4, (15, 28), 33)).collect())
    assert 4 <= len(got) <= 20 and not [i for i in got if 16 <= i < 28] and 33 not in got, got


def test_a_slow_clip_is_relaxed(spark):
    got = chosen(spark, clip(50, 1, (0, 0)), relax=True).collect()
    assert len(got) >= 7 and max(r.relaxed for r in got) >= 1


def test_registered_clips(spark):
    for r in QUERIES["frame_steps"](spark, DATA).collect():
        want = [None, r.clip % 5, 3, 0, r.clip % 7][r.frame_index]
        assert (r.step_px is None and r.ratio == 0.0) if want is None else abs(r.step_px - want) < 0.1 and r.ratio > 0.6


# streams


def test_a_stream_of_samples_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    at = np.sort(rng.choice(np.arange(0, 4000), 160, replace=False)) * 0.1
    samples = [(int(k), float(t), i, float(rng.normal()) if rng.random() < 0.9 else None, float(i)) for i, t in enumerate(at) for k in (1, 2) if rng.random() < 0.8]
    targets = [(int(k), float(t), f"{k}-{j}") for j, t in enumerate(np.round(rng.uniform(5, 380, 70), 2)) for k in (1, 2)]
    s = spark.createDataFrame(samples, "k int, t double, seq long, a double, b double").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    w = spark.createDataFrame(targets, "k int, t double, target string").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))
    # Five arrivals; within one and from one to the next, rows are late by up to eight seconds.
    for name, df in (("s", s), ("w", w)):
        part = F.least(F.lit(4), F.floor((F.col("t") + F.pmod(F.hash("t"), F.lit(8))) / 80))
        for i in range(5):
            df.where(part == i).drop("t").coalesce(1).write.parquet(str(tmp_path / name / f"{i}.parquet"))
    end = F.timestamp_seconds(F.lit(10_000))
    s.limit(1).withColumns({"k": F.lit(9), "ts": end}).drop("t").coalesce(1).write.parquet(str(tmp_path / "s/9.parquet"))
    w.limit(1).withColumns({"k": F.lit(9), "ts": end}).drop("t").coalesce(1).write.parquet(str(tmp_path / "w/9.parquet"))
    read = lambda name, df: spark.readStream.schema(df.drop("t").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        out = interpolation.interpolate_stream(read("s", s), read("w", w), ["k"], ["a", "b"], late="20 seconds", patience=60.0)
        kept = str(tmp_path / "out")
        q = out.writeStream.format("parquet").option("path", kept).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {r.target: (r.a, r.b) for r in spark.read.parquet(kept).where("k < 9").collect()}
    want = {r.target: (r.a, r.b) for r in interpolate.interpolate_fields(s.drop("ts"), w.drop("ts"), ["k"], {"a": False, "b": False}).collect()}
    assert set(got) == set(want) and len(got) == len(targets)
    for k, v in want.items():
        assert np.allclose(np.array(got[k], float), np.array(v, float), atol=1e-9), k


def test_state_of_a_key_stays_small():
    """Samples that no target can need any more are dropped."""

    class Held:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class Handle:
        timers: list = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Timers:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return int(self.now * 1000)

    p = interpolation.Interpolator(["k"], ["a"], 30.0)
    p.handle, p.samples, p.waiting = Handle(), Held(), Held()
    most = given = 0
    for step in range(200):
        samples = p._held(p.samples) + [(float(step * 10 + j), 10 * step + j, 1.0 * j) for j in range(10)]
        out = p._settled((1,), samples, p._held(p.waiting) + [(step * 10 + 4.5, str(step))], Timers(step * 10 - 5))
        most, given = max(most, len(p.samples.rows)), given + len(out)
    assert most <= 30 and given >= 198 and len(p.waiting.rows) <= 2 and p.handle.timers


# SQL


def test_rings_from_sql_text(spark):
    register_functions(spark)
    rows = [("sq", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 4), (0, 4)])] + [("tri", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1)])] + [("two", 0, 0.0, 0.0), ("two", 1, 1.0, 0.0)]
    spark.createDataFrame(rows, "ring_id string, pos int, x double, y double").createOrReplaceTempView("rings")
    got = spark.sql("SELECT * FROM triangulate(TABLE(rings) PARTITION BY ring_id)")
    assert got.columns == ["ring_id", "k", "a", "b", "c"] and got.schema["ring_id"].dataType.simpleString() == "string"
    by = {}
    for r in got.collect():
        by.setdefault(r.ring_id, []).append((r.a, r.b, r.c))
    assert {k: len(v) for k, v in by.items()} == {"sq": 2, "tri": 1}
    with pytest.raises(Exception, match="corners lack"):
        spark.sql("SELECT * FROM triangulate(TABLE(SELECT 1 AS ring_id, 2 AS pos))").collect()


# decimation


def flat(spark, n, bend):
    v = spark.range(n * n).select(F.col("id").alias("vid"), F.floor(F.col("id") / n).cast("double").alias("x"), (F.col("id") % n).cast("double").alias("y")).withColumn("z", bend(F.col("x"), F.col("y")))
    a = spark.range(n * n).where((F.col("id") % n < n - 1) & (F.col("id") < n * (n - 1))).select("id", F.explode(F.array(*[F.struct(F.lit(h).alias("h"), *[(F.col("id") + o).alias(f"v{i}") for i, o in enumerate(c)]) for h, c in ((0, (0, n, n + 1)), (1, (0, n + 1, 1)))])).alias("f"))
    return v, a.select((F.col("id") * 2 + F.col("f.h")).alias("fid"), "f.v0", "f.v1", "f.v2")


def test_a_flat_patch_keeps_its_rim_and_area(spark):
    v, f = decimate.decimate(*flat(spark, 8, lambda x, y: 0.5 * x + 1.0), 60)
    r = surface.mesh_report(v, f).first()
    assert 50 <= r.faces <= 60 and r.odd_edges == 0 and abs(r.area_m2 - 49 * np.sqrt(1.25)) < 1e-6 and r.vertices - r.edges + r.faces == 1
    assert all(abs(p.z - 0.5 * p.x - 1) < 1e-6 for p in v.collect())


def test_the_registered_waves_stay_near(spark):
    got = QUERIES["mesh_decimation"](spark, DATA).collect()
    n = 128 * len({r.v0 // 1000 for r in got})
    assert 0.6 * n < len(got) <= 0.71 * n
    edges = {}
    for r in got:
        for a, b in ((r.v0, r.v1), (r.v1, r.v2), (r.v2, r.v0)):
            edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
        for v, p in ((r.v0, r.at_v0), (r.v1, r.at_v1), (r.v2, r.at_v2)):
            assert abs(p.z - np.sin(p.x / 3) * (v // 1000 % 3)) < 0.15
    assert max(edges.values()) == 2


def test_contractions_of_a_round_are_apart(spark):
    v, f = flat(spark, 9, lambda x, y: F.sin(x) * F.cos(y))
    v = v.join(decimate.start_errors(v, f), "vid")
    able = decimate.candidates(v, f)
    picked = decimate.independent(able, decimate._edges(f)).collect()
    near = {}
    for r in f.collect():
        for a in (r.v0, r.v1, r.v2):
            near.setdefault(a, set()).update((r.v0, r.v1, r.v2))
    zones = [near[r.p] | near[r.q] for r in picked]
    assert picked and all(not ({p.p, p.q} & zones[j]) for i, p in enumerate(picked) for j in range(len(picked)) if i != j)


# stereo


def slanted(spark, n=40, extra=()):
    """Two or more views of a textured plane z = 10 + 0.15 x, in the first camera's frame."""
    waves = np.random.default_rng(8).uniform(-3.0, 3.0, (12, 2))
    paint = lambda x, y: 128 + sum(9 * np.sin(a * x + b * y + i) for i, (a, b) in enumerate(waves))
    f, c = 45.0, n / 2
    v, u = np.mgrid[0:n, 0:n] + 0.5
    rows, truth = [], None
    for name, shift in (("a", 0.0), ("b", 1.0), *extra):
        rx, ry = (u - c) / f, (v - c) / f
        z = (10 + 0.15 * shift) / (1 - 0.15 * rx)
        x, y = rx * z + shift, ry * z
        truth = z if name == "a" else truth
        px = np.clip(np.rint(paint(x, y)), 0, 255).astype(np.uint8)
        rows.append((name, n, n, px.tobytes(), f, f, c, c, np.eye(3).ravel().tolist(), [-shift, 0.0, 0.0]))
    return spark.createDataFrame(rows, "image string, height int, width int, pixels binary, fx double, fy double, cx double, cy double, r_cw array<double>, t_cw array<double>"), truth


def test_a_slanted_plane_from_two_views(spark):
    frames, truth = slanted(spark)
    got = stereo.dense_depth(frames, spark.createDataFrame([("a", "b")], "image string, other string"), 7.0, 14.0, 24, step=0.3, jump=20.0).collect()
    z = np.zeros((40, 40))
    for r in got:
        z[r.row, r.col] = r.z
    inner = (slice(4, 36), slice(12, 36))  # what the other view sees, with its windows
    off = np.abs(1 / z - 1 / truth)[inner] / np.diff(stereo.inverse_depths(7.0, 14.0, 24))[0]
    assert len(got) == 1600 and np.median(off) < 0.1 and np.percentile(off, 95) < 0.5, (np.median(off), np.percentile(off, 95))


def test_lines_against_a_plain_loop():
    rng = np.random.default_rng(1)
    length = np.array([7, 3, 1])
    cost = rng.uniform(0, 10, (3, 7, 5))
    got = stereo.along_lines(cost, length, 1.0, 4.0)
    for i, n in enumerate(length):
        ways = []
        for order in (range(n), range(n - 1, -1, -1)):
            last, total = None, {}
            for p in order:
                here = [cost[i, p, d] + (0 if last is None else min(last[d], min(last) + 4.0, *[last[e] + 1.0 for e in (d - 1, d + 1) if 0 <= e < 5]) - min(last)) for d in range(5)]
                total[p] = last = here
            ways.append(total)
        for p in range(n):
            assert np.allclose(got[i, p], np.array(ways[0][p]) + np.array(ways[1][p]) - cost[i, p])


def test_images_without_a_neighbour_give_no_depth(spark):
    frames, _ = slanted(spark, 16)
    pairs = spark.createDataFrame([("a", "missing")], "image string, other string")
    assert stereo.dense_depth(frames, pairs, 7.0, 14.0, 8).count() == 0


def test_registered_pairs(spark):
    """Each supplier's plane, from two views of it, to half a step of the planes."""
    gap = np.diff(stereo.inverse_depths(7.0, 14.0, 16))[0]
    off = []
    for r in QUERIES["dense_depth"](spark, DATA).where("row BETWEEN 4 AND 19 AND col BETWEEN 11 AND 19").collect():
        z = (9 + r.k % 3) / (1 - 0.1 * (r.k % 2) * (r.col + 0.5 - 12) / 40)
        off.append(abs(1 / r.z - 1 / z) / gap)
    assert len(off) % (16 * 9) == 0 and np.median(off) < 0.2 and np.percentile(off, 95) < 0.6, (np.median(off), np.percentile(off, 95))
