"""A gated run: stages in order, one table folder each, results kept by a key of settings and inputs.

A stage's function takes the runner and returns (tables, gate row). A failed gate
or an exception stops the run; nothing downstream runs on what did not pass."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .config import stable_hash

GATE = "stage string, passed boolean, failures array<string>, metrics string, seconds double, key string"


class GateFailure(RuntimeError):
    """An upstream stage is missing or did not pass."""


@dataclass
class Stage:
    name: str
    run: Callable
    requires: list[str] = field(default_factory=list)
    section: str | None = None


@dataclass
class Runner:
    spark: SparkSession
    folder: str
    config: dict
    inputs: dict = field(default_factory=dict)

    def table(self, stage: str, name: str) -> DataFrame:
        """A table of an earlier stage, which must have passed."""
        gate = self.gate(stage)
        if gate is None or not gate["passed"]:
            raise GateFailure(f"stage {stage} has not passed")
        return self.spark.read.parquet(f"{self.folder}/{stage}/{name}")

    def optional(self, stage: str, name: str) -> DataFrame | None:
        """A table that the stage may have left out."""
        try:
            return self.table(stage, name)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def gate(self, stage: str):
        try:
            return self.spark.read.schema(GATE).json(f"{self.folder}/{stage}/gate").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _key(self, stage: Stage, keys: dict) -> str:
        return stable_hash([stage.name, self.config.get(stage.section or stage.name, {}), self.inputs, [keys.get(r) for r in stage.requires]])

    def run(self, stages: list[Stage], until: str | None = None, start: str | None = None, force: bool = False) -> dict:
        """Run what is not kept: {status, stages}. ``start``: stages before it are taken as they are."""
        keys, report, status, begun = {}, {}, "SUCCESS", start is None
        for s in stages:
            begun = begun or s.name == start
            keys[s.name] = self._key(s, keys)
            old = self.gate(s.name)
            if old is not None and old["passed"] and (not begun or (old["key"] == keys[s.name] and not force)):
                report[s.name] = {"cached": True, "passed": True}
            else:
                t = time.time()
                try:
                    tables, gate = s.run(self)
                    for name, df in tables.items():
                        df.write.mode("overwrite").parquet(f"{self.folder}/{s.name}/{name}")
                    g = gate.select("passed", "failures", "metrics").first()
                    row = (s.name, g["passed"], list(g["failures"]), g["metrics"], time.time() - t, keys[s.name])
                except Exception:
                    row = (s.name, False, [traceback.format_exc(limit=3)], None, time.time() - t, keys[s.name])
                self.spark.createDataFrame([row], GATE).coalesce(1).write.mode("overwrite").json(f"{self.folder}/{s.name}/gate")
                report[s.name] = {"cached": False, "passed": row[1], "failures": row[2]}
                if not row[1]:
                    status = "FAILED" if len(report) == 1 else "PARTIAL"
                    break
            if s.name == until:
                status = "PARTIAL_SUCCESS" if s is not stages[-1] else status
                break
        return {"status": status, "stages": report}


def products_stage(r: Runner):
    """Points (x, y, z) of the stage ``fusion`` to height rasters: highest points, holes filled low, ground, terrain.

    Its gate asks for ortho coverage where ``fusion`` has a table ``ortho`` (row, col, alpha) on the same grid."""
    from ..functions.grids import cell, grid_spec
    from ..operators import gates, raster

    c = r.config["products"]
    pts = r.table("fusion", "points")
    spec = grid_spec(pts, gsd=c["gsd"]).first()
    row, col = cell("x", "y", spec["xmin"], spec["ymax"], c["gsd"])
    dsm = raster.dense(raster.rasterise_max(pts, row, col), spec["height"], spec["width"])
    dsm = raster.fill_low(dsm.withColumn("observed", F.col("value").isNotNull()), c["fill_cells"])
    ground = raster.ground_filter(dsm, c["gsd"], c["max_window_m"], c["slope"], c["dh0"], c["dh_max"])
    dtm = raster.terrain(ground, c["gsd"])
    cells = ground.join(dtm, ["row", "col"]).select("row", "col", F.col("value").alias("dsm"), F.when(F.col("value").isNotNull(), F.col("dtm")).alias("dtm"), "ground", "observed")
    # The gate's counts are taken by the pass that writes the table.
    seen = Observation("cells")
    cells.observe(seen, F.count_if("observed").alias("observed_cells"), F.count("dsm").alias("surface")).write.mode("overwrite").parquet(f"{r.folder}/products/cells")
    cells = r.spark.read.parquet(f"{r.folder}/products/cells")
    m = r.spark.createDataFrame([(seen.get["observed_cells"], seen.get["surface"])], "observed_cells long, surface long")
    ortho = r.optional("fusion", "ortho")
    filled = None if ortho is None else ortho.where("alpha > 0").select("row", "col").distinct().count()
    hull = raster.hull_fraction(cells.select("row", "col", F.col("observed").cast("int").alias("value")))
    m = m.select("observed_cells", F.lit(hull).alias("hull_frac"), (F.lit(filled).cast("double") / F.greatest("surface", F.lit(1))).alias("ortho_frac"))
    return {"spec": r.spark.createDataFrame([spec.asDict()])}, gates.products_gate(m)


def ingest_stage(r: Runner):
    """Telemetry (a file or folder, ``inputs.telemetry``) at the frames of a clip (``inputs.frames``: name, t): one row a frame."""
    from ..operators import gates, interpolate
    from ..sources.telemetry import read_telemetry

    samples = read_telemetry(r.spark, r.inputs["telemetry"]).drop("source").withColumn("clip", F.lit(0))
    frames = r.spark.read.parquet(r.inputs["frames"]).select(F.lit(0).alias("clip"), "name", "t")
    out = materialise(interpolate.synchronise(samples, frames, ["clip"]).drop("clip"))
    return {"frames": out}, gates.ingest_gate(out, [], r.config["ingest"]["min_keyframes"])


def georef_stage(r: Runner):
    """The similarity from a sparse model (tables ``images`` and ``points`` of the stage ``sfm``) to local metres about the first frame's position."""
    from ..functions.geodesy import geodetic_to_enu, utm_epsg
    from ..operators import estimate, gates
    from ..operators.joins import numbered

    seen = gates.usable_frames(r.table("sfm", "images"), r.table("ingest", "frames"), [])
    first = seen.orderBy("name").select("lat", "lon", "alt", utm_epsg("lat", "lon").alias("epsg")).first()
    enu = geodetic_to_enu("lat", "lon", "alt", first["lat"], first["lon"], first["alt"])
    rows = numbered(seen, "name", "idx").select("idx", "name", *[F.col("centre")[i].alias(c) for i, c in enumerate("xyz")], *[v.alias(f"e{c}") for v, c in zip(enu, "xyz")], *[F.col("r_cw")[6 + i].alias(f"a{c}") for i, c in enumerate("xyz")], "gimbal_yaw", "gimbal_pitch")
    got = estimate.solve_frame(materialise(rows), r.table("sfm", "points"), r.config["georef"])
    row = (got["scale"], got["rotation"], got["translation"], first["lat"], first["lon"], first["alt"], first["epsg"], got["rmse_holdout_m"], got["up_error_deg"], got["orientation_prior"])
    frame = r.spark.createDataFrame([row], "scale double, rotation array<double>, translation array<double>, lat0 double, lon0 double, alt0 double, epsg int, rmse_holdout_m double, up_error_deg double, orientation string")
    return {"frame": frame, "residuals": got["residuals"]}, gates.georef_gate(frame)


def fusion_stage(r: Runner):
    """Depth pixels (table ``pixels`` of the stage ``depth``: image, row, col, z, conf, r, g, b, in the model's units) to one cloud and one mesh in local metres.

    Poses and depths move with the georeferenced frame; pixels that are unsure, far, coarse
    or grazing are left out. Small parts of the mesh go; its vertices know in how many
    images they are seen, and the report has the area that at least two see."""
    from ..functions.camera import unproject_pinhole
    from ..functions.geodesy import camera_centre, pose_to_enu
    from ..functions.vectors import mat_vec, transpose
    from ..operators import depth, gates, mesh, surface, visibility

    c, f = r.config["fusion"], r.table("georef", "frame").first()
    cams = r.table("sfm", "images").select("image", "fx", "fy", "cx", "cy", "r_cw", "t_cw")
    rot, t = pose_to_enu(F.col("r_cw"), F.col("t_cw"), f["scale"], F.array(*map(F.lit, f["rotation"])), [F.lit(v) for v in f["translation"]])
    cams = materialise(cams.withColumns({"r_cw": rot, "t_cw": t}))
    cams = cams.withColumns(dict(zip(("cam_x", "cam_y", "cam_z"), camera_centre(F.col("r_cw"), F.col("t_cw")))))
    maps = r.table("depth", "pixels").withColumn("z", F.col("z") * f["scale"])
    pix = maps.join(visibility.camera_table(cams), "image")
    pix = visibility.grazing_ok(pix, F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    fx = r.table("sfm", "images").agg(F.percentile("fx", 0.5)).first()[0]
    kept = depth.fusion_pixels(pix, fx, c["voxel_m"], c["max_depth_m"], c["footprint"])
    k = F.struct("fx", "fy", "cx", "cy")
    x, y, z = unproject_pinhole(F.col("col") + 0.5, F.col("row") + 0.5, F.col("z"), k)
    away = mat_vec(transpose(F.col("r_cw")), (x, y, z))
    rays = kept.select(*[(v + F.col(f"cam_{a}")).alias(a) for v, a in zip(away, "xyz")], "cam_x", "cam_y", "cam_z", F.col("conf").alias("w"), *[F.col(c).cast("double").alias(c) for c in "rgb"])
    voxels = materialise(depth.integrate(rays, c["voxel_m"], c["trunc_m"]))
    points = materialise(depth.surface_points(voxels, c["voxel_m"], c["least_weight"]))
    raw = surface.surface_mesh(voxels, c["voxel_m"], c["least_weight"])
    vertices, faces = surface.large_parts(*raw, c["min_component_frac"])
    sizes = maps.groupBy("image").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    vertices = materialise(visibility.view_counts(vertices, cams.join(sizes, "image"), maps, id_col="vid"))
    n, kept = raw[1].count(), faces.count()
    m = points.agg(F.count(F.lit(1)).alias("points")).crossJoin(mesh.coverage(faces, vertices))
    m = m.withColumns({"faces": F.lit(kept), "kept_face_ratio": F.lit(kept / max(n, 1))})
    gate = {"points": F.col("points") >= c["min_points"], "faces": F.col("faces") > c["min_faces"], "kept_faces": F.col("kept_face_ratio") >= 0.6}
    return {"points": points, "vertices": vertices, "faces": faces}, gates.gate(m, gate, ["points", "faces", "kept_face_ratio", "coverage"])


def completion_stage(r: Runner):
    """Height rasters to building records, regular buildings with roofs, and their roof and wall meshes."""
    from ..operators import buildings, gates

    cells, spec = r.table("products", "cells"), r.table("products", "spec").first()
    found = buildings.extract(cells, spec["gsd"], r.config["completion"])
    whole = materialise(buildings.regular_buildings(found, cells, spec["xmin"], spec["ymax"], spec["gsd"]))
    rec = buildings.records(found, spec["gsd"]).join(whole.drop("area_m2", "tops"), "component")
    roof = buildings.roof_meshes(whole.select("component", F.col("corners").alias("ring"), "kind", "params"))
    m = cells.agg(F.count(F.lit(1)).alias("cells"))
    return {"buildings": rec, "cells": found, "roofs": roof, "walls": buildings.building_walls(whole)}, gates.gate(m, {"grid": F.col("cells") > 0}, ["cells"])


#: Stages whose work is analytics; ``sfm`` and ``depth`` are tables that other tools write into the run's folder, with their gate rows.
STAGES = [Stage("products", products_stage, ["fusion"]), Stage("completion", completion_stage, ["products"])]
SURVEY_STAGES = [Stage("ingest", ingest_stage), Stage("georef", georef_stage, ["ingest", "sfm"]), Stage("fusion", fusion_stage, ["georef", "depth"]), *STAGES]
