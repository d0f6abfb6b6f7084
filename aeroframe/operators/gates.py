"""Quality gates: named checks over metrics, with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(df: DataFrame, checks: dict[str, Column], metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """keys, passed, checks, failures and metrics (JSON) of each row. A check that is null has failed."""
    ok = {n: F.coalesce(c, F.lit(False)) for n, c in checks.items()}
    named = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("ok")) for n, c in ok.items()])
    return df.select(
        *(keys or []),
        F.forall(named, lambda x: x["ok"]).alias("passed"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in ok]), F.array(*ok.values())).alias("checks"),
        F.transform(F.filter(named, lambda x: ~x["ok"]), lambda x: x["name"]).alias("failures"),
        F.to_json(F.struct(*metrics)).alias("metrics"),
    )


def ingest_gate(frames: DataFrame, keys: list[str], min_frames: int = 20, min_coverage: float = 0.9) -> DataFrame:
    """Enough key frames, and telemetry over nine in ten of them. Columns: in_span, lat."""
    m = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("in_span") & F.col("lat").isNotNull()).cast("int")).alias("coverage"))
    return gate(m, {"min_keyframes": F.col("n") >= min_frames, "telemetry_coverage": F.col("coverage") >= min_coverage}, ["n", "coverage"], keys)


def sfm_gate(m: DataFrame, min_ratio: float = 0.8, max_reproj: float = 1.5, keys: list[str] | None = None) -> DataFrame:
    return gate(m, {"registered": F.col("registered_ratio") >= min_ratio, "reprojection": F.col("reproj_px") <= max_reproj}, ["registered_ratio", "reproj_px"], keys)


def georef_gate(m: DataFrame, max_rmse: float = 3.0, max_up: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """A missing hold-out error fails; a missing up error passes."""
    return gate(m, {"holdout_rmse": F.coalesce(F.col("rmse_holdout_m") <= max_rmse, F.lit(False)), "up_error": F.coalesce(F.col("up_error_deg") <= max_up, F.lit(True))}, ["rmse_holdout_m", "up_error_deg"], keys)


def depth_gate(m: DataFrame, min_accepted: float = 0.5, min_consistency: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    return gate(m, {"accepted": F.col("accepted_ratio") >= min_accepted, "consistency": F.col("consistency") >= min_consistency}, ["accepted_ratio", "consistency"], keys)


def fusion_gate(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return gate(m, {"kept_faces": F.col("kept_face_ratio") >= 0.6, "faces": F.col("faces") > 1000}, ["kept_face_ratio", "faces"], keys)


def products_gate(m: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Observed cells and hull share, ortho coverage (not asked where null: no ortho); a hull share under 0.3 is a warning."""
    out = gate(m, {"observed_cells": F.col("observed_cells") >= 1000, "hull_fraction": F.col("hull_frac") >= 0.08, "ortho": F.col("ortho_frac").isNull() | (F.col("ortho_frac") > 0.5)}, ["observed_cells", "hull_frac", "ortho_frac"], keys)
    return out.withColumn("warning", F.get_json_object("metrics", "$.hull_frac").cast("double") < 0.3)


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first reason that holds, else null."""
    out = F.lit(None).cast("string")
    for name, c in reversed(list(reasons.items())):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def sharp_enough(df: DataFrame, keys: list[str], score: str = "sharpness", pct: float = 15.0) -> DataFrame:
    """Rows at or above their clip's own percentile (exact, interpolated)."""
    cut = df.groupBy(*keys).agg(F.percentile(score, pct / 100.0).alias("__cut"))
    return df.join(cut, keys).where(F.col(score) >= F.col("__cut")).drop("__cut")


def usable_frames(poses: DataFrame, telemetry: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Registered frames with a position inside the telemetry's span; fewer than ``least`` in a run is an error."""
    out = poses.join(telemetry, [*keys, "name"]).where("lat IS NOT NULL AND alt IS NOT NULL AND coalesce(in_span, true)")
    short = out.groupBy(*keys).count().where(F.col("count") < least).limit(1).collect()
    if short or out.isEmpty():
        raise ValueError(f"fewer than {least} registered frames have telemetry")
    return out


def stage_rows(gates: DataFrame) -> DataFrame:
    """Checks maps to one row per check."""
    return gates.select("run_id", "stage", "passed", F.explode("checks").alias("check", "ok"))
