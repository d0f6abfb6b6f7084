"""Run settings: defaults, deep merge, dotted overrides."""

from __future__ import annotations

import copy
import hashlib
import json

from ..operators import buildings, estimate

DEFAULTS = {
    "ingest": {"candidate_hz": 5.0, "min_keyframes": 20, "sharpness_reject_pct": 15.0, "max_gap_s": 2.0},
    "sfm": {"min_registered_ratio": 0.8, "max_reproj_px": 1.5},
    "georef": dict(estimate.CONFIG),
    "fusion": {"voxel_m": 0.3, "trunc_m": 0.9, "max_depth_m": 300.0, "footprint": 1.5, "least_weight": 1.0, "min_points": 1000, "min_faces": 1000, "min_component_frac": 0.01},
    "products": {"gsd": 0.25, "max_window_m": 40.0, "slope": 0.15, "dh0": 0.3, "dh_max": 3.0, "fill_cells": 6},
    "completion": dict(buildings.CONFIG),
}


def merge(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``, dictionaries key by key; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def coerce(text: str):
    """A setting's text as the value it looks like: JSON where it parses, yes/no words, else the text."""
    low = text.strip().lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    if low in ("null", "none", "~", ""):
        return None
    try:
        return json.loads(text)
    except ValueError:
        return text


def override(config: dict, settings: list[str]) -> dict:
    """``a.b=value`` settings applied in order."""
    for s in settings:
        path, _, value = s.partition("=")
        if not _:
            raise ValueError(f"not a setting: {s}")
        patch = coerce(value)
        for key in reversed(path.split(".")):
            patch = {key: patch}
        config = merge(config, patch)
    return config


def stable_hash(obj) -> str:
    return hashlib.sha1(json.dumps(obj, sort_keys=True, default=str).encode()).hexdigest()[:16]
