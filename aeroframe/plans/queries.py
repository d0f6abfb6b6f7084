"""Registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from . import q_cloud, q_geometry, q_more, q_series, q_surface  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
