"""Query op2: encode and decode every document."""

from __future__ import annotations

from .bpe import round_trip
from .common import table


def op2_bpe(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_bpe": op2_bpe}
ORACLES: dict = {}
