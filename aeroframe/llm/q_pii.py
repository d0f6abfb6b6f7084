"""Query op10: replace the personal data of every document by surrogates."""

from __future__ import annotations

from .common import table
from .pii import replace_pii

#: The production key is a parameter; this one belongs to the registered query.
KEY = "registered query"


def op10_pii(spark, sf_dir):
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict = {}
