"""Query op13: bytes and tokens of every document."""

from __future__ import annotations

from .common import table
from .token_counts import count_tokens

LIMIT = 1024


def op13_token_counts(spark, sf_dir):
    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("over_limit", out["n_tokens"] > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict = {}
