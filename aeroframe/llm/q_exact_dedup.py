"""Query op9: exact dedup over all documents."""

from __future__ import annotations

from .common import table
from .exact_dedup import duplicate_groups


def op9_exact_dedup(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": OP9_SQL}
