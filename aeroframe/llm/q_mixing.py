"""Query op6: mix all documents to the sources' target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .mixing import MAX_COPIES, TOTAL_SHARE, WEIGHTS, mix, n_words, source_key, targets


def op6_mix_sources(spark, sf_dir):
    out = mix(table(spark, sf_dir, "documents"))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_targets(spark, sf_dir):
    """Every document's size, and its source's size and target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", n_words(F.col("text")).alias("size"), source_key(F.col("source")).alias("sk"))
    goal = targets(docs.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_keys")))
    return docs.join(goal, "sk").select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, {list(WEIGHTS)}[r % {len(WEIGHTS)} + 1]::DOUBLE AS w, {float(MAX_COPIES)}::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, {TOTAL_SHARE}::DOUBLE * sum(source_size) OVER () AS total, coalesce(sum(cap) OVER b, 0) AS before, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest
      FROM w WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - before) / rest, cap / w) FILTER (WHERE (total - before) / rest * w <= cap) AS level FROM o)
SELECT d.doc_id, d.size::BIGINT AS size, o.source_size, round(CASE WHEN level IS NULL OR level * w > cap THEN cap ELSE level * w END, 4) AS target
FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l
"""

QUERIES = {"op6_mix_sources": op6_mix_sources, "mix_targets": mix_targets}
ORACLES = {"mix_targets": MIX_SQL}
