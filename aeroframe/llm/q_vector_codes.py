"""Query op12: codes and errors of all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, codebooks_digest, compress, with_label_error


def op12_vector_codes(spark, sf_dir):
    coded, codebooks = compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = with_label_error(coded)
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"), "label")


def _sql() -> str:
    """The rounds written out, one pair of tables each."""
    floor_div = "((s - ((s % n) + n) % n) // n)"
    text = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, embedding FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
x AS MATERIALIZED (SELECT id, (pos - 1) // w AS part, (pos - 1) % w AS pos, floor({SCALE} * e::DOUBLE)::BIGINT AS x
      FROM (SELECT id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos, len(embedding) // {PARTS} AS w FROM v)),
c0 AS MATERIALIZED (SELECT part, id - 1 AS entry, pos, x AS c FROM x WHERE id <= {ENTRIES}),"""
    for r in range(ROUNDS + 1):
        text += f"""
a{r} AS MATERIALIZED (SELECT id, part, entry, d FROM (SELECT x.id, x.part, c.entry, sum((x.x - c.c) * (x.x - c.c)) AS d
      FROM x JOIN c{r} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY d, entry) = 1),"""
        if r < ROUNDS:
            text += f"""
c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.c, c.c)::BIGINT AS c FROM c{r} c LEFT JOIN
      (SELECT part, entry, pos, {floor_div} AS c FROM (SELECT x.part, a.entry, x.pos, sum(x.x)::HUGEINT AS s, count(*)::HUGEINT AS n
       FROM x JOIN a{r} a ON a.id = x.id AND a.part = x.part GROUP BY ALL)) m USING (part, entry, pos)),"""
    return text + f"""
o AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY id)
SELECT v.vec_id, v.label, o.code, o.error, sum(o.error) OVER (PARTITION BY v.label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM v JOIN o USING (id)"""


QUERIES = {"op12_vector_codes": op12_vector_codes}
ORACLES = {"op12_vector_codes": _sql()}
