"""Query op11: divergences between the sources of each language."""

from __future__ import annotations

from .common import table
from .divergence import divergences


def op11_source_divergence(spark, sf_dir):
    return divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+')) AS term FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS df FROM t GROUP BY lang, source, term),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(df) >= 10),
v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k ON k.lang = g.lang GROUP BY g.lang),
g AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
      LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        (1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.n + 2 * v.v)::HUGEINT)::BIGINT AS p,
        (1 + (1000000000 * (k.n + 2)::HUGEINT) // (v.n + 2 * v.v)::HUGEINT)::BIGINT AS q
      FROM g JOIN v ON v.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                 FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
        ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLES = {"op11_source_divergence": OP11_SQL}
