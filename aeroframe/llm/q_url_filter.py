"""Query op8: judge every page's url."""

from __future__ import annotations

from .common import table
from .url_filter import RULES, host_path, judge, rule_verdict


def op8_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def url_rules(spark, sf_dir):
    """What the rules alone say of every page's url."""
    rule, verdict = rule_verdict()
    return host_path(table(spark, sf_dir, "pages")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


_TABLE = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
URL_SQL = f"""
WITH p AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES {_TABLE}) AS r(verdict, host, path)),
f AS (SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC) AS n
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT u.page_id, u.host, u.path, f.rule, f.verdict FROM u LEFT JOIN f ON f.page_id = u.page_id AND f.n = 1
"""

QUERIES = {"op8_url_filter": op8_url_filter, "url_rules": url_rules}
ORACLES = {"url_rules": URL_SQL}
