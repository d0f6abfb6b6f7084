"""The list of registered queries and adapter views over the given tables.

Views have the same text in both engines: integer arithmetic first, then one
division, so that both see the same doubles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def twin(name: str, sql: str) -> None:
    """Gives a registered query its SQL twin."""
    ORACLES[name] = sql


# Points of a cloud.
PTS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast((l_partkey*37+l_linenumber*11)%1000 as double)/10 AS x,
  cast((l_orderkey*53+l_suppkey*17)%1000 as double)/10 AS y, l_extendedprice/5000 AS z FROM lineitem"""
# Fewer points, with an id.
SPOTS = """SELECT p_partkey AS id, cast((p_partkey*37)%1000 as double)/10 AS x, cast((p_partkey*53)%997 as double)/10 AS y,
  cast((p_partkey*29)%211 as double)/10 AS z, cast((p_partkey*37)%256 as int) AS r, cast((p_partkey*59)%256 as int) AS g, cast((p_partkey*83)%256 as int) AS b FROM part"""
# Cameras.
CAMS = """SELECT s_suppkey AS cam_order, cast((s_suppkey*29)%100 as double) AS cam_x, cast((s_suppkey*43)%100 as double) AS cam_y, 60+s_acctbal/1000 AS cam_z FROM supplier"""
# Highest points on a dense grid of 50 by 50 cells of 2 m; holes are null.
GRID = f"""SELECT g.r AS row, c.c AS col, m.value FROM (SELECT cast(unnest(range(50)) AS bigint) AS r) g, (SELECT cast(unnest(range(50)) AS bigint) AS c) c
  LEFT JOIN (SELECT cast(floor((100-y)/2) AS bigint) AS row, cast(floor(x/2) AS bigint) AS col, max(z) AS value FROM ({PTS}) p WHERE z > 8 GROUP BY 1, 2) m ON m.row = g.r AND m.col = c.c"""
# Such a grid for every survey of a thousand order numbers: cells grow in number with the table.
GRIDS = f"""SELECT s.survey, g.r AS row, c.c AS col, m.value FROM (SELECT DISTINCT cast(floor(l_orderkey/1000) AS bigint) AS survey FROM lineitem) s, (SELECT cast(unnest(range(50)) AS bigint) AS r) g, (SELECT cast(unnest(range(50)) AS bigint) AS c) c
  LEFT JOIN (SELECT cast(floor(l_orderkey/1000) AS bigint) AS survey, cast(floor((100-y)/2) AS bigint) AS row, cast(floor(x/2) AS bigint) AS col, max(z) AS value FROM ({PTS}) p WHERE z > 8 GROUP BY 1, 2, 3) m ON m.survey = s.survey AND m.row = g.r AND m.col = c.c"""
# Telemetry-like samples and frames: seconds, value, key.
SAMPLES = "SELECT user_id, event_id AS seq, epoch_us(ts)/1e6 AS t, value FROM events WHERE event_type = 'click'"
FRAMES = "SELECT user_id, event_id, epoch_us(ts)/1e6 AS t FROM events WHERE event_type = 'view'"


class Views:
    """The adapter views as DataFrames."""

    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def table(self, name):
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def of(self, text: str):
        """A view's text over named tables, without registering anything."""
        import re

        names = set(re.findall(r"\b(lineitem|part|supplier|events|customer|orders|nation|region|pages|conversations|documents)\b", text))
        return self.spark.sql(_braced(text, names), **{n: self.table(n) for n in names})

    def pts(self):
        return self.of(PTS)

    def spots(self):
        return self.of(SPOTS)

    def cams(self):
        return self.of(CAMS)

    def grid(self):
        from pyspark.sql import functions as F

        from ..functions.grids import cell
        from ..operators.raster import dense, rasterise_max

        row, col = cell("x", "y", 0.0, 100.0, 2.0)
        return dense(rasterise_max(self.pts().where("z > 8"), row, col), 50, 50).select(F.col("row"), F.col("col"), "value")

    def grids(self):
        """One grid a survey."""
        from pyspark.sql import functions as F

        from ..functions.grids import cell
        from ..operators.raster import dense, rasterise_max

        p = self.pts().withColumn("survey", F.floor(F.col("l_orderkey") / 1000))
        row, col = cell("x", "y", 0.0, 100.0, 2.0)
        return dense(rasterise_max(p.where("z > 8"), row, col, keys=["survey"]), 50, 50, p.select("survey").distinct())

    def samples(self, kind: str = "click"):
        from pyspark.sql import functions as F

        e = self.table("events").where(F.col("event_type") == kind)
        t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6
        return e.select("user_id", F.col("event_id").alias("seq"), t.alias("t"), "value")

    def frames(self):
        return self.samples("view").withColumnRenamed("seq", "event_id").drop("value")


def _braced(text: str, names: set) -> str:
    """Table names after FROM or JOIN become parameters of spark.sql."""
    import re

    return re.sub(rf"(?<=FROM |JOIN )({'|'.join(sorted(names))})\b", r"{\1}", text)
