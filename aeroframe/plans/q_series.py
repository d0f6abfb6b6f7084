"""Queries over time series and text: interpolation, windows, gaps, keyframes, telemetry text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth, estimate, gates, interpolate
from ..sources import telemetry
from ..streaming import telemetry as live
from .registry import FRAMES, SAMPLES, Views, query

_SIDES = f"""s AS ({SAMPLES}), f AS ({FRAMES}), l AS (SELECT user_id, t, arg_max(value, seq) AS v FROM s WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT user_id, t, arg_min(value, seq) AS v FROM s WHERE value IS NOT NULL GROUP BY ALL),
  a AS (SELECT f.*, l.t AS ta, l.v AS va FROM f ASOF LEFT JOIN l ON f.user_id = l.user_id AND f.t >= l.t), b AS (SELECT a.*, r.t AS tb, r.v AS vb FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.t <= r.t)"""


@query(f"WITH {_SIDES} SELECT user_id, event_id, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR tb = ta THEN va ELSE va + (vb-va)*(t-ta)/(tb-ta) END, 4) AS value FROM b")
def interp_linear(spark, d):
    v = Views(spark, d)
    return interpolate.interpolate(v.samples(), v.frames(), ["user_id"], "value").select("user_id", "event_id", F.round("value", 4).alias("value"))


@query()
def interp_angle(spark, d):
    v = Views(spark, d)
    s = v.samples().withColumn("value", interpolate.wrap_degrees(F.col("value") * 37))
    return interpolate.interpolate(s, v.frames(), ["user_id"], "value", angle=True).select("user_id", "event_id", F.round("value", 3).alias("value"))


_UNWRAP = """WITH e AS (SELECT user_id, event_id, ts, (value*37) % 360 - 180 AS v FROM events), s AS (SELECT *, v - lag(v) OVER w AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  f AS (SELECT *, CASE WHEN st IS NULL OR abs(st) < 180 THEN 0 ELSE (((st+180) % 360 + 360) % 360 - 180) - st END AS fix FROM s)
  SELECT event_id, round(v + sum(fix) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS v FROM f"""


@query(_UNWRAP)
def angle_unwrap(spark, d):
    e = Views(spark, d).table("events").withColumn("v", (F.col("value") * 37) % 360 - 180)
    return interpolate.unwrap_degrees(e, "v", ["user_id"], ["ts", "event_id"]).select("event_id", F.round("v", 4).alias("v"))


@query(f"""WITH s AS ({SAMPLES}), f AS ({FRAMES}), p AS (SELECT user_id, min(t)-0.5 AS a, max(t)+0.5 AS b FROM s GROUP BY user_id), g AS (SELECT f.user_id, coalesce(f.t BETWEEN a AND b, false) AS ok FROM f LEFT JOIN p USING (user_id)),
  m AS (SELECT user_id, count(*) AS n, avg(ok::int) AS c FROM g GROUP BY user_id) SELECT user_id, n >= 10 AND c >= 0.9 AS passed FROM m""")
def ingest_gate(spark, d):
    v = Views(spark, d)
    f = v.frames().join(interpolate.spans(v.samples(), ["user_id"]), "user_id", "left")
    f = f.withColumns({"in_span": F.coalesce(F.col("t").between(F.col("span_from"), F.col("span_to")), F.lit(False)), "lat": F.lit(1.0)})
    return gates.ingest_gate(f, ["user_id"], 10).select("user_id", "passed")


@query("""WITH x AS (SELECT o_custkey, epoch_us(o_orderdate)/86400000000 AS day FROM orders), g AS (SELECT o_custkey, CASE WHEN day - lag(day) OVER (PARTITION BY o_custkey ORDER BY day) > 90 THEN 1 ELSE 0 END AS cut FROM x)
  SELECT o_custkey, cast(1 + sum(cut) AS bigint) AS islands FROM g GROUP BY o_custkey""")
def gap_islands(spark, d):
    o = Views(spark, d).table("orders").select("o_custkey", (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)") / 86400000000).alias("day"))
    return interpolate.gap_islands(o, ["o_custkey"], "day", 90.0).groupBy("o_custkey").agg(F.max("island").cast("long").alias("islands"))


@query("""SELECT event_type, cast(floor(epoch_us(ts)/1e6/86400) AS bigint) AS bucket, arg_min(event_id, event_id) AS event_id, any_value(value) AS value FROM (
  SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type, floor(epoch_us(ts)/1e6/86400) ORDER BY value DESC, event_id) = 1) GROUP BY 1, 2""")
def bucket_best(spark, d):
    e = Views(spark, d).table("events").withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6)
    return interpolate.bucket_best(e, ["event_type"], "t", 86400.0, "value", "event_id")


@query("""WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), s AS (SELECT *, (n-1)/49::double AS st FROM e)
  SELECT event_type, event_id FROM s WHERE n <= 50 OR round_even(round_even(i/st, 0)*st, 0) = i""")
def decimate(spark, d):
    return interpolate.decimate(Views(spark, d).table("events"), ["event_type"], ["ts", "event_id"], 50).select("event_type", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  s AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(n-12, 0)+1, 8), greatest(n-12, 0)))) AS st FROM e)
  SELECT event_id, cast(st AS bigint) AS window_start FROM s WHERE i >= st AND i < st+12 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(2*i-2*st-(least(12, n)-1)), st) = 1""")
def central_windows(spark, d):
    return interpolate.central_windows(Views(spark, d).table("events"), ["user_id"], ["ts", "event_id"], 12, 8).select("event_id", F.col("window_start").cast("long").alias("window_start"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.15) AS c FROM lineitem GROUP BY 1) USING (l_suppkey) WHERE l_extendedprice >= c")
def sharp_percentile(spark, d):
    t = Views(spark, d).table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return gates.sharp_enough(t, ["l_suppkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


def _candidates(spark, d):
    e = Views(spark, d).samples("view").withColumnRenamed("seq", "frame_index")
    e = e.withColumns({"sharpness": F.col("value"), "step_px": F.col("value") % 9, "ratio": F.lit(0.97)})
    cut = e.groupBy("user_id").agg(F.percentile("sharpness", 0.15).alias("cut"))
    return e.join(cut, "user_id")


@query()
def keyframes(spark, d):
    return depth.relaxed_keyframes(_candidates(spark, d), "user_id", least=4, max_gap=86400.0)


@query("SELECT CASE WHEN o_orderkey % 5 = 2 THEN 'hold' ELSE 'train' END AS part, count(*) AS n, round(sqrt(avg(o_totalprice*o_totalprice)), 4) AS rmse FROM orders GROUP BY 1")
def holdout_rmse(spark, d):
    train, hold = estimate.holdout(Views(spark, d).table("orders"), 5, "o_orderkey")
    one = lambda df, n: df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("o_totalprice") * F.col("o_totalprice"))), 4).alias("rmse"))
    return one(train, "train").unionByName(one(hold, "hold"))


@query("""(SELECT c_custkey AS k, 'both' AS side FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders) UNION ALL (SELECT c_custkey, 'left' FROM customer EXCEPT SELECT o_custkey, 'left' FROM orders)""")
def key_sets(spark, d):
    v = Views(spark, d)
    a, b = v.table("customer").select(F.col("c_custkey").alias("k")), v.table("orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("left")))


@query("SELECT s_suppkey, n AS neighbour FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) JOIN (SELECT s_suppkey AS n, row_number() OVER (ORDER BY s_suppkey) AS j FROM supplier) ON abs(i-j) <= 2 AND i <> j")
def band_join(spark, d):
    from ..operators.visibility import neighbour_pairs

    return neighbour_pairs(Views(spark, d).table("supplier"), 2, "s_suppkey").select("s_suppkey", "neighbour")


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling(spark, d):
    w = live.windowed(Views(spark, d).table("events"), "ts", ["event_type"], "value", "1 hour")
    return w.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def flight_segments(spark, d):
    return live.segments(Views(spark, d).table("events"), "ts", ["user_id"], "6 hours").select("user_id", "start", "end", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_report(spark, d):
    return Views(spark, d).table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT page_id, md5(regexp_replace(replace(html, chr(13)||chr(10), chr(10)), '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def tag_strip(spark, d):
    return Views(spark, d).table("pages").select("page_id", F.md5(F.encode(telemetry.strip_tags(F.col("html")), "UTF-8")).alias("digest"))


@query(r"""SELECT conv_id, turn, cast(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n\s*\n')) AS int) AS n FROM conversations""")
def block_split(spark, d):
    return Views(spark, d).table("conversations").select("conv_id", "turn", F.size(telemetry.blocks(F.col("text"))).alias("n"))


@query(r"""SELECT event_id, 'k' AS key, cast(regexp_extract(props, '(\d+)', 1) AS double) AS value FROM events UNION ALL SELECT event_id, 'alt', round(value, 2) FROM events""")
def kv_extract(spark, d):
    e = Views(spark, d).table("events").withColumn("text", F.concat(F.replace("props", F.lit('"'), F.lit("")), F.format_string(" [ALT: %.2f]", "value")))
    return telemetry.key_values(e, "text", ["event_id"]).select("event_id", "key", "value")


_FLIGHT = """SELECT event_id AS seq, cast(event_id % 40000 AS double)/10 AS t, 0.1::double AS dt, 47+cast(event_id%1000 as double)/10000 AS lat, 8+cast(event_id%700 as double)/10000 AS lon, cast(user_id AS double) AS rel_alt, 400+cast(user_id AS double) AS abs_alt,
  cast(event_id%360 as double)-180 AS gimbal_yaw, -60.0::double AS gimbal_pitch, 0.0::double AS gimbal_roll FROM events"""


@query(f"SELECT seq, t, round(lat, 7) AS lat, round(lon, 7) AS lon, rel_alt, abs_alt, gimbal_yaw, gimbal_pitch FROM ({_FLIGHT})")
def srt_round_trip(spark, d):
    """Samples written as subtitle blocks and read back by the block parser."""
    from ..sources.files import srt_text

    e = Views(spark, d).table("events")
    n = lambda m, q: (F.col("event_id") % m).cast("double") / q
    s = e.select(F.col("event_id").alias("seq"), n(40000, 10).alias("t"), F.lit(0.1).alias("dt"), (47 + n(1000, 10000)).alias("lat"), (8 + n(700, 10000)).alias("lon"), F.col("user_id").cast("double").alias("rel_alt"), (400 + F.col("user_id")).cast("double").alias("abs_alt"), (n(360, 1) - 180).alias("gimbal_yaw"), F.lit(-60.0).alias("gimbal_pitch"), F.lit(0.0).alias("gimbal_roll"))
    return telemetry.usable(telemetry.parse_blocks(srt_text(s))).select("seq", F.round("t", 3).alias("t"), "lat", "lon", "rel_alt", "abs_alt", "gimbal_yaw", "gimbal_pitch")


@query("SELECT o_orderkey, round(cast(o_orderkey%24 as double)*3600 + (o_orderkey%60)*60 + o_orderkey%59 + (o_orderkey%1000)/1000.0::double, 3) AS seconds FROM orders")
def clock_text(spark, d):
    k = F.col("o_orderkey")
    text = F.format_string("%02d:%02d:%02d,%03d", k % 24, k % 60, k % 59, k % 1000)
    return Views(spark, d).table("orders").select("o_orderkey", F.round(telemetry.clock_seconds(text), 3).alias("seconds"))


@query()
def synchronised_frames(spark, d):
    """All telemetry fields at every frame of a clip, in one pass."""
    v = Views(spark, d)
    s = v.samples().select("user_id", "seq", "t", *[(F.col("value") / (k + 0.7)).alias(f) for k, f in enumerate(interpolate.SYNC_FIELDS)])
    return interpolate.synchronise(s, v.frames().withColumn("name", F.format_string("frame_%06d", "event_id")), ["user_id"])


@query("SELECT count(*) AS images, cast(sum(l_linenumber) AS bigint) AS keypoints, count(*) FILTER (WHERE l_linenumber > 3) AS verified FROM lineitem")
def model_metrics(spark, d):
    return Views(spark, d).table("lineitem").agg(F.count(F.lit(1)).alias("images"), F.sum("l_linenumber").alias("keypoints"), F.count_if(F.col("l_linenumber") > 3).alias("verified"))


@query("""WITH b AS (SELECT c_nationkey AS building_id, abs(c_acctbal)/70 AS mid_m FROM customer), r AS (SELECT *, CASE WHEN mid_m - lag(mid_m) OVER (PARTITION BY building_id ORDER BY mid_m) > 1.2 THEN 1 ELSE 0 END AS cut FROM b),
  w AS (SELECT building_id, 1+sum(cut) AS rows, count(*) AS n, min(mid_m) AS low FROM r GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT building_id, rows + CASE WHEN building_id % 2 = 0 AND low > 2.5 THEN 1 ELSE 0 END AS rows FROM w)
  SELECT n_nationkey AS building_id, cast(coalesce(rows, CASE WHEN n_nationkey > 0 THEN greatest(1, round_even(n_nationkey*1.1::double/3, 0)) END) AS int) AS floors FROM nation LEFT JOIN x ON building_id = n_nationkey""")
def storeys(spark, d):
    from ..operators.buildings import floors

    v = Views(spark, d)
    w = v.table("customer").select(F.col("c_nationkey").alias("building_id"), (F.abs("c_acctbal") / 70).alias("mid_m"))
    e = v.table("nation").select(F.col("n_nationkey").alias("building_id"), (F.col("n_nationkey") * F.lit(1.1)).alias("eave_height_m"))
    return floors(w, e.where("building_id % 2 = 0").select("building_id"), e).select("building_id", F.col("floors").cast("int").alias("floors"))
