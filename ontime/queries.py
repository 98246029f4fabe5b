"""Driver queries over the test tables, and their SQL.

The tables have no flights, so roles are mapped: aircraft is user_id, departure is ts, the label is
event_type = 'error', a reading is value (all of events); lineitem stands for flight facts, routes
are supplier nation to customer nation. For whole chains events also give raw flights and weather
reports, suppliers the stations, nations the airports and their zones.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontime import columns as C
from ontime.functions import scalar as S
from ontime.operators import aggregate as A
from ontime.operators import clean as P
from ontime.operators import encode as T
from ontime.operators import ensemble as V
from ontime.operators import features as W
from ontime.operators import graph as G
from ontime.operators import metrics as M
from ontime.operators import models
from ontime.operators import places, sketches
from ontime.operators import timejoin as J
from ontime.operators import trees
from ontime.operators import validate as K
from ontime.plans import flights
from ontime.session import shared_folder
from ontime.sources import bucketed, io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _uniform(seed: int, *keys: str) -> str:
    """functions.scalar.uniform in SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys]])
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/ontime-queries-{uuid.uuid4().hex[:12]}/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("label", (F.col("event_type") == "error").cast("int"))


def targets_and_readings(spark, d) -> DataFrame:
    """Error events with the earlier readings of their user between 24 and 2 hours before."""
    e = events(spark, d)
    targets = J.window_bounds(e.where("label = 1").select("event_id", "user_id", "ts"), "ts", 24, 2, ("w_start", "w_end"))
    readings = e.where("label = 0").select(
        F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"), F.col("value").alias("reading"), F.col("event_type").alias("kind"), (F.col("event_id") % 5).alias("distance")
    )
    return J.interval_join(targets, readings, [("user_id", "r_user")], "r_ts", "w_start", "w_end", longest_hours=22)


_READINGS = """t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, ts, value, event_type AS kind, event_id % 5 AS d FROM events WHERE event_type <> 'error'),
j AS (SELECT t.event_id, r.value, r.kind, r.d, (epoch_us(t.ts) - epoch_us(r.ts)) / 60000000.0 AS m
  FROM t LEFT JOIN r ON t.user_id = r.user_id AND r.ts BETWEEN t.ts - INTERVAL 24 HOUR AND t.ts - INTERVAL 2 HOUR)"""


@query(f"""WITH {_READINGS},
w AS (SELECT *, (CASE WHEN d = 0 THEN 1.0 ELSE 1.0 / d END)::DOUBLE * (CASE WHEN m = 0 THEN 1.0 ELSE 1.0 / m END)::DOUBLE AS w FROM j)
SELECT event_id, round(sum(value * w) / sum(CASE WHEN value IS NOT NULL THEN w END), 6) AS reading FROM w GROUP BY event_id""")
def interval_join_idw(spark, d):
    j = targets_and_readings(spark, d)
    return A.collapse_readings(j, ["event_id"], ["reading"], [], "distance", "ts", "r_ts", digits=6)


@query(f"""WITH {_READINGS}, c AS (SELECT event_id, kind, count(*) AS n FROM j WHERE kind IS NOT NULL GROUP BY ALL),
b AS (SELECT event_id, kind, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, kind) AS i FROM c)
SELECT t.event_id, b.kind FROM t LEFT JOIN b ON t.event_id = b.event_id AND i = 1""")
def interval_join_mode(spark, d):
    return A.collapse_readings(targets_and_readings(spark, d), ["event_id"], [], ["kind"], "distance", "ts", "r_ts")


@query(f"WITH {_READINGS} SELECT event_id, count(value) AS n FROM j GROUP BY event_id")
def interval_join_bucketed(spark, d):
    """The interval join without buckets of time gives the same."""
    e = events(spark, d)
    targets = J.window_bounds(e.where("label = 1").select("event_id", "user_id", "ts"), "ts", 24, 2, ("w_start", "w_end"))
    readings = e.where("label = 0").select(F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"), "value")
    j = J.interval_join(targets, readings, [("user_id", "r_user")], "r_ts", "w_start", "w_end", "left", buckets=False)
    return j.groupBy("event_id").agg(F.count("value").alias("n"))


#: Hours before an event: most spans have two, one in fifty has weeks.
_SPAN = "CASE WHEN event_id % 50 = 0 THEN 24 * (event_id % 700 // 50 + 7) ELSE 2 END"


@query(f"""WITH t AS (SELECT event_id, user_id, ts, {_SPAN} AS h FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts, value FROM events WHERE event_id % 2 = 1)
SELECT event_id, count(r.value) AS n, round(coalesce(sum(r.value), 0), 6) AS total FROM t
LEFT JOIN r ON t.user_id = r.user_id AND r.ts BETWEEN t.ts - to_hours(CAST(h AS BIGINT)) AND t.ts GROUP BY event_id""")
def interval_join_any_length(spark, d):
    """Spans of two hours and of weeks in one join: the lengths are measured, long spans have coarser buckets."""
    e = table(spark, d, "events")
    t = e.where("event_id % 2 = 0").select("event_id", "user_id", F.col("ts").alias("w_end"), S.hours_before(F.col("ts"), F.expr(_SPAN.replace("//", "div"))).alias("w_start"))
    r = e.where("event_id % 2 = 1").select(F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"), "value")
    j = J.interval_join(t, r, [("user_id", "r_user")], "r_ts", "w_start", "w_end", "left")
    return j.groupBy("event_id").agg(F.count("value").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"))


@query("""SELECT * FROM (SELECT s_suppkey, n_nationkey, abs(s_suppkey * 7 % 31 - n_nationkey) AS distance,
  CAST(rank() OVER (PARTITION BY s_suppkey ORDER BY abs(s_suppkey * 7 % 31 - n_nationkey)) AS INTEGER) AS nearness
  FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey) WHERE nearness <= 3""")
def nearest_n_rank(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    pairs = s.join(n, F.col("s_nationkey") % 5 == F.col("n_regionkey"))
    pairs = pairs.select("s_suppkey", "n_nationkey", F.abs(F.col("s_suppkey") * 7 % 31 - F.col("n_nationkey")).alias("distance"))
    return J.nearest(pairs, "s_suppkey", "distance", 3, "nearness")


@query("""SELECT event_id, CAST(CASE WHEN ts - INTERVAL 2 HOUR >= p AND ts - INTERVAL 12 HOUR < p THEN l ELSE 0 END AS INTEGER) AS prev_label
FROM (SELECT *, lag(ts) OVER w AS p, lag(CAST(event_type = 'error' AS INTEGER)) OVER w AS l FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def prev_event_flag(spark, d):
    return W.previous_flag(events(spark, d), "user_id", "ts", "label", "prev_label", tie=["event_id"]).select("event_id", "prev_label")


@query("""SELECT event_id, round(avg(CAST(value > 20 AS INTEGER)) OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id
  ROWS BETWEEN 20 PRECEDING AND 5 PRECEDING), 9) AS status FROM events""")
def rolling_status(spark, d):
    e = events(spark, d).withColumn("late", (F.col("value") > 20).cast("int")).withColumn("airport", F.col("user_id") % 10)
    out = W.rolling_share(e, ["event_type", "airport"], "ts", "late", "status", tie=["event_id"])
    return out.select("event_id", F.round("status", 9).alias("status"))


@query("""SELECT event_id, round(avg(CAST(value > 20 AS INTEGER)) OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts
  RANGE BETWEEN INTERVAL 20 HOUR PRECEDING AND INTERVAL 2 HOUR PRECEDING), 9) AS status FROM events""")
def rolling_status_by_time(spark, d):
    e = events(spark, d).withColumn("late", (F.col("value") > 20).cast("int")).withColumn("airport", F.col("user_id") % 10)
    out = W.rolling_share(e, ["event_type", "airport"], "ts", "late", "status", first=-20, least_hours=2)
    return out.select("event_id", F.round("status", 9).alias("status"))


_HUB = "CASE WHEN event_id % 10 < 7 THEN 0 WHEN event_id % 10 = 9 THEN NULL ELSE user_id END"


@query(f"""WITH e AS (SELECT event_id, ts, {_HUB} AS hub, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events)
SELECT event_id, round(avg(v) OVER (PARTITION BY hub ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 2 PRECEDING), 6) AS status,
  CAST(CASE WHEN hub IS NOT NULL AND ts - INTERVAL 1 HOUR >= lag(ts) OVER w AND ts - INTERVAL 12 HOUR < lag(ts) OVER w THEN lag(event_id) OVER w ELSE 0 END AS BIGINT) AS previous
FROM e WINDOW w AS (PARTITION BY hub ORDER BY ts, event_id)""")
def hot_history(spark, d):
    """Seven rows of ten belong to one key: its history is cut into blocks of twelve hours. Null keys have no previous row."""
    e = events(spark, d).select("event_id", "ts", F.expr(_HUB).alias("hub"), F.expr("CASE WHEN event_id % 11 <> 0 THEN value END").alias("v"), F.col("event_id").alias("id"))
    out = W.rolling_share(e, ["hub"], "ts", "v", "status", -30, -2, tie=["event_id"], block_hours=12)
    out = W.previous_flag(out, "hub", "ts", "id", "previous", 1, 12, tie=["event_id"], block_hours=12)
    return out.select("event_id", F.round("status", 6).alias("status"), "previous")


def holey_part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("p_size"))


_HOLEY = "h AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS p_size FROM part)"


@query(f"WITH {_HOLEY} SELECT p_partkey, round(coalesce(p_size, avg(p_size) OVER (PARTITION BY p_brand)), 9) AS p_size_mean FROM h")
def fill_group_mean(spark, d):
    return W.fill_group_mean(holey_part(spark, d), ["p_size"], ["p_brand"]).select("p_partkey", F.round("p_size_mean", 9).alias("p_size_mean"))


@query(f"WITH {_HOLEY} SELECT p_partkey, coalesce(p_size, quantile_disc(p_size, 0.5) OVER (PARTITION BY p_brand)) AS p_size_median FROM h")
def fill_group_median(spark, d):
    return W.fill_group_median(holey_part(spark, d), ["p_size"], ["p_brand"]).select("p_partkey", "p_size_median")


@query(f"""WITH {_HOLEY}, c AS (SELECT p_brand, p_size, count(*) AS n FROM h WHERE p_size IS NOT NULL GROUP BY ALL),
m AS (SELECT p_brand, p_size AS mode FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1)
SELECT p_partkey, coalesce(p_size, mode, 0) AS p_size_mode FROM h LEFT JOIN m USING (p_brand)""")
def fill_group_mode(spark, d):
    return W.fill_group_mode(holey_part(spark, d), ["p_size"], ["p_brand"], 0).select("p_partkey", "p_size_mode")


@query(f"""WITH {_HOLEY}, m AS (SELECT p_brand, avg(p_size) AS mean FROM h WHERE p_partkey % 2 = 0 GROUP BY p_brand)
SELECT p_partkey, round(coalesce(p_size, mean), 9) AS p_size_mean FROM h LEFT JOIN m USING (p_brand)""")
def fill_from_train(spark, d):
    """Group means of training rows (even keys) fill all rows."""
    h = holey_part(spark, d)
    return W.fill_from_train(h, h.where("p_partkey % 2 = 0"), ["p_size"], ["p_brand"]).select("p_partkey", F.round("p_size_mean", 9).alias("p_size_mean"))


def typed_lines(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


@query("""SELECT l_returnflag, p_type, n, CAST(rank AS INTEGER) AS rank FROM (SELECT l_returnflag, p_type, count(*) AS n,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, p_type) AS rank
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, p_type) WHERE rank <= 3""")
def topk_category_per_class(spark, d):
    return A.top_categories(typed_lines(spark, d), "l_returnflag", "p_type", 3)


@query("""SELECT l_orderkey, l_partkey, l_quantity, NULL::BIGINT AS l_suppkey FROM lineitem WHERE l_linenumber % 2 = 1
UNION ALL SELECT l_orderkey, NULL, l_quantity, l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0""")
def union_by_name_missing(spark, d):
    li = table(spark, d, "lineitem")
    return io.union_all([li.where("l_linenumber % 2 = 1").select("l_orderkey", "l_partkey", "l_quantity"), li.where("l_linenumber % 2 = 0").select("l_suppkey", "l_quantity", "l_orderkey")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (
  PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1""")
def dedup_keys(spark, d):
    out = P.drop_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT before, after, before - after AS dropped, round((before - after) * 100.0 / after, 2)::DOUBLE AS percent FROM (
  SELECT count(*) AS before, count(DISTINCT (l_orderkey, l_linenumber)) AS after FROM lineitem)""")
def dedup_report(spark, d):
    return P.duplicate_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def labelled_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")


@query("SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def fill_zero(spark, d):
    return P.fill(labelled_documents(spark, d), ["quality", "toxic"], 0).select("doc_id", "quality", "toxic")


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def drop_null(spark, d):
    return P.drop_missing(labelled_documents(spark, d), ["quality"]).select("doc_id", "quality")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
def date_bounded(spark, d):
    df = io.read_between(spark, f"{d}/orders.parquet", "o_orderdate", "1996-01-01", "1997-01-01")
    return df.select("o_orderkey", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, TRY_CAST(x[1] AS INTEGER) AS "WND_Angle", x[2] AS "WND_Quality", TRY_CAST(x[3] AS INTEGER) AS "WND_Speed", x[4] AS "WND_Gust"
FROM (SELECT l_orderkey, l_linenumber, string_split(concat_ws(',', CAST(l_suppkey AS VARCHAR), l_returnflag,
  CASE WHEN l_linenumber = 3 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END), ',') AS x FROM lineitem)""")
def packed_split(spark, d):
    speed = F.when(F.col("l_linenumber") == 3, "x").otherwise(F.col("l_linenumber").cast("string"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(",", F.col("l_suppkey").cast("string"), "l_returnflag", speed).alias("WND"))
    return P.split_packed(li, {"WND": "Angle:int Quality Speed:int Gust"})


@query("""SELECT l_orderkey, l_partkey, CAST(CASE WHEN l_linenumber IN (2, 3, 6, 7) THEN 0 ELSE 1 END AS INTEGER) AS flag,
  CASE WHEN l_linenumber NOT IN (2, 3, 6, 7) THEN l_quantity END AS value FROM lineitem""")
def quality_null(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("string").alias("flag"), F.col("l_quantity").alias("value"))
    return P.flag_quality(li, quality={"flag": ["value"]})


@query("""SELECT l_orderkey, l_partkey, nullif(l_linenumber, 7) AS number, CASE WHEN kind = '9' AND speed = 0 THEN 'C' ELSE nullif(kind, '9') END AS kind
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN '9' ELSE l_returnflag END AS kind, l_partkey % 3 AS speed FROM lineitem)""")
def sentinel_null(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "9").otherwise(F.col("l_returnflag"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("number"), kind.alias("kind"), (F.col("l_partkey") % 3).alias("speed"))
    return P.null_codes(P.calm_wind(li, "kind", "speed"), {"number": 7, "kind": "9"}).drop("speed")


@query("""SELECT l_orderkey, l_partkey, CAST(CASE WHEN s > 0 THEN trunc(s * 1.0 / n) END AS INTEGER) AS mean FROM (
  SELECT l_orderkey, l_partkey, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS s,
    (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n FROM (
    SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber > 3 THEN l_linenumber END AS a,
      CASE WHEN l_partkey % 2 = 0 THEN CAST(l_quantity AS INTEGER) END AS b, CASE WHEN l_suppkey % 4 = 0 THEN 0 END AS c FROM lineitem))""")
def repeat_mean_nonnull(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).alias("a"),
        F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity").cast("int")).alias("b"), F.when(F.col("l_suppkey") % 4 == 0, 0).alias("c"),
    )
    return P.average_repeated(li, {"mean": ["a", "b", "c"]})


_HHMM = "CASE WHEN o_orderkey % 97 = 0 THEN 2400 ELSE (o_orderkey % 24) * 100 + o_custkey % 60 END"


@query(f"""WITH c AS (SELECT o_orderkey, o_orderdate, {_HHMM} AS hhmm FROM orders)
SELECT o_orderkey, lpad(CAST(CASE WHEN hhmm = 2400 THEN 0 ELSE hhmm // 100 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(hhmm % 100 AS VARCHAR), 2, '0') AS clock,
  epoch_us(o_orderdate + to_minutes(CAST(hhmm // 100 * 60 + hhmm % 100 AS BIGINT))) AS at FROM c""")
def clock_normalise(spark, d):
    o = table(spark, d, "orders").withColumn("hhmm", F.expr(_HHMM))
    at = S.local_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("hhmm"))
    return o.select("o_orderkey", S.clock(F.col("hhmm")).alias("clock"), F.unix_micros(at).alias("at"))


_ZONE = "CASE n_regionkey WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Europe/Berlin' WHEN 2 THEN 'Asia/Tokyo' WHEN 3 THEN 'America/Chicago' ELSE 'Australia/Sydney' END"


@query(f"""SELECT o_orderkey, epoch_us((o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE ({_ZONE})) AS utc
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def local_to_utc(spark, d):
    n = table(spark, d, "nation")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = o.withColumn("local", F.col("o_orderdate") + F.expr("INTERVAL 12 HOURS"))
    zones = n.select(F.col("n_name").alias("iata_code"), F.expr(_ZONE).alias("tz"))
    return J.local_to_utc(o, zones, "n_name", "local", "utc").select("o_orderkey", F.unix_micros("utc").alias("utc"))


@query("SELECT event_id, epoch_us(ts - INTERVAL 6 HOUR) AS w_start, epoch_us(ts - INTERVAL 2 HOUR) AS w_end FROM events")
def window_bounds(spark, d):
    e = J.window_bounds(events(spark, d), "ts", 6, 2, ("w_start", "w_end"))
    return e.select("event_id", F.unix_micros("w_start").alias("w_start"), F.unix_micros("w_end").alias("w_end"))


@query("""SELECT l_orderkey, l_partkey, coalesce(CASE WHEN l_linenumber = 1 THEN 'a' END, CASE WHEN l_linenumber <= 3 THEN 'b' END,
  CASE WHEN l_linenumber <= 5 THEN 'c' END) AS condition FROM lineitem""")
def coalesce_merge(spark, d):
    n = F.col("l_linenumber")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(n == 1, "a").alias("c1"), F.when(n <= 3, "b").alias("c2"), F.when(n <= 5, "c").alias("c3"))
    return P.merge_first(li, ["c1", "c2", "c3"], "condition")


@query("""SELECT o_orderkey, TRY_CAST(replace(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':30' END, ':', '') AS INTEGER) AS clock,
  CAST(o_custkey AS INTEGER) AS cust, CAST(o_orderkey AS VARCHAR) AS key FROM orders""")
def cast_features(spark, d):
    clock = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.concat(F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":30")))
    o = table(spark, d, "orders").select("o_orderkey", clock.alias("clock"), F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("key"))
    return P.cast_all(P.to_integers(o, ["clock", "cust"]), ["key"])


@query("SELECT l_orderkey, l_partkey, l_returnflag || '-' || l_linestatus AS route FROM lineitem")
def concat_key(spark, d):
    return P.key_of(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "route").select("l_orderkey", "l_partkey", "route")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def unmapped_anti(spark, d):
    return J.unmapped(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 200000"), "c_custkey", "o_custkey")


_DAYS = [("1996", "7", "4", 2), ("1996", "12", "25", 1), ("1997", "1", "1", 0), ("1998", "11", "26", 2), ("1999", "5", "31", 1)]


@query(f"""WITH h(y, m, d, i) AS (VALUES {', '.join(map(str, _DAYS))}), k AS (SELECT make_date(y::INT, m::INT, d::INT) AS day, i FROM h)
SELECT o_orderkey, CAST(i IS NOT NULL AS INTEGER) AS is_holiday, CAST(coalesce(i + 1, 0) AS INTEGER) AS holiday_imp FROM orders LEFT JOIN k ON o_orderdate::DATE = day""")
def holiday_lookup(spark, d):
    calendar = spark.createDataFrame(_DAYS, "Year string, Month string, Day string, Importance int")
    return W.holidays(table(spark, d, "orders"), calendar, "o_orderdate").select("o_orderkey", "is_holiday", "holiday_imp")


@query("""WITH h AS (SELECT DISTINCT o_orderdate::DATE AS day, month(o_orderdate) % 3 AS i FROM orders WHERE day(o_orderdate) = 4)
SELECT o_orderkey, CAST(i IS NOT NULL AS INTEGER) AS is_holiday, CAST(coalesce(i + 1, 0) AS INTEGER) AS holiday_imp FROM orders LEFT JOIN h ON o_orderdate::DATE = day""")
def holiday_table(spark, d):
    """A calendar written as a table and read by the reader of holidays."""
    orders = table(spark, d, "orders")
    day = F.col("o_orderdate")
    calendar = orders.where(F.dayofmonth(day) == 4).select(F.year(day).alias("Year"), F.month(day).alias("Month"), F.dayofmonth(day).alias("Day"), (F.month(day) % 3).alias("Importance"))
    path = folder(spark, "holidays")
    io.write_parquet(calendar, path)
    return W.holidays(orders, io.read_holidays(spark, path), "o_orderdate").select("o_orderkey", "is_holiday", "holiday_imp")


def routes(spark, d):
    """Edges supplier nation -> customer nation, one per line, with carrier and previous delay."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        "l_orderkey", F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"),
        F.col("l_returnflag").alias("carrier"), (F.col("l_discount") > 0.05).cast("int").alias("prev_delay"),
    )


_ROUTES = """e AS (SELECT l_orderkey, s_nationkey AS src, c_nationkey AS dst, l_returnflag AS carrier, CAST(l_discount > 0.05 AS INTEGER) AS prev_delay
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"""WITH {_ROUTES}, r AS (SELECT src, dst, carrier, avg(prev_delay) AS a FROM e GROUP BY ALL)
SELECT e.l_orderkey, e.src, e.dst, e.carrier, round(a, 9) AS avg_prev_delay_carrier FROM e LEFT JOIN r USING (src, dst, carrier)""")
def route_delay_lookup(spark, d):
    e = routes(spark, d)
    flights = e.select("l_orderkey", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("carrier").alias("c"))
    out = W.lookup(flights, G.route_delay(e), [("a", "src"), ("b", "dst"), ("c", "carrier")])
    return out.select("l_orderkey", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("carrier"), F.round("avg_prev_delay_carrier", 9).alias("avg_prev_delay_carrier"))


@query(f"""WITH {_ROUTES}, g AS (SELECT dst AS id, count(*) AS d FROM e GROUP BY dst) SELECT e.l_orderkey, e.src, g.d AS "inDegree" FROM e LEFT JOIN g ON e.src = g.id""")
def indegree_lookup(spark, d):
    e = routes(spark, d)
    return W.lookup(e.select("l_orderkey", "src"), G.in_degrees(e), [("src", "id")])


@query(f"""WITH {_ROUTES}, g AS (SELECT dst AS id, count(*) AS d FROM e GROUP BY dst)
SELECT e.carrier, round(avg(g.d), 9) AS mean_in_degree FROM e JOIN g ON e.src = g.id GROUP BY e.carrier""")
def mean_in_degree(spark, d):
    e = routes(spark, d)
    joined = W.lookup(e, G.in_degrees(e), [("src", "id")])
    return G.mean_in_degree(joined, "carrier").withColumn("mean_in_degree", F.round("mean_in_degree", 9))


@query("""WITH e AS (SELECT *, CAST(event_type = 'error' AS INTEGER) AS label FROM events),
m AS (SELECT user_id, avg(label) AS a FROM e WHERE event_id % 4 <> 0 AND user_id % 7 <> 0 GROUP BY user_id),
g AS (SELECT avg(label) AS g FROM e WHERE event_id % 4 <> 0 AND user_id % 7 <> 0)
SELECT event_id, round(coalesce(a, g), 9) AS user_id_mean_encoding FROM e LEFT JOIN m USING (user_id) CROSS JOIN g""")
def target_mean_encode(spark, d):
    """Means from training rows; users whom training lacks get the mean of all."""
    e = events(spark, d)
    model = T.TargetMeanEncoder("user_id", "label").fit(e.where("event_id % 4 <> 0 AND user_id % 7 <> 0"))
    return model.transform(e).select("event_id", F.round("user_id_mean_encoding", 9).alias("user_id_mean_encoding"))


def _out_of_fold_sql(train: bool) -> str:
    k = _uniform(1, "event_id")
    own = f"""SELECT t.event_id, round((coalesce(c.s, 0) - coalesce(f.s, 0) + 10 * o.s / o.n) / (coalesce(c.n, 0) - coalesce(f.n, 0) + 10), 9) AS user_id_mean_encoding
FROM e t JOIN a c ON t.user_id IS NOT DISTINCT FROM c.user_id JOIN b f ON t.user_id IS NOT DISTINCT FROM f.user_id AND t.fold = f.fold JOIN o ON t.fold = o.fold WHERE t.event_id % 4 <> 0"""
    other = """SELECT t.event_id, round((coalesce(c.s, 0) + 10 * w.s / w.n) / (coalesce(c.n, 0) + 10), 9) AS user_id_mean_encoding
FROM e t LEFT JOIN a c ON t.user_id IS NOT DISTINCT FROM c.user_id, (SELECT sum(y) AS s, count(y) AS n FROM train) w WHERE t.event_id % 4 = 0"""
    return f"""WITH e AS (SELECT event_id, CASE WHEN user_id % 13 <> 0 THEN user_id END AS user_id, (event_type = 'error')::DOUBLE AS y, CAST(floor({k} * 5) AS INT) AS fold FROM events),
train AS (SELECT * FROM e WHERE event_id % 4 <> 0 AND coalesce(user_id, 0) % 7 <> 1),
b AS (SELECT user_id, fold, sum(y) AS s, count(y) AS n FROM train GROUP BY ALL), a AS (SELECT user_id, sum(s) AS s, sum(n) AS n FROM b GROUP BY ALL),
o AS (SELECT f.fold, sum(b.s) AS s, sum(b.n) AS n FROM (SELECT DISTINCT fold FROM b) f JOIN b ON b.fold <> f.fold GROUP BY f.fold)
{own if train else other}""".replace("FROM e t JOIN a c", "FROM train t JOIN a c")


def _encoder(spark, d):
    e = events(spark, d).withColumn("user_id", F.when(F.col("user_id") % 13 != 0, F.col("user_id")))
    train = e.where("event_id % 4 <> 0 AND coalesce(user_id, 0) % 7 <> 1")
    return e, train, T.OutOfFoldEncoder("user_id", "label", ["event_id"]).fit(train)


@query(_out_of_fold_sql(True))
def out_of_fold_means(spark, d):
    """Training rows: means of their category in other folds, drawn towards the overall mean."""
    _, train, model = _encoder(spark, d)
    return model.transform_train(train).select("event_id", F.round("user_id_mean_encoding", 9).alias("user_id_mean_encoding"))


@query(_out_of_fold_sql(False))
def shrunk_means(spark, d):
    """Other rows: means of all training rows, drawn towards the overall mean; unseen users get that one."""
    e, _, model = _encoder(spark, d)
    return model.transform(e.where("event_id % 4 = 0")).select("event_id", F.round("user_id_mean_encoding", 9).alias("user_id_mean_encoding"))


@query("""WITH n AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1997-01-01'), h AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < DATE '1997-01-01')
SELECT l_partkey, l_suppkey, l_quantity, min(l_orderkey) AS l_orderkey FROM n WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.l_partkey = n.l_partkey AND h.l_suppkey = n.l_suppkey AND h.l_quantity = n.l_quantity)
GROUP BY ALL""")
def incremental_load(spark, d):
    """A new period without what history has already: only history's suspects, by a Bloom filter, are joined."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "l_suppkey", "l_quantity", "l_orderkey", "o_orderdate")
    new, history = P.between_dates(li, "o_orderdate", start="1997-01-01"), P.between_dates(li, "o_orderdate", until="1997-01-01")
    keys = ["l_partkey", "l_suppkey", "l_quantity"]
    return P.new_rows(new, history, keys, ["l_orderkey"]).select(*keys, "l_orderkey")


@query('SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand) AS "p_brand_COUNT" FROM part')
def count_encode(spark, d):
    return T.count_encode(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand")


_INDEX = """i AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY count(*) {order}, p_brand) - 1 AS INTEGER) AS i FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand)
SELECT p_partkey, CAST(coalesce(i, (SELECT count(*) FROM i)) AS INTEGER) AS "p_brand_Index" FROM part LEFT JOIN i USING (p_brand)"""


@query("WITH " + _INDEX.format(order="DESC"))
def freq_index(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return T.apply_index(p, T.frequency_index(p.where("p_partkey % 2 = 0"), "p_brand"), "p_brand").select("p_partkey", "p_brand_Index")


@query("WITH " + _INDEX.format(order="ASC"))
def freq_index_ascending(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    return T.apply_index(p, T.frequency_index(p.where("p_partkey % 2 = 0"), "p_brand", ascending=True), "p_brand").select("p_partkey", "p_brand_Index")


@query("""SELECT l_orderkey, l_partkey, CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A", CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N",
  CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R" FROM lineitem""")
def one_hot(spark, d):
    return T.one_hot(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag"), "l_returnflag", ["A", "N", "R"]).drop("l_returnflag")


@query(f"""SELECT o_orderkey, CAST(CASE WHEN h >= 0 AND h < 900 THEN 0 WHEN h >= 900 AND h < 1200 THEN 1 WHEN h >= 1200 AND h < 1600 THEN 2
  WHEN h >= 1600 AND h < 2000 THEN 3 WHEN h >= 2000 AND h <= 2359 THEN 4 ELSE 5 END AS INTEGER) AS part FROM (SELECT o_orderkey, {_HHMM} AS h FROM orders)""")
def bucketise(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(_HHMM).alias("h"))
    return T.bucketise(o, "h", name="part").select("o_orderkey", "part")


@query("""SELECT p_partkey, round((p_retailprice - m) / s, 9) AS p_retailprice_scaled FROM part,
  (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part WHERE p_partkey % 2 = 0)""")
def standardise(spark, d):
    p = table(spark, d, "part")
    return T.standardise(p, p.where("p_partkey % 2 = 0"), ["p_retailprice"], True).select("p_partkey", F.round("p_retailprice_scaled", 9).alias("p_retailprice_scaled"))


@query("SELECT p_partkey, round(ln(p_retailprice + 1e-6), 9) AS p_retailprice_log FROM part")
def log_transform(spark, d):
    return T.log_columns(table(spark, d, "part"), ["p_retailprice"]).select("p_partkey", F.round("p_retailprice_log", 9).alias("p_retailprice_log"))


@query("""SELECT l_orderkey, l_partkey, round(l_quantity * l_discount, 6) AS l_quantity_l_discount, round(l_quantity * l_tax, 6) AS l_quantity_l_tax,
  round(l_discount * l_tax, 6) AS l_discount_l_tax FROM lineitem""")
def interactions(spark, d):
    df, names = W.interactions(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return df.select("l_orderkey", "l_partkey", *[F.round(n, 6).alias(n) for n in names])


@query("""WITH k AS (SELECT count(*) FILTER (event_type <> 'error') // count(*) FILTER (event_type = 'error') AS k FROM events)
SELECT event_id, event_type FROM events WHERE event_type <> 'error'
UNION ALL SELECT event_id, event_type FROM events, k, unnest(range(k)) WHERE event_type = 'error'""")
def oversample(spark, d):
    return W.oversample(events(spark, d), "label").select("event_id", "event_type")


@query(f"""WITH k AS (SELECT count(*) FILTER (event_type = 'error')::DOUBLE / count(*) FILTER (event_type <> 'error') AS share FROM events)
SELECT event_id, event_type FROM events, k WHERE event_type = 'error' OR {_uniform(7, 'event_id')} < share""")
def undersample(spark, d):
    return W.undersample(events(spark, d), "label", seed=7, key=["event_id"]).select("event_id", "event_type")


@query("""SELECT event_id, round(CASE WHEN event_type = 'error' THEN r ELSE 1 - r END, 9) AS "classWeights" FROM events,
  (SELECT count(*) FILTER (event_type <> 'error') / count(*) AS r FROM events)""")
def class_weights(spark, d):
    return W.class_weights(events(spark, d), "label").select("event_id", F.round("classWeights", 9).alias("classWeights"))


def judged(spark, d):
    return labelled_documents(spark, d).where("toxic IS NOT NULL").withColumn("prediction", (F.col("n_chars") > 2000).cast("int"))


_JUDGED = "j AS (SELECT *, CAST(n_chars > 2000 AS INTEGER) AS prediction FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL)"


@query(f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (prediction = 1 AND toxic = 1) AS tp, count(*) FILTER (prediction = 1 AND toxic <> 1) AS fp,
  count(*) FILTER (prediction <> 1 AND toxic = 1) AS fn, count(*) FILTER (prediction <> 1 AND toxic <> 1) AS tn FROM j),
m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
SELECT tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0.0), 9) AS f_beta FROM m""")
def confusion_metrics(spark, d):
    m = M.confusion(judged(spark, d), label="toxic")
    return m.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f_beta")})


@query(f"""WITH {_JUDGED} SELECT CASE WHEN prediction = 1 THEN (CASE WHEN toxic = 1 THEN 'TP' ELSE 'FP' END) WHEN toxic <> 0 THEN 'FN' ELSE 'TN' END AS pred_group,
  count(*) AS n, round(avg(n_chars), 6) AS n_chars_mean, round(avg(quality), 9) AS quality_mean FROM j GROUP BY 1""")
def error_groups(spark, d):
    g = M.error_groups(judged(spark, d), ["n_chars", "quality"], label="toxic")
    return g.withColumns({"n_chars_mean": F.round("n_chars_mean", 6), "quality_mean": F.round("quality_mean", 9)})


@query("""SELECT n_train, n_test, round(n_train / (n_train + n_test), 9) AS share FROM (
  SELECT count(*) FILTER (event_id % 4 <> 0) AS n_train, count(*) FILTER (event_id % 4 = 0) AS n_test FROM events)""")
def train_share(spark, d):
    e = events(spark, d)
    return M.train_share(e.where("event_id % 4 <> 0"), e.where("event_id % 4 = 0")).withColumn("share", F.round("share", 9))


@query(f"""WITH {_JUDGED}, m AS (SELECT count(*) FILTER (prediction = 1 AND toxic = 1) / nullif(count(*) FILTER (prediction = 1), 0) AS p,
  count(*) FILTER (prediction = 1 AND toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0) AS r FROM j)
SELECT round(r * 976000.0, 3) AS correct, round(r * 976000.0 / p, 3) AS detected, round(r * 976000.0 * 8504.0, 1) AS savings FROM m""")
def savings_report(spark, d):
    s = M.savings(M.confusion(judged(spark, d), label="toxic"), 976_000.0, 8_504.0)
    return s.select(F.round("correct", 3).alias("correct"), F.round("detected", 3).alias("detected"), F.round("savings", 1).alias("savings"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std,
  round(avg(l_extendedprice / 10), 6) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice / 10), 6) AS l_extendedprice_std FROM lineitem GROUP BY 1""")
def class_stats(spark, d):
    s = A.class_stats(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"], {"l_extendedprice": 0.1})
    return s.select("l_returnflag", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query("""SELECT l_returnflag, p_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, p_type""")
def category_share(spark, d):
    return A.category_share(typed_lines(spark, d), "l_returnflag", "p_type").withColumn("share", F.round("share", 9))


@query("""WITH s AS (SELECT l_returnflag, l_linestatus, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(max(share) FILTER (l_linestatus = 'F'), 9) AS "F", round(max(share) FILTER (l_linestatus = 'O'), 9) AS "O" FROM s GROUP BY 1""")
def share_pivot(spark, d):
    p = A.share_pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])
    return p.select("l_returnflag", F.round("F", 9).alias("F"), F.round("O", 9).alias("O"))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r FROM lineitem" for a, b in _PAIRS))
def corr_matrix(spark, d):
    return A.correlations(table(spark, d, "lineitem"), _NUMBERS)


@query("""SELECT 'double' AS "column" WHERE (SELECT abs(corr(l_quantity, 2 * l_quantity + l_tax)) FROM lineitem) > 0.95""")
def corr_prune(spark, d):
    li = table(spark, d, "lineitem").withColumn("double", 2 * F.col("l_quantity") + F.col("l_tax"))
    return A.correlated(li, ["l_quantity", "l_discount", "l_tax", "double"])


@query("""WITH j AS (SELECT quality, toxic, CASE WHEN n_chars % 5 > 0 THEN n_chars END AS n FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'n' AS "column", count(*) FILTER (n IS NULL) AS n_null, round(count(*) FILTER (n IS NULL AND toxic IS NULL) / count(*) FILTER (n IS NULL), 9) AS target_null_share FROM j
UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), round(count(*) FILTER (quality IS NULL AND toxic IS NULL) / count(*) FILTER (quality IS NULL), 9) FROM j""")
def null_audit(spark, d):
    j = labelled_documents(spark, d).withColumn("n", F.when(F.col("n_chars") % 5 > 0, F.col("n_chars")))
    return A.null_audit(j, ["n", "quality"], "toxic").withColumn("target_null_share", F.round("target_null_share", 9))


@query("""SELECT 'p_brand' AS "column", count(p_brand) AS n_values, count(DISTINCT p_brand) AS n_distinct FROM part
UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT p_type) FROM part UNION ALL SELECT 'p_size', count(p_size), count(DISTINCT p_size) FROM part""")
def distinct_audit(spark, d):
    return A.distinct_audit(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])


@query("SELECT p_brand, quantile_disc(p_size, 0.5) AS quantile FROM part GROUP BY p_brand")
def approx_quantile(spark, d):
    return A.quantile(table(spark, d, "part"), "p_size", 0.5, by=["p_brand"])


@query("""WITH p AS (SELECT s_suppkey, abs(s_suppkey * 7 % 31 - n_nationkey) AS distance FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey),
r AS (SELECT *, CAST(rank() OVER (PARTITION BY s_suppkey ORDER BY distance) AS INTEGER) AS nearness FROM p)
SELECT nearness, round(avg(distance), 9) AS mean, count(*) AS n FROM r WHERE nearness <= 3 GROUP BY 1""")
def mean_by_rank(spark, d):
    return A.mean_by_rank(nearest_n_rank(spark, d), "nearness", "distance").withColumn("mean", F.round("mean", 9))


def late_orders(spark, d):
    return table(spark, d, "orders").withColumn("late", (F.col("o_orderpriority") == "1-URGENT").cast("int"))


def _by(sql_dim: str, source: str, label: str, name: str, alias: str):
    return f"SELECT {sql_dim} AS {alias}, count(*) AS n, round(avg(CAST({label} AS INTEGER)), 9) AS share FROM {source} GROUP BY 1"


def _share(df, dim, alias, label):
    return A.share_by(df, [dim.alias(alias)], label).withColumn("share", F.round("share", 9))


@query(_by("CAST(year(o_orderdate) AS INTEGER)", "orders", "o_orderpriority = '1-URGENT'", "", "year"))
def delay_by_year(spark, d):
    return _share(late_orders(spark, d), F.year("o_orderdate"), "year", "late")


@query(_by("CAST(month(o_orderdate) AS INTEGER)", "orders", "o_orderpriority = '1-URGENT'", "", "month"))
def delay_by_month(spark, d):
    return _share(late_orders(spark, d), F.month("o_orderdate"), "month", "late")


@query(_by("CAST(isodow(o_orderdate) AS INTEGER)", "orders", "o_orderpriority = '1-URGENT'", "", "weekday"))
def delay_by_weekday(spark, d):
    return _share(late_orders(spark, d), (F.weekday("o_orderdate") + 1).cast("int"), "weekday", "late")


@query(_by("CAST(CASE WHEN hour(ts) < 6 THEN 0 WHEN hour(ts) < 10 THEN 1 WHEN hour(ts) < 14 THEN 2 WHEN hour(ts) < 18 THEN 3 ELSE 4 END AS INTEGER)", "events", "event_type = 'error'", "", "part"))
def delay_by_daypart(spark, d):
    return _share(events(spark, d), A.day_part(F.hour("ts")), "part", "label")


@query(_by("user_id % 10", "events", "event_type = 'error'", "", "carrier"))
def delay_by_carrier(spark, d):
    return _share(events(spark, d), F.col("user_id") % 10, "carrier", "label")


@query(_by("CAST(floor(value / 10) AS BIGINT)", "events", "event_type = 'error'", "", "bin"))
def delay_by_bin(spark, d):
    return _share(events(spark, d), F.floor(F.col("value") / 10), "bin", "label")


@query("""WITH s AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, avg(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS share FROM orders GROUP BY ALL)
SELECT CAST(m AS INTEGER) AS month, round(stddev_samp(share), 9) AS spread, count(*) AS n_years FROM s GROUP BY m""")
def monthly_spread(spark, d):
    s = A.monthly_spread(late_orders(spark, d), F.year("o_orderdate"), F.month("o_orderdate"), "late")
    return s.withColumn("spread", F.round("spread", 9))


@query("""WITH p AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS label, ts, lag(ts) OVER w AS p, lag(CAST(event_type = 'error' AS INTEGER)) OVER w AS l FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT label, count(*) AS n, round(avg(CASE WHEN ts - INTERVAL 2 HOUR >= p AND ts - INTERVAL 12 HOUR < p THEN l ELSE 0 END), 9) AS share FROM p GROUP BY label""")
def delay_given_previous(spark, d):
    e = W.previous_flag(events(spark, d), "user_id", "ts", "label", "prev", tie=["event_id"])
    return _share(e, F.col("label"), "label", "prev")


def order_folds():
    return K.rolling_folds(12 * 1995, train=9, valid=3, step=9, n=5)


@query("""WITH f AS (SELECT i + 1 AS fold, 23940 + 9 * i AS s FROM range(5) t(i)), o AS (SELECT o_totalprice, 12 * year(o_orderdate) + month(o_orderdate) - 1 AS m FROM orders)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN m < s + 9 THEN 'train' ELSE 'valid' END AS role, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM f JOIN o ON m >= s AND m < s + 12 GROUP BY ALL""")
def rolling_folds(spark, d):
    o = table(spark, d, "orders")
    month = K.month_number(F.year("o_orderdate"), F.month("o_orderdate"))
    parts = K.label_folds(o, order_folds(), month)
    return parts.groupBy("fold", "role").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def three_models(spark, d):
    """Three derived scores for each labelled document, joined from the first."""
    base = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    outs = []
    for i, m in enumerate((3, 5, 7)):
        p1 = (F.col("n_chars") % m) / F.lit(float(m - 1))
        scored = base.select("doc_id", (p1 > 0.5).cast("int").alias("prediction"), F.array(1 - p1, p1).alias("probability"))
        outs.append(V.outputs(scored if i == 0 else scored.where(F.col("doc_id") % (m + 6) != 0), ["doc_id"], f"m{i}"))
    return V.join_outputs(outs, ["doc_id"])


_MODELS = """b AS (SELECT doc_id, (n_chars % 3) / 2.0::DOUBLE AS a, CASE WHEN doc_id % 11 <> 0 THEN (n_chars % 5) / 4.0::DOUBLE END AS b,
  CASE WHEN doc_id % 13 <> 0 THEN (n_chars % 7) / 6.0::DOUBLE END AS c FROM labels JOIN documents USING (doc_id))"""


@query(f"WITH {_MODELS} SELECT doc_id, CAST(CASE WHEN ((a > 0.5)::INT + (b > 0.5)::INT + (c > 0.5)::INT) / 3.0 > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS vote FROM b")
def hard_vote(spark, d):
    return three_models(spark, d).select("doc_id", V.hard_vote([F.col(f"m{i}_pred") for i in range(3)]).alias("vote"))


@query(f"WITH {_MODELS} SELECT doc_id, CAST(CASE WHEN (1 - a) + (1 - b) + (1 - c) > a + b + c THEN 0 ELSE 1 END AS INTEGER) AS vote FROM b")
def soft_vote(spark, d):
    return three_models(spark, d).select("doc_id", V.soft_vote([F.col(f"m{i}_p0") for i in range(3)], [F.col(f"m{i}_p1") for i in range(3)]).alias("vote"))


def scaled_events(spark, d):
    e = events(spark, d)
    return e.select("event_id", "label", (F.col("value") / 100).alias("value"), (F.hour("ts") / 24).alias("hour"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"), "user_id", "ts")


def _descent_sql(rounds: int, rate: float) -> str:
    """Steps of gradient descent for the log loss, one table per step."""
    parts = ["WITH e AS (SELECT value / 100 AS a, hour(ts) / 24::DOUBLE AS b, CAST(event_type = 'error' AS DOUBLE) AS y FROM events)",
             "w0 AS (SELECT 0 AS step, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS wc)"]
    for i in range(1, rounds + 1):
        p = "(1 / (1 + exp(-(wc + wa * a + wb * b))))"
        parts.append(
            f"w{i} AS (SELECT {i} AS step, any_value(wa) - {rate}::DOUBLE * avg(({p} - y) * a) AS wa, any_value(wb) - {rate}::DOUBLE * avg(({p} - y) * b) AS wb,"
            f" any_value(wc) - {rate}::DOUBLE * avg({p} - y) AS wc FROM e, w{i - 1})"
        )
    p = "(1 / (1 + exp(-(wc + wa * a + wb * b))))"
    loss = f"(SELECT avg(-(y * ln({p} + 1e-5) + (1 - y) * ln(1 - {p} + 1e-5))) FROM e, (SELECT w.wa, w.wb, w.wc))"
    rows = " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(rounds + 1))
    return ",\n".join(parts) + f"""
SELECT step, CASE WHEN step < {rounds} THEN round({loss}, 8) END AS loss, round(wa, 8) AS w_value, round(wb, 8) AS w_hour, round(wc, 8) AS w_constant FROM ({rows}) w"""


@query(_descent_sql(10, 0.5))
def gd_logistic(spark, d):
    h = models.gradient_descent(scaled_events(spark, d), ["value", "hour"], "label", rounds=10, rate=0.5)
    return h.select("step", *[F.round(c, 8).alias(c) for c in h.columns[1:]])


def _one_step(penalty: str | None):
    def run(spark, d):
        li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("y"))
        (w, c), loss = models.gradient_step(li, ["x"], "y", [0.5, 0.1], 0.01, "linear", penalty, 0.1)
        return spark.createDataFrame([(0, round(loss, 6), round(w, 9), round(c, 9))], "step int, loss double, w_x double, w_constant double")

    return run


def _one_step_sql(extra: str) -> str:
    return f"""SELECT 0 AS step, round(avg(r * r), 6) AS loss, round(0.5 - 0.01 * (2 * avg(r * x) + {extra}), 9) AS w_x, round(0.1 - 0.01 * 2 * avg(r), 9) AS w_constant
FROM (SELECT *, 0.5 * x + 0.1 - y AS r FROM (SELECT l_quantity / 50 AS x, l_discount AS y FROM lineitem))"""


@query(_one_step_sql("0"))
def gd_plain(spark, d):
    """One step of least squares without a penalty."""
    return _one_step(None)(spark, d)


@query(_one_step_sql("2 * 0.1 * 0.5"))
def gd_ridge(spark, d):
    return _one_step("ridge")(spark, d)


@query(_one_step_sql("0.1"))
def gd_lasso(spark, d):
    return _one_step("lasso")(spark, d)


@query("""SELECT 0 AS step, round(avg(y * y), 6) AS loss, round(0.01 * 2 * avg(x * y), 9) AS w_x, round(0.01 * 2 * avg(y), 9) AS w_constant
FROM (SELECT l_quantity / 50 AS x, l_discount AS y FROM lineitem)""")
def gd_regularised(spark, d):
    """One ridge step of least squares from zero weights."""
    li = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("x"), F.col("l_discount").alias("y"))
    (w, c), loss = models.gradient_step(li, ["x"], "y", [0.0, 0.0], 0.01, "linear", "ridge", 0.1)
    return spark.createDataFrame([(0, round(loss, 6), round(w, 9), round(c, 9))], "step int, loss double, w_x double, w_constant double")


_SCALED = "e AS (SELECT event_id, value / 100 AS value, hour(ts) / 24::DOUBLE AS hour, day(ts) AS day, CAST(event_type = 'error' AS DOUBLE) AS y FROM events)"


def _newton_sql(steps: int, ridge: float) -> str:
    """Newton steps for two features and a constant: sums, then the inverse of the Gram matrix by cofactors."""
    parts = [f"WITH {_SCALED}", "w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    p = "(1 / (1 + exp(-(w.c + w.a * value + w.b * hour))))"
    for i in range(1, steps + 2):  # the last one gives the spread at the solution
        parts.append(f"""s{i} AS (SELECT any_value(w.a) AS a, any_value(w.b) AS b, any_value(w.c) AS c,
  sum((y - {p}) * value) - {ridge}::DOUBLE * any_value(w.a) AS ga, sum((y - {p}) * hour) - {ridge}::DOUBLE * any_value(w.b) AS gb, sum(y - {p}) AS gc,
  sum({p} * (1 - {p}) * value * value) + {ridge}::DOUBLE AS aa, sum({p} * (1 - {p}) * value * hour) AS ab, sum({p} * (1 - {p}) * value) AS ac,
  sum({p} * (1 - {p}) * hour * hour) + {ridge}::DOUBLE AS bb, sum({p} * (1 - {p}) * hour) AS bc, sum({p} * (1 - {p})) AS cc FROM e, w{i - 1} w),
i{i} AS (SELECT *, bb * cc - bc * bc AS iaa, ac * bc - ab * cc AS iab, ab * bc - ac * bb AS iac, aa * cc - ac * ac AS ibb, ab * ac - aa * bc AS ibc, aa * bb - ab * ab AS icc,
  aa * (bb * cc - bc * bc) - ab * (ab * cc - ac * bc) + ac * (ab * bc - ac * bb) AS det FROM s{i}),
w{i} AS (SELECT a + (iaa * ga + iab * gb + iac * gc) / det AS a, b + (iab * ga + ibb * gb + ibc * gc) / det AS b, c + (iac * ga + ibc * gb + icc * gc) / det AS c,
  sqrt(iaa / det) AS ea, sqrt(ibb / det) AS eb, sqrt(icc / det) AS ec FROM i{i})""")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS feature, round({k}, 6) AS weight, round(e{k}, 6) AS error FROM w{steps + 1}" for n, k in (("value", "a"), ("hour", "b"), ("constant", "c")))
    return ",\n".join(parts) + "\n" + rows


@query(_newton_sql(8, 2.0))
def newton_logistic(spark, d):
    """Logistic regression by Newton steps with a ridge: weights and their standard errors."""
    fit = models.newton_logistic(scaled_events(spark, d), ["value", "hour"], "label", ridge=2.0)
    return fit.table(spark).select("feature", F.round("weight", 6).alias("weight"), F.round("error", 6).alias("error"))


_TREE_FEATURES = ["value", "hour", "day"]
_EDGES = {"value": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2], "hour": [0.2, 0.4, 0.6, 0.8], "day": [5.0, 10.0, 15.0, 20.0, 25.0]}
_BINS = "[" + ", ".join(" + ".join(f"({c} > {e})::INT" for e in _EDGES[c]) for c in _TREE_FEATURES) + "]"


def _levels_sql(p: str, rows: str, depth: int, gain: str, least: float, allowed: list[tuple[int, int, int]]) -> list[str]:
    """Levels of trees over a table (event_id, bins, tree, a, h): p_r<depth> has the node of each row, p_s all splits."""
    parts = [f"{p}r0 AS (SELECT *, 1 AS node FROM {rows})", f"{p}ok(tree, node, f) AS (VALUES {', '.join(map(str, allowed))})"]
    for n in range(depth):
        parts.append(f"""{p}x{n} AS (SELECT tree, node, f, b, sum(a) OVER w AS la, sum(h) OVER w AS lh, sum(a) OVER (PARTITION BY tree, node, f) AS ta, sum(h) OVER (PARTITION BY tree, node, f) AS th
  FROM (SELECT tree, node, f, bins[f + 1] AS b, sum(a) AS a, sum(h) AS h FROM {p}r{n}, range(3) k(f) WHERE node >= {2**n} GROUP BY ALL) WINDOW w AS (PARTITION BY tree, node, f ORDER BY b)),
{p}s{n} AS (SELECT tree, node, CAST(f AS INT) AS f, b, g, th FROM (SELECT *, round({gain}, 10) AS g FROM (SELECT *, ta - la AS ra, th - lh AS rh FROM {p}x{n} WHERE lh >= {least} AND th - lh >= {least} AND lh > 0 AND th - lh > 0))
  JOIN {p}ok USING (tree, node, f) WHERE g > 0 QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY g DESC, f, b) = 1),
{p}r{n + 1} AS (SELECT r.* REPLACE (CASE WHEN s.f IS NULL THEN r.node WHEN bins[s.f + 1] <= s.b THEN 2 * r.node ELSE 2 * r.node + 1 END AS node) FROM {p}r{n} r LEFT JOIN {p}s{n} s ON r.tree = s.tree AND r.node = s.node)""")
    parts.append(f"{p}s AS ({' UNION ALL '.join(f'SELECT * FROM {p}s{n}' for n in range(depth))})")
    return parts


def _descend(rows: str, p: str, depth: int) -> str:
    """Any table (event_id, bins, tree) with the node that its rows come to."""
    out = f"(SELECT *, 1 AS node FROM {rows})"
    for n in range(depth):
        out = f"(SELECT r.* REPLACE (CASE WHEN s.f IS NULL THEN r.node WHEN bins[s.f + 1] <= s.b THEN 2 * r.node ELSE 2 * r.node + 1 END AS node) FROM {out} r LEFT JOIN {p}s{n} s ON r.tree = s.tree AND r.node = s.node)"
    return out


_FOREST = {"trees": 3, "depth": 2, "some": 2, "least": 5.0, "seed": 4}


def _forest_sql(result: str) -> str:
    k = _FOREST
    seeds = ", ".join(f"({t})" for t in range(k["trees"]))
    below, total = [], 0.0
    for i in range(8):
        total += math.exp(-1) / math.factorial(i)
        below.append(f"(u >= {total!r}::DOUBLE)::INT")
    allowed = [(t, n, f) for t in range(k["trees"]) for n in range(1, 2 ** k["depth"]) for f in trees.chosen(_TREE_FEATURES, k["some"], k["seed"], t, n)]
    gini = lambda a, h: f"2 * {a} / {h} * (1 - {a} / {h})"
    gain = f"{gini('ta', 'th')} - lh / th * {gini('la', 'lh')} - rh / th * {gini('ra', 'rh')}"
    parts = [
        f"WITH {_SCALED}",
        f"b AS (SELECT event_id, y, {_BINS} AS bins, tree, {_uniform(k['seed'], 'event_id', 'tree')} AS u FROM e, (VALUES {seeds}) t(tree))",
        f"d AS (SELECT event_id, bins, tree, w * y AS a, w::DOUBLE AS h FROM (SELECT *, {' + '.join(below)} AS w FROM b) WHERE w > 0)",
        *_levels_sql("f", "d", k["depth"], gain, k["least"], allowed),
        f"v AS (SELECT tree, node, sum(a) / sum(h) AS v FROM fr{k['depth']} GROUP BY tree, node)",
    ]
    return ",\n".join(parts) + "\n" + result


def forest_of(spark, d) -> trees.Trees:
    k = _FOREST
    return trees.fit_forest(scaled_events(spark, d), _TREE_FEATURES, "label", ["event_id"], k["trees"], k["depth"], edges=_EDGES, some=k["some"], least=k["least"], seed=k["seed"])


@query(_forest_sql(f"SELECT event_id, round(avg(v), 8) AS probability FROM {_descend('b', 'f', _FOREST['depth'])} JOIN v USING (tree, node) GROUP BY event_id"))
def forest_levels(spark, d):
    """A forest of three trees grown level by level: share of errors that it gives each event."""
    out = forest_of(spark, d).transform(scaled_events(spark, d))
    return out.select("event_id", F.round("probability", 8).alias("probability"))


@query(_forest_sql(f"""SELECT feature, round(coalesce(gain / sum(gain) OVER (), 0), 6) AS importance FROM (VALUES ('value', 0), ('hour', 1), ('day', 2)) n(feature, f)
LEFT JOIN (SELECT f, sum(round(g * s.th / root, 10)) AS gain FROM fs s JOIN (SELECT tree, max(th) AS root FROM fs GROUP BY tree) USING (tree) GROUP BY f) USING (f)""").replace("coalesce(gain / sum(gain) OVER (), 0)", "coalesce(gain, 0) / sum(gain) OVER ()"))
def forest_importance(spark, d):
    """Named importances of the same forest: shares of all gains."""
    return forest_of(spark, d).importance(spark).withColumn("importance", F.round("importance", 6))


_BOOST = {"rounds": 2, "depth": 2, "rate": 0.3, "gamma": 0.01, "alpha": 0.2, "lam": 1.5, "positive_weight": 2.0, "least_hessian": 1.0, "share": 0.7, "seed": 9}


def _boosted_sql() -> str:
    k = _BOOST
    soft = lambda g: f"(sign({g}) * greatest(abs({g}) - {k['alpha']}::DOUBLE, 0))"
    part = lambda g, h: f"{soft(g)} * {soft(g)} / ({h} + {k['lam']}::DOUBLE)"
    gain = f"({part('la', 'lh')} + {part('ra', 'rh')} - {part('ta', 'th')}) / 2 - {k['gamma']}::DOUBLE"
    parts = [f"WITH {_SCALED}", f"m0 AS (SELECT event_id, y, {_BINS} AS bins, 0.0::DOUBLE AS margin FROM e)"]
    for r in range(k["rounds"]):
        some = max(1, round(k["share"] * len(_TREE_FEATURES)))
        allowed = [(0, n, f) for n in range(1, 2 ** k["depth"]) for f in trees.chosen(_TREE_FEATURES, some, k["seed"], "tree", r)]
        p, w = "(1 / (1 + exp(-margin)))", f"CASE WHEN y = 1 THEN {k['positive_weight']}::DOUBLE ELSE 1.0::DOUBLE END"
        parts.append(f"g{r} AS (SELECT event_id, y, bins, margin, 0 AS tree, {w} * ({p} - y) AS a, {w} * {p} * (1 - {p}) AS h FROM m{r})")
        parts += _levels_sql(f"t{r}", f"g{r}", k["depth"], gain, k["least_hessian"], allowed)
        last = f"t{r}r{k['depth']}"
        parts.append(f"v{r} AS (SELECT node, -{k['rate']}::DOUBLE * {soft('sum(a)')} / (sum(h) + {k['lam']}::DOUBLE) AS v FROM {last} GROUP BY node)")
        parts.append(f"m{r + 1} AS (SELECT event_id, y, bins, margin + v AS margin FROM {last} JOIN v{r} USING (node))")
    return ",\n".join(parts) + f"\nSELECT event_id, round(1 / (1 + exp(-margin)), 8) AS probability FROM m{k['rounds']}"


@query(_boosted_sql())
def boosted_levels(spark, d):
    """Two rounds of boosted trees with penalties on the leaves, depth 2."""
    e = scaled_events(spark, d)
    out = trees.fit_boosted(e, _TREE_FEATURES, "label", edges=_EDGES, **_BOOST).transform(e)
    return out.select("event_id", F.round("probability", 8).alias("probability"))


def day_folds() -> list[K.Fold]:
    """Folds over days instead of months."""
    return K.rolling_folds(1, train=9, valid=3, step=9, n=3)


def prepared(train, other):
    model = T.TargetMeanEncoder("user_id", "label").fit(train)
    train, other = model.transform(train), model.transform(other)
    pipe = T.tree_pipeline(["value", "hour", "user_id_mean_encoding"]).fit(train)
    return pipe.transform(train), pipe.transform(other)


@query()
def lr_cv(spark, d):
    """Logistic regression over rolling folds: metrics of each fold and setting."""
    lr = models.logistic("label", rounds=5)
    maps = K.grid({lr.regParam: [0.0, 0.1]})
    cv = K.TimeFoldValidator(lr, maps, "label", sampling="over", prepare=prepared)
    return cv.fit(scaled_events(spark, d), day_folds(), F.col("day")).metrics(spark)


@query()
def random_search(spark, d):
    """Random settings of boosted trees over rolling folds."""
    gbt = models.boosted("label", rounds=3)
    maps = K.RandomGrid(2, seed=3).add(gbt.maxDepth, lambda r: r.choice([2, 3])).add(gbt.stepSize, lambda r: r.choice([0.1, 0.2])).build()
    cv = K.TimeFoldValidator(gbt, maps, "label", sampling="under", prepare=prepared)
    return cv.fit(scaled_events(spark, d), day_folds(), F.col("day")).metrics(spark)


def _holdout(spark, d, estimator):
    e = scaled_events(spark, d)
    return K.evaluate_holdout(estimator, e.where("day <= 24"), e.where("day > 24"), "label", "over", prepared)


@query()
def rf_holdout(spark, d):
    _, scored = _holdout(spark, d, models.forest("label", 4, 10))
    return scored.select("event_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query()
def gbt_holdout(spark, d):
    _, scored = _holdout(spark, d, models.boosted("label", 3, 5))
    return scored.select("event_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query()
def feature_importance(spark, d):
    model, scored = _holdout(spark, d, models.forest("label", 4, 10))
    return models.importances(spark, model, models.feature_names(scored))


@query(f"WITH {_ROUTES} SELECT count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)")
def node_count(spark, d):
    return G.nodes(routes(spark, d)).agg(F.count("*").alias("n"))


_SPARSE = """s AS (SELECT o_custkey AS src, -1 - l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def sparse_routes(spark, d):
    """Customer -> supplier, one edge per line; suppliers have negative ids and no edges of their own."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst"))


@query(f"""WITH {_SPARSE}, o AS (SELECT src, count(DISTINCT dst) AS g FROM s GROUP BY src), n AS (SELECT src AS id FROM s UNION SELECT dst FROM s)
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM o) AS n_with_targets, (SELECT count(*) FROM n) - (SELECT count(*) FROM o) AS n_dangling, (SELECT round(avg(g), 9) FROM o) AS mean_degree""")
def degree_stats(spark, d):
    return G.degree_stats(sparse_routes(spark, d)).withColumn("mean_degree", F.round("mean_degree", 9))


@query(f"WITH {_SPARSE} SELECT DISTINCT dst AS id FROM s WHERE dst NOT IN (SELECT src FROM s)")
def dangling_nodes(spark, d):
    return G.dangling(sparse_routes(spark, d))


@query(f"WITH {_SPARSE} SELECT src, array_to_string(list_sort(list(DISTINCT dst)), ' ') AS targets FROM s GROUP BY src")
def adjacency_list(spark, d):
    return G.adjacency(sparse_routes(spark, d)).select("src", F.array_join("targets", " ").alias("targets"))


@query(f"WITH {_SPARSE} SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY ALL")
def adjacency_text(spark, d):
    """Edges written to files as lines 'node TAB {dest: count}' and read back."""
    counts = sparse_routes(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    cells = F.concat_ws(", ", F.collect_list(F.format_string("'%s': %s", F.col("dst").cast("string"), F.col("n").cast("string"))))
    lines = counts.groupBy("src").agg(cells.alias("c")).select(F.concat(F.col("src").cast("string"), F.lit("\t{"), "c", F.lit("}")).alias("value"))
    path = folder(spark, "lines")
    io.write_lines(lines, path)
    return G.edges_of_text(io.read_lines(spark, path))


def _pagerank_sql(rounds: int, alpha: float, edges: str = _SPARSE) -> str:
    parts = [
        f"WITH {edges}",
        "n AS (SELECT src AS id FROM s UNION SELECT dst FROM s)",
        "k AS (SELECT count(*)::DOUBLE AS k FROM n)",
        "w AS (SELECT src, dst, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS w FROM s GROUP BY src, dst)",
        "r0 AS (SELECT id, 1 / k AS rank FROM n, k)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS (SELECT n.id, {alpha} / k + (1 - {alpha}) * ((SELECT coalesce(sum(rank), 0) FROM {p} WHERE id NOT IN (SELECT src FROM w)) / k"
            f" + coalesce(g, 0)) AS rank FROM n CROSS JOIN k LEFT JOIN (SELECT dst, sum(w * rank) AS g FROM w JOIN {p} ON src = id GROUP BY dst) ON n.id = dst)"
        )
    return ",\n".join(parts)


@query(_pagerank_sql(8, 0.15) + " SELECT id, round(rank, 9) AS rank FROM r8")
def pagerank(spark, d):
    return G.pagerank(sparse_routes(spark, d), 0.15, 8).withColumn("rank", F.round("rank", 9))


@query(_pagerank_sql(8, 0.15) + " SELECT id, s_name, round(rank, 9) AS rank FROM r8 JOIN supplier ON id = -1 - s_suppkey ORDER BY round(r8.rank, 12) DESC, id LIMIT 10")
def pagerank_topk_named(spark, d):
    names = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), "s_name")
    ranks = G.pagerank(sparse_routes(spark, d), 0.15, 8).where("id < 0").withColumn("rank", F.round("rank", 12))
    return G.named(ranks, names, k=10).select("id", "s_name", F.round("rank", 9).alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, d):
    return G.top(table(spark, d, "orders"), "o_totalprice", 20, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n, format('{:,}', count(*)) AS n_text, epoch_us(max(o_orderdate)) AS latest FROM orders")
def overview(spark, d):
    return io.overview(table(spark, d, "orders"), "o_orderdate").withColumn("latest", F.unix_micros("latest"))


@query("""SELECT CASE WHEN month(o_orderdate) < 6 OR (month(o_orderdate) = 6 AND day(o_orderdate) <= 15) THEN 'train' ELSE 'test' END AS role, count(*) AS n FROM orders GROUP BY 1""")
def calendar_split(spark, d):
    o = table(spark, d, "orders").select(F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd"))
    train, test = P.split_by_month(o, "m", 6, "dd", 15)
    both = train.withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test")))
    return both.groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST((event_type = 'error' AND user_id % 10 IN (1, 2)) OR (event_type = 'click' AND user_id % 10 = 3) AS INTEGER) AS is_hub FROM events")
def hub_flags(spark, d):
    e = events(spark, d).withColumn("airport", (F.col("user_id") % 10).cast("string"))
    return P.hub_flags(e, {"error": ["1", "2"], "click": ["3"]}, "event_type", "airport").select("event_id", "is_hub")


@query(f"""WITH {_MODELS}, v AS (SELECT doc_id, CASE WHEN ((a > 0.5)::INT + (b > 0.5)::INT + (c > 0.5)::INT) / 3.0 > 0.5 THEN 1 ELSE 0 END AS vote FROM b),
j AS (SELECT v.*, n_chars, toxic FROM v LEFT JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))
SELECT CASE WHEN vote = 1 THEN (CASE WHEN toxic = 1 THEN 'TP' ELSE 'FP' END) WHEN toxic <> 0 THEN 'FN' ELSE 'TN' END AS pred_group,
  count(*) AS n, round(avg(n_chars), 6) AS n_chars_mean FROM j GROUP BY 1""")
def ensemble_error_groups(spark, d):
    """Votes joined back to features, then means by kind of error."""
    scored = V.attach(labelled_documents(spark, d), hard_vote(spark, d), ["doc_id"])
    return M.error_groups(scored, ["n_chars"], "vote", "toxic").withColumn("n_chars_mean", F.round("n_chars_mean", 6))


@query("SELECT p_partkey, p_brand FROM part")
def drop_uninformative(spark, d):
    """Constant and nearly empty columns go; they are found from the data."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.lit("x").alias("constant"), F.when(F.col("p_partkey") < 0, 1).alias("empty"))
    return P.drop_constant(P.drop_nearly_empty(p))


@query("SELECT DISTINCT l_returnflag AS feature FROM lineitem UNION SELECT DISTINCT l_linestatus FROM lineitem UNION SELECT DISTINCT o_orderstatus FROM orders")
def feature_union(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return G.union_features([li.select(F.col("l_returnflag").alias("feature")), li.select("l_linestatus"), o.select("o_orderstatus")])


@query("SELECT c_nationkey AS id, min(c_name) AS code FROM customer GROUP BY 1")
def graph_vertices(spark, d):
    return G.vertices_with_code(table(spark, d, "customer"), "c_nationkey", "c_name")


_STATS = ["count", "mean", "stddev", "min", "25%", "50%", "75%", "max"]


def _summary_sql(column: str) -> str:
    at = lambda p: f"v[ceil({p} * len(v))::INT]::DOUBLE"
    values = [f"count({column})::DOUBLE", f"avg({column})", f"stddev_samp({column})", f"min({column})::DOUBLE", *map(at, (0.25, 0.5, 0.75)), f"max({column})::DOUBLE"]
    values = [x if "v[" not in x else x.replace("v[", f"list_sort(list({column}))[").replace("len(v)", f"count({column})") for x in values]
    return f"SELECT unnest({_STATS}) AS summary, unnest([{', '.join(values)}]) AS {column} FROM part"


@query(f"""SELECT summary, round(p_size, 6) AS p_size, round(p_retailprice, 6) AS p_retailprice
FROM ({_summary_sql('p_size')}) JOIN ({_summary_sql('p_retailprice')}) USING (summary)""")
def dataset_summary(spark, d):
    s = table(spark, d, "part").select("p_size", "p_retailprice").summary(*_STATS)
    return s.select("summary", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in s.columns[1:]])


def _columns_sql(columns: list[str]) -> str:
    one = "SELECT '{0}' AS column, count({0}) AS count, count(*) - count({0}) AS nulls, round(avg({0}), 6) AS mean, round(stddev({0}), 6) AS stddev, min({0})::DOUBLE AS min, quantile_disc({0}, 0.25)::DOUBLE AS q25, quantile_disc({0}, 0.5)::DOUBLE AS q50, quantile_disc({0}, 0.75)::DOUBLE AS q75, max({0})::DOUBLE AS max FROM part"
    return " UNION ALL ".join(one.format(c) for c in columns)


@query(_columns_sql(["p_partkey", "p_size", "p_retailprice"]))
def column_summary(spark, d):
    """Counts, moments and quartiles of all numeric columns in one pass."""
    out = A.summary(table(spark, d, "part"))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query(f"SELECT * FROM lineitem WHERE {_uniform(5, 'l_orderkey', 'l_linenumber')} < 0.1")
def sampled_rows(spark, d):
    return P.sample(table(spark, d, "lineitem"), 0.1, seed=5, key=["l_orderkey", "l_linenumber"])


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY {_uniform(5, 'o_orderkey')}, o_orderkey LIMIT 5")
def random_orders(spark, d):
    return G.random_rows(table(spark, d, "orders"), 5, seed=5, key=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


# --- a rule instead of a learned model, so that SQL can follow folds, grids and votes


_FACTORS = [0.5, 1.0, 1.5]
_RANDOM_FACTORS = [m["factor"] for m in K.RandomGrid(3, seed=11).add("factor", lambda r: round(r.uniform(0.2, 2.0), 3)).build()]


def _scores(group: str) -> str:
    """Precision, recall and F of half beta from tp, fp, fn in a table c."""
    return f"""m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM c)
SELECT {group}, round(p, 9) AS precision, round(r, 9) AS recall, round(coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0.0), 9) AS f_beta FROM m"""


def _fold_sql(factors: list[float], skip: list[int] = ()) -> str:
    """Counts of each fold and map. Days 1 to 9, 10 to 18, 19 to 27 train, the 3 days after each validate."""
    folds = ", ".join(f"({f.number}, {f.train[0]}, {f.valid[0]}, {f.valid[1]})" for f in day_folds() if f.number not in skip)
    maps = ", ".join(f"({i}, {x}::DOUBLE)" for i, x in enumerate(factors))
    return f"""WITH f(fold, a, b, z) AS (VALUES {folds}), g(map, factor) AS (VALUES {maps}),
e AS (SELECT day(ts) AS day, value / 100 AS value, event_type = 'error' AS y FROM events),
t AS (SELECT fold, avg(value) FILTER (y) AS mean FROM f JOIN e ON day >= a AND day < b GROUP BY fold),
c AS (SELECT CAST(f.fold AS INTEGER) AS fold, CAST(map AS INTEGER) AS map, count(*) FILTER (value > factor * mean AND y) AS tp, count(*) FILTER (value > factor * mean AND NOT y) AS fp,
  count(*) FILTER (value <= factor * mean AND y) AS fn FROM f JOIN t USING (fold) JOIN e ON day >= b AND day < z CROSS JOIN g GROUP BY ALL)"""


def rule_folds(spark, d, maps, folds=None, **more):
    rule = models.MeanRule("value", "label")
    cv = K.TimeFoldValidator(rule, maps(rule), "label", **more)
    return cv.fit(scaled_events(spark, d), folds or day_folds(), F.col("day"))


def _rounded(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.select(*keys, *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f_beta")])


@query(f"{_fold_sql(_FACTORS)}, {_scores('fold, map')}")
def rule_cv(spark, d):
    """Every map on every fold, maps from a grid builder."""
    model = rule_folds(spark, d, lambda rule: K.Grid().base_on({rule.labelCol: "label"}).add(rule.factor, _FACTORS).build())
    return _rounded(model.metrics(spark), ["fold", "map"])


@query(f"{_fold_sql(_RANDOM_FACTORS)}, {_scores('fold, map')}")
def rule_random_search(spark, d):
    draw = lambda rule: K.RandomGrid(3, seed=11).add(rule.factor, lambda r: round(r.uniform(0.2, 2.0), 3)).build()
    return _rounded(rule_folds(spark, d, draw).metrics(spark), ["fold", "map"])


@query(f"{_fold_sql([1.0], K.skip_folds(3, 4))}, {_scores('fold, map')}")
def rule_skipped_folds(spark, d):
    """Two folds left out."""
    skip = K.skip_folds(3, 4)
    left = [f for f in day_folds() if f.number not in skip]
    return _rounded(rule_folds(spark, d, lambda rule: [{rule.factor: 1.0}], left).metrics(spark), ["fold", "map"])


@query(f"SELECT map, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f_beta), 9) AS f_beta FROM ({_fold_sql(_FACTORS)}, {_scores('fold, map')}) GROUP BY map")
def mean_fold_metrics(spark, d):
    return _rounded(M.mean_metrics(rule_cv(spark, d), ["precision", "recall", "f_beta"], ["map"]), ["map"])


@query(f"""{_fold_sql(_FACTORS)}, s AS ({_scores('fold, map').replace('m AS', 'WITH m AS')}), best AS (SELECT map FROM s GROUP BY map ORDER BY avg(f_beta) DESC, map LIMIT 1),
l AS (SELECT factor * mean AS lim FROM best JOIN g USING (map), t WHERE fold = 3)
SELECT day, count(*) FILTER (value > lim) AS n_positive, count(*) AS n FROM e, l GROUP BY day""")
def rule_saved(spark, d):
    """The tuner's best model, saved with those of the folds, loaded and applied."""
    model = rule_folds(spark, d, lambda rule: [{rule.factor: x} for x in _FACTORS], keep_models=True, evaluator=lambda scored: M.confusion(scored, label="label").first()["f_beta"])
    path = folder(spark, "tuned")
    model.save(spark, path)
    scored = K.TimeFoldModel.load(spark, path).transform(scaled_events(spark, d))
    return scored.groupBy(F.col("day").cast("long").alias("day")).agg(F.count_if(F.col("prediction") == 1).alias("n_positive"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, value / 100 AS v, event_type = 'error' AS y FROM events),
t AS (SELECT 0.8::DOUBLE * avg(v) FILTER (y) AS lim FROM e WHERE day(ts) <= 24)
SELECT event_id, CAST(y AS INTEGER) AS label, CAST(v > lim AS INTEGER) AS prediction FROM e, t WHERE day(ts) > 24""")
def rule_holdout(spark, d):
    e = scaled_events(spark, d)
    _, scored = K.evaluate_holdout(models.MeanRule("value", "label", 0.8), e.where("day <= 24"), e.where("day > 24"), "label", "over")
    return scored.select("event_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query(f"""WITH e AS (SELECT value / 100 AS v, event_type = 'error' AS y, CAST(floor({_uniform(1, 'event_id')} * 3) AS INTEGER) AS f FROM events),
g(map, factor) AS (VALUES (0, 0.5::DOUBLE), (1, 1.0::DOUBLE), (2, 1.5::DOUBLE)), n AS (SELECT unnest(range(3)) AS n),
t AS (SELECT n, avg(v) FILTER (y) AS mean FROM n JOIN e ON f <> n GROUP BY n),
c AS (SELECT n, CAST(map AS INTEGER) AS map, count(*) FILTER (v > factor * mean AND y) AS tp, count(*) FILTER (v > factor * mean AND NOT y) AS fp,
  count(*) FILTER (v <= factor * mean AND y) AS fn FROM t JOIN e ON f = n CROSS JOIN g GROUP BY ALL), s AS (WITH {_scores('map')})
SELECT map, round(avg(f_beta), 6) AS f_beta FROM s GROUP BY map""")
def rule_kfold(spark, d):
    """Plain k-fold, rows dealt by a hash of their key."""
    rule = models.MeanRule("value", "label")
    judge = lambda scored: M.confusion(scored, label="label").first()["f_beta"]
    _, means = K.kfold(rule, K.grid({rule.factor: _FACTORS}), scaled_events(spark, d), "label", folds=3, key=["event_id"], evaluator=judge)
    return spark.createDataFrame([(i, round(m, 6)) for i, m in enumerate(means)], "map int, f_beta double")


_FEATURES = ["value", "hour", "day"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({x}, CAST(event_type = 'error' AS INTEGER)), 9) AS importance FROM events" for c, x in zip(_FEATURES, ("value", "hour(ts)", "day(ts)"), strict=True)))
def ranked_correlations(spark, d):
    """Features ranked by how they go with the label."""
    row = scaled_events(spark, d).agg(*[F.corr(c, "label").alias(c) for c in _FEATURES]).first()
    return models.ranked(spark, _FEATURES, [row[c] for c in _FEATURES]).withColumn("importance", F.round("importance", 9))


@query()
def kfold_forest(spark, d):
    """Plain k-fold: mean area under the curve for each depth, encoders fitted fold by fold."""
    rf = models.forest("label", trees=5)
    _, means = K.kfold(rf, K.grid({rf.maxDepth: [2, 4]}), scaled_events(spark, d), "label", "areaUnderROC", 2, prepare=prepared, key=["event_id"])
    return spark.createDataFrame([(depth, m) for depth, m in zip((2, 4), means, strict=True)], "depth int, area double")


# --- sources and whole chains


@query("SELECT * FROM supplier UNION ALL BY NAME SELECT * FROM customer")
def period_union(spark, d):
    """Several files as one table; what one of them lacks is null there."""
    return io.read_periods(spark, [f"{d}/supplier.parquet", f"{d}/customer.parquet"])


@query("SELECT o_orderkey, NULL::INTEGER AS n_regionkey FROM orders UNION ALL SELECT NULL, n_regionkey FROM nation")
def period_columns(spark, d):
    """Only some columns of several files."""
    return io.read_periods(spark, [f"{d}/orders.parquet", f"{d}/nation.parquet"], ["o_orderkey", "n_regionkey"])


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, 12 * year(o_orderdate) + month(o_orderdate) - 1 AS m FROM orders)
SELECT o_orderkey, o_totalprice FROM o WHERE m >= 23940 + 9 + 9 AND m < 23940 + 9 + 12""")
def stored_fold(spark, d):
    """Folds written as one table with a folder for each; one of them read."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    parts = K.label_folds(o, order_folds(), K.month_number(F.year("o_orderdate"), F.month("o_orderdate")))
    path = folder(spark, "folds")
    io.write_folds(parts, path)
    return io.read_fold(spark, path, 2, "valid").select("o_orderkey", "o_totalprice")


@query("SELECT n_name AS title, CAST(n_nationkey AS VARCHAR) AS id, CAST(n_regionkey AS INTEGER) AS in_degree, CAST(NULL AS INTEGER) AS out_degree FROM nation")
def title_lines(spark, d):
    """Tab-separated lines with a number that isn't one."""
    n = table(spark, d, "nation")
    return G.title_index(n.select(F.concat_ws("\t", "n_name", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), F.lit("x")).alias("value")))


@query("""SELECT 'p_name' AS "column", count(p_name) AS n_values, count(DISTINCT p_name) AS n_distinct FROM part
UNION ALL SELECT 'p_brand', count(p_brand), count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_type', count(p_type), count(DISTINCT p_type) FROM part""")
def text_columns(spark, d):
    """The audit of all text columns, found by type."""
    p = table(spark, d, "part")
    return A.distinct_audit(p, P.dtypes_split(p)[0])


@query(f"""SELECT o_orderkey, o_totalprice AS price, CASE WHEN h < 900 THEN 0.0 WHEN h < 1200 THEN 1.0 WHEN h < 1600 THEN 2.0 WHEN h < 2000 THEN 3.0 ELSE 4.0 END::DOUBLE AS part
FROM (SELECT o_orderkey, o_totalprice, ({_HHMM}) % 2400 AS h FROM orders)""")
def vector_elements(spark, d):
    """The tree pipeline's vector, taken apart again."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.expr(f"({_HHMM}) % 2400").cast("double").alias("CRS_DEP_TIME"))
    v = T.tree_pipeline(["CRS_DEP_TIME", "o_totalprice"]).fit(o).transform(o)
    return T.vector_columns(v, "features", ["price", "part"]).select("o_orderkey", "price", "part")


@query("""WITH b AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1),
s AS (SELECT stddev_samp(p_size) AS size, stddev_samp(p_retailprice) AS price, stddev_samp(CAST(p_brand = (SELECT p_brand FROM b) AS INTEGER)) AS brand FROM part)
SELECT p_partkey, round(CAST(p_brand = (SELECT p_brand FROM b) AS INTEGER) / brand, 9) AS first_brand, round(p_size / size, 9) AS size, round(p_retailprice / price, 9) AS price FROM part, s""")
def scaled_vector(spark, d):
    """The regression pipeline's vector: one-hot categories and numbers, all scaled."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    v = T.regression_pipeline(["p_brand"], ["p_size", "p_retailprice"]).fit(p).transform(p)
    n = len(models.feature_names(v, "vectorized_features"))
    out = T.vector_columns(v, "features", ["first_brand", *[f"_{i}" for i in range(n - 3)], "size", "price"])
    return out.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("first_brand", "size", "price")])


@query("""WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS "ORIGIN", event_type AS "DEST", coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0.0) AS value, CAST(event_type = 'error' AS INTEGER) AS label FROM events),
k AS (SELECT *, "ORIGIN" || '-' || "DEST" AS route FROM e), m AS (SELECT route, avg(label) AS a FROM k WHERE event_id % 4 <> 0 GROUP BY route), g AS (SELECT avg(label) AS g FROM k WHERE event_id % 4 <> 0)
SELECT event_id, value, route AS "ORIGIN_DEST", round(coalesce(a, g), 9) AS "ORIGIN_DEST_mean_encoding" FROM k LEFT JOIN m USING (route) CROSS JOIN g WHERE event_id % 4 = 0""")
def preprocessed(spark, d):
    """Fills, the route key and target means of training rows, applied to the others."""
    e = events(spark, d).select("event_id", F.col("user_id").cast("string").alias("ORIGIN"), F.col("event_type").alias("DEST"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"), "label")
    prepare = flights.preprocess("label", ["ORIGIN_DEST"], {"value": 0.0}, drop=["ORIGIN", "DEST"])
    _, other = prepare(e.where("event_id % 4 <> 0"), e.where("event_id % 4 = 0"))
    return other.select("event_id", "value", "ORIGIN_DEST", F.round("ORIGIN_DEST_mean_encoding", 9).alias("ORIGIN_DEST_mean_encoding"))


def raw_tables(spark, d) -> dict[str, str]:
    """Flights of two periods that share a day, weather reports, stations, airport codes and zones, as
    files of the kinds that the readers take."""
    e, n = table(spark, d, "events"), table(spark, d, "nation").where("n_nationkey < 8")
    f = e.where("event_type IN ('error', 'click')")
    known = {
        "FL_DATE": F.date_format("ts", "yyyy-MM-dd"), "CRS_DEP_TIME": F.hour("ts") * 100 + F.minute("ts"), "DISTANCE": F.col("event_id"),
        "ORIGIN": F.concat(F.lit("A"), (F.col("user_id") % 8).cast("string")), "DEST": F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")),
        "DEST_AIRPORT_ID": F.col("event_id"), "ORIGIN_AIRPORT_ID": F.col("user_id") % 8, "OP_CARRIER_FL_NUM": F.col("user_id") % 5,
        "TAIL_NUM": F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")), "DEP_DELAY": F.when(F.col("event_id") % 10 != 0, F.col("value")),
        "DEP_DEL15": (F.col("event_type") == "error").cast("int"), **dict.fromkeys(C.DELAY_CAUSES, F.lit(None).cast("double")),
    }
    f = f.select("ts", *[known.get(c, F.lit(None).cast("string")).alias(c) for c in C.FLIGHT_COLUMNS])
    w = e.where("event_type NOT IN ('error', 'click')")
    whole = lambda x: F.floor(x).cast("string")
    tmp = F.when(F.col("event_id") % 13 == 0, "9999").otherwise(whole(F.col("value") * 10))
    known = {
        "STATION": F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")), "DATE": F.col("ts"), "SOURCE": F.col("event_id").cast("string"), "REPORT_TYPE": F.col("event_type"),
        "TMP": F.concat_ws(",", tmp, F.when(F.col("event_id") % 9 == 0, "2").otherwise("1")), "WND": F.concat_ws(",", F.lit("90,1,N"), whole(F.col("value")), F.lit("1")),
    }
    w = w.select(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in [*C.WEATHER_COLUMNS, *C.packed_columns()]])
    s = table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 8).alias("k"), (F.col("s_suppkey") % 20).alias("n")).agg(F.min(F.col("s_suppkey") * 7 % 31).alias("distance"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    s = s.select(text("st", "k").alias("station_id"), none.alias("lat"), none.alias("lon"), text("s", "n").alias("neighbor_id"), none.alias("neighbor_name"), none.alias("neighbor_state"),
                 text("K", "k").alias("neighbor_call"), F.col("distance").cast("double").alias("distance_to_neighbor"))
    path = {name: folder(spark, name) for name in ("first", "second", "weather", "stations", "codes", "zones")}
    io.write_parquet(f.where("ts < '2024-01-16'").drop("ts"), path["first"])
    io.write_parquet(f.where("ts >= '2024-01-15'").drop("ts", "OP_CARRIER"), path["second"])
    io.write_parquet(w, path["weather"])
    io.write_parquet(s, path["stations"])
    iata = F.when(F.col("n_nationkey") == 7, "null").otherwise(text("A", "n_nationkey"))
    n.select(text("K", "n_nationkey").alias("ident"), F.lit("10").alias("elevation_ft"), iata.alias("iata_code"), F.lit("0").alias("coordinates")).write.csv(path["codes"], header=True)
    n.select(text("A", "n_nationkey").alias("iata_code"), F.expr(_ZONE).alias("tz")).write.csv(path["zones"], header=True)
    return path


def joined_flights(spark, d) -> DataFrame:
    path = raw_tables(spark, d)
    f = flights.load_flights(spark, [path["first"], path["second"]])
    w = flights.load_weather(spark, path["weather"], until="2024-01-25 00:00:00")
    codes, zones = io.read_airport_codes(spark, path["codes"]), io.read_csv(spark, path["zones"], "iata_code string, tz string")
    return flights.flights_with_weather(f, w, io.read_stations(spark, path["stations"]), codes, zones)


_CHAIN = f"""f AS (SELECT event_id, user_id % 8 AS k, user_id % 5 AS num, user_id % 7 AS tail, hour(ts) * 100 + minute(ts) AS hhmm, date_trunc('minute', ts) AS local
  FROM events WHERE event_type IN ('error', 'click') AND event_id % 10 <> 0),
st AS (SELECT s_suppkey % 8 AS k, s_suppkey % 20 AS n, min(s_suppkey * 7 % 31)::DOUBLE AS dist FROM supplier GROUP BY ALL),
nr AS (SELECT * FROM st QUALIFY rank() OVER (PARTITION BY k ORDER BY dist) <= 3),
t AS (SELECT f.*, epoch_us(local AT TIME ZONE ({_ZONE})) AS u FROM f JOIN nation ON k = n_nationkey WHERE k < 7 AND k IN (SELECT k FROM st)),
w AS (SELECT user_id % 20 AS n, epoch_us(ts) AS seen, CASE WHEN event_id % 9 <> 0 AND event_id % 13 <> 0 THEN floor(value * 10) END AS tmp, floor(value) AS speed
  FROM events WHERE event_type NOT IN ('error', 'click') AND ts < TIMESTAMP '2024-01-25 00:00:00'),
r AS (SELECT nr.k, nr.dist, w.* FROM nr JOIN w USING (n)),
j AS (SELECT t.event_id, num, tail, hhmm, tmp, speed, (CASE WHEN dist = 0 THEN 1.0 ELSE 1 / dist END)::DOUBLE * (60000000.0 / (u - seen))::DOUBLE AS w
  FROM t LEFT JOIN r ON t.k = r.k AND seen BETWEEN u - 6 * 3600000000 AND u - 2 * 3600000000),
c AS (SELECT event_id, any_value(num) AS num, any_value(tail) AS tail, any_value(hhmm) AS hhmm, round(sum(tmp * w) / sum(w) FILTER (tmp IS NOT NULL), 2) AS tmp, round(sum(speed * w) / sum(w) FILTER (speed IS NOT NULL), 2) AS speed FROM j GROUP BY event_id)"""


@query(f'WITH {_CHAIN} SELECT event_id, tmp AS "TMP_Value", speed AS "WND_Speed" FROM c')
def flight_chain(spark, d):
    """From raw files to one row per flight with its weather."""
    return joined_flights(spark, d).select(F.col("DISTANCE").alias("event_id"), "TMP_Value", "WND_Speed")


@query(f"""WITH {_CHAIN} SELECT event_id, CAST(hhmm AS INTEGER) AS "CRS_DEP_TIME", tmp AS "TMP_Value", round(coalesce(speed, avg(speed) OVER (PARTITION BY num, tail), 0), 6) AS "WND_Speed_mean", 0.0::DOUBLE AS "AA_RainDepth", '0' AS weather_condition FROM c""")
def flight_features(spark, d):
    """The same, filled and shaped for a model, without the columns that tell the outcome."""
    out = flights.drop_features(flights.shape_features(joined_flights(spark, d)))
    return out.select(F.col("DISTANCE").alias("event_id"), "CRS_DEP_TIME", "TMP_Value", F.round("WND_Speed_mean", 6).alias("WND_Speed_mean"), "AA_RainDepth", "weather_condition")


@query(_pagerank_sql(40, 0.5, "s AS (SELECT CAST(l_suppkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT) AS dst FROM lineitem)") + " SELECT id, round(rank, 9) AS rank FROM r40")
def pagerank_converged(spark, d):
    """Ranks whose rounds stop by themselves equal those of so many rounds that nothing changes any more; the graph has
    cycles, since parts and suppliers share numbers."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    ranks, _ = G.pagerank_converged(e, 0.5, 1e-12)
    return ranks.withColumn("rank", F.round("rank", 9))


#: Places for customers and suppliers, from their keys: latitude and longitude in degrees.
_LAT, _LON = "({k} * 7919 % 17001) / 100.0 - 85.0", "({k} * 104729 % 36007) / 100.0 - 180.0"


def place_of(key: str) -> tuple[str, str]:
    return f"CAST({_LAT.format(k=key)} AS DOUBLE)", f"CAST({_LON.format(k=key)} AS DOUBLE)"


@query(f"""WITH c AS (SELECT c_custkey, radians({place_of("c_custkey")[0]}) AS a, radians({place_of("c_custkey")[1]}) AS o FROM customer WHERE c_custkey % 7 <> 0),
s AS (SELECT s_suppkey, radians({place_of("s_suppkey")[0]}) AS b, radians({place_of("s_suppkey")[1]}) AS p FROM supplier),
d AS (SELECT c_custkey, s_suppkey, 2 * 6371.0088 * asin(sqrt(pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin((p - o) / 2), 2))) AS km FROM c, s)
SELECT c_custkey, s_suppkey, round(km, 2) AS km, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY km, s_suppkey) AS INTEGER) AS nearness FROM d
QUALIFY nearness <= 3""")
def nearest_places(spark, d):
    """The three suppliers nearest to each customer on the globe; customers without coordinates have none."""
    lat, lon = place_of("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.expr(f"CASE WHEN c_custkey % 7 <> 0 THEN {lat} END").alias("lat"), F.expr(lon).alias("lon"))
    lat, lon = place_of("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.expr(lat).alias("lat"), F.expr(lon).alias("lon"))
    near = places.nearest_places(c, s, 3, ("c_custkey", "lat", "lon"), ("s_suppkey", "lat", "lon"))
    return near.select(F.col("left_id").alias("c_custkey"), F.col("right_id").alias("s_suppkey"), F.round("distance_km", 2).alias("km"), F.col("rank").alias("nearness"))


def monthly_sketches(spark, d) -> DataFrame:
    """Sketches of lineitem's numbers per month, stored."""
    line = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_discount")))
    return io.stage(sketches.by_period(line, F.trunc("l_shipdate", "month"), ["l_extendedprice", "l_quantity", "l_discount"]), folder(spark, "sketches"))


@query("""SELECT CAST(y AS INTEGER) AS year, "column", count(*) AS rows, count(*) - count(v) AS n_null, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most, true AS median_fits, true AS distinct_fits
FROM (SELECT year(l_shipdate) AS y, unnest([{'column': 'l_extendedprice', 'v': CAST(l_extendedprice AS DOUBLE)}, {'column': 'l_quantity', 'v': CAST(l_quantity AS DOUBLE)},
  {'column': 'l_discount', 'v': CASE WHEN l_orderkey % 9 <> 0 THEN CAST(l_discount AS DOUBLE) END}], recursive := true) FROM lineitem) GROUP BY ALL""")
def sketched_audit(spark, d):
    """Months' sketches merged to years; medians and numbers of distinct values lie within the stated errors of the
    exact ones, which are counted beside them."""
    years = sketches.merged(monthly_sketches(spark, d), [F.year("period").alias("year")])
    got = sketches.audit(years, ["year"], {"median": 0.5})
    columns = ["l_extendedprice", "l_quantity", "l_discount"]
    line = table(spark, d, "lineitem").withColumn("l_discount", F.when(F.col("l_orderkey") % 9 != 0, F.col("l_discount")))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = line.select(F.year("l_shipdate").alias("year"), F.inline(cells)).where("v IS NOT NULL").join(F.broadcast(got.select("year", "column", "median")), ["year", "column"])
    below, upto = F.avg((F.col("v") < F.col("median")).cast("double")), F.avg((F.col("v") <= F.col("median")).cast("double"))
    exact = rows.groupBy("year", "column").agg((F.greatest(below - 0.5, 0.5 - upto) <= sketches.rank_error()).alias("median_fits"), F.count_distinct("v").alias("exact"))
    fits = F.abs(F.col("n_distinct") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    out = got.join(exact, ["year", "column"])
    return out.select("year", "column", "rows", "n_null", "least", "most", "median_fits", fits.alias("distinct_fits"))


@query("""WITH m AS (SELECT quantile_disc(l_quantity, 0.5) AS m FROM lineitem WHERE l_linenumber % 3 <> 0)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE m END AS DOUBLE) AS l_quantity FROM lineitem, m""")
def sketched_fill(spark, d):
    """Nulls filled with the median of all months' merged sketches: the values are so few that it is the exact one."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("l_quantity"))
    kept = io.stage(sketches.by_period(line, F.trunc("l_shipdate", "month"), ["l_quantity"]), folder(spark, "sketches"))
    return sketches.fill_median(line, sketches.merged(kept), ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, o_orderdate, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 100000""")
def bucketed_join(spark, d):
    """Facts joined with their dimension, both stored in buckets of the key: no exchange."""
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    n = bucketed.buckets_for(o, line)
    a, b = bucketed.write_bucketed(o, ["o_orderkey"], n), bucketed.write_bucketed(line, ["o_orderkey"], n)
    j = bucketed.co_join(a.where("o_totalprice > 100000"), b, ["o_orderkey"])
    return j.select("o_orderkey", "o_orderdate", "l_linenumber", "l_quantity")


@query("""SELECT event_id, CAST(value > 20 AS INTEGER) + CAST(value > 40 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER) AS votes,
  CAST(CAST(value > 20 AS INTEGER) + CAST(value > 40 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER) > 1.5 AS INTEGER) AS vote FROM events""")
def bucketed_votes(spark, d):
    """Outputs of three models, each stored in buckets of the row's key as it is made, joined without an exchange."""
    e = table(spark, d, "events")
    rules = {"a": F.col("value") > 20, "b": F.col("value") > 40, "c": F.col("event_id") % 3 == 0}
    n = bucketed.buckets_for(e)
    outs = [bucketed.write_bucketed(e.select("event_id", rule.cast("int").alias(f"{m}_pred")), ["event_id"], n) for m, rule in rules.items()]
    j = V.join_outputs([outs[0], *[o.hint("merge") for o in outs[1:]]], ["event_id"])
    preds = [F.col(f"{m}_pred") for m in rules]
    return j.select("event_id", sum(preds[1:], preds[0]).alias("votes"), V.hard_vote(preds).alias("vote"))
