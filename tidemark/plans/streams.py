"""The events table as streams: each query runs its stream to the end of what there is and gives what came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import place
from ..streaming import availability as A
from ..streaming import ordered
from . import views as V
from .panel import S, r

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 hour"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream, with UTC times."""
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    return source.select("event_id", "user_id", "event_type", "value", S("ts").cast("timestamp").alias("ts"))


def finished(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream puts out until it has read what there is; its log and its output lie in the shared folder."""
    path = place(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stateful_filter_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A recursive quantile filter by event type, applied in event order once the watermark has passed."""
    before = {k: spark.conf.get(k, None) for k in ordered.PROVIDER}
    for k, v in ordered.PROVIDER.items():
        spark.conf.set(k, v)
    try:
        got = finished(spark, ordered.filtered_quantile(events(spark, sf), "event_type", "ts", "event_id", "value", LATE), "filter")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    return got.groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("forecast"), 4).alias("mean_forecast"), F.count_if(S("value") > S("forecast")).alias("hits"), F.count_if("late").alias("late"))


def stream_known_within(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one type with those of another that the same user had within twelve hours after, as two streams."""
    e = events(spark, sf)
    a = e.filter("event_type = 'click'").select("user_id", S("event_id").alias("event"), S("ts").alias("happened"))
    b = events(spark, sf).filter("event_type = 'purchase'").select("user_id", S("event_id").alias("knowledge"), S("ts").alias("known"))
    out = finished(spark, ordered.known_within(a, b, ["user_id"], "happened", "known", "12 hours", LATE), "known")
    return out.select("user_id", "event", "knowledge", ((F.unix_micros("known") - F.unix_micros("happened")) / 1000000).alias("seconds"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = finished(spark, A.session_clusters(events(spark, sf), ["user_id"], "ts", "6 hours", LATE), "sessions")
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


def stream_sliding_sums(spark: SparkSession, sf: str) -> DataFrame:
    out = finished(spark, A.sliding_sums(events(spark, sf), ["event_type"], "ts", "value", "1 day", "6 hours", LATE), "sums")
    return out.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events", r("total", 3).alias("total"))


def stream_available(spark: SparkSession, sf: str) -> DataFrame:
    """Events that were known in time, where an event is known as many minutes after it as its user number says."""
    e = events(spark, sf).withColumn("known", S("ts") + F.make_dt_interval(mins=S("user_id") % 60))
    out = finished(spark, A.available_only(e, "ts", "known", 30, LATE), "available")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 3).alias("total"))


Q = {f.__name__: f for f in (stateful_filter_stream, stream_known_within, stream_sessions, stream_sliding_sums, stream_available)}

MARK = "mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS passed FROM events)"
SQL = {
    "stateful_filter_stream": f"""WITH {MARK}, e AS (SELECT event_type, ts, event_id, value, coalesce(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS h FROM events),
      f AS (SELECT event_type, value, list_reduce(list_prepend(CAST(0.5 AS DOUBLE), h), lambda v, x: 0.05 + 0.8 * v + 0.25 * abs(x)) AS forecast FROM e, mark WHERE ts <= passed)
      SELECT event_type, count(*) AS n, round(avg(forecast), 4) AS mean_forecast, count(*) FILTER (WHERE value > forecast) AS hits, CAST(0 AS BIGINT) AS late FROM f GROUP BY 1""",
    "stream_known_within": """WITH a AS (SELECT user_id, event_id AS event, ts FROM events WHERE event_type = 'click'), b AS (SELECT user_id, event_id AS knowledge, ts FROM events WHERE event_type = 'purchase'),
      mark AS (SELECT least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b)) - INTERVAL 1 HOUR AS passed)
      SELECT a.user_id, event, knowledge, epoch_us(b.ts - a.ts) / 1000000 AS seconds FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR, mark WHERE knowledge IS NOT NULL OR a.ts + INTERVAL 12 HOUR < passed""",
    "stream_sessions": f"""WITH {MARK}, e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
      g AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS z, count(*) AS events FROM s GROUP BY user_id, k)
      SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, events FROM g, mark WHERE z <= passed""",
    "stream_sliding_sums": f"""WITH {MARK}, e AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start FROM events, (SELECT unnest(range(4)) AS k))
      SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(sum(value), 3) AS total FROM e, mark WHERE start + INTERVAL 1 DAY <= passed GROUP BY 1, 2""",
    "stream_available": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events WHERE user_id % 60 <= 30 GROUP BY 1",
}
