"""Queries that run as streams over all of events: T1-T5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import jobs
from .registry import query


@query("t01_latest_change_stream", """SELECT user_id, max_by(event_type, struct_pack(a := ts, b := event_id)) AS event_type, max_by(value, struct_pack(a := ts, b := event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id""")
def t01(m):
    return jobs.drain(jobs.latest_change(jobs.events(m.spark, m.sf_dir)), "update", "user_id")


@query("t02_day_sums_stream", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (value >= 5) AS ge5, max(value) AS top FROM events GROUP BY 1, 2", dates=("day",))
def t02(m):
    return jobs.drain(jobs.day_sums(jobs.events(m.spark, m.sf_dir)), "update", "day", "event_type")


JOURNEYS = """WITH e AS (SELECT *, user_id AS train, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 + 1 AS stop, event_id % 5 <> 0 AS live, ts + to_minutes((event_id % 7 - 3) * 10) AS due FROM events),
j AS (SELECT train, day, count(*) AS n, max({'stop': stop, 'ts': ts, 'id': event_id, 'delay': value}) FILTER (live) AS last, max(due) FILTER (live) AS latest, CAST(day AS TIMESTAMP) + to_hours(6 + train % 12) AS planned FROM e GROUP BY train, day)
SELECT train, day, coalesce(last.stop, 0) AS stop, coalesce(last.delay, 0) AS delay, n, CASE WHEN last.stop = 8 THEN 'terminal'
  WHEN epoch_ms(greatest(planned, latest)) + 1200000 < (SELECT epoch_ms(max(ts)) FROM events) - 600000 THEN 'time' ELSE 'running' END AS status FROM j"""


@query("t03_running_trains_stream", JOURNEYS, dates=("day",))
def t03(m):
    """Each journey's last status: over at its terminal, over by time, or running when the feed ends."""
    return jobs.drain(jobs.running_trains(jobs.stop_events(jobs.events(m.spark, m.sf_dir))), "append", *jobs.JOURNEY)


@query("t04_unique_visitors_stream", "SELECT count(DISTINCT user_id) AS visitors FROM events")
def t04(m):
    return jobs.drain(jobs.visitors(jobs.events(m.spark, m.sf_dir)), "append").agg(F.count("*").alias("visitors"))


@query("t05_upserted_days_stream", """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(*) FILTER (value >= 5) AS ge5 FROM events GROUP BY 1, 2),
p AS (SELECT day + 1 AS day, event_type, ge5 / n AS predicted FROM d), e AS (SELECT d.day, count(*) AS n_types, round(avg(abs(predicted - ge5 / n)), 4) AS mae FROM d JOIN p ON d.day = p.day AND d.event_type = p.event_type GROUP BY d.day)
SELECT e.day, CAST(s.sig AS BIGINT) AS data_sig, n_types, mae FROM e JOIN (SELECT day, sum(n) AS sig FROM d GROUP BY day) s ON e.day = s.day""", dates=("day",))
def t05(m):
    """The forecast of a day's share of late events is the share of the day before."""
    sums = m.table("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg((F.count_if(F.col("value") >= 5) / F.count("*")).alias("predicted"))
    forecasts = sums.select(F.date_add("day", 1).alias("day"), "event_type", "predicted")
    return jobs.reevaluated_days(jobs.day_sums(jobs.events(m.spark, m.sf_dir)), forecasts).drop("evaluations")
