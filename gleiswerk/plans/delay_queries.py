"""Queries over stop facts: J1-J3, N17, A1-A6, U1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delays
from .registry import query
from .testmodel import cte


@query("j01_first_plan_row", cte("changes") + """SELECT sid, min_by(msg_class, struct_pack(a := obs_ts, b := seq)) AS msg_class, min_by(seq, struct_pack(a := obs_ts, b := seq)) AS seq FROM changes GROUP BY sid""")
def first_plan_row(m):
    return delays.first_row(m.changes, "sid", "obs_ts", "seq").select("sid", "msg_class", "seq")


LATEST = """SELECT sid, max_by(code, struct_pack(a := obs_ts, b := seq)) AS code, max_by(delay, struct_pack(a := obs_ts, b := seq)) AS delay, max_by(msg_class, struct_pack(a := obs_ts, b := seq)) AS msg_class FROM changes GROUP BY sid"""


@query("j02_latest_change", cte("changes") + LATEST)
def latest_change(m):
    return delays.latest_row(m.changes, "sid", "obs_ts", "seq").select("sid", "code", "delay", "msg_class")


@query("j03_plan_with_changes", cte("changes", "clean") + f""", latest AS ({LATEST})
SELECT c.sid, c.station, c.delay AS planned_delay, l.code, l.delay AS real_delay, l.msg_class FROM clean c LEFT JOIN latest l ON c.sid = l.sid""")
def plan_with_changes(m):
    plan = delays.first_row(m.stops, "sid", "pk", "sk", "price").select("sid", "station", F.col("delay").alias("planned_delay"))
    latest = delays.latest_row(m.changes, "sid", "obs_ts", "seq").select("sid", "code", F.col("delay").alias("real_delay"), "msg_class")
    return delays.plan_with_changes(plan, latest)


def polled_facts(m):
    """Facts of the stops: rows of one sid are polls of it, the first of which is the plan and the last the latest change."""
    minute = lambda x, n: F.timestamp_add("MINUTE", n.cast("int"), x)
    at = minute(F.col("date").cast("timestamp"), F.col("plan_min"))
    no = lambda n, x: F.when(F.col("pk") % n != 0, x)
    rows = m.stops.withColumn("sched_arr", no(11, at)).withColumn("sched_dep", no(7, minute(at, F.lit(2))))
    plan = rows.select("sid", "pk", "sk", "price", (F.col("sk") + 8000000).alias("eva"), "station", no(5, F.col("train_type")).alias("train_cat"), no(5, F.col("train_num").cast("string")).alias("train_num"), "line", "sched_arr", "sched_dep")
    polls = m.stops.select(
        "sid", "pk", "sk", "price", no(3, minute(at, F.col("delay"))).alias("real_arr"), no(4, minute(at, F.col("delay") + 3)).alias("real_dep"), F.when(F.col("is_canceled"), "c").alias("cl_arr"), F.when(F.col("pk") % 50 == 1, "1").alias("cl_dep"),
        F.when(F.col("code") != 99, F.col("code").cast("string")).alias("delay_codes"), F.col("msg").alias("msg_cats"),
    )
    latest = delays.latest_row(polls, "sid", "pk", "sk", "price").drop("pk", "sk", "price")
    return delays.stop_facts(delays.plan_with_changes(delays.first_row(plan, "sid", "pk", "sk", "price").drop("pk", "sk", "price"), latest))


FACT_ROWS = """, tm AS (SELECT *, CAST(date AS TIMESTAMP) + to_minutes(plan_min) AS due FROM stops), pn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY pk, sk, price) AS k FROM tm) WHERE k = 1),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY pk DESC, sk DESC, price DESC) AS k FROM tm) WHERE k = 1),
jn AS (SELECT p.sid, p.sk + 8000000 AS eva, p.station, CASE WHEN p.pk % 5 <> 0 THEN p.train_type END AS train_cat, CASE WHEN p.pk % 5 <> 0 THEN CAST(p.train_num AS VARCHAR) END AS train_num, p.line,
  CASE WHEN p.pk % 11 <> 0 THEN p.due END AS sched_arr, CASE WHEN p.pk % 7 <> 0 THEN p.due + to_minutes(2) END AS sched_dep, CASE WHEN l.pk % 3 <> 0 THEN l.due + to_minutes(CAST(l.delay AS BIGINT)) END AS real_arr,
  CASE WHEN l.pk % 4 <> 0 THEN l.due + to_minutes(CAST(l.delay AS BIGINT) + 3) END AS real_dep, l.is_canceled OR l.pk % 50 = 1 AS cancelled, CASE WHEN l.code <> 99 THEN CAST(l.code AS VARCHAR) END AS delay_codes, l.msg AS msg_cats FROM pn p JOIN lt l ON p.sid = l.sid),
mi AS (SELECT *, CAST(coalesce(sched_dep, sched_arr) AS DATE) AS date, CASE WHEN train_cat IS NULL AND train_num IS NULL THEN CAST(sid AS VARCHAR) ELSE trim(coalesce(train_cat, '') || ' ' || coalesce(train_num, '')) END AS train_label,
  (epoch(real_arr) - epoch(sched_arr)) / 60 AS a, (epoch(real_dep) - epoch(sched_dep)) / 60 AS d FROM jn),
facts AS (SELECT sid, eva, station, date, train_cat, train_num, train_label, line, sched_arr, sched_dep, real_arr, real_dep, CASE WHEN a >= -15 THEN a END AS delay_arr_min, CASE WHEN d >= -15 THEN d END AS delay_dep_min, cancelled, delay_codes, msg_cats FROM mi)
"""


@query("n17_stop_facts", cte("stops") + FACT_ROWS + "SELECT * FROM facts", dates=("date", "sched_arr", "sched_dep", "real_arr", "real_dep"))
def stop_facts(m):
    return polled_facts(m)


@query("n17_daily_statistics", cte("stops") + FACT_ROWS + """, r AS (SELECT *, sched_dep IS NOT NULL AND real_dep IS NOT NULL AND NOT cancelled AS run FROM facts)
SELECT date, count(*) AS stops_total, count(DISTINCT train_label) FILTER (run) AS trips, count(*) FILTER (cancelled) AS cancelled, round(avg(delay_dep_min) FILTER (run), 4) AS avg_delay, round(quantile_cont(delay_dep_min, 0.5) FILTER (run), 4) AS med_delay,
round(quantile_cont(delay_dep_min, 0.9) FILTER (run), 4) AS p90_delay, """
       + ", ".join(f"round(100.0 * count(*) FILTER (run AND delay_dep_min {o} {k}) / count(*) FILTER (run), 4) AS pct_{n}" for o, k, n in (("<=", 1, "le1"), (">=", 3, "ge3"), (">=", 5, "ge5"), (">=", 10, "ge10"), (">=", 30, "ge30")))
       + " FROM r GROUP BY date HAVING count(*) FILTER (run) > 0", dates=("date",))
def statistics_of_facts(m):
    """The daily statistics over the stop facts: unknown delays stay in the shares' denominator."""
    return delays.daily_statistics(delays.departures(polled_facts(m)))


@query("a01_daily_statistics", cte("stops") + """, r AS (SELECT *, NOT is_canceled AS run, CASE WHEN NOT is_canceled AND delay >= -15 THEN delay END AS d FROM stops)
SELECT date, count(*) AS stops_total, count(DISTINCT ride_id) FILTER (run) AS trips, count(*) FILTER (is_canceled) AS cancelled, round(avg(d), 4) AS avg_delay,
round(quantile_cont(d, 0.5), 4) AS med_delay, round(quantile_cont(d, 0.9), 4) AS p90_delay,
round(100.0 * count(*) FILTER (run AND d <= 1) / count(*) FILTER (run), 4) AS pct_le1, round(100.0 * count(*) FILTER (run AND d >= 3) / count(*) FILTER (run), 4) AS pct_ge3,
round(100.0 * count(*) FILTER (run AND d >= 5) / count(*) FILTER (run), 4) AS pct_ge5, round(100.0 * count(*) FILTER (run AND d >= 10) / count(*) FILTER (run), 4) AS pct_ge10,
round(100.0 * count(*) FILTER (run AND d >= 30) / count(*) FILTER (run), 4) AS pct_ge30 FROM r GROUP BY date HAVING count(*) FILTER (run) > 0""", dates=("date",))
def daily_statistics(m):
    return delays.daily_statistics(m.stops)


@query("a02_top_codes", cte("stops") + """, c AS (SELECT date, code, count(*) AS n FROM stops GROUP BY date, code),
k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, code) AS k FROM c)
SELECT date, string_agg(code || ':' || n, ' | ' ORDER BY k) AS top_codes FROM k WHERE k <= 5 GROUP BY date""", dates=("date",))
def top_codes(m):
    return delays.top_codes(m.stops)


@query("a03_day_type_stats", cte("stats") + "SELECT * FROM stats", dates=("date",))
def day_type_stats(m):
    return delays.day_type_statistics(m.stops)


@query("a04_merged_partials", cte("stats") + "SELECT date, train_type, n_stops, n_cancel, cancel_rate, avg_delay, pct_ge5, pct_ge10 FROM stats", dates=("date",))
def merged_partials(m):
    return delays.merge_partials(delays.partial_sums(m.stops, "date", "train_type", "region"))


@query("a05_source_precedence", cte("stats", "stops") + """, raw AS (SELECT date, train_type, count(*) AS n_stops, round(avg(delay), 4) AS avg_delay FROM stops WHERE region = 'EUROPE' GROUP BY date, train_type)
SELECT s.date, s.train_type, coalesce(r.n_stops, s.n_stops) AS n_stops, CASE WHEN r.date IS NULL THEN s.avg_delay ELSE r.avg_delay END AS avg_delay FROM stats s LEFT JOIN raw r ON s.date = r.date AND s.train_type = r.train_type""", dates=("date",))
def source_precedence(m):
    monthly = delays.day_type_statistics(m.stops).select("date", "train_type", "n_stops", "avg_delay")
    raw = m.stops.where("region = 'EUROPE' and train_type is not null").groupBy("date", "train_type").agg(F.count("*").alias("n_stops"), F.round(F.avg("delay"), 4).alias("avg_delay"))
    return delays.by_precedence([monthly, raw], "date", "train_type")


@query("a06_type_volume", cte("stops") + "SELECT train_type, count(*) AS volume FROM stops WHERE train_type IS NOT NULL GROUP BY train_type ORDER BY volume DESC, train_type LIMIT 3")
def type_volume(m):
    return delays.type_volume(m.stops.where("train_type is not null").groupBy("date", "train_type").agg(F.count("*").alias("n_stops")), 3)


@query("u01_union_sources", cte("stops", "changes") + """SELECT src, count(*) AS n, sum(CAST(code AS BIGINT)) AS codes, round(avg(delay), 4) AS avg_delay FROM
(SELECT 'monthly' AS src, code, delay FROM stops UNION ALL SELECT 'raw', code, delay FROM changes) GROUP BY src""")
def union_sources(m):
    both = m.stops.select(F.lit("monthly").alias("src"), "code", "delay").unionByName(m.changes.select(F.lit("raw").alias("src"), F.col("delay"), F.col("code")))
    return both.groupBy("src").agg(F.count("*").alias("n"), F.sum("code").alias("codes"), F.round(F.avg("delay"), 4).alias("avg_delay"))
