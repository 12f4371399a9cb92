"""Queries of rides and train-days: W4-W6, W9-W14, W16, W17, A25, A31-A38, A40, A41, A45-A49, J10-J12, J16-J23, U3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import causes, rides
from ..sources import files
from .registry import query
from .testmodel import cte

TODAY = "1998-06-01"


def clean(m, *columns):
    return rides.clean_stops(m.stops, *columns)


def of_rides(m):
    return rides.rides(clean(m))


def days(m):
    return rides.train_days(of_rides(m))


def details(m, station="station"):
    return rides.train_day_details(clean(m), station)


def by_state(sql):
    """The entity of states where ``cte`` has stations: trains pass few states, so they meet."""
    return sql.replace("clean AS (SELECT * FROM (SELECT *,", "clean AS (SELECT * REPLACE (state AS station) FROM (SELECT *,")


def said(calls, station, delay):
    """An array of stations with delays as text."""
    return F.array_join(F.transform(calls, lambda x: F.concat(x[station], F.lit("="), x[delay].cast("int").cast("string"))), "|")


SAID = "array_to_string(list_transform({0}, lambda x: concat(x.station, '=', CAST(x.delay AS INTEGER))), '|')"


@query("w04_monotone_stops", cte("clean") + """SELECT ride_id, station_num, plan_min FROM (SELECT *, max(plan_min) OVER (PARTITION BY ride_id ORDER BY station_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM clean) WHERE b IS NULL OR plan_min > b""")
def w04(m):
    return rides.monotone(clean(m)).select("ride_id", "station_num", "plan_min")


@query("a31_rides", cte("rides") + "SELECT * FROM rides", dates=("date",))
def a31(m):
    return of_rides(m)


@query("a32_train_days", cte("details") + f"SELECT * REPLACE ({SAID.format('sample')} AS sample, {SAID.format('delays')} AS delays) FROM details", dates=("date",))
def a32(m):
    return details(m).withColumn("sample", said("sample", "station", "delay")).withColumn("delays", said(F.array_sort(F.map_entries("delays")), "key", "value"))


@query("a48_station_delays", cte("clean") + """, dd AS (SELECT train, date FROM (SELECT train, date, dense_rank() OVER (PARTITION BY train ORDER BY date DESC) AS k FROM (SELECT DISTINCT train, date FROM clean)) WHERE k <= 10),
sd AS (SELECT train, date, station, delay FROM (SELECT *, row_number() OVER (PARTITION BY train, date, station ORDER BY ride_id, station_num) AS k FROM clean) WHERE k = 1)
SELECT sd.train, sd.date, count(*) AS n, string_agg(station || '=' || CAST(CAST(greatest(delay, 0) AS INTEGER) AS VARCHAR), '|' ORDER BY station) AS delays FROM sd JOIN dd ON sd.train = dd.train AND sd.date = dd.date WHERE delay <> -1 GROUP BY 1, 2""", dates=("date",))
def a48(m):
    found = rides.station_delay_maps(clean(m))
    said = F.transform(F.map_entries("delays"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("int").cast("string")))
    return found.select("train", "date", F.size("delays").cast("long").alias("n"), F.array_join(said, "|").alias("delays"))


@query("a33_baseline_prediction", cte("days") + """SELECT train, round(quantile_cont(d, 0.5), 3) AS median, round(quantile_cont(d, 0.1), 3) AS p10, round(quantile_cont(d, 0.9), 3) AS p90, round(avg(CASE WHEN d >= 15 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 4) AS prob_ge15,
round(avg(CASE WHEN d >= 30 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 4) AS prob_ge30, round(avg(CASE WHEN d < 15 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END), 4) AS on_time, count(d) AS n
FROM (SELECT train, CASE WHEN end_delay >= 0 THEN end_delay END AS d FROM days) GROUP BY train HAVING count(d) > 0""")
def a33(m):
    return rides.baseline(days(m))


ASKED = """, ends AS (SELECT DISTINCT train, min_by(station, station_num) OVER (PARTITION BY ride_id) AS a, max_by(station, station_num) OVER (PARTITION BY ride_id) AS b FROM clean),
asked AS (SELECT train, a AS origin, b AS destination FROM ends UNION SELECT train, b, a FROM ends UNION SELECT train, a, 'Nowhere' FROM ends)"""
SEGMENTS = """, rt AS (SELECT train, list_transform(max_by(sample, struct_pack(a := n_stops, b := date)), lambda x: lower(x.station)) AS names FROM details GROUP BY train),
rc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY train ORDER BY date DESC) AS k FROM details) WHERE k <= 10),
dl AS (SELECT train, date, canceled, unnest(delays) AS e FROM rc), v AS (SELECT a.train, a.origin, a.destination, canceled, greatest(e.delay, 0) AS d FROM asked a JOIN dl ON a.train = dl.train AND e.station = lower(a.destination) WHERE canceled OR e.delay <> -1),
g AS (SELECT train, origin, destination, count(*) FILTER (NOT canceled) AS n_days, count(*) FILTER (canceled) AS canceled_days, round(quantile_cont(d, 0.5) FILTER (NOT canceled), 2) AS median, round(quantile_cont(d, 0.1) FILTER (NOT canceled), 2) AS p10,
  round(quantile_cont(d, 0.9) FILTER (NOT canceled), 2) AS p90, round(avg(CASE WHEN d >= 15 THEN 1.0 ELSE 0.0 END) FILTER (NOT canceled), 4) AS prob_ge15 FROM v GROUP BY 1, 2, 3),
er AS (SELECT a.*, CASE WHEN NOT list_contains(names, lower(a.origin)) THEN 'from_not_in_route' WHEN NOT list_contains(names, lower(a.destination)) THEN 'to_not_in_route' WHEN g.train IS NULL THEN 'no_segment_data' END AS error, n_days, canceled_days, median, p10, p90, prob_ge15
  FROM asked a JOIN rt ON a.train = rt.train LEFT JOIN g ON a.train = g.train AND a.origin = g.origin AND a.destination = g.destination)
SELECT train, origin, destination, error, CASE WHEN error IS NULL THEN n_days END AS n_days, CASE WHEN error IS NULL THEN canceled_days END AS canceled_days, CASE WHEN error IS NULL THEN median END AS median, CASE WHEN error IS NULL THEN p10 END AS p10,
  CASE WHEN error IS NULL THEN p90 END AS p90, CASE WHEN error IS NULL THEN prob_ge15 END AS prob_ge15 FROM er"""


@query("a34_segment_statistics", by_state(cte("details")) + ASKED + SEGMENTS)
def a34(m):
    """Asked: from each ride's first state to its last one, back, and to nowhere."""
    days = details(m, "state")
    ends = clean(m).groupBy("ride_id", "train").agg(F.min_by("state", "station_num").alias("a"), F.max_by("state", "station_num").alias("b"))
    pair = lambda a, b: F.struct(F.col("a").alias("origin") if a == "a" else F.col("b").alias("origin"), b.alias("destination"))
    asked = ends.select("train", F.explode(F.array(pair("a", F.col("b")), pair("b", F.col("a")), pair("a", F.lit("Nowhere")))).alias("q")).select("train", "q.*").distinct()
    return rides.segments(asked, days)


@query("a35_cancel_probability", cte("rides") + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY train ORDER BY date DESC) AS k FROM rides), l AS (SELECT * FROM r WHERE k <= 20),
c AS (SELECT train, last_state, count(*) AS n FROM l GROUP BY 1, 2), mn AS (SELECT train, min_by(last_state, struct_pack(a := -n, b := last_state)) AS main FROM c GROUP BY train),
p AS (SELECT l.train, count(*) FILTER (last_state = main) AS ns, count(*) FILTER (last_state = main AND first_canceled) AS cs, count(*) AS na, count(*) FILTER (first_canceled) AS ca FROM l JOIN mn ON l.train = mn.train GROUP BY l.train)
SELECT train, round(CASE WHEN ns >= 5 THEN cs / ns ELSE ca / na END, 4) AS prob, ns >= 5 AS same_state, CASE WHEN ns >= 5 THEN ns ELSE na END AS n FROM p""")
def a35(m):
    return rides.cancel_probability(of_rides(m))


@query("a36_whole_day_cancelled", cte("clean") + """SELECT train, date, round(count(*) FILTER (is_canceled) / count(*), 4) AS share, count(*) FILTER (is_canceled) / count(*) > 0.5 AS cancelled, bool_and(delay = 0) AS all_zero FROM clean GROUP BY 1, 2""", dates=("date",))
def a36(m):
    return rides.whole_day_cancelled(clean(m))


@query("a37_ride_list", cte("rides") + "SELECT line, first_station, dep_min, count(DISTINCT date) AS days, min(ride_id) AS ride_id FROM rides GROUP BY 1, 2, 3")
def a37(m):
    return rides.ride_list(of_rides(m))


def templates_sql(rows: str, station: str, minute: str, least_stops: int) -> str:
    return f""", s AS (SELECT *, lag({station}) OVER (PARTITION BY ride_id ORDER BY station_num) AS b FROM {rows}),
r AS (SELECT ride_id, line, list({station} ORDER BY station_num) AS stations, list(coalesce({minute}, -1) ORDER BY station_num) AS times FROM s WHERE b IS NULL OR b <> {station} GROUP BY 1, 2),
t AS (SELECT line, stations, count(*) AS n, min(ride_id) AS first_ride, min_by(times, ride_id) AS times FROM r WHERE len(stations) >= {least_stops} GROUP BY 1, 2 HAVING count(*) >= 3),
tpl AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY line ORDER BY n DESC, array_to_string(stations, '>')) AS INTEGER) AS k FROM t) WHERE k <= 10)
"""


TEMPLATE_ROWS = "SELECT line, k, n, first_ride, array_to_string(stations, '>') AS route, array_to_string(times, '>') AS times FROM tpl"


def shown(templates):
    return templates.select("line", "k", "n", "first_ride", F.array_join("stations", ">").alias("route"), F.array_join(F.transform("times", lambda x: x.cast("string")), ">").alias("times"))


@query("a38_trip_templates", cte("patterned") + templates_sql("patterned", "station", "minute", 5) + TEMPLATE_ROWS)
def a38(m):
    """With the contract's thresholds, over rides that follow the ways of their line."""
    return shown(rides.templates(m.patterned, station="station", minute="minute"))


@query("a38_short_trip_templates", cte("clean") + templates_sql("clean", "state", "plan_min", 1) + TEMPLATE_ROWS)
def a38b(m):
    """As a38, of any length, over the states that rides pass."""
    return shown(rides.templates(clean(m), least_stops=1))


@query("a25_line_statistics", cte("rides") + """, p AS (SELECT line, count(*) AS rides, round(avg(end_delay), 4) AS avg_delay, round(quantile_cont(end_delay, 0.95), 4) AS p95, round(100.0 * count(*) FILTER (end_delay = 0) / count(*), 4) AS zero_pct,
round(100.0 * count(*) FILTER (first_canceled) / count(*), 4) AS cancel_pct FROM rides GROUP BY line), w AS (SELECT line, station, row_number() OVER (PARTITION BY line ORDER BY avg(delay) DESC, station) AS k FROM clean GROUP BY line, station),
t AS (SELECT line, string_agg(station, '|' ORDER BY k) AS worst FROM w WHERE k <= 3 GROUP BY line) SELECT p.*, worst FROM p LEFT JOIN t ON p.line = t.line""")
def a25(m):
    return rides.line_statistics(of_rides(m), clean(m))


SMOOTH = """, sm AS (SELECT *, CASE WHEN len(b) > 0 AND len(a) > 0 AND len(list_filter(list_concat(b, a), lambda x: x = list_sort(list_concat(b, a))[2])) >= 3 AND list_contains(b, list_sort(list_concat(b, a))[2]) AND list_contains(a, list_sort(list_concat(b, a))[2])
THEN list_sort(list_concat(b, a))[2] ELSE state END AS smooth FROM (SELECT *, coalesce(list(state) OVER (PARTITION BY ride_id ORDER BY station_num ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS b,
coalesce(list(state) OVER (PARTITION BY ride_id ORDER BY station_num ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS a FROM clean))"""


@query("w06_smoothed_states", cte("clean") + SMOOTH + "SELECT ride_id, station_num, state, smooth FROM sm")
def w06(m):
    return rides.smoothed_states(clean(m)).select("ride_id", "station_num", "state", "smooth")


@query("a40_line_fingerprint", cte("clean") + SMOOTH + """, v AS (SELECT line, smooth AS state, count(*) AS n FROM sm GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n DESC, state) AS k, max(n) OVER (PARTITION BY line) AS top FROM v)
SELECT line, string_agg(state, ',' ORDER BY state) AS states FROM k WHERE k <= 4 AND n >= 0.05 * top GROUP BY line""")
def a40(m):
    return rides.fingerprint(rides.smoothed_states(clean(m))).withColumn("states", F.array_join("states", ","))


@query("a41_main_states", cte("stops") + """, d AS (SELECT train, date, list_sort(list(DISTINCT state)) AS states FROM stops GROUP BY 1, 2), e AS (SELECT train, date, unnest(states) AS state FROM d), c AS (SELECT train, state, count(*) AS n FROM e GROUP BY 1, 2),
s AS (SELECT train, min_by(state, struct_pack(a := -n, b := state)) AS seed FROM c GROUP BY train), sd AS (SELECT d.* FROM d JOIN s ON d.train = s.train WHERE list_contains(states, seed)), dn AS (SELECT train, count(*) AS days FROM sd GROUP BY train),
m AS (SELECT x.train, x.state FROM (SELECT train, state, count(*) AS n FROM (SELECT train, unnest(states) AS state FROM sd) GROUP BY 1, 2) x JOIN dn ON x.train = dn.train WHERE n >= 0.5 * days), l AS (SELECT train, list_sort(list(state)) AS main FROM m GROUP BY train)
SELECT d.train, d.date, array_to_string(main, ',') AS main, round(len(list_intersect(states, main)) / len(states), 4) AS share, len(list_intersect(states, main)) / len(states) >= 0.6 AS kept FROM d JOIN l ON d.train = l.train""", dates=("date",))
def a41(m):
    return rides.main_states(m.stops.groupBy("train", "date").agg(F.array_sort(F.collect_set("state")).alias("states")))


@query("a45_query_popularity", """SELECT event_type, user_id % 97 AS train_num, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM events GROUP BY 1, 2 ORDER BY weight DESC, event_type, train_num LIMIT 20""")
def a45(m):
    logs = m.table("events")
    weighted = [logs.where(c).select("event_type", (F.col("user_id") % 97).alias("train_num"), F.lit(w).alias("w")) for c, w in (("event_type = 'purchase'", 3), ("event_type = 'click'", 2), ("event_type not in ('purchase', 'click')", 1))]
    rows = weighted[0].unionByName(weighted[1]).unionByName(weighted[2])
    return rows.groupBy("event_type", "train_num").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "event_type", "train_num").limit(20)


@query("a46_delay_parity", cte("days", "clean") + """, s AS (SELECT train, date, max_by(delay, struct_pack(a := ride_id, b := station_num)) AS src_end, max(delay) AS src_max FROM clean GROUP BY 1, 2)
SELECT count(*) AS days, count(*) FILTER (abs(end_delay - src_end) <= 0.5) AS end_ok, count(*) FILTER (abs(max_delay - src_max) <= 0.5) AS max_ok, count(*) FILTER (end_delay = 0) AS zero, count(*) FILTER (end_delay = -1) AS minus_one FROM days d JOIN s ON d.train = s.train AND d.date = s.date""")
def a46(m):
    source = clean(m).groupBy("train", "date").agg(F.max_by("delay", F.struct("ride_id", "station_num")).alias("src_end"), F.max("delay").alias("src_max"))
    return rides.parity(days(m), source)


@query("a47_coverage", cte("details") + """SELECT train, count(*) AS days, count(end_delay) AS valid, count(*) FILTER (n_stops < 3) AS limited, min(date) FILTER (end_delay IS NOT NULL) AS first, max(date) FILTER (end_delay IS NOT NULL) AS last,
coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (canceled), '') AS canceled_days FROM details GROUP BY train""", dates=("first", "last",))
def a47(m):
    return rides.coverage(details(m))


def shares_sql(name: str, by: str, where: str, having: str = "") -> str:
    """Shares of causes of the coded stops of each ``by``."""
    keys = f"{by}, " if by else ""
    over = f"PARTITION BY {by}" if by else ""
    return f"""{name} AS (SELECT {keys}category, sum(n) OVER ({over}) AS coded, 100 * (n / sum(n) OVER ({over})) AS pct FROM (SELECT {keys}{rules.sql_code_category('code')} AS category, count(*) AS n FROM stops WHERE {where} GROUP BY {keys}category))"""


@query("a49_decomposed_prediction", cte("days", "stops") + f""", {shares_sql('o', 'train', 'code < 20 AND train_num % 3 = 0')}, {shares_sql('l0', 'line', "code < 10 AND right(line, 1) < '5'")}, l AS (SELECT * FROM l0 WHERE coded >= 4), {shares_sql('a', '', 'true')},
p AS (SELECT t.train, t.line, value FROM (SELECT DISTINCT train, line FROM stops) t JOIN (SELECT train, round(avg(end_delay), 4) AS value FROM days GROUP BY train) v ON t.train = v.train),
ti AS (SELECT p.*, CASE WHEN train IN (SELECT train FROM o WHERE coded >= 8) THEN 'train' WHEN line IN (SELECT line FROM l) THEN 'line' ELSE 'network' END AS tier FROM p),
x AS (SELECT ti.train, ti.line, tier, category, value, pct FROM ti JOIN o ON tier = 'train' AND ti.train = o.train UNION ALL SELECT ti.train, ti.line, tier, category, value, pct FROM ti JOIN l ON tier = 'line' AND ti.line = l.line
  UNION ALL SELECT ti.train, ti.line, tier, category, value, pct FROM ti JOIN a ON tier = 'network'),
m AS (SELECT train, line, tier, category, round(value * pct / 100 + 1e-9, 3) AS minutes FROM x)
SELECT *, CAST(row_number() OVER (PARTITION BY train, line ORDER BY minutes DESC, category) AS INTEGER) AS rank FROM m""")
def a49(m):
    """Profiles are of codes under 20 for a third of the trains, and under 10 for half of the lines (of four such stops), so that each tier has its cases."""
    value = days(m).groupBy("train").agg(F.round(F.avg("end_delay"), 4).alias("value"))
    predictions = m.stops.select("train", "line").distinct().join(value, "train")
    own, line = causes.coded_shares(m.stops.where("code < 20 and train_num % 3 = 0"), "train"), causes.coded_shares(m.stops.where("code < 10 and right(line, 1) < '5'"), "line").where("coded >= 4")
    return rides.decomposed(predictions, own, line, causes.coded_shares(m.stops))


@query("w05_mixed_days", cte("clean") + """SELECT train, date, bool_or(coalesce(lag - plan_min > 15, false)) AS mixed FROM (SELECT *, lag(plan_min) OVER (PARTITION BY train, date ORDER BY ride_id, station_num) AS lag FROM clean) GROUP BY 1, 2""", dates=("date",))
def w05(m):
    return rides.mixed_days(clean(m))


@query("w09_longest_segment", cte("clean") + """, b AS (SELECT *, CASE WHEN lag(plan_min) OVER (PARTITION BY ride_id ORDER BY station_num) - plan_min > 15 THEN 1 ELSE 0 END AS b FROM clean), r AS (SELECT *, sum(b) OVER (PARTITION BY ride_id ORDER BY station_num) AS run FROM b),
s AS (SELECT ride_id, run, count(*) AS n, min(station_num) AS first_num, max(station_num) AS last_num FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY n DESC, run) AS k FROM s) SELECT ride_id, n, first_num, last_num FROM k WHERE k = 1""")
def w09(m):
    return rides.jump_segments(clean(m))


ROUTE = """, l AS (SELECT train, date, ride_id, count(*) AS n FROM clean GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY train ORDER BY n DESC, date DESC, ride_id) AS k FROM l), best AS (SELECT train, date, ride_id FROM b WHERE k = 1)"""


@query("w10_reference_route", cte("clean") + ROUTE + "SELECT b.train, b.date, string_agg(station, '|' ORDER BY station_num) AS stations FROM best b JOIN clean c ON b.ride_id = c.ride_id GROUP BY 1, 2", dates=("date",))
def w10(m):
    return rides.reference_route(clean(m)).withColumn("stations", F.array_join("stations", "|"))


CURVES = """, rt AS (SELECT train, max_by(sample, struct_pack(a := n_stops, b := date)) AS route FROM details GROUP BY train), k AS (SELECT *, row_number() OVER (PARTITION BY train ORDER BY date DESC) AS k FROM details),
z AS (SELECT train FROM k WHERE k <= 3 GROUP BY train HAVING bool_and(coalesce(end_delay, 0) = 0)),
pk AS (SELECT *, false AS historical FROM k WHERE k <= 3 UNION ALL SELECT * EXCLUDE (e), true FROM (SELECT k.*, row_number() OVER (PARTITION BY k.train ORDER BY date DESC) AS e FROM k JOIN z ON k.train = z.train WHERE k > 3 AND end_delay > 0) WHERE e <= 3),
ce AS (SELECT pk.train, pk.date, historical, canceled, delays, sample, generate_subscripts(route, 1) - 1 AS pos, unnest(route).station AS station FROM pk JOIN rt ON pk.train = rt.train),
vl AS (SELECT *, list_filter(delays, lambda x: x.station = lower(ce.station))[1].delay AS d FROM ce),
ou AS (SELECT train, date, historical, CAST(pos AS INTEGER) AS pos, station, CASE WHEN NOT canceled AND d <> -1 THEN greatest(d, 0) END AS delay, d IS NULL AND NOT list_contains(list_transform(sample, lambda x: lower(x.station)), lower(station)) AS skipped FROM vl)
SELECT * FROM ou QUALIFY NOT historical OR count(delay) OVER (PARTITION BY train, date) > 0"""


@query("w11_curve_matrix", cte("details") + CURVES, dates=("date",))
def w11(m):
    return rides.curves(details(m))


@query("w11_curves_of_punctual_trains", cte("details").replace("l_quantity - 20 AS delay", "greatest(l_quantity - 46, 0) AS delay").replace("clean AS (SELECT * FROM (SELECT *,", "clean AS (SELECT * REPLACE (state AS station) FROM (SELECT *,") + CURVES, dates=("date",))
def w11b(m):
    """As w11, over states and where only the largest delays count: many trains were on time for three days, and show earlier ones."""
    lenient = m.stops.withColumn("delay", F.greatest(F.col("delay") - 26, F.lit(0.0)))
    return rides.curves(rides.train_day_details(rides.clean_stops(lenient), "state"))


@query("w12_last_actual", cte("days") + f"SELECT train, max_by(end_delay, date) AS end_delay, max(date) AS date, max(date) = DATE '{TODAY}' AS is_today FROM days WHERE end_delay >= 0 GROUP BY train", dates=("date",))
def w12(m):
    return rides.last_actual(days(m), TODAY)


@query("w13_last_dates", cte("days") + "SELECT train, date, end_delay FROM (SELECT *, dense_rank() OVER (PARTITION BY train ORDER BY date DESC) AS k FROM days) WHERE k <= 5", dates=("date",))
def w13(m):
    return rides.last_dates(days(m), 5).select("train", "date", "end_delay")


@query("w14_adjacent_stations", cte("clean") + """SELECT ride_id, count(*) AS n, string_agg(state, '>' ORDER BY station_num) AS route FROM (SELECT *, lag(state) OVER (PARTITION BY ride_id ORDER BY station_num) AS b FROM clean) WHERE b IS NULL OR b <> state GROUP BY ride_id""")
def w14(m):
    from pyspark.sql import Window

    rows = clean(m).withColumn("b", F.lag("state").over(Window.partitionBy("ride_id").orderBy("station_num"))).where("b is null or b <> state")
    way = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station_num", "state"))), lambda x: x["state"]), ">")
    return rows.groupBy("ride_id").agg(F.count("*").alias("n"), way.alias("route"))


@query("w16_partial_days", cte("days") + "SELECT train, date, end_delay IS NULL OR n_stops < max(n_stops) OVER (PARTITION BY train) AS partial FROM days", dates=("date",))
def w16(m):
    return rides.partial_days(days(m))


@query("w17_pending_snapshots", cte("days") + """, s AS (SELECT *, day(date) % 3 = 0 AS pending FROM days), k AS (SELECT *, row_number() OVER (PARTITION BY train, pending ORDER BY date DESC) AS k FROM s)
SELECT train, date, pending, CASE WHEN NOT pending THEN end_delay END AS end_delay, pending AND k <= 4 AS pull_again FROM k""", dates=("date",))
def w17(m):
    snapshots = days(m).withColumn("written", F.when(F.dayofmonth("date") % 3 == 0, F.col("date")).otherwise(F.date_add("date", 2)).cast("timestamp"))
    return rides.pending_days(snapshots)


# -- joins ------------------------------------------------------------------------------


@query("j10_nearest_ride", cte("clean") + """, cl AS (SELECT line, date, ride_id, state, min_by(plan_min, station_num) AS plan_min, min(station_num) AS first_num, max(station_num) AS last_num FROM clean GROUP BY 1, 2, 3, 4),
q AS (SELECT ride_id AS query, line, date, min_by(state, station_num) AS state, (min_by(plan_min, station_num) + 17) % 1440 AS minute, max_by(state, station_num) AS destination FROM clean GROUP BY 1, 2, 3),
c AS (SELECT q.query, t.ride_id, abs(minute - plan_min) AS gap FROM q JOIN cl t ON q.line = t.line AND q.date = t.date AND q.state = t.state
WHERE abs(minute - plan_min) <= 90 AND EXISTS (SELECT 1 FROM cl g WHERE g.ride_id = t.ride_id AND g.state = q.destination AND g.last_num > t.first_num)) SELECT query, min_by(ride_id, struct_pack(a := gap, b := ride_id)) AS ride_id, min(gap) AS gap FROM c GROUP BY query""")
def j10(m):
    """Each ride asks for the line's day it is of, a bit after its own departure, from its first state to its last."""
    # a line's day is together from here on: rides are grouped, and pairs ordered, within it
    calls = rides.calls_of_rides(clean(m, "line", "date", "state", "plan_min").repartition("line", "date"))
    first = lambda c: F.array_min(F.transform(F.col("calls"), lambda x: F.struct(x["first_num"], x[c])))[c]
    last = F.array_max(F.transform(F.col("calls"), lambda x: F.struct(x["last_num"], x["state"])))["state"]
    asked = F.struct(first("state").alias("state"), last.alias("destination"), ((first("minute") + 17) % 1440).alias("minute"))
    return rides.nearest_of_own_days(calls.withColumn("asked", asked))


@query("j11_number_of_service", cte("clean") + """, q AS (SELECT ride_id, line, min_by(state, station_num) AS origin, min_by(plan_min, station_num) AS dep FROM clean GROUP BY 1, 2),
c AS (SELECT a.ride_id AS service, b.ride_id AS num, abs(a.dep - b.dep) AS gap FROM q a JOIN q b ON a.line = b.line AND a.origin = b.origin AND a.ride_id <> b.ride_id WHERE abs(a.dep - b.dep) <= 10)
SELECT service, min_by(num, struct_pack(a := gap, b := num)) AS num, min(gap) AS gap FROM c GROUP BY service""")
def j11(m):
    """Departures meet in buckets of ten minutes: their own and the two beside it."""
    first = clean(m).groupBy("ride_id", "line").agg(F.min_by("state", "station_num").alias("origin"), F.min_by("plan_min", "station_num").alias("dep"))
    bucket = F.floor(F.col("dep") / 10)
    other = first.select(F.col("ride_id").alias("num"), "line", "origin", F.col("dep").alias("dep2"), bucket.alias("bucket"))
    own = first.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = own.join(other, ["line", "origin", "bucket"]).where("ride_id <> num").withColumn("gap", F.abs(F.col("dep") - F.col("dep2"))).where("gap <= 10")
    return near.groupBy(F.col("ride_id").alias("service")).agg(F.min_by("num", F.struct("gap", "num")).alias("num"), F.min("gap").alias("gap"))


@query("j12_number_by_direction", cte("clean") + """, p AS (SELECT a.line, a.state AS origin, b.state AS dest, a.ride_id, min(a.plan_min) AS dep FROM clean a JOIN clean b ON a.ride_id = b.ride_id AND a.station_num < b.station_num GROUP BY 1, 2, 3, 4)
SELECT line, origin, dest, min_by(ride_id, struct_pack(a := abs(dep - 600), b := ride_id)) AS ride_id, count(*) AS candidates FROM p GROUP BY 1, 2, 3""")
def j12(m):
    a = clean(m).select("line", "ride_id", F.col("state").alias("origin"), F.col("station_num").alias("k1"), "plan_min")
    b = clean(m).select(F.col("ride_id"), F.col("state").alias("dest"), F.col("station_num").alias("k2"))
    pairs = a.join(b, "ride_id").where("k1 < k2").groupBy("line", "origin", "dest", "ride_id").agg(F.min("plan_min").alias("dep"))
    return pairs.groupBy("line", "origin", "dest").agg(F.min_by("ride_id", F.struct(F.abs(F.col("dep") - 600), F.col("ride_id"))).alias("ride_id"), F.count("*").alias("candidates"))


#: States of each train's live days after smoothing, and the main states of a train.
DAY_STATES = """, lv AS (SELECT train, date, end_delay FROM days WHERE n_rides > 1 OR n_stops > 3),
v0 AS (SELECT sm.train, sm.date, smooth AS state, count(*) AS n FROM sm JOIN lv ON sm.train = lv.train AND sm.date = lv.date GROUP BY 1, 2, 3),
v1 AS (SELECT *, row_number() OVER (PARTITION BY train, date ORDER BY n DESC, state) AS k, max(n) OVER (PARTITION BY train, date) AS top FROM v0),
d AS (SELECT train, date, list_sort(list(state)) AS states FROM v1 WHERE k <= 4 AND n >= 0.05 * top GROUP BY 1, 2)"""
MAINS = """, e AS (SELECT train, date, unnest(states) AS state FROM d), c AS (SELECT train, state, count(*) AS n FROM e GROUP BY 1, 2), s AS (SELECT train, min_by(state, struct_pack(a := -n, b := state)) AS seed FROM c GROUP BY train),
sd AS (SELECT d.* FROM d JOIN s ON d.train = s.train WHERE list_contains(states, seed)), dn AS (SELECT train, count(*) AS days FROM sd GROUP BY train),
mn AS (SELECT x.train, list(x.state) AS main FROM (SELECT train, state, count(*) AS n FROM (SELECT train, unnest(states) AS state FROM sd) GROUP BY 1, 2) x JOIN dn ON x.train = dn.train WHERE n >= 0.5 * days GROUP BY x.train)"""


def live_days(m, rows):
    return rides.train_days(rides.rides(rows)).where("n_rides > 1 or n_stops > 3")


def live_mains(smoothed, live):
    """Main states of the trains, by the smoothed states of their live days."""
    return rides.main_set(rides.fingerprint(smoothed.join(live.select("train", "date"), ["train", "date"], "left_semi"), keys=("train", "date")))


@query("j16_gap_fill", cte("days") + SMOOTH + DAY_STATES + MAINS + f""", st AS (SELECT s_name AS station, n_name AS state FROM places WHERE s_suppkey % 7 <> 0)
SELECT train, date, end_delay, 'live' AS source FROM lv UNION ALL SELECT h.train, h.date, h.end_delay, 'history' FROM days h LEFT JOIN lv ON h.train = lv.train AND h.date = lv.date LEFT JOIN st ON h.max_station = st.station LEFT JOIN mn ON h.train = mn.train
WHERE h.date < DATE '{TODAY}' AND lv.train IS NULL AND (st.state IS NULL OR main IS NULL OR list_contains(main, st.state))""", dates=("date",))
def j16(m):
    """A seventh of the stations have no known state."""
    rows = clean(m)
    live = live_days(m, rows)
    known = m.stations.where("s_suppkey % 7 <> 0").select(F.col("station").alias("max_station"), "state")
    return rides.gap_fill(live, days(m).join(known, "max_station", "left"), live_mains(rides.smoothed_states(rows), live), TODAY)


@query("u03_days_not_taken", cte("days") + """SELECT train, date FROM days EXCEPT SELECT train, date FROM days WHERE n_stops >= 3""", dates=("date",))
def u03(m):
    rows = days(m)
    return rows.select("train", "date").subtract(rows.where("n_stops >= 3").select("train", "date"))


@query("j17_profile_tiers", cte("stops") + """, t AS (SELECT DISTINCT train, line FROM stops), o AS (SELECT train, count(*) AS own_n, round(avg(delay), 4) AS own_value FROM stops WHERE code < 30 GROUP BY train), l AS (SELECT line, round(avg(delay), 4) AS line_value FROM stops WHERE code < 20 GROUP BY line HAVING count(*) >= 30),
a AS (SELECT round(avg(delay), 4) AS all_value FROM stops) SELECT t.train, t.line, CASE WHEN coalesce(own_n >= 8, false) THEN 'train' WHEN line_value IS NOT NULL THEN 'line' ELSE 'network' END AS tier,
CASE WHEN coalesce(own_n >= 8, false) THEN own_value WHEN line_value IS NOT NULL THEN line_value ELSE all_value END AS value FROM t LEFT JOIN o ON t.train = o.train LEFT JOIN l ON t.line = l.line, a""")
def j17(m):
    s = m.stops
    value = lambda name: F.round(F.avg("delay"), 4).alias(name)
    own = s.where("code < 30").groupBy("train").agg(F.count("*").alias("own_n"), value("own_value"))
    line = s.where("code < 20").groupBy("line").agg(F.count("*").alias("n"), value("line_value")).where("n >= 30").drop("n")
    return rides.tiers(s.select("train", "line").distinct(), own, line, s.agg(value("all_value")))


@query("j18_tolerant_lookup", cte("stops") + """, k AS (SELECT DISTINCT train_type AS known_type, train_num AS number FROM stops WHERE delay > 28), q AS (SELECT DISTINCT train_type AS type, train_num AS number FROM stops),
c AS (SELECT type, q.number, known_type, CASE WHEN type = known_type THEN 0 WHEN known_type = 'RE' THEN 1 WHEN known_type = 'RB' THEN 2 WHEN known_type = 'IC' THEN 3 WHEN known_type = 'ICE' THEN 4 END AS k FROM q JOIN k ON q.number = k.number)
SELECT type, number, min_by(known_type, struct_pack(a := k, b := known_type)) AS found FROM c WHERE k IS NOT NULL GROUP BY 1, 2""")
def j18(m):
    known = m.stops.where("delay > 28").select(F.col("train_type").alias("known_type"), F.col("train_num").alias("number")).distinct()
    return rides.tolerant_lookup(m.stops.select(F.col("train_type").alias("type"), F.col("train_num").alias("number")).distinct(), known)


@query("j19_prediction_errors", cte("days") + f""", p AS (SELECT train, date + 7 AS date, max_delay AS predicted FROM days)
SELECT p.train, p.date, round(predicted - CASE WHEN end_delay <> -1 THEN end_delay END, 1) AS error, coalesce(end_delay = -1, false) AS cancelled, CASE WHEN p.date < DATE '{TODAY}' THEN CASE WHEN end_delay IS NULL THEN 'yes' ELSE 'no' END END AS needs_backfill FROM p LEFT JOIN days d ON p.train = d.train AND p.date = d.date""", dates=("date",))
def j19(m):
    rows = days(m)
    return rides.prediction_errors(rows.select("train", F.date_add("date", 7).alias("date"), F.col("max_delay").alias("predicted")), rows, TODAY)


@query("j20_transfer_risk", cte("clean") + """, b AS (SELECT ride_id, station_num, delay, ((lead(plan_min) OVER (PARTITION BY ride_id ORDER BY station_num) - plan_min) % 1440 + 1440) % 1440 AS buffer FROM clean)
SELECT ride_id, station_num, buffer, round(least(greatest(greatest(delay, 0) / 30 * CASE WHEN buffer <= 8 THEN 1.3 WHEN buffer <= 15 THEN 0.65 ELSE 0.25 END, 0.02), 0.95), 4) AS miss FROM b WHERE buffer IS NOT NULL""")
def j20(m):
    return rides.transfer_risk(clean(m))


@query("j21_corrected_destination", cte("days") + SMOOTH + DAY_STATES + MAINS + """, st AS (SELECT s_name AS station, n_name AS state, s_suppkey FROM places), us AS (SELECT train, min_by(last_station, struct_pack(a := -n, b := last_station)) AS usual FROM
(SELECT r.train, last_station, count(*) AS n FROM rides r JOIN mn ON r.train = mn.train WHERE list_contains(main, last_state) GROUP BY 1, 2) GROUP BY train),
q AS (SELECT DISTINCT train, dest, CASE WHEN s_suppkey % 7 <> 0 THEN state END AS state FROM (SELECT train, last_station AS dest FROM rides UNION SELECT train, b.s_name FROM rides JOIN places a ON last_station = a.s_name JOIN places b ON b.s_suppkey = a.s_suppkey + 1) x JOIN st ON x.dest = st.station),
kn AS (SELECT DISTINCT train, station FROM clean),
w AS (SELECT q.*, usual, main IS NOT NULL AND (coalesce(NOT list_contains(main, q.state), false) OR kn.train IS NULL) AS wrong FROM q LEFT JOIN kn ON q.train = kn.train AND q.dest = kn.station LEFT JOIN mn ON q.train = mn.train LEFT JOIN us ON q.train = us.train)
SELECT train, dest, CASE WHEN wrong THEN coalesce(usual, dest) ELSE dest END AS corrected, wrong AND coalesce(usual, dest) <> dest AS conflict FROM w""")
def j21(m):
    """Asked: the terminals of each train's rides, and the stations numbered next to them, which the train may never see."""
    rows = files.written(rides.smoothed_states(clean(m, "train", "train_type", "line", "date", "station", "state")), "smoothed")
    rows = rows.withColumns({"delay": F.lit(0.0), "plan_min": F.lit(0), "is_canceled": F.lit(False)})  # parts of rides that nothing reads here
    of = rides.rides(rows)
    mains = live_mains(rows, live_days(m, rows))
    number = m.stations.select("s_suppkey", "station", F.when(F.col("s_suppkey") % 7 != 0, F.col("state")).alias("state"))
    ends = of.select("train", F.col("last_station").alias("station")).distinct().join(number, "station")
    beside = ends.select("train", (F.col("s_suppkey") + 1).alias("s_suppkey")).join(number, "s_suppkey")
    asked = ends.unionByName(beside).select("train", F.col("station").alias("dest"), "state").distinct()
    return rides.corrected_destination(asked, of, rows.select("train", "station"), mains)


@query("j22_route_region", cte("clean") + """SELECT ride_id, max_by(region, station_num) AS region FROM clean WHERE sk % 3 <> 0 GROUP BY ride_id""")
def j22(m):
    known = m.stations.where("s_suppkey % 3 <> 0").select("station", F.col("region").alias("known_region"))
    return rides.route_region(clean(m).select("ride_id", "station_num", "station"), known)


@query("j23_station_number", cte("stops", "stations") + """SELECT s.station, min(eva) AS eva, count(*) AS n FROM stops s LEFT JOIN stations d ON lower(s.station) = lower(d.station) GROUP BY s.station""")
def j23(m):
    dim = m.stations.groupBy(F.lower("station").alias("key")).agg(F.min("eva").alias("eva"))
    seen = m.stops.groupBy("station").agg(F.count("*").alias("n"))
    return seen.join(dim, F.lower("station") == F.col("key"), "left").select("station", "eva", "n")
