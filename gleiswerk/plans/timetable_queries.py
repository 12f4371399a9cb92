"""Queries of the timetable: J13-J15, A39, A42-A44, U5, and the alignment of mixed days: W7, W8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment, rides, timetable
from ..sources import files
from . import ride_queries
from .registry import query
from .testmodel import cte


def by_state(m):
    """Services whose stations are states, so that many of them meet."""
    order = F.array_sort(F.collect_list(F.struct("station_num", "state", "plan_min")))
    return rides.clean_stops(m.stops).groupBy("ride_id", "line", "train_type").agg(order.alias("s")).select(F.col("ride_id").alias("service"), "line", "train_type", F.col("s.state").alias("stations"), F.col("s.plan_min").alias("times"))


CONNECT = """, f AS (SELECT ride_id AS service, line, train_type, min(station_num) AS p1, min_by(plan_min, station_num) AS dep FROM clean WHERE state = 'NATION_3' GROUP BY 1, 2, 3),
con AS (SELECT f.service, f.line, f.train_type, f.dep, min_by(c.plan_min, c.station_num) AS arr FROM f JOIN clean c ON f.service = c.ride_id AND c.state = 'NATION_7' AND c.station_num > p1 GROUP BY 1, 2, 3, 4)"""


@query("j13_connections", cte("clean") + CONNECT + "SELECT *, CASE WHEN arr > dep THEN arr - dep END AS duration FROM con ORDER BY dep, service LIMIT 100")
def j13(m):
    return timetable.first_departures(timetable.connections(by_state(m), "NATION_3", "NATION_7"), 100)


@query("j14_departures_around", cte("clean") + CONNECT + """SELECT *, CASE WHEN arr > dep THEN arr - dep END AS duration, (SELECT max(dep) FROM con WHERE dep <= 600) AS earlier, (SELECT min(dep) FROM con WHERE dep > 600) AS later FROM con WHERE dep BETWEEN 570 AND 720""")
def j14(m):
    return timetable.around(timetable.connections(by_state(m), "NATION_3", "NATION_7"), 600)


SERVICES = """, v AS (SELECT ride_id AS service, train_type, min_by(station, station_num) AS first, max_by(station, station_num) AS last, list_sort(list(DISTINCT state)) AS states, ride_id % 300 AS n_days FROM clean GROUP BY ride_id, train_type)"""


@query("j15_similar_services", cte("clean") + SERVICES + """, p AS (SELECT u.service, c.service AS num, round(0.45 * CASE WHEN u.first = c.first AND u.last = c.last THEN 1.0 WHEN u.first = c.first THEN 0.55 ELSE 0.25 END
+ 0.55 * (len(list_intersect(u.states, c.states)) / len(list_distinct(list_concat(u.states, c.states)))), 4) AS score FROM v u JOIN v c ON u.train_type = c.train_type AND (u.first = c.first OR u.last = c.last) AND u.service <> c.service WHERE u.n_days < 30 AND c.n_days >= 30)
SELECT service, min_by(num, struct_pack(a := -score, b := num)) AS num, max(score) AS score, count(*) > 1 AS several FROM p WHERE score >= 0.5 GROUP BY service""")
def j15(m):
    rows = rides.clean_stops(m.stops, "train_type", "station", "state").groupBy("ride_id", "train_type").agg(
        F.min_by("station", "station_num").alias("first"), F.max_by("station", "station_num").alias("last"), F.array_sort(F.collect_set("state")).alias("states")
    ).withColumnRenamed("ride_id", "service").withColumn("n_days", F.col("service") % 300)
    return timetable.numbers_by_similarity(rows.where("n_days < 30"), rows.where("n_days >= 30"), keep=files.written)


VOTES = """, e AS (SELECT DISTINCT service, region, unnest([stations[1], stations[-1]]) AS station FROM services), vt AS (SELECT station, region, count(*) AS n FROM e GROUP BY 1, 2),
vr AS (SELECT station, min_by(region, struct_pack(a := -n, b := region)) AS region, CAST(sum(n) AS BIGINT) AS votes FROM vt GROUP BY station)"""


@query("a39_station_regions", cte("services") + VOTES + "SELECT * FROM vr")
def a39(m):
    return timetable.regions_by_vote(m.services)


@query("a39_regions_passed", cte("services") + VOTES + ", x AS (SELECT DISTINCT service, r.region FROM (SELECT service, unnest(stations) AS station FROM services) c JOIN vr r ON c.station = r.station) SELECT service, string_agg(region, ',' ORDER BY region) AS regions FROM x GROUP BY service")
def a39b(m):
    return timetable.regions_passed(m.services, timetable.regions_by_vote(m.services))


@query("a42_lines_of_type", cte("stops") + "SELECT DISTINCT line FROM stops WHERE train_type = 'IC' AND regexp_matches(line, '^IC[0-9]')")
def a42(m):
    return timetable.lines_of_type(m.services, "IC")


@query("a43_services_of_lines", cte("services") + """SELECT line, service, n_days, first, last, dep FROM (SELECT *, row_number() OVER (PARTITION BY line, first, last, dep ORDER BY n_days DESC, service) AS k
FROM (SELECT line, service, n_days, stations[1] AS first, stations[-1] AS last, times[1] AS dep FROM services)) WHERE k = 1""")
def a43(m):
    return timetable.services_of_lines(m.services)


@query("a44_station_index", cte("services") + "SELECT upper(left(station, 1)) AS letter, count(*) AS n, string_agg(station, '|' ORDER BY station) AS stations FROM (SELECT DISTINCT unnest(stations) AS station FROM services) GROUP BY 1")
def a44(m):
    return timetable.station_index(m.services)


@query("u05_distinct_stations", cte("services") + "SELECT DISTINCT unnest(stations) AS station FROM services")
def u05(m):
    return m.services.select(F.explode("stations").alias("station")).distinct()


#: Each step of a day's alignment as SQL; the longest subsequence by a recursion over its positions.
ALIGNED = (
    ride_queries.templates_sql("patterned", "station", "minute", 5).replace(", s AS", ", step AS").replace("FROM s ", "FROM step ")
    + """, pl AS (SELECT line, k AS template, unnest(stations) AS halt, unnest(times) AS time, generate_subscripts(stations, 1) - 1 AS pos FROM tpl),
mt AS (SELECT r.line, r.date, r.ord, r.minute, template, pos, CASE WHEN station = halt THEN 0 ELSE 1 END AS cost, coalesce(abs(minute - time), 1440) AS off FROM patterned r JOIN pl ON r.line = pl.line
  AND (station = halt OR length(station) >= 4 AND (starts_with(halt, station) OR starts_with(station, halt)))),
nr AS (SELECT line, date, template, ord, minute, min({'cost': cost, 'off': off, 'pos': pos}) AS n FROM mt GROUP BY ALL),
bp AS (SELECT line, date, template, n.pos AS pos, min({'off': n.off, 'ord': ord, 'minute': minute}) AS b FROM nr GROUP BY ALL),
it AS (SELECT line, date, template, list({'pos': pos, 'ord': b.ord} ORDER BY pos) AS c, list(b.minute ORDER BY pos) AS ms FROM bp WHERE b.minute IS NOT NULL GROUP BY ALL),
dp AS (SELECT *, 1 AS i, CAST([] AS BIGINT[]) AS size FROM it UNION ALL
  SELECT line, date, template, c, ms, i + 1, list_append(size, 1 + coalesce(list_max([CASE WHEN ms[j] <= ms[i] THEN size[j] ELSE 0 END FOR j IN range(1, i)]), 0)) FROM dp WHERE i <= len(ms)),
bk AS (SELECT line, date, template, c, ms, size, CAST(list_position(size, list_max(size)) AS BIGINT) AS loc FROM dp WHERE i = len(ms) + 1 UNION ALL
  SELECT line, date, template, c, ms, size, list_filter(range(1, loc), lambda j: size[j] = size[loc] - 1 AND ms[j] <= ms[loc])[1] FROM bk WHERE size[loc] > 1),
al AS (SELECT line, date, template, CAST(c[loc].pos AS INTEGER) AS pos, c[loc].ord AS ord FROM bk UNION ALL SELECT line, date, template, CAST(pos AS INTEGER), b.ord FROM bp WHERE b.minute IS NULL)
"""
)
CHOSEN = """, bw AS (SELECT *, coalesce(last_value(minute IGNORE NULLS) OVER (PARTITION BY line, date ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - minute > 15, false) AS back FROM patterned),
dy AS (SELECT line, date, count(*) AS n, bool_or(back) AS mixed FROM bw GROUP BY 1, 2), cv AS (SELECT line, date, template, count(*) AS covered FROM al GROUP BY 1, 2, 3),
bt AS (SELECT line, date, min({'less': -covered, 'template': template}) AS b FROM cv GROUP BY 1, 2),
kn AS (SELECT dy.*, b.template AS template, coalesce(-b.less, 0) AS covered FROM dy LEFT JOIN bt ON dy.line = bt.line AND dy.date = bt.date),
ch AS (SELECT *, CASE WHEN n < 6 THEN 'none' WHEN mixed AND covered >= 4 AND covered >= 0.2 * n OR NOT mixed AND covered >= 5 AND covered < 0.7 * n THEN 'template' WHEN mixed THEN 'segment' ELSE 'none' END AS action FROM kn)
"""
NORMAL = """, rn AS (SELECT *, sum(CAST(back AS INTEGER)) OVER (PARTITION BY line, date ORDER BY ord) AS run FROM bw),
lg AS (SELECT line, date, min({'less': -size, 'run': run}) AS b FROM (SELECT line, date, run, count(*) AS size FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2),
dc AS (SELECT ch.line, ch.date, template, b.run AS run, CASE WHEN action = 'segment' AND -b.less < 4 THEN 'none' ELSE action END AS action FROM ch JOIN lg ON ch.line = lg.line AND ch.date = lg.date),
nm AS (SELECT r.line, r.date, dc.action, CASE WHEN dc.action = 'template' THEN al.pos ELSE r.ord END AS place, r.station, r.delay FROM rn r JOIN dc ON r.line = dc.line AND r.date = dc.date
  LEFT JOIN al ON dc.action = 'template' AND al.line = r.line AND al.date = r.date AND al.template = dc.template AND al.ord = r.ord
  WHERE CASE dc.action WHEN 'template' THEN al.ord IS NOT NULL WHEN 'segment' THEN r.run = dc.run ELSE true END)
SELECT line, date, action, count(*) AS kept, max_by(delay, place) AS end_delay, max(delay) AS max_delay, min_by(station, {'less': -delay, 'place': place}) AS max_station FROM nm GROUP BY 1, 2, 3"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def aligned(rows):
    return alignment.align(rows, rides.templates(rows, station="station", minute="minute"))


def day_rows(m):
    """The rows of days in order, written: a file holds whole days, so that what is counted by day is counted before it is shuffled."""
    return files.written(alignment.marked(m.patterned), "patterned")


@query("w07_aligned_rows", recursive(cte("patterned") + ALIGNED + "SELECT * FROM al"), dates=("date",))
def w07(m):
    return aligned(m.patterned)


@query("w08_chosen_template", recursive(cte("patterned") + ALIGNED + CHOSEN + "SELECT * FROM ch"), dates=("date",))
def w08(m):
    rows = day_rows(m)
    return alignment.choose(rows, aligned(rows))


@query("w08_normalised_days", recursive(cte("patterned") + ALIGNED + CHOSEN + NORMAL), dates=("date",))
def w08b(m):
    rows = day_rows(m)
    found = aligned(rows)
    return alignment.day_delays(alignment.normalised(rows, found, alignment.choose(rows, found)))
