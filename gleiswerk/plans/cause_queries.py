"""Queries of causes and remarks: J4-J6, A7-A24, A50, A51, U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import causes, delays, remarks, rides
from .registry import query
from .testmodel import cte

CAT = rules.sql_code_category("code")
REASONS = """, reasons AS (SELECT sid AS id, list_sort(list(DISTINCT code)) AS codes, list_sort(list(DISTINCT msg) FILTER (msg IS NOT NULL)) AS msgs FROM stops GROUP BY sid)"""


def reasons_of(m):
    return causes.stop_reasons(m.stops.withColumnRenamed("sid", "id"))


def unique_stops(m):
    return delays.first_row(m.stops.withColumnRenamed("sid", "id"), "id", "pk", "sk", "price")


@query("j04_stops_with_reasons", cte("clean", "changes") + """SELECT c.sid, c.delay, x.n_codes FROM clean c JOIN (SELECT sid, count(DISTINCT code) AS n_codes FROM changes GROUP BY sid) x ON c.sid = x.sid""")
def j04(m):
    coded = m.changes.groupBy("sid").agg(F.count_distinct("code").alias("n_codes"))
    return delays.first_row(m.stops, "sid", "pk", "sk", "price").select("sid", "delay").join(coded, "sid")


@query("j05_semi_anti", cte("clean", "changes") + """SELECT sid IN (SELECT sid FROM changes) AS has_code, count(*) AS n FROM clean GROUP BY 1""")
def j05(m):
    rows = delays.first_row(m.stops, "sid", "pk", "sk", "price").select("sid")
    known = m.changes.select("sid")
    both = rows.join(known, "sid", "left_semi").withColumn("has_code", F.lit(True)).unionByName(rows.join(known, "sid", "left_anti").withColumn("has_code", F.lit(False)))
    return both.groupBy("has_code").agg(F.count("*").alias("n"))


@query("j06_reason_sets", cte("stops") + """SELECT sid AS id, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, coalesce(array_to_string(list_sort(list(DISTINCT msg) FILTER (msg IS NOT NULL)), ';'), '') AS msgs,
bool_or(coalesce(contains(msg, 'törung'), false)) AS has_stoerung, bool_or(coalesce(contains(msg, 'Bauarbeiten'), false)) AS has_bau, bool_or(coalesce(starts_with(msg, 'Groß'), false)) AS has_gross FROM stops GROUP BY sid""")
def j06(m):
    return reasons_of(m).withColumn("codes", F.array_join(F.col("codes").cast("array<string>"), ",")).withColumn("msgs", F.array_join("msgs", ";"))


@query("a07_cause_frequency", cte("stops") + f""", c AS (SELECT CASE WHEN contains(lower(coalesce(msg, '')), 'bauarbeiten') THEN 'bau' ELSE {CAT} END AS category, count(*) AS n FROM stops GROUP BY 1)
SELECT category, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct, CAST(row_number() OVER (ORDER BY n DESC, category) AS INTEGER) AS rank FROM c""")
def a07(m):
    return causes.cause_frequency(m.stops)


@query("a08_construction_kinds", cte("stops") + f""", c AS (SELECT {rules.sql_construction('code')} AS kind, count(*) AS n FROM stops WHERE contains(lower(coalesce(msg, '')), 'bauarbeiten') OR {CAT} = 'bau' GROUP BY 1)
SELECT kind, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def a08(m):
    return causes.construction_frequency(m.stops)


@query("a09_code_frequency", cte("changes") + """SELECT code, count(DISTINCT (msg_class, sid)) AS n, min(obs_ts) AS first_seen, max(obs_ts) AS last_seen FROM changes GROUP BY code""")
def a09(m):
    return causes.code_frequency(m.changes.select(F.col("msg_class").alias("doc"), F.col("sid").alias("id"), "code", "obs_ts"))


@query("a10_cause_composition", cte("stops") + f""", c AS (SELECT {CAT} AS category, count(*) AS n FROM (SELECT DISTINCT sid, code FROM stops) GROUP BY 1) SELECT category, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def a10(m):
    return causes.cause_composition(reasons_of(m))


@query("a11_measured_by_code", cte("clean") + f"""SELECT r.code, {rules.sql_code_category('r.code')} AS category, count(*) AS n, round(avg(delay), 4) AS avg_delay, round(100.0 * count(*) FILTER (is_canceled) / count(*), 4) AS cancel_pct
FROM (SELECT DISTINCT sid, code FROM stops) r JOIN clean c ON r.sid = c.sid GROUP BY 1, 2""")
def a11(m):
    return causes.measured_by_code(reasons_of(m), unique_stops(m))


@query("a12_with_and_without", cte("clean", "changes") + """SELECT sid IN (SELECT sid FROM changes) AS has_code, count(*) AS n, round(avg(delay), 4) AS avg_delay, round(100.0 * count(*) FILTER (delay >= 5) / count(*), 4) AS pct_ge5,
round(100.0 * count(*) FILTER (is_canceled) / count(*), 4) AS cancel_pct FROM clean GROUP BY 1""")
def a12(m):
    return causes.with_and_without(rides.clean_stops(m.stops, "sid", "delay", "is_canceled"), m.changes.select("sid"), "sid")


@query("a12_top_codes", cte("clean") + """SELECT r.code, count(*) AS n, round(avg(delay), 4) AS avg_delay, round(100.0 * count(*) FILTER (is_canceled) / count(*), 4) AS cancel_pct
FROM (SELECT DISTINCT sid, code FROM stops) r JOIN clean c ON r.sid = c.sid GROUP BY 1 ORDER BY n DESC, code LIMIT 12""")
def a12_codes(m):
    return causes.top_codes(reasons_of(m), unique_stops(m))


PROFILE = """SELECT train, count(DISTINCT date) AS days, count(*) AS stops, count(*) FILTER (code <> 99) AS coded, count(msg) AS with_msg, round(avg(delay), 4) AS avg_delay, greatest(max(delay), 0) AS max_delay,
round(100.0 * count(*) FILTER (is_canceled) / count(*), 4) AS cancel_pct FROM stops GROUP BY train HAVING count(*) >= 5"""


@query("a13_train_profile", cte("stops") + PROFILE)
def a13(m):
    return causes.train_profile(m.stops)


@query("a14_train_causes", cte("stops") + f""", c AS (SELECT train, {CAT} AS category, count(*) AS n, sum(delay) AS total FROM stops GROUP BY 1, 2)
SELECT train, category, n, round(100 * (n / sum(n) OVER w), 4) AS pct, round((sum(total) OVER w / sum(n) OVER w) * (n / sum(n) OVER w) + 1e-9, 4) AS minutes FROM c WINDOW w AS (PARTITION BY train)""")
def a14(m):
    return causes.train_causes(m.stops)


def top_sql(what: str, k: int) -> str:
    return f"""SELECT train, string_agg(v || '=' || n, '|' ORDER BY k) AS top FROM (SELECT train, v, n, row_number() OVER (PARTITION BY train ORDER BY n DESC, v) AS k FROM
(SELECT train, {what} AS v, count(*) AS n FROM stops WHERE {what} IS NOT NULL GROUP BY 1, 2)) WHERE k <= {k} GROUP BY train"""


@query("a15_train_tops", cte("stops") + f""", a AS ({top_sql('code', 12)}), b AS ({top_sql('msg', 8)}), c AS ({top_sql('line', 3)}),
d AS (SELECT train, string_agg(station, '|' ORDER BY k) AS first FROM (SELECT train, station, row_number() OVER (PARTITION BY train ORDER BY first, station) AS k FROM
(SELECT train, station, min({{'date': date, 'ride_id': ride_id, 'station_num': station_num}}) AS first FROM stops GROUP BY 1, 2)) WHERE k <= 8 GROUP BY train)
SELECT a.train, a.top AS codes, coalesce(b.top, '') AS msgs, c.top AS lines, d.first AS stations FROM a LEFT JOIN b ON a.train = b.train JOIN c ON a.train = c.train JOIN d ON a.train = d.train""")
def a15(m):
    """Counts of codes, messages and lines, and the first stations that a train is seen at."""
    out = causes.first_of_each(m.stops, "train", "station", 8, "date", "ride_id", "station_num").select("train", F.array_join("first", "|").alias("stations"))
    for what, k, name in (("code", 12, "codes"), ("msg", 8, "msgs"), ("line", 3, "lines")):
        said = F.array_join(F.transform("top", lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))), "|")
        out = out.join(causes.counts_of_each(m.stops, "train", what, k).select("train", said.alias(name)), "train", "left")
    return out.withColumn("msgs", F.coalesce("msgs", F.lit("")))


@query("a16_baseline_shares", cte("stops") + f""", p AS ({PROFILE}), c AS (SELECT {CAT} AS category, count(*) AS n FROM stops WHERE train IN (SELECT train FROM p WHERE stops >= 20) GROUP BY 1)
SELECT category, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def a16(m):
    return causes.baseline_shares(m.stops, causes.train_profile(m.stops, 20))


@query("a50_type_by_cause", cte("clean") + "SELECT train_type, " + ", ".join(f"count(*) FILTER ({rules.sql_code_category('r.code')} = '{c}') AS {c}" for c in causes.PIVOT)
       + " FROM (SELECT DISTINCT sid, code FROM stops) r JOIN clean c ON r.sid = c.sid GROUP BY train_type")
def a50(m):
    return causes.type_by_cause(reasons_of(m), unique_stops(m))


@query("a51_message_combinations", cte("stops") + REASONS + r"""SELECT array_to_string(list_sort(list_distinct([rtrim(trim(split_part(trim(x), '(', 1)), '.') for x in coalesce(msgs, [])])), '+') AS combination, count(*) AS n FROM reasons GROUP BY 1 ORDER BY n DESC, combination LIMIT 8""")
def a51(m):
    return causes.message_combinations(reasons_of(m))


# -- the remark archive -----------------------------------------------------------------

MARKED = f""", marked AS (SELECT *, greatest(max_delay, last_delay) AS delay, {rules.sql_text_category('remark')} AS category, trim(coalesce(remark, '')) <> '' AS has FROM remarks)"""


@query("a17_archive_totals", cte("remarks") + MARKED + """SELECT count(*) AS records, count(*) FILTER (has) AS with_remark, round(100.0 * count(*) FILTER (has) / count(*), 4) AS pct_with, round(avg(delay) FILTER (has), 4) AS avg_with,
round(avg(delay) FILTER (NOT has), 4) AS avg_without, count(DISTINCT remark) FILTER (has) AS distinct_remarks FROM marked""")
def a17(m):
    return remarks.totals(remarks.marked(m.remarks))


@query("a18_remark_frequency", cte("remarks") + MARKED + """, c AS (SELECT remark, category, count(*) AS n FROM marked WHERE has GROUP BY 1, 2)
SELECT md5(remark) AS remark_md5, category, n, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def a18(m):
    return remarks.text_frequency(remarks.marked(m.remarks)).withColumn("remark_md5", F.md5("remark")).drop("remark")


@query("a19_category_strength", cte("remarks") + MARKED + f""", c AS (SELECT category, count(*) AS n, round(avg(delay), 4) AS avg_delay, max(delay) AS max_delay FROM marked WHERE has GROUP BY 1)
SELECT category, n, avg_delay, max_delay, {rules.sql_severity('category')} AS severity, round(100.0 * n / (SELECT sum(n) FROM c), 4) AS pct FROM c""")
def a19(m):
    return remarks.category_strength(remarks.marked(m.remarks))


@query("a20_remarks_per_year", cte("remarks") + MARKED + "SELECT CAST(year(date) AS VARCHAR) AS year, count(*) AS n FROM marked WHERE has GROUP BY 1")
def a20(m):
    return remarks.marked(m.remarks).where("has").groupBy(F.substring(F.col("date").cast("string"), 1, 4).alias("year")).agg(F.count("*").alias("n"))


@query("a21_remark_detail", cte("remarks") + MARKED + f"""SELECT slug, date, category, count(*) AS n, sum(delay) AS sum_delay, max(delay) AS max_delay, round(avg(delay), 4) AS avg_delay, {rules.sql_severity('category')} AS severity
FROM marked WHERE has GROUP BY slug, date, category""", dates=("date",))
def a21(m):
    return remarks.detail(remarks.marked(m.remarks))


@query("a22_train_remark_profile", cte("remarks") + MARKED + """, c AS (SELECT slug, category, count(*) AS n, sum(delay) AS s, max(delay) AS mx FROM marked WHERE has GROUP BY 1, 2)
SELECT slug, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 4) AS avg_delay, max(mx) AS max_delay, min_by(category, struct_pack(a := -n, b := category)) AS dominant, count(*) AS n_categories FROM c GROUP BY slug""")
def a22(m):
    return remarks.train_profile(remarks.marked(m.remarks))


IMPACT = """, k AS (SELECT kind, category, count(*) AS n, sum(delay) AS total FROM marked WHERE has GROUP BY 1, 2),
t AS (SELECT kind, count(*) AS all_n, count(*) FILTER (has) AS with_n, avg(delay) FILTER (has) AS aw, avg(delay) FILTER (NOT has) AS ao FROM marked GROUP BY kind)"""


@query("a23_impact_by_type", cte("remarks") + MARKED + IMPACT + """SELECT k.kind, category, round(with_n / all_n, 4) AS remark_rate, round(aw / ao, 4) AS signal_ratio, round(100.0 * n / sum(n) OVER w, 4) AS rec_pct, round(100.0 * total / sum(total) OVER w, 4) AS delay_pct,
round((total / sum(total) OVER w) / (n / sum(n) OVER w), 4) AS impact_ratio FROM k JOIN t ON k.kind = t.kind WINDOW w AS (PARTITION BY k.kind)""")
def a23(m):
    return remarks.impact_by_type(remarks.marked(m.remarks))


@query("a24_delay_contribution", cte("remarks") + MARKED + """, c AS (SELECT category, count(*) AS n, avg(delay) AS a FROM marked WHERE has GROUP BY 1)
SELECT category, n, round(n * a, 4) AS minutes, round(100.0 * n * a / (SELECT sum(n * a) FROM c), 4) AS delay_pct, round((n * a / (SELECT sum(n * a) FROM c)) / (n / (SELECT sum(n) FROM c)), 4) AS impact_ratio FROM c""")
def a24(m):
    return remarks.contribution(remarks.marked(m.remarks))


@query("u04_state_overlap", cte("rides", "stops") + """, s AS (SELECT train, date, list_sort(list(DISTINCT state)) AS states FROM stops GROUP BY train, date), a AS (SELECT train, min_by(states, date) AS base FROM s GROUP BY train)
SELECT s.train, s.date, CAST(len(list_intersect(states, base)) AS INTEGER) AS shared, round(len(list_intersect(states, base)) / len(states), 4) AS overlap, len(list_intersect(states, base)) > 0 AS any_shared FROM s JOIN a ON s.train = a.train""", dates=("date",))
def u04(m):
    days = m.stops.groupBy("train", "date").agg(F.array_sort(F.collect_set("state")).alias("states"))
    base = days.groupBy("train").agg(F.min_by("states", "date").alias("base"))
    both = F.size(F.array_intersect("states", "base"))
    return days.join(base, "train").select("train", "date", both.alias("shared"), F.round(both / F.size("states"), 4).alias("overlap"), F.arrays_overlap("states", "base").alias("any_shared"))
