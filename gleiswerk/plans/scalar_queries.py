"""Queries of column functions: N1-N20 (N9-N12, N15 and N17 also where they are used)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scalars as s
from .registry import query
from .testmodel import cte


@query("n01_train_id", cte("stops") + r"""SELECT DISTINCT train, regexp_replace(regexp_replace(upper(trim(train)), '[\s\-]+', '_', 'g'), '([A-Z])(\d)', '\1_\2', 'g') AS id,
regexp_replace(upper(train), '[\s\-_]+', '', 'g') AS plain, regexp_replace(regexp_replace(upper(trim(line)), '[\s\-]+', '_', 'g'), '([A-Z])(\d)', '\1_\2', 'g') AS line_id FROM stops""")
def n01(m):
    return m.stops.select("train", s.train_id(F.col("train")).alias("id"), s.train_id_plain(F.col("train")).alias("plain"), s.train_id(F.col("line")).alias("line_id")).distinct()


@query("n02_split_label", cte("stops") + r"""SELECT DISTINCT train, nullif(regexp_extract(upper(trim(train)), '^(ICE|FLX|RE|RB|IC)', 1), '') AS type, CAST(regexp_extract(train, '(\d+)', 1) AS BIGINT) AS number,
nullif(regexp_extract(upper(trim(train)), '^(ICE|FLX|RE|RB|IC)', 1), '') || CAST(CAST(regexp_extract(train, '(\d+)', 1) AS BIGINT) AS VARCHAR) AS key FROM stops""")
def n02(m):
    t = F.col("train")
    return m.stops.select("train", s.train_type(t).alias("type"), s.train_number(t).alias("number"), s.line_key(t).alias("key")).distinct()


NAME = "n_name || CASE s_suppkey % 4 WHEN 0 THEN ' Hbf' WHEN 1 THEN ' (Main)' WHEN 2 THEN ' Hauptbahnhof' ELSE '-Süd Bf' END || ' ' || s_name"


def names(m):
    """Station names with the suffixes that keys differ by."""
    kind = F.col("s_suppkey") % 4
    tail = F.when(kind == 0, " Hbf").when(kind == 1, " (Main)").when(kind == 2, " Hauptbahnhof").otherwise("-Süd Bf")
    return m.stations.select("s_suppkey", F.concat("state", tail).alias("name"), F.concat_ws(" ", F.concat("state", tail), "station").alias("full"))


SHORT = NAME.replace(" || ' ' || s_name", "")


@query("n03_station_keys", cte("places") + rf"""SELECT s_suppkey, regexp_replace(lower(trim(name)), '[\s\-–—.(),&+/]', '', 'g') AS plain, regexp_replace(lower(trim(name)), '[^\p{{L}}\p{{N}}]', '', 'g') AS alnum,
replace(translate(lower(regexp_replace(trim(name), '( Hauptbahnhof| Hbf| Pbf| \(Main\)| Bf)$', '')), 'üöä -', 'uoa'), 'ß', 'ss') AS folded,
regexp_replace(regexp_replace(lower(name), 'hauptbahnhof|hbf|flughafen|bahnhof', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g') AS bare FROM (SELECT s_suppkey, {SHORT} AS name FROM places)""")
def n03(m):
    n = F.col("name")
    return names(m).select("s_suppkey", s.station_key(n).alias("plain"), s.station_key_alnum(n).alias("alnum"), s.station_key_folded(n).alias("folded"), s.station_key_bare(n).alias("bare"))


@query("n04_key_lookup", cte("places") + rf""", n AS (SELECT s_suppkey, lower({NAME}) AS b FROM places),
k AS (SELECT s_suppkey, unnest([b, replace(b, '-', ' '), replace(b, ' ', '-'), trim(regexp_replace(translate(b, '()', '  '), '\s+', ' ', 'g'))]) AS key, unnest([1, 2, 3, 4]) AS pos FROM n),
d AS (SELECT s_suppkey AS hit, unnest([b, replace(b, '-', ' '), replace(b, ' ', '-'), trim(regexp_replace(translate(b, '()', '  '), '\s+', ' ', 'g')), trim(split_part(b, '(', 1))]) AS key FROM n)
SELECT k.s_suppkey, min_by(hit, struct_pack(a := pos, b := hit)) AS hit, count(DISTINCT k.key) AS n_keys FROM k JOIN d ON k.key = d.key GROUP BY k.s_suppkey""")
def n04(m):
    rows = names(m)
    probe = rows.select("s_suppkey", F.posexplode(s.station_keys(F.col("full"))).alias("pos", "key"))
    build = rows.select(F.col("s_suppkey").alias("hit"), F.explode(s.station_keys(F.col("full"), True)).alias("key"))
    return probe.join(build, "key").groupBy("s_suppkey").agg(F.min_by("hit", F.struct("pos", "hit")).alias("hit"), F.count_distinct("key").alias("n_keys"))


@query("n05_minute_of_day", cte("stops") + r"""SELECT sid, pk, CASE WHEN pk % 10 = 0 THEN NULL ELSE plan_min END AS minute FROM stops""")
def n05(m):
    text = F.when(F.col("pk") % 10 == 0, "99:99").otherwise(s.clock(F.col("plan_min")))
    return m.stops.select("sid", "pk", s.minute_of_day(text).cast("long").alias("minute"))


@query("n06_berlin_clock", "SELECT event_id, strftime(timezone('Europe/Berlin', timezone('UTC', ts)), '%H:%M') AS local FROM events")
def n06(m):
    return m.table("events").select("event_id", s.berlin_clock(F.col("ts")).alias("local"))


@query("n07_transfer_buffer", cte("stops") + "SELECT sid, pk, (plan_min - (plan_min * 7) % 1440 + 1440) % 1440 AS minutes FROM stops")
def n07(m):
    return m.stops.select("sid", "pk", s.buffer_minutes((F.col("plan_min") * 7) % 1440, F.col("plan_min")).alias("minutes"))


@query("n08_traffic_light", cte("stops") + """SELECT train, sid, pk, delay, CASE WHEN delay > 15 THEN 'red' WHEN delay > 5 THEN 'yellow' ELSE 'green' END AS light FROM stops
WHERE contains(lower(train), 'ice 1') ORDER BY delay DESC, sid, pk, sk, price LIMIT 50""")
def n08(m):
    rows = m.stops.where(F.lower("train").contains("ice 1")).orderBy(F.desc("delay"), "sid", "pk", "sk", "price").limit(50)
    return rows.select("train", "sid", "pk", "delay", s.light(F.col("delay")).alias("light"))


@query("n09_code_category", cte("stops") + f"SELECT code, {rules.sql_code_category('code')} AS category, count(*) AS n FROM stops GROUP BY 1, 2")
def n09(m):
    return m.stops.groupBy("code", rules.code_category(F.col("code")).alias("category")).agg(F.count("*").alias("n"))


@query("n10_construction", cte("stops") + f"""SELECT sid, pk, CASE WHEN contains(lower(coalesce(msg, '')), 'bauarbeiten') THEN 'bau' ELSE {rules.sql_code_category('code')} END AS category,
CASE WHEN contains(lower(coalesce(msg, '')), 'bauarbeiten') OR code BETWEEN 30 AND 39 THEN {rules.sql_construction('code')} END AS kind FROM stops""")
def n10(m):
    by_msg = F.lower(F.coalesce("msg", F.lit(""))).contains("bauarbeiten")
    category = F.when(by_msg, "bau").otherwise(rules.code_category(F.col("code")))
    return m.stops.select("sid", "pk", category.alias("category"), F.when(category == "bau", rules.construction_kind(F.col("code"))).alias("kind"))


@query("n11_text_category", cte("remarks") + f"SELECT id, {rules.sql_text_category('remark')} AS archive, {rules.sql_text_category('remark', rules.INCIDENT_RULES)} AS incident FROM remarks")
def n11(m):
    r = F.col("remark")
    return m.remarks.select("id", rules.text_category(r).alias("archive"), rules.text_category(r, rules.INCIDENT_RULES).alias("incident"))


@query("n12_message_class", cte("stops") + r"""SELECT msg, rtrim(trim(split_part(trim(msg), '(', 1)), '.') AS name,
CASE WHEN t LIKE 'bauarbeiten%' THEN 'bau' WHEN t LIKE 'großstörung%' THEN 'gross' WHEN t LIKE 'störung%' THEN 'stoerung' WHEN t LIKE 'information%' THEN 'info' END AS class, count(*) AS n
FROM (SELECT msg, rtrim(regexp_replace(lower(trim(msg)), '\.?\s*\(quelle:[^)]*\)', ''), ' .') AS t FROM stops) GROUP BY 1, 2, 3""")
def n12(m):
    return m.stops.groupBy("msg", s.message_name(F.col("msg")).alias("name"), s.message_class(F.col("msg")).alias("class")).agg(F.count("*").alias("n"))


@query("n13_sentinels", cte("stops") + """SELECT sid, pk, CASE WHEN delay <> -1 AND delay >= -15 THEN delay END AS known, CASE WHEN delay <> -1 THEN greatest(delay, 0) END AS chart,
CASE WHEN pk % 10 <> 0 THEN 'x' END AS planned FROM stops""")
def n13(m):
    text = F.col("delay").cast("string")
    return m.stops.select("sid", "pk", s.known_delay(text).alias("known"), s.known_delay(text, chart=True).alias("chart"), s.scheduled(F.when(F.col("pk") % 10 == 0, "99:99").otherwise("x")).alias("planned"))


STATES = "n_name || CASE s_suppkey % 5 WHEN 0 THEN ' (Westf)' WHEN 1 THEN ' (Bay)' WHEN 2 THEN ' (Mark)' ELSE '' END"


@query("n14_station_state", cte("places") + f"SELECT s_suppkey, CASE WHEN s_suppkey % 50 = 0 THEN 'XX' ELSE coalesce({rules.sql_suffix_state(STATES)}, r_name) END AS state FROM places")
def n14(m):
    kind = F.col("s_suppkey") % 5
    name = F.concat("state", F.when(kind == 0, " (Westf)").when(kind == 1, " (Bay)").when(kind == 2, " (Mark)").otherwise(""))
    rows = m.stations.select("s_suppkey", "region", name.alias("name"))
    override = rows.where("s_suppkey % 50 = 0").select("s_suppkey", F.lit("XX").alias("own"))
    return rows.join(override, "s_suppkey", "left").select("s_suppkey", F.coalesce("own", rules.suffix_state(F.col("name")), "region").alias("state"))


@query("n15_weather_delay", cte("weather") + """SELECT region, station, date, snow, gust, precip, (CASE WHEN snow >= 1 THEN 8 ELSE 0 END) + (CASE WHEN snow >= 3 THEN 20 ELSE 0 END) + (CASE WHEN gust >= 60 THEN 15 ELSE 0 END)
+ (CASE WHEN precip >= 20 THEN 5 ELSE 0 END) AS weather_delay_min, CAST(coalesce(snow >= 1, false) AS INTEGER) AS snow_risk, CAST(coalesce(snow >= 3, false) AS INTEGER) AS heavy_snow_risk,
CAST(coalesce(gust >= 60, false) AS INTEGER) AS strong_wind_risk, CAST(coalesce(precip >= 20, false) AS INTEGER) AS heavy_precip_risk FROM weather""", dates=("date",))
def n15(m):
    measured = F.col("snow"), F.col("gust"), F.col("precip")
    risks = [c.alias(n) for n, c in s.weather_risks(*measured).items()]
    return m.weather.select("region", "station", "date", "snow", "gust", "precip", s.weather_delay(*measured).alias("weather_delay_min"), *risks)


@query("n16_calendar", cte("stops") + "SELECT DISTINCT date, CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(month(date) AS INTEGER) AS month FROM stops", dates=("date",))
def n16(m):
    return m.stops.select("date", F.weekday("date").alias("weekday"), F.month("date").alias("month")).distinct()


IMPORTANCE = """CASE WHEN regexp_matches(lower(name), 'hbf|hauptbahnhof') THEN 10000 ELSE 0 END + CASE WHEN regexp_matches(lower(name), 'flughafen|airport') THEN 8000 ELSE 0 END
+ greatest(0, 30 - length(name)) * 10 + CASE WHEN NOT contains(name, '(') AND NOT contains(split_part(name, ' ', 1), '-') THEN 500 ELSE 0 END"""


@query("n18_station_search", cte("places") + f"""SELECT name, CAST({IMPORTANCE} AS INTEGER) AS score FROM (SELECT DISTINCT {SHORT} AS name FROM places) WHERE lower(name) LIKE 'nation_1%' ORDER BY score DESC, name LIMIT 20""")
def n18(m):
    return station_search(names(m).select("name").distinct(), "nation_1", 20)


def station_search(stations, q: str, k: int):
    """The k most important names that begin with q, or hold it if none does and q has more than two letters."""
    low = F.lower("name")
    starts = low.startswith(q.lower())
    marked = stations.select("name", starts.alias("starts"), low.contains(q.lower()).alias("has"))
    if len(q) <= 2:
        hits = marked.where("starts")
    else:
        some = marked.agg(F.coalesce(F.bool_or("starts"), F.lit(False)).alias("some"))
        hits = marked.join(some, F.when(F.col("some"), F.col("starts")).otherwise(F.col("has")))
    return hits.select("name", s.importance(F.col("name")).cast("int").alias("score")).orderBy(F.desc("score"), "name").limit(k)


@query("n19_token_explode", cte("stops") + """SELECT ride_id, token, count(*) AS n FROM (SELECT ride_id, unnest([CAST(code AS VARCHAR), CAST(code + 1 AS VARCHAR)]) AS token FROM stops) GROUP BY 1, 2""")
def n19(m):
    text = F.concat(F.col("code").cast("string"), F.lit(" ;, "), (F.col("code") + 1).cast("string"), F.lit(",;"))
    return m.stops.select("ride_id", F.explode(s.tokens(text)).alias("token")).groupBy("ride_id", "token").agg(F.count("*").alias("n"))


@query("n20_full_train_key", cte("stops") + r"""SELECT DISTINCT ride_id, CASE WHEN ride_id % 3 = 0 THEN regexp_extract(line, '^([A-Z]+)', 1) ELSE train_type END || '_' || train_num AS key FROM stops WHERE train_type IS NOT NULL""")
def n20(m):
    kind = F.when(F.col("ride_id") % 3 == 0, "ZUG").otherwise(F.col("train_type"))
    return m.stops.where("train_type is not null").select("ride_id", s.full_train_key(kind, F.col("train_num"), F.col("line")).alias("key")).distinct()
