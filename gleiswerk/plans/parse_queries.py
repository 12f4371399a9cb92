"""Queries of parsers, sources and sinks: P1-P9, S1-S10.

Responses and files are made inside the job from whole tables, written to the
shared folder where the operator reads files, and parsed back; the SQL uses
the columns they were made of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, rules
from ..functions import scalars as s
from ..sources import files
from .registry import query
from .testmodel import cte


def plan_responses(m):
    """Boards: a response for each ride, with a stop element for each of its stops."""
    at = lambda x: F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + x * 60), "yyMMddHHmm")
    stop = F.concat(
        F.lit('<s id="'), F.col("sid").cast("string"), F.lit('"><tl c="'), "train_type", F.lit('" f="F" n="'), F.col("train_num").cast("string"), F.lit('"/><ar pt="'), at(F.col("plan_min")), F.lit('" l="'), "line",
        F.lit('"/><dp pt="'), F.when(F.col("pk") % 7 == 0, "bad").otherwise(at(F.col("plan_min") + 2)), F.lit('"/></s>'),
    )
    return m.stops.withColumn("stop", stop).groupBy("ride_id").agg(F.array_join(F.array_sort(F.collect_list("stop")), "").alias("stops")).select(
        F.when(F.col("ride_id") % 13 == 0, "500").otherwise("200").alias("status_code"), F.lit("timetables/v1/plan").alias("api_name"), F.concat(F.lit("https://api/timetables/v1/plan/"), (F.col("ride_id") + 8000000).cast("string"), F.lit("/260901/08")).alias("url"),
        F.concat(F.lit('<timetable station="A">'), "stops", F.when(F.col("ride_id") % 11 == 0, "<broken").otherwise("</timetable>")).alias("response_data"),
    )


PLAN_SQL = """SELECT CAST(sid AS VARCHAR) AS sid, CAST(ride_id + 8000000 AS VARCHAR) AS eva, 'A' AS station, train_type AS train_cat, CAST(train_num AS VARCHAR) AS train_num, line,
day + to_minutes(plan_min) AS sched_arr, CASE WHEN pk % 7 <> 0 THEN day + to_minutes(plan_min + 2) END AS sched_dep
FROM (SELECT *, CAST(date AS TIMESTAMP) + CASE WHEN year(date) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END AS day FROM stops) WHERE ride_id % 11 <> 0"""


@query("p01_plan_rows", cte("stops") + PLAN_SQL)
def p01(m):
    return parsing.plan_rows(plan_responses(m))


@query("s01_raw_archive", cte("stops") + "SELECT count(*) AS n, count(DISTINCT eva) AS boards FROM (" + PLAN_SQL.replace("WHERE ride_id % 11 <> 0", "WHERE ride_id % 11 <> 0 AND ride_id % 13 <> 0") + ")")
def s01(m):
    path = files.scratch(m.spark, "raw")
    plan_responses(m).write.parquet(path)
    rows = parsing.plan_rows(files.raw_archive(m.spark, path, "timetables/v1/plan"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("eva").alias("boards"))


def change_responses(m):
    """A response for each poll."""
    code = F.coalesce(F.col("code").cast("string"), F.lit("0"))
    body = F.concat(
        F.lit('<timetable><s id="'), F.col("sid").cast("string"), F.lit('"><ar'), F.when(F.col("seq") % 3 == 0, F.concat(F.lit(' ct="'), F.date_format("obs_ts", "yyMMddHHmm"), F.lit('"'))).otherwise(""), F.lit('><m t="d" c="'), code, F.lit('"/><m t="f" c="0"/><m t="d" c="'), code,
        F.lit('"/></ar><dp cs="'), F.when(F.col("seq") % 5 == 0, "c").otherwise("p"), F.lit('"/><m t="h" cat="'), "msg_class", F.lit('"/></s></timetable>'),
    )
    return m.changes.select("obs_ts", "seq", body.alias("response_data"))


@query("p02_change_rows", cte("changes") + """SELECT CAST(sid AS VARCHAR) AS sid, obs_ts, CASE WHEN seq % 3 = 0 THEN date_trunc('minute', obs_ts) END AS real_arr, CAST(NULL AS TIMESTAMP) AS real_dep, CAST(NULL AS VARCHAR) AS cl_arr, CASE WHEN seq % 5 = 0 THEN 'c' ELSE 'p' END AS cl_dep,
CAST(coalesce(code, 0) AS VARCHAR) AS delay_codes, msg_class AS msg_cats FROM changes""")
def p02(m):
    return parsing.change_rows(change_responses(m))


@query("p03_short_time", cte("stops") + "SELECT sid, pk, CASE WHEN pk % 7 <> 0 THEN CAST(date AS TIMESTAMP) + CASE WHEN year(date) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END + to_minutes(plan_min) END AS at FROM stops")
def p03(m):
    text = F.when(F.col("pk") % 7 == 0, "bad").otherwise(F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + F.col("plan_min") * 60), "yyMMddHHmm"))
    return m.stops.select("sid", "pk", parsing.short_time(text).alias("at"))


@query("p04_station_of_url", cte("stops") + "SELECT DISTINCT ride_id, CAST(ride_id + 8000000 AS VARCHAR) AS eva, CASE WHEN ride_id % 2 = 0 THEN 'plan' ELSE 'fchg' END AS kind FROM stops")
def p04(m):
    eva = (F.col("ride_id") + 8000000).cast("string")
    url = F.when(F.col("ride_id") % 2 == 0, F.concat(F.lit("https://api/plan/"), eva, F.lit("/260901/08"))).otherwise(F.concat(F.lit("https://api/fchg/"), eva))
    return m.stops.select("ride_id", url.alias("url")).distinct().select("ride_id", parsing.station_number(F.col("url")).alias("eva"), parsing.endpoint(F.col("url")).alias("kind"))


NEXT = """, nx AS (SELECT ride_id, station_num, line, station, lead(station) OVER w AS dest, plan_min, lead(plan_min) OVER w AS arr FROM clean WINDOW w AS (PARTITION BY ride_id ORDER BY station_num))"""
HHMM = "lpad(CAST({0} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0')"


@query("p05_tolerant_changes", cte("changes") + "SELECT CAST(sid AS VARCHAR) AS id, CAST(coalesce(code, 0) AS VARCHAR) AS codes, msg_class AS cats, count(*) AS n FROM changes GROUP BY 1, 2, 3")
def p05(m):
    rows = parsing.tolerant_changes(change_responses(m).withColumn("response_data", F.concat("response_data", F.lit("<unclosed"))))
    return rows.groupBy("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"), F.array_join("cats", ",").alias("cats")).agg(F.count("*").alias("n"))


def legs(m):
    from pyspark.sql import Window

    from ..operators.rides import clean_stops

    w = Window.partitionBy("ride_id").orderBy("station_num")
    return clean_stops(m.stops).withColumn("dest", F.lead("station").over(w)).withColumn("arr", F.lead("plan_min").over(w)).where("dest is not null")


@query("p06_itinerary_text", cte("clean") + NEXT + f"""SELECT ride_id, CAST(row_number() OVER (PARTITION BY ride_id ORDER BY station_num) - 1 AS INTEGER) AS leg, 'RE ' || (ride_id % 97) AS service, station AS origin, {HHMM.format('plan_min')} AS dep, dest AS destination, {HHMM.format('arr')} AS arr FROM nx WHERE dest IS NOT NULL""")
def p06(m):
    said = F.concat(F.lit("RE "), (F.col("ride_id") % 97).cast("string"), F.lit("\nFrom "), "station", F.lit(" Platform 3a "), s.clock(F.col("plan_min")), F.lit("\nTo "), "dest", F.lit(" Platform 7 "), s.clock(F.col("arr")))
    text = legs(m).withColumn("said", said).groupBy("ride_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station_num", "said"))), lambda x: x["said"]), "\n").alias("text"))
    return parsing.legs_of_text(text)


@query("p07_page_links", r"""SELECT page_id, CAST(len(l) AS INTEGER) AS n, url_decode(l[1]) AS first, url_decode(l[-1]) AS last FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS l FROM pages) WHERE len(l) > 0""")
def p07(m):
    return parsing.links_of_html(m.table("pages").select("page_id", "html"))


@query("p07_page_legs", cte("clean") + f""", st AS (SELECT ride_id, station_num, station, CASE WHEN pk % 5 = 0 THEN '' ELSE {HHMM.format('plan_min')} END AS arr, CASE WHEN pk % 3 = 0 THEN '' ELSE {HHMM.format('((plan_min + 2) % 1440)')} END AS dep FROM clean),
lg AS (SELECT ride_id // 32 AS page, ride_id, 'ICE ' || (ride_id % 97) || '/ü' AS service, list({{'name': station, 'arr': arr, 'dep': dep}} ORDER BY station_num) AS s FROM st GROUP BY ride_id HAVING count(*) >= 2)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY ride_id) - 1 AS INTEGER) AS leg, service, s[1].name AS origin, CASE WHEN s[1].dep <> '' THEN s[1].dep ELSE s[1].arr END AS dep, s[-1].name AS destination,
CASE WHEN s[-1].arr <> '' THEN s[-1].arr ELSE s[-1].dep END AS arr, array_to_string(list_transform(s, lambda x: x.name || ' ' || x.arr || '-' || x.dep), '|') AS stops FROM lg""")
def p07_legs(m):
    """Pages of several rides each, made of the stops: a leg for each ride of two stops or more."""
    from ..operators.rides import clean_stops

    clock = lambda x, n: F.when(F.col("pk") % n != 0, F.concat(F.lit(' class="' + ("ArrivalTime" if n == 5 else "DepartureTime") + ' now">'), s.clock(x), F.lit(" "))).otherwise(F.lit(">"))
    stop = F.concat(F.lit('<div class="RouteStop"><a href="/s?x=1&name='), F.url_encode("station"), F.lit('&y">there</a><b'), clock(F.col("plan_min"), 5), F.lit("</b><b"), clock((F.col("plan_min") + 2) % 1440, 3), F.lit("</b></div>"))
    ride = clean_stops(m.stops).withColumn("stop", stop).groupBy("ride_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station_num", "stop"))), lambda x: x["stop"]), "\n").alias("stops"))
    title = F.concat(F.lit('<div class="SubTitle"><a href="/t?name='), F.url_encode(F.concat(F.lit("ICE "), (F.col("ride_id") % 97).cast("string"), F.lit("/ü"))), F.lit('">train</a></div>\n<refresh-container a="b" data-id="stopList7">'))
    leg = ride.select(F.expr("ride_id div 32").alias("page"), "ride_id", F.concat(title, "stops", F.lit("</refresh-container>")).alias("leg"))
    pages = leg.groupBy("page").agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ride_id", "leg"))), lambda x: x["leg"]), "<hr>"), F.lit("</html>")).alias("html"))
    said = F.array_join(F.transform("stops", lambda x: F.concat(x["name"], F.lit(" "), x["arr"], F.lit("-"), x["dep"])), "|")
    return parsing.legs_of_html(pages).withColumn("stops", said)


@query("p08_compact_records", cte("clean") + NEXT + """SELECT ride_id, CAST(row_number() OVER (PARTITION BY ride_id ORDER BY station_num) - 1 AS INTEGER) AS leg, station AS origin, dest AS destination, lpad(CAST(plan_min AS VARCHAR), 12, '2') AS dep, lpad(CAST(arr AS VARCHAR), 12, '2') AS arr, 'RE ' || (ride_id % 97) AS service FROM nx WHERE dest IS NOT NULL""")
def p08(m):
    said = F.concat(F.lit("T$A=1@O="), "station", F.lit("@$A=1@O="), "dest", F.lit("@$"), F.lpad(F.col("plan_min").cast("string"), 12, "2"), F.lit("$"), F.lpad(F.col("arr").cast("string"), 12, "2"), F.lit("$RE "), (F.col("ride_id") % 97).cast("string"), F.lit("$"))
    rows = legs(m).withColumn("said", said).groupBy("ride_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("station_num", "said"))), lambda x: x["said"]), "§").alias("record"))
    return parsing.legs_of_record(rows)


@query("p09_message_incidents", f"""SELECT role AS station, {rules.sql_text_category('text', rules.INCIDENT_RULES)} AS category, left(text, 60) AS text60, md5(min(text)) AS text_md5 FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2, 3""")
def p09(m):
    stops = m.table("conversations").where("text is not null").groupBy("conv_id", "role").agg(F.collect_list("text").alias("messages")).withColumnRenamed("role", "station")
    found = parsing.message_incidents(stops, rules.text_category(F.col("text"), rules.INCIDENT_RULES))
    return found.select("station", "category", "text60", F.md5("text").alias("text_md5"))


# -- sources and sinks -----------------------------------------------------------------


def facts(m):
    path = files.scratch(m.spark, "facts")
    files.write_facts(m.stops.select("sid", "train_num", "train_type", "line", "date", "delay"), path)
    return path


@query("s02_monthly_files", cte("stops") + "SELECT strftime(date, '%Y-%m') AS file_month, count(*) AS n, sum(delay) AS total FROM stops GROUP BY 1")
def s02(m):
    return files.monthly_stops(m.spark, facts(m), "delay").groupBy("file_month").agg(F.count("*").alias("n"), F.sum("delay").alias("total"))


@query("s03_one_train", cte("stops") + "SELECT line, train_num, count(*) AS n, sum(delay) AS total FROM stops WHERE (train_num = 42 AND train_type = 'ICE') OR line = 'RE7' GROUP BY 1, 2")
def s03(m):
    return files.one_train(m.spark.read.parquet(facts(m)), 42, "ICE", "RE7").groupBy("line", "train_num").agg(F.count("*").alias("n"), F.sum("delay").alias("total"))


@query("s04_remark_json_lines", cte("remarks") + "SELECT slug AS train_slug, count(*) AS n, CAST(sum(last_delay) AS BIGINT) AS delays FROM remarks WHERE id % 10 <> 0 GROUP BY 1")
def s04(m):
    path = files.scratch(m.spark, "remarks")
    good = F.to_json(F.struct(F.col("date").cast("string").alias("service_date"), F.col("slug").alias("train_slug"), F.col("last_delay").cast("int").alias("last_delay_min"), F.col("remark").alias("remarks")))
    m.remarks.select(F.when(F.col("id") % 20 == 0, "").when(F.col("id") % 10 == 0, '{"broken').otherwise(good)).write.text(path)
    return files.remark_archive(m.spark, path).groupBy("train_slug").agg(F.count("*").alias("n"), F.sum("last_delay_min").alias("delays"))


@query("s05_timetable_json", cte("services") + "SELECT line AS line_number, count(*) AS n, CAST(sum(len(stations)) AS BIGINT) AS calls FROM services GROUP BY 1")
def s05(m):
    path = files.scratch(m.spark, "timetable")
    # an array for each line's services, each file a whole JSON value
    rows = m.services.select(F.col("line").alias("line_number"), "train_type", "stations", F.col("times").cast("array<string>").alias("planned_times"), F.col("n_days").cast("int").alias("n_days"), "region")
    arrays = rows.groupBy("line_number").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.select("value").repartition(8).write.option("lineSep", "\n").text(path)
    lines = m.spark.read.text(path).select(F.explode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in files.SERVICE.split(', '))}>>")).alias("x")).select("x.*")
    return lines.groupBy("line_number").agg(F.count("*").alias("n"), F.sum(F.size("stations")).alias("calls"))


@query("s06_snapshots", cte("stops") + "SELECT train_type AS train, count(*) AS n, count(DISTINCT month(date)) AS months FROM stops WHERE train_type IS NOT NULL GROUP BY 1")
def s06(m):
    path = files.scratch(m.spark, "snapshots")
    rows = m.stops.where("train_type is not null").select(F.col("station").alias("bhf"), F.col("delay").cast("string").alias("adelay"), F.lit("-1").alias("ddelay"), F.col("train_type").alias("train"), F.trunc("date", "month").alias("date"))
    rows.withColumn("date", F.make_date(F.lit(2026), F.month("date"), F.lit(1))).repartition("train", "date").write.partitionBy("train", "date").json(path)
    return files.snapshots(m.spark, path).groupBy("train").agg(F.count("*").alias("n"), F.count_distinct(F.month("date")).alias("months"))


@query("s07_quoted_csv", cte("weather") + "SELECT region, count(*) AS n, CAST(sum(gust) AS BIGINT) AS gusts FROM weather GROUP BY 1")
def s07(m):
    path = files.scratch(m.spark, "weather")
    # each file has its header, with the mark of byte order that the writer of such files puts first
    rows = m.weather.select(F.concat(F.lit(" "), "region", F.lit(" ")).alias("\ufeffregion"), F.lit('a "b", c').alias("note"), F.col("gust").cast("int").alias("gust"))
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{path}/csv")
    found = files.quoted_csv(m.spark, f"{path}/csv")
    return found.groupBy(F.trim("region").alias("region")).agg(F.count("*").alias("n"), F.sum(F.col("gust").cast("long")).alias("gusts"))


@query("s08_written_facts", cte("stops") + "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, count(DISTINCT line) AS lines FROM stops GROUP BY 1")
def s08(m):
    return m.spark.read.parquet(facts(m)).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("line").alias("lines"))


@query("s09_distinct_shards", cte("stops") + """, v AS (SELECT replace(region, ' ', '_') AS region, ride_id, station_num % 2 = 0 AS early, station_num % 3 = 0 AS late FROM stops)
SELECT region || '.txt' AS name, count(DISTINCT ride_id) AS n_rows, CAST(2 AS BIGINT) AS n_files FROM v WHERE early OR late GROUP BY region""")
def s09(m):
    """Each region's shard came twice under different names, and once more under another with other content: two files stay, whose rows are taken once."""
    path = files.scratch(m.spark, "shards")
    rows = m.stops.select(F.translate("region", " ", "_").alias("region"), "ride_id", "station_num").distinct()
    for name, part in (("date_", 2), ("2026-01-01_date_", 2), ("2026-01-02_date_", 3)):
        own = rows.where(F.col("station_num") % part == 0).select("region", "ride_id").distinct().select(F.concat(F.lit(name), "region", F.lit(".txt")).alias("shard"), F.col("ride_id").cast("string").alias("value"))
        own.repartition("shard").sortWithinPartitions("shard", "value").write.mode("append").partitionBy("shard").text(path)
    shards = files.distinct_shards(m.spark, path, "shard=([^/]+)/")
    found = files.shard_rows(m.spark, path, shards).groupBy("name").agg(F.count("*").alias("n_rows"))
    return found.join(shards.groupBy("name").agg(F.count("*").alias("n_files")), "name")


@query("s10_days_to_load", cte("stops") + "SELECT CAST(unnest(generate_series(max(date) + 1, DATE '2002-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM stops", dates=("day",))
def s10(m):
    listing = m.stops.select(F.concat(F.lit("stops-"), F.col("date").cast("string"), F.lit(".parquet")).alias("name")).distinct()
    return files.days_to_load(listing, "2002-01-31")
