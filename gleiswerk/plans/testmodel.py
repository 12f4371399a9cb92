"""The data model's entities, built from the driver's tables; and the same as SQL.

Every entity is derived from whole tables. ``Model`` gives DataFrames, ``cte``
the DuckDB text of the same entities.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rides import clean_stops

#: Train types by order priority's first character.
TYPES = {"1": "ICE", "2": "IC", "3": "RE", "4": "RB", "5": "FLX"}


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def stops(self) -> DataFrame:
        """Stop facts: a row for each train and station.

        The last join is by ride, so that what is grouped by ride isn't shuffled again; tables
        meet stops one by one, as Spark takes a join's size for the product of both; what takes
        less room than what it is made of is made before the joins.
        """
        kind = F.lit(None).cast("string")
        for digit, name in TYPES.items():
            kind = F.when(F.col("o_orderpriority").startswith(digit), name).otherwise(kind)
        orders = self.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), kind.alias("train_type"))
        items = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") - 20).alias("delay"), ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("is_canceled")
        )
        supplier = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        rows = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        number = F.col("l_orderkey") % 97
        return rows.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sid"),
            F.col("l_orderkey").alias("ride_id"),
            F.col("l_linenumber").cast("long").alias("station_num"),
            F.col("s_name").alias("station"),
            F.col("n_name").alias("state"),
            F.col("r_name").alias("region"),
            "date",
            "train_type",
            number.alias("train_num"),
            F.concat_ws(" ", "train_type", number.cast("string")).alias("train"),
            F.concat("train_type", (F.col("l_orderkey") % 40 + 1).cast("string")).alias("line"),
            "delay",
            "is_canceled",
            (F.col("l_partkey") % 100).alias("code"),
            F.when(F.col("l_suppkey") % 4 == 0, "Bauarbeiten.").when(F.col("l_suppkey") % 4 == 1, "Störung. (Quelle: zuginfo)").when(F.col("l_suppkey") % 4 == 2, "Großstörung").alias("msg"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 11) % 1440).alias("plan_min"),
            F.col("l_partkey").alias("pk"),
            F.col("l_suppkey").alias("sk"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def patterned(self) -> DataFrame:
        """Rides that follow one of four ways of their line (one turns back, one passes stations twice), gathered as a day's rows by quarter; some times are unknown.

        In odd quarters a day's rows are ride after ride, in even ones by time.
        """
        way, n = F.col("ride_id") % 4, F.col("station_num")
        halt = F.when(way == 3, 12 - n).when(way == 2, 1 + n % 5).otherwise(2 * way + n)
        rows = clean_stops(self.stops, "line", "date", "pk", "delay").select(
            "line", F.trunc("date", "quarter").alias("date"), "ride_id", "station_num",
            F.when(F.col("pk") % 23 != 0, way * 200 + 300 + n * 11 + F.col("pk") % 7).alias("minute"), "delay",
        )
        by_time = F.when(F.quarter("date") % 2 == 0, F.coalesce("minute", F.lit(1440)))
        rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("line", "date").orderBy(by_time, "ride_id", "station_num")).cast("long"))
        return rows.withColumn("station", F.concat(F.lit("Halt "), halt.cast("string")))

    @cached_property
    def changes(self) -> DataFrame:
        """Polled changes: many observations of a stop."""
        return self.table("events").select(
            F.col("user_id").alias("sid"),
            F.col("ts").alias("obs_ts"),
            F.col("event_id").alias("seq"),
            F.col("event_type").alias("msg_class"),
            F.col("value").alias("delay"),
            F.get_json_object("props", "$.k").cast("long").alias("code"),
        )

    @cached_property
    def remarks(self) -> DataFrame:
        """The remark archive: a text, a train and a day."""
        return self.table("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("slug"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
            F.col("text").alias("remark"),
            F.col("lang").alias("kind"),
            (F.col("n_chars") % 120).cast("double").alias("last_delay"),
            (F.col("n_chars") % 150).cast("double").alias("max_delay"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        """Station-days of weather."""
        return self.table("lineitem").join(self.stations, F.col("l_suppkey") == F.col("s_suppkey")).select(
            "region",
            "station",
            F.to_date("l_shipdate").alias("date"),
            (F.col("l_quantity") - 10).alias("temp"),
            F.round(F.col("l_tax") * 300).alias("precip"),
            (F.round(F.col("l_discount") * 100) / 2).alias("snow"),
            (F.col("l_quantity") * 2).alias("gust"),
            (F.col("l_partkey") % 24).alias("hour"),
        )

    @cached_property
    def stations(self) -> DataFrame:
        return (
            self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("s_name").alias("station"), F.col("n_name").alias("state"), F.col("r_name").alias("region"), (F.col("s_suppkey") + 8000000).alias("eva"))
        )

    @cached_property
    def incidents(self) -> DataFrame:
        """Planned incidents: a region and two weeks for each order."""
        return (
            self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("o_orderkey").alias("incident_id"), F.col("r_name").alias("region"), F.to_date("o_orderdate").alias("start_date"), F.date_add(F.to_date("o_orderdate"), 14).alias("end_date"), (F.col("o_orderkey") % 30).cast("double").alias("delay_min"))
        )

    @cached_property
    def services(self) -> DataFrame:
        """Timetable services: parallel arrays of stations and planned minutes."""
        order = F.array_sort(F.collect_list(F.struct("station_num", "pk", "sk", "price", "station", "plan_min", "region")))
        return (
            self.stops.groupBy("ride_id", "line", "train_type").agg(order.alias("s"))
            .select(F.col("ride_id").alias("service"), "line", "train_type", F.col("s.station").alias("stations"), F.col("s.plan_min").alias("times"), F.col("s")[0]["region"].alias("region"), (F.col("ride_id") % 300).alias("n_days"))
        )


_CTE = {
    "places": ((), """SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "stops": (
        ("places",),
        """SELECT l_orderkey * 10 + l_linenumber AS sid, l_orderkey AS ride_id, CAST(l_linenumber AS BIGINT) AS station_num, s_name AS station, n_name AS state, r_name AS region,
  CAST(o_orderdate AS DATE) AS date, tt AS train_type, l_orderkey % 97 AS train_num, tt || ' ' || (l_orderkey % 97) AS train, tt || (l_orderkey % 40 + 1) AS line,
  l_quantity - 20 AS delay, l_returnflag = 'R' AND l_linestatus = 'F' AS is_canceled, l_partkey % 100 AS code,
  CASE l_suppkey % 4 WHEN 0 THEN 'Bauarbeiten.' WHEN 1 THEN 'Störung. (Quelle: zuginfo)' WHEN 2 THEN 'Großstörung' END AS msg,
  (l_orderkey * 7 + l_linenumber * 11) % 1440 AS plan_min, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS price
FROM lineitem JOIN (SELECT *, CASE left(o_orderpriority, 1) WHEN '1' THEN 'ICE' WHEN '2' THEN 'IC' WHEN '3' THEN 'RE' WHEN '4' THEN 'RB' WHEN '5' THEN 'FLX' END AS tt FROM orders) ON l_orderkey = o_orderkey
JOIN places ON l_suppkey = s_suppkey""",
    ),
    "changes": ((), """SELECT user_id AS sid, ts AS obs_ts, event_id AS seq, event_type AS msg_class, value AS delay, CAST(json_extract_string(props, '$.k') AS BIGINT) AS code FROM events"""),
    "remarks": (
        (),
        """SELECT doc_id AS id, source AS slug, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date, text AS remark, lang AS kind,
  CAST(n_chars % 120 AS DOUBLE) AS last_delay, CAST(n_chars % 150 AS DOUBLE) AS max_delay FROM documents""",
    ),
    "weather": (
        ("places",),
        """SELECT r_name AS region, s_name AS station, CAST(l_shipdate AS DATE) AS date, l_quantity - 10 AS temp, round(l_tax * 300) AS precip,
  round(l_discount * 100) / 2 AS snow, l_quantity * 2 AS gust, l_partkey % 24 AS hour FROM lineitem JOIN places ON l_suppkey = s_suppkey""",
    ),
    "stations": (("places",), """SELECT s_suppkey, s_name AS station, n_name AS state, r_name AS region, s_suppkey + 8000000 AS eva FROM places"""),
    "incidents": (
        (),
        """SELECT o_orderkey AS incident_id, r_name AS region, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 14 AS end_date, CAST(o_orderkey % 30 AS DOUBLE) AS delay_min
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "services": (
        ("stops",),
        """SELECT ride_id AS service, line, train_type, list(station ORDER BY station_num, pk, sk, price, station) AS stations, list(plan_min ORDER BY station_num, pk, sk, price, station) AS times,
  first(region ORDER BY station_num, pk, sk, price, station) AS region, ride_id % 300 AS n_days FROM stops GROUP BY ride_id, line, train_type""",
    ),
    # derived by operators, for the operators above them
    "clean": (
        ("stops",),
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ride_id, station_num ORDER BY pk, sk, price) AS rn FROM stops) WHERE rn = 1""",
    ),
    "patterned": (
        ("clean",),
        """SELECT *, row_number() OVER (PARTITION BY line, date ORDER BY CASE WHEN quarter(date) % 2 = 0 THEN coalesce(minute, 1440) END NULLS FIRST, ride_id, station_num) AS ord FROM
(SELECT line, CAST(date_trunc('quarter', date) AS DATE) AS date, ride_id, station_num, 'Halt ' || CASE ride_id % 4 WHEN 3 THEN 12 - station_num WHEN 2 THEN 1 + station_num % 5 ELSE 2 * (ride_id % 4) + station_num END AS station,
  CASE WHEN pk % 23 <> 0 THEN ride_id % 4 * 200 + 300 + station_num * 11 + pk % 7 END AS minute, delay FROM clean)""",
    ),
    "rides": (
        ("clean",),
        """SELECT ride_id, train, train_type, line, date, count(*) AS n_stops, max_by(delay, station_num) AS end_delay, max(delay) AS max_delay,
  min_by(station, struct_pack(a := -delay, b := station_num)) AS max_station, min_by(is_canceled, station_num) AS first_canceled,
  min_by(station, station_num) AS first_station, max_by(station, station_num) AS last_station, min_by(plan_min, station_num) AS dep_min, max_by(state, station_num) AS last_state
FROM clean GROUP BY ride_id, train, train_type, line, date""",
    ),
    "days": (
        ("rides",),
        """SELECT train, date, round(avg(end_delay), 1) AS end_delay, max(max_delay) AS max_delay, min_by(max_station, struct_pack(a := -max_delay, b := ride_id)) AS max_station,
  count(*) AS n_rides, max(n_stops) AS n_stops FROM rides GROUP BY train, date""",
    ),
    "details": (
        ("days", "clean"),
        """SELECT days.*, canceled, sample, delays FROM days JOIN
(SELECT train, date, bool_or(first_canceled) OR sum(nc) > 0.5 * sum(n) AS canceled, max_by(stops, struct_pack(a := n, b := -ride_id)) AS sample FROM
  (SELECT train, date, ride_id, count(*) AS n, count(*) FILTER (is_canceled) AS nc, min_by(is_canceled, station_num) AS first_canceled, list(struct_pack(num := station_num, station := station, delay := delay) ORDER BY station_num) AS stops FROM clean GROUP BY 1, 2, 3)
  GROUP BY 1, 2) x ON days.train = x.train AND days.date = x.date
JOIN (SELECT train, date, list(struct_pack(station := station, delay := delay) ORDER BY station) AS delays FROM
  (SELECT train, date, lower(station) AS station, min_by(delay, struct_pack(a := ride_id, b := station_num)) AS delay FROM clean WHERE delay IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) y ON days.train = y.train AND days.date = y.date""",
    ),
    "daytype": (
        ("stops",),
        """SELECT date, train_type, count(*) AS n_stops, count(*) FILTER (is_canceled) AS n_cancel, count(*) FILTER (ok) AS cnt, coalesce(sum(delay) FILTER (ok), 0) AS total,
  avg(delay) FILTER (ok) AS avg_delay, quantile_cont(delay, 0.5) FILTER (ok) AS med_delay, quantile_cont(delay, 0.9) FILTER (ok) AS p90_delay,
  count(*) FILTER (ok AND delay >= 5) AS ge5, count(*) FILTER (ok AND delay >= 10) AS ge10
FROM (SELECT *, NOT is_canceled AND delay >= -15 AS ok FROM stops WHERE train_type IS NOT NULL) GROUP BY date, train_type""",
    ),
    "stats": (
        ("daytype",),
        """SELECT date, train_type, n_stops, n_cancel, round(n_cancel / n_stops, 4) AS cancel_rate, round(avg_delay, 4) AS avg_delay, round(med_delay, 4) AS med_delay, round(p90_delay, 4) AS p90_delay,
  round(100.0 * ge5 / nullif(cnt, 0), 4) AS pct_ge5, round(100.0 * ge10 / nullif(cnt, 0), 4) AS pct_ge10 FROM daytype""",
    ),
    "regionday": (
        ("weather",),
        """SELECT region, date, round(avg(temp), 4) AS temp, max(precip) AS precip, max(snow) AS snow, max(gust) AS gust, count(DISTINCT station) AS n_stations FROM weather GROUP BY region, date""",
    ),
}


def cte(*names: str) -> str:
    """WITH clause of the entities and what they need."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for x in _CTE[name][0]:
                add(x)
            done.append(name)

    for x in names:
        add(x)
    return "WITH " + ",\n".join(f"{x} AS ({_CTE[x][1]})" for x in done) + "\n"
