"""Parsers as Spark expressions: timetable XML, change XML, itineraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN = """struct<_station:string, s:array<struct<_id:string, tl:struct<_c:string,_f:string,_n:string>, ar:struct<_pt:string,_l:string>, dp:struct<_pt:string,_l:string>>>>"""
CHANGE = """struct<s:array<struct<_id:string, m:array<struct<_t:string,_c:string,_cat:string>>, ar:struct<_ct:string,_cs:string,m:array<struct<_t:string,_c:string>>>, dp:struct<_ct:string,_cs:string,m:array<struct<_t:string,_c:string>>>>>>"""


def short_time(text: Column) -> Column:
    """YYMMDDHHMM -> timestamp; null if it is none."""
    return F.try_to_timestamp(F.concat(F.lit("20"), text), F.lit("yyyyMMddHHmm"))


def station_number(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:plan|fchg|rchg)/(\d+)", 1), F.lit(""))


def endpoint(url: Column) -> Column:
    return F.when(url.rlike(r"/plan/\d+/\d+/\d+"), "plan").when(url.rlike(r"/fchg/\d+"), "fchg")


def plan_rows(raw: DataFrame) -> DataFrame:
    """Planned stops of archived responses (url, response_data); broken XML gives no rows.

    Two digits of a year don't tell its century: a departure half a century
    before its arrival is of the night in which a century ends, so of the next.
    """
    arrival, departure = short_time(F.col("s.ar._pt")), short_time(F.col("s.dp._pt"))
    next_century = departure < arrival - F.expr("INTERVAL '50' YEAR")
    rows = raw.select("url", F.from_xml("response_data", PLAN).alias("x")).select("url", F.col("x._station").alias("station"), F.explode("x.s").alias("s"))
    return rows.select(
        F.col("s._id").alias("sid"),
        station_number(F.col("url")).alias("eva"),
        "station",
        F.coalesce("s.tl._c", "s.tl._f").alias("train_cat"),
        F.col("s.tl._n").alias("train_num"),
        F.coalesce("s.ar._l", "s.dp._l").alias("line"),
        arrival.alias("sched_arr"),
        F.when(next_century, departure + F.expr("INTERVAL '100' YEAR")).otherwise(departure).alias("sched_dep"),
    )


def change_rows(raw: DataFrame) -> DataFrame:
    """Changed stops of archived responses (response_data, obs_ts): real times, cancel flags, sorted codes and categories; rows of nothing go."""
    rows = raw.select("obs_ts", F.explode(F.from_xml("response_data", CHANGE)["s"]).alias("s"))
    none = F.array().cast("array<struct<_t:string,_c:string>>")
    inner = F.concat(F.coalesce("s.ar.m", none), F.coalesce("s.dp.m", none))
    codes = F.array_sort(F.array_distinct(F.transform(F.filter(inner, lambda x: x["_t"] == "d"), lambda x: x["_c"].try_cast("int"))))
    cats = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("s.m", F.array().cast("array<struct<_t:string,_c:string,_cat:string>>")), lambda x: x["_t"] == "h"), lambda x: x["_cat"])))
    out = rows.select(
        F.col("s._id").alias("sid"), "obs_ts", short_time(F.col("s.ar._ct")).alias("real_arr"), short_time(F.col("s.dp._ct")).alias("real_dep"), F.col("s.ar._cs").alias("cl_arr"), F.col("s.dp._cs").alias("cl_dep"),
        F.array_join(codes.cast("array<string>"), ",").alias("delay_codes"), F.array_join(cats, ",").alias("msg_cats"),
    )
    return out.where("real_arr is not null or real_dep is not null or cl_arr is not null or cl_dep is not null or delay_codes <> '' or msg_cats <> ''")


def tolerant_changes(raw: DataFrame) -> DataFrame:
    """Stops, codes and message categories by patterns, where the XML may be broken."""
    blocks = raw.select(F.explode(F.regexp_extract_all("response_data", F.lit(r'(?s)<s\s[^>]*?id="[^"]+"[^>]*>.*?</s>'), F.lit(0))).alias("b"))
    return blocks.select(
        F.regexp_extract("b", r'<s\s[^>]*?id="([^"]+)"', 1).alias("id"),
        F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("b", F.lit(r'<m\s[^>]*?t="d"[^>]*?\sc="(\d+)"'), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))).alias("codes"),
        F.array_sort(F.array_distinct(F.regexp_extract_all("b", F.lit(r'<m\s[^>]*?t="h"[^>]*?\scat="([^"]+)"'), F.lit(1)))).alias("cats"),
    )


def legs_of_text(rows: DataFrame, text: str = "text") -> DataFrame:
    """Legs of itinerary texts: 'RE 8 From A 10:15 To B 11:20', platforms dropped."""
    clean = F.regexp_replace(text, r"\s*\bPlatform\s+\S+", "")
    pattern = F.lit(r"(?s)\b([A-Z]{2,3} ?\d+)\s+From\s+(.+?)\s+(\d{1,2}:\d{2})\s+To\s+(.+?)\s+(\d{1,2}:\d{2})")
    parts = F.arrays_zip(*(F.regexp_extract_all(clean, pattern, F.lit(k)).alias(n) for k, n in enumerate(("service", "origin", "dep", "destination", "arr"), 1)))
    found = rows.withColumn("__legs", parts)
    return found.select(*rows.columns, F.posexplode("__legs").alias("leg", "__x")).select(*[c for c in rows.columns if c != text], "leg", "__x.*")


def links_of_html(rows: DataFrame, html: str = "html") -> DataFrame:
    """The number of links of a page, its first and its last."""
    links = F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)">'), F.lit(1))
    found = rows.withColumn("__l", links)
    return found.where(F.size("__l") > 0).select(*[c for c in rows.columns if c != html], F.size("__l").alias("n"), F.try_url_decode(F.element_at("__l", 1)).alias("first"), F.try_url_decode(F.element_at("__l", -1)).alias("last"))


def legs_of_html(rows: DataFrame, html: str = "html") -> DataFrame:
    """Legs of an itinerary page (leg, service, stops, origin, dep, destination, arr): a title names the service, the list after it its stops.

    Each stop has name, arrival and departure (empty if not given). The first
    and last stop make the leg, whose times are the departure there (else the
    arrival) and the arrival there (else the departure). A list of fewer than
    two named stops is no leg; legs are numbered among those that are.
    """
    block = F.lit(r'(?si)<div class="SubTitle"><a[^>]*[?&]name=([^&"]+)[^>]*>(?:(?!<div class="SubTitle">).)*?<refresh-container[^>]+data-id="stopList\d+"(.*?)</refresh-container>')
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    time = lambda stop, kind: F.trim(F.regexp_extract(stop, f'(?i)class="{kind}Time[^>]*>([^<]*)<', 1))
    stop = lambda x: F.struct(decoded(F.regexp_extract(x, '(?i)[?&]name=([^&"]+)', 1)).alias("name"), time(x, "Arrival").alias("arr"), time(x, "Departure").alias("dep"))
    stops = lambda x: F.filter(F.transform(F.slice(F.split(x, '<div class="RouteStop"'), 2, 1 << 30), stop), lambda s: s["name"] != "")
    pairs = F.arrays_zip(F.regexp_extract_all(html, block, F.lit(1)).alias("service"), F.regexp_extract_all(html, block, F.lit(2)).alias("list"))
    legs = F.filter(F.transform(pairs, lambda p: F.struct(decoded(p["service"]).alias("service"), stops(p["list"]).alias("stops"))), lambda p: F.size(p["stops"]) >= 2)
    kept = [c for c in rows.columns if c != html]
    found = rows.select(*kept, F.posexplode(legs).alias("leg", "__l")).select(*kept, "leg", "__l.service", "__l.stops")
    first, last = F.element_at("stops", 1), F.element_at("stops", -1)
    either = lambda s, a, b: F.when(s[a] != "", s[a]).otherwise(s[b])
    return found.select(*kept, "leg", "service", "stops", first["name"].alias("origin"), either(first, "dep", "arr").alias("dep"), last["name"].alias("destination"), either(last, "arr", "dep").alias("arr"))


def legs_of_record(rows: DataFrame, record: str = "record") -> DataFrame:
    """Legs of compact records: stations as A=1@O=name@, 12-digit times, then the service."""
    legs = rows.select(*[c for c in rows.columns if c != record], F.posexplode(F.split(record, "§")).alias("leg", "__r"))
    names = F.regexp_extract_all("__r", F.lit(r"A=1@O=([^@]+)@"), F.lit(1))
    times = F.regexp_extract_all("__r", F.lit(r"\b(\d{12})\b"), F.lit(1))
    service = F.regexp_extract("__r", r"\d{12}\D+\d{12}\W+([A-Z]{2,3} ?\d+)", 1)
    return legs.withColumn("origin", F.get(names, F.lit(0))).withColumn("destination", F.get(names, F.lit(1))).withColumn("dep", F.get(times, F.lit(0))).withColumn("arr", F.get(times, F.lit(1))).withColumn("service", service).drop("__r")


def message_incidents(stops: DataFrame, category: Column) -> DataFrame:
    """Messages nested in stops (station, messages) as incidents, one for each category, station and first 60 characters."""
    rows = stops.select("station", F.explode("messages").alias("text")).withColumn("category", category).withColumn("text60", F.substring("text", 1, 60))
    return rows.groupBy("category", "station", "text60").agg(F.min("text").alias("text"))
