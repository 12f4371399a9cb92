"""Operators on small rows with results worked out by hand, and properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleiswerk.functions import parsing, rules
from gleiswerk.functions import scalars as s
from gleiswerk.operators import alignment, causes, delays, forecast, rides, timetable, weather
from gleiswerk.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_plan_and_change_by_hand(spark):
    plan = '<timetable station="A"><s id="1"><tl c="ICE" f="F" n="847"/><ar pt="2609010815" l="11"/><dp pt="2609010817"/></s></timetable>'
    change = '<timetable><s id="1"><ar ct="2609010820"><m t="d" c="43"/><m t="f" c="0"/></ar><m t="h" cat="Bauarbeiten"/></s><s id="2"/></timetable>'
    raw = spark.createDataFrame([("https://x/plan/8000001/260901/08", plan), ("https://x/plan/8000001/260901/09", "<broken"), ("u", None)], "url string, response_data string")
    rows = parsing.plan_rows(raw).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.sid, r.eva, r.station, r.train_cat, r.train_num, r.line) == ("1", "8000001", "A", "ICE", "847", "11")
    assert r.sched_arr == dt.datetime(2026, 9, 1, 8, 15) and r.sched_dep == dt.datetime(2026, 9, 1, 8, 17)
    polls = spark.createDataFrame([(dt.datetime(2026, 9, 1), change), (dt.datetime(2026, 9, 1), "<t"), (dt.datetime(2026, 9, 1), None)], "obs_ts timestamp, response_data string")
    rows = parsing.change_rows(polls).collect()
    assert [(x.sid, x.real_arr, x.real_dep, x.delay_codes, x.msg_cats) for x in rows] == [("1", dt.datetime(2026, 9, 1, 8, 20), None, "43", "Bauarbeiten")]


@pytest.mark.parametrize(("text", "want"), [("2609010815", dt.datetime(2026, 9, 1, 8, 15)), ("bad", None), (None, None), ("2613010815", None)])
def test_short_time(spark, text, want):
    assert one(spark, parsing.short_time(F.lit(text))) == want


def test_weather_delay_by_hand(spark):
    assert one(spark, s.weather_delay(F.lit("3"), F.lit("60"), F.lit("20"))) == 48
    assert one(spark, s.weather_delay(F.lit(None).cast("string"), F.lit("x"), F.lit("19.9"))) == 0


@pytest.mark.parametrize(("text", "plain", "chart"), [("-1", None, None), ("-20", None, 0.0), ("-15", -15.0, 0.0), ("7", 7.0, 7.0), ("x", None, None)])
def test_sentinels(spark, text, plain, chart):
    assert one(spark, s.known_delay(F.lit(text))) == plain
    assert one(spark, s.known_delay(F.lit(text), chart=True)) == chart  # an unknown delay is no 0


def test_keys(spark):
    assert one(spark, s.train_id(F.lit("ice 847"))) == "ICE_847" == one(spark, s.train_id(F.lit("ICE847")))
    assert one(spark, s.line_key(F.lit("ICE 847"))) == "ICE847" and one(spark, s.train_type(F.lit("IC 1"))) == "IC"
    assert one(spark, s.station_key_alnum(F.lit("Hamm (Westf) Hbf"))) == one(spark, s.station_key_alnum(F.lit("Hamm(Westf)Hbf"))) == "hammwestfhbf"
    assert one(spark, s.station_key_folded(F.lit("Köln Hbf"))) == "koln"
    assert one(spark, s.minute_of_day(F.lit("99:99"))) is None and one(spark, s.minute_of_day(F.lit("8:05"))) == 485
    assert one(spark, s.buffer_minutes(F.lit(1430), F.lit(5))) == 15
    assert one(spark, rules.suffix_state(F.lit("Kamen (Westf)"))) == "NRW"
    assert one(spark, s.station_keys(F.lit("A-B  (C) Hbf"), True)) == ["a-b (c) hbf", "a b (c) hbf", "a-b-(c)-hbf", "a-b c hbf", "a-b"]


def test_text_rules_first_hit_wins(spark):
    assert one(spark, rules.text_category(F.lit("Warten auf Anschluss wegen Signal"))) == "kaskade"
    assert one(spark, rules.text_category(F.lit("x"))) == one(spark, rules.text_category(F.lit(None).cast("string"))) == "sonstiges"
    assert one(spark, rules.text_category(F.lit("Vorheriger Fahrt"), rules.INCIDENT_RULES)) == "bereitstellung"
    for code, want in ((4, "kaskade"), (5, "einsatz"), (29, "wagen"), (39, "bau"), (99, "keine"), (0, "sonstiges"), (98, "sonstiges")):
        assert one(spark, rules.code_category(F.lit(code))) == want


#: Eight days of one train: end delay, largest delay.
DAYS = [("2026-08-12", 82.0), ("2026-08-13", 58.0), ("2026-08-14", 104.0), ("2026-08-15", 75.0), ("2026-08-16", 71.0), ("2026-08-17", 118.0), ("2026-08-18", 60.0), ("2026-08-19", 76.0)]


def test_baseline_by_hand(spark):
    rows = [("ICE 847", d, x) for d, x in DAYS] + [("ICE 847", "2026-08-20", -3.0), ("RE 1", "2026-08-20", -3.0)]
    got = rides.baseline(spark.createDataFrame(rows, "train string, date string, end_delay double")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["median"], r.p10, r.p90, r.prob_ge15, r.prob_ge30, r.on_time, r.n) == (75.5, 59.4, 108.2, 1.0, 1.0, 0.0, 8)


def stop_rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(40), rng.randrange(1, 8), f"S{rng.randrange(9)}", f"N{rng.randrange(4)}", dt.date(2026, 1, 1 + rng.randrange(20)), rng.choice(["ICE", "RE", None]), float(rng.randrange(-19, 31)), rng.random() < 0.2, rng.randrange(100), rng.choice(["Bauarbeiten.", None]), rng.randrange(1440), i, i, 1.0)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "ride_id long, station_num long, station string, state string, date date, train_type string, delay double, is_canceled boolean, code long, msg string, plan_min long, pk long, sk long, price double")
    return df.withColumn("train", F.concat_ws(" ", "train_type", (F.col("ride_id") % 5).cast("string"))).withColumn("line", F.concat(F.coalesce("train_type", F.lit("X")), F.lit("1"))).withColumn("sid", F.col("ride_id") * 10 + F.col("station_num"))


def test_merged_partials_equal_direct(spark):
    stops = stop_rows(spark)
    direct = delays.day_type_statistics(stops).drop("med_delay", "p90_delay")
    merged = delays.merge_partials(delays.partial_sums(stops, "date", "train_type", "station"))
    assert direct.exceptAll(merged.select(direct.columns)).count() == 0 and direct.count() == merged.count()


def test_latest_row_equals_window(spark):
    from pyspark.sql import Window

    stops = stop_rows(spark)
    w = Window.partitionBy("sid").orderBy(F.desc("pk"))
    want = stops.withColumn("k", F.row_number().over(w)).where("k = 1").select("sid", "delay")
    got = delays.latest_row(stops, "sid", "pk").select("sid", "delay")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_shares_sum_up_and_percentiles_are_ordered(spark):
    stops = stop_rows(spark)
    for r in causes.train_causes(stops).groupBy("train").agg(F.sum("pct").alias("p")).collect():
        assert abs(r.p - 100) < 0.01
    rows = rides.clean_stops(stops)
    asked = rows.select("train", F.col("station").alias("origin")).distinct().join(rows.select("train", F.col("station").alias("destination")).distinct(), "train")
    for r in rides.segments(asked, rides.train_day_details(rows)).where("median is not null").collect():
        assert r.p10 <= r["median"] <= r.p90


def test_history_upsert_is_idempotent(spark):
    now = spark.createDataFrame([(dt.date(2026, 1, 1), 1.0, 10), (dt.date(2026, 1, 2), 2.0, 20)], "date date, mae_avg double, data_sig long")
    past = spark.createDataFrame([(dt.date(2026, 1, 1), 9.0, 10), (dt.date(2026, 1, 2), 9.0, 19)], "date date, mae_avg double, data_sig long")
    first = forecast.upsert_history(past, now)
    assert {(r.date.day, r.mae_avg, r.state) for r in first.collect()} == {(1, 9.0, "kept"), (2, 2.0, "evaluated")}
    again = forecast.upsert_history(first.drop("state"), now)
    assert {r.state for r in again.collect()} == {"kept"} and again.count() == 2


def test_longest_non_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.randrange(8) for _ in range(rng.randrange(9))]
        best = 0
        for mask in range(1 << len(x)):
            y = [v for k, v in enumerate(x) if mask >> k & 1]
            if all(a <= b for a, b in zip(y, y[1:], strict=False)):
                best = max(best, len(y))
        got = [x[i] for i in alignment.longest_non_decreasing(x)]
        assert len(got) == best and got == sorted(got)


def test_connections_need_the_order(spark):
    rows = spark.createDataFrame([(1, "L", "RE", ["A", "B", "C"], [10, 20, 15]), (2, "L", "RE", ["C", "A"], [1, 2]), (3, "L", "RE", ["A", "C", "A", "C"], [50, 60, 70, 80])], "service long, line string, train_type string, stations array<string>, times array<long>")
    got = timetable.connections(rows, "A", "C").orderBy("service").collect()
    assert [(r.service, r.dep, r.arr, r.duration) for r in got] == [(1, 10, 15, 5), (3, 50, 60, 10)]
    assert timetable.first_departures(timetable.connections(rows, "C", "A"), 1).collect()[0].service == 2


def test_smoothing(spark):
    rows = [(1, k, x) for k, x in enumerate("AABAA")] + [(2, k, x) for k, x in enumerate("ABABA")]
    got = rides.smoothed_states(spark.createDataFrame(rows, "ride_id long, station_num long, state string")).orderBy("ride_id", "station_num").collect()
    assert "".join(r.smooth for r in got[:5]) == "AAAAA"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"train_slug": "a", "last_delay_min": 3}\n\n{"broken\n{"train_slug": "b", "last_delay_min": 4}\n')
    assert sorted(r.train_slug for r in files.remark_archive(spark, str(tmp_path / "r.jsonl")).where("train_slug is not null").collect()) == ["a", "b"]
    (tmp_path / "w.csv").write_text('﻿region,"note"\n " a ","x ""y"", z"\n', encoding="utf-8")
    got = files.quoted_csv(spark, str(tmp_path / "w.csv")).collect()
    assert got[0].asDict().keys() == {"region", "note"} and got[0].note == 'x "y", z'
    (tmp_path / "t.json").write_text('[{"line_number": "1", "stations": ["A"], "n_days": 2}]')
    assert files.timetable_file(spark, str(tmp_path / "t.json")).collect()[0].stations == ["A"]
    folder = tmp_path / "shards"
    folder.mkdir()
    for name, text in (("a.txt", "1"), ("a (1).txt", "1"), ("b-copy.txt", "1"), ("b.txt", "2")):
        (folder / name).write_text(text)
    assert sorted((r.name, r.length) for r in files.distinct_shards(spark, str(folder)).collect()) == [("a.txt", 1), ("b.txt", 1), ("b.txt", 1)]
    listing = spark.createDataFrame([("x-2026-01-03.parquet",), ("x-2026-01-01.parquet",), ("other",)], "name string")
    assert sorted(str(r.day) for r in files.days_to_load(listing, "2026-01-05").collect()) == ["2026-01-04", "2026-01-05"]
    assert files.days_to_load(listing, "2026-01-02").count() == 0


def test_pushdown_reaches_the_scan(spark, tmp_path):
    stops = stop_rows(spark).withColumn("train_num", F.col("ride_id"))
    files.write_facts(stops.select("sid", "train_num", "train_type", "line", "date", "delay"), str(tmp_path / "facts"))
    plan = files.one_train(spark.read.parquet(str(tmp_path / "facts")), 3, "ICE", "RE1").select("delay")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(EqualTo(train_num,3),EqualTo(train_type,ICE)),EqualTo(line,RE1))]" in plan and "sid" not in plan.split("ReadSchema")[1]


def test_itinerary_texts(spark):
    rows = spark.createDataFrame([(1, "RE 8 From Köln Platform 3a 10:15 To Bonn Platform 7 10:45\nICE 9\nFrom Bonn 11:00\nTo Ulm 14:00"), (2, "nothing"), (3, None)], "id long, text string")
    got = parsing.legs_of_text(rows).orderBy("leg").collect()
    assert [(r.service, r.origin, r.dep, r.destination, r.arr) for r in got] == [("RE 8", "Köln", "10:15", "Bonn", "10:45"), ("ICE 9", "Bonn", "11:00", "Ulm", "14:00")]


def test_empty_tables(spark):
    none = stop_rows(spark).where("false")
    clean = rides.clean_stops(none)
    for df in (delays.daily_statistics(none), delays.day_type_statistics(none), causes.cause_frequency(none), causes.train_profile(none), rides.rides(clean), rides.train_days(rides.rides(clean)), rides.templates(clean), weather.region_days(none.selectExpr("state as region", "station", "date", "delay as temp", "delay as snow", "delay as gust", "delay as precip"))):
        assert df.count() == 0


def test_batches_of_a_stream_replace_rows_by_key(spark, tmp_path):
    """Two files, so two batches: the later one's rows of a key replace the earlier one's, others stay."""
    from gleiswerk.streaming import jobs

    for rows in [[("a", 1), ("b", 1)], [("a", 5), ("c", None)]]:
        spark.createDataFrame(rows, "key string, value long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, value long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.drain(stream.groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n")), "update", "key")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 6, 2), ("b", 1, 1), ("c", None, 1)]


def test_back_check_reaches_ten_days_back(spark):
    days = [dt.date(2026, 1, d) for d in range(1, 21)]
    now = spark.createDataFrame([(d, 1.0, 10) for d in days], "date date, mae_avg double, data_sig long")
    past = spark.createDataFrame([(d, 9.0, 9) for d in days[:15]], "date date, mae_avg double, data_sig long")
    got = {r.date.day: (r.mae_avg, r.state) for r in forecast.back_check(past, now).collect()}
    assert got == {d: (9.0, "kept") if d <= 10 else (1.0, "evaluated") for d in range(1, 21)}
