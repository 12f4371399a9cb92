"""A train's days, and what reads them: asked segments, curves, gaps, destinations, shares; by hand."""

import datetime as dt
import random
import statistics

from gleiswerk.functions import parsing
from gleiswerk.operators import causes, delays, rides, timetable
from gleiswerk.sources import files

CLEAN = "train string, date date, ride_id long, station_num long, station string, delay double, is_canceled boolean"


def day(n):
    return dt.date(2026, 3, n)


def clean(spark, *trips):
    """Each trip: train, day, ride, [(station, delay)], cancelled."""
    rows = [(t, day(d), r, k, s, x, c) for t, d, r, calls, c in trips for k, (s, x) in enumerate(calls, 1)]
    return spark.createDataFrame(rows, CLEAN)


def test_day_details_take_the_longest_ride_and_the_first_known_delay(spark):
    rows = clean(
        spark,
        ("A", 1, 1, [("Ulm", None), ("Bonn", 4.0)], False), ("A", 1, 2, [(" ulm ", 7.0), ("Köln", -1.0), ("Bonn", 9.0)], False), ("A", 1, 3, [("Köln", 5.0), ("x", 1.0), ("y", 1.0)], False),
        ("A", 2, 4, [("Ulm", 1.0)], True),
    )
    one, two = rides.train_day_details(rows).orderBy("date").collect()
    assert (one.end_delay, one.max_delay, one.max_station, one.n_rides, one.n_stops, one.canceled) == (4.7, 9.0, "Bonn", 3, 3, False)
    assert [(s.station, s.delay) for s in one["sample"]] == [(" ulm ", 7.0), ("Köln", -1.0), ("Bonn", 9.0)]
    assert one.delays == {"ulm": 7.0, "bonn": 4.0, "köln": -1.0, "x": 1.0, "y": 1.0} and two.canceled


def test_segments_answer_what_is_asked(spark):
    trips = [("A", d, d, [("U", 0.0), ("B", float(d) * 4 - 6), ("K", -1.0)], d == 3) for d in range(1, 6)] + [("A", 6, 6, [("U", 2.0)], False)]
    asked = spark.createDataFrame([("A", "u ", "b"), ("A", "U", "K"), ("A", "X", "B"), ("A", "U", "X"), ("Z", "U", "B"), ("A", "B", "U")], "train string, origin string, destination string")
    got = {(r.train, r.origin, r.destination): r for r in rides.segments(asked, rides.train_day_details(clean(spark, *trips))).collect()}
    assert [got[k].error for k in (("A", "X", "B"), ("A", "U", "X"), ("Z", "U", "B"))] == ["from_not_in_route", "to_not_in_route", "from_not_in_route"]
    b = got["A", "u ", "b"]
    assert (b.error, b.n_days, b.canceled_days, b.median, b.p10, b.p90, b.prob_ge15) == (None, 4, 1, 6.0, 0.6, 12.8, 0.0)
    k = got["A", "U", "K"]  # known on the cancelled day only
    assert (k.error, k.n_days, k.canceled_days, k.median) == (None, 0, 1, None)
    assert got["A", "B", "U"].n_days == 5


def test_quantiles_of_sorted_arrays(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 10):
        x = sorted(float(rng.randrange(50)) for _ in range(n))
        df = spark.createDataFrame([(x,)], "x array<double>")
        got = df.select(*(rides.quantile_of_sorted(df.x, q).alias(str(q)) for q in (0.1, 0.5, 0.9))).first()
        want = [x[0]] * 3 if n == 1 else [statistics.quantiles(x, n=10, method="inclusive")[k] for k in (0, 4, 8)]
        assert [round(v, 9) for v in got] == [round(v, 9) for v in want]


def test_curves_add_late_days_where_the_last_ones_show_nothing(spark):
    trips = [("A", d, d, [("U", 0.0), ("B", x)], False) for d, x in ((1, 5.0), (2, 6.0), (3, 0.0), (4, 7.0), (5, 8.0), (7, 0.0), (8, 0.0), (9, 0.0))]
    trips += [("B", d, 100 + d, [("U", 1.0)] + ([("B", -1.0)] if d > 1 else [("B", 3.0)]), False) for d in (1, 2, 3, 4)]
    got = {}
    for r in rides.curves(rides.train_day_details(clean(spark, *trips))).collect():
        got.setdefault((r.train, r.date.day, r.historical), {})[r.station] = (r.delay, r.skipped)
    assert sorted(got) == [("A", 2, True), ("A", 4, True), ("A", 5, True), ("A", 7, False), ("A", 8, False), ("A", 9, False), ("B", 2, False), ("B", 3, False), ("B", 4, False)]
    assert got["A", 5, True]["B"] == (8.0, False) and got["B", 4, False]["B"] == (None, False)


def test_skipped_stations_and_cancelled_days(spark):
    rows = clean(spark, ("A", 1, 1, [("U", 1.0), ("B", 2.0), ("C", None)], False), ("A", 2, 2, [("U", 3.0), ("C", None)], False), ("A", 3, 3, [("U", 3.0)], True))
    got = {(r.date.day, r.station): (r.delay, r.skipped) for r in rides.curves(rides.train_day_details(rows)).collect()}
    assert got == {(1, "U"): (1.0, False), (1, "B"): (2.0, False), (1, "C"): (None, False), (2, "U"): (3.0, False), (2, "B"): (None, True), (2, "C"): (None, False), (3, "U"): (None, False), (3, "B"): (None, True), (3, "C"): (None, True)}


def test_gap_fill_leaves_other_lines_out(spark):
    live = spark.createDataFrame([("A", day(5), 1.0), ("B", day(5), 2.0)], "train string, date date, end_delay double")
    history = spark.createDataFrame([("A", day(5), 9.0, "NW"), ("A", day(4), 3.0, "NW"), ("A", day(3), 4.0, "BY"), ("A", day(2), 5.0, None), ("B", day(4), 6.0, "BY"), ("A", day(9), 7.0, "NW")], "train string, date date, end_delay double, state string")
    states = spark.createDataFrame([("A", day(5), ["NW", "HE"]), ("A", day(6), ["NW"]), ("A", day(7), ["BY"])], "train string, date date, states array<string>")
    mains = rides.main_set(states)
    assert [tuple(r) for r in mains.collect()] == [("A", ["HE", "NW"])]
    got = {(r.train, r.date.day, r.source) for r in rides.gap_fill(live, history, mains, "2026-03-09").collect()}
    assert got == {("A", 5, "live"), ("B", 5, "live"), ("A", 4, "history"), ("A", 2, "history"), ("B", 4, "history")}


def test_destinations_outside_the_main_states_are_replaced(spark):
    of = spark.createDataFrame([("A", "K", "NW"), ("A", "K", "NW"), ("A", "D", "NW"), ("A", "M", "BY"), ("A", "M", "BY"), ("A", "M", "BY"), ("B", "X", "BY")], "train string, last_station string, last_state string")
    mains = spark.createDataFrame([("A", ["NW"])], "train string, main array<string>")
    seen = spark.createDataFrame([("A", "K"), ("A", "D"), ("A", "M"), ("A", "Q"), ("B", "X")], "train string, station string")
    asked = spark.createDataFrame([("A", "D", "NW"), ("A", "M", "BY"), ("A", "Z", "NW"), ("A", "Q", None), ("B", "V", "BY"), ("A", "Y", None)], "train string, dest string, state string")
    got = {(r.train, r.dest): (r.corrected, r.conflict) for r in rides.corrected_destination(asked, of, seen, mains).collect()}
    assert got == {("A", "D"): ("D", False), ("A", "M"): ("K", True), ("A", "Z"): ("K", True), ("A", "Q"): ("Q", False), ("B", "V"): ("V", False), ("A", "Y"): ("K", True)}


def test_shares_fall_back_to_line_and_network(spark):
    predictions = spark.createDataFrame([("A", "L1", 10.0), ("B", "L1", 10.0), ("C", "L2", 10.0)], "train string, line string, value double")
    own = spark.createDataFrame([("A", 8, "bau", 100.0), ("B", 7, "bau", 100.0)], "train string, coded long, category string, pct double")
    line = spark.createDataFrame([("L1", 4, "tier", 25.0), ("L1", 4, "bau", 75.0)], "line string, coded long, category string, pct double")
    network = spark.createDataFrame([(9, "wetter", 50.0), (9, "bau", 50.0)], "coded long, category string, pct double")
    got = {(r.train, r["rank"]): (r.tier, r.category, r.minutes) for r in rides.decomposed(predictions, own, line, network).collect()}
    assert got == {("A", 1): ("train", "bau", 10.0), ("B", 1): ("line", "bau", 7.5), ("B", 2): ("line", "tier", 2.5), ("C", 1): ("network", "bau", 5.0), ("C", 2): ("network", "wetter", 5.0)}


def test_each_tier_and_error_has_cases_in_the_queries(spark):
    from gleiswerk import plans

    sf = "/root/testdata/sf0.01"
    kinds = lambda name, column: {r[0] for r in plans.QUERIES[name](spark, sf).select(column).distinct().collect()}
    assert kinds("a49_decomposed_prediction", "tier") == {"train", "line", "network"}
    assert kinds("a34_segment_statistics", "error") == {None, "from_not_in_route", "to_not_in_route", "no_segment_data"}
    assert kinds("w11_curves_of_punctual_trains", "historical") == {True, False}
    assert kinds("t03_running_trains_stream", "status") == {"terminal", "time", "running"}


def test_stop_facts_know_both_sides(spark):
    at = lambda h, m: dt.datetime(2026, 3, 1, h, m)
    joined = spark.createDataFrame(
        [("s1", 1, "U", "ICE", "9", "11", at(23, 50), None, at(23, 40), None, None, "1", "43", None), ("s2", 1, "U", None, None, None, at(8, 0), at(8, 2), at(7, 40), at(8, 30), None, None, None, "x"), ("s3", 1, "U", None, "7", None, None, None, at(8, 0), at(8, 0), "c", None, None, None)],
        "sid string, eva long, station string, train_cat string, train_num string, line string, sched_arr timestamp, sched_dep timestamp, real_arr timestamp, real_dep timestamp, cl_arr string, cl_dep string, delay_codes string, msg_cats string",
    )
    got = {r.sid: r for r in delays.stop_facts(joined).collect()}
    assert tuple(got["s1"].asDict()) == delays.FACTS
    assert (got["s1"].delay_arr_min, got["s1"].delay_dep_min, got["s1"].cancelled, got["s1"].date, got["s1"].train_label) == (-10.0, None, True, day(1), "ICE 9")
    assert (got["s2"].delay_arr_min, got["s2"].delay_dep_min, got["s2"].cancelled, got["s2"].train_label) == (None, 28.0, False, "s2")
    assert (got["s3"].date, got["s3"].cancelled, got["s3"].train_label) == (None, True, "7")


def test_legs_of_a_page(spark):
    stop = '<div class="RouteStop"><a href="/x?name={}">s</a><b class="ArrivalTime x">{}</b><b class="DepartureTime">{}</b></div>'
    leg = lambda name, *stops: f'<div class="SubTitle"><a href="/t?a=1&name={name}">t</a></div>\n<refresh-container x data-id="stopList1">{"".join(stop.format(*s) for s in stops)}</refresh-container>'
    html = leg("ICE+9", ("K%C3%B6ln", "", " 10:00 "), ("100%", "10:30", "10:31"), ("Ulm", "", "12:00")) + leg("RE+1", ("Ulm", "", "")) + leg("RB%209", ("Ulm", "12:10", ""), ("Bonn", "13:00", ""))
    html += '<div class="SubTitle"><a href="/t?name=none">t</a></div>'
    rows = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id long, html string")
    got = [(r.id, r.leg, r.service, r.origin, r.dep, r.destination, r.arr, len(r.stops)) for r in parsing.legs_of_html(rows).orderBy("leg").collect()]
    assert got == [(1, 0, "ICE 9", "Köln", "10:00", "Ulm", "12:00", 3), (1, 1, "RB 9", "Ulm", "12:10", "Bonn", "13:00", 2)]


def test_shards_of_one_name(spark, tmp_path):
    for name, text in (("date_a.txt", "1\n2"), ("2026-03-01_date_a.txt", "1\n2"), ("2026-03-02_date_a.txt", "2\n3"), ("b.txt", "9"), ("b (1).txt", "9")):
        (tmp_path / name).write_text(text)
    shards = files.distinct_shards(spark, str(tmp_path))
    assert sorted((r.name, r.length) for r in shards.collect()) == [("a.txt", 3), ("a.txt", 3), ("b.txt", 1)]
    assert sorted(map(tuple, files.shard_rows(spark, str(tmp_path), shards).collect())) == [("a.txt", "1"), ("a.txt", "2"), ("a.txt", "3"), ("b.txt", "9")]


def test_first_and_most_frequent_of_each(spark):
    rows = spark.createDataFrame([("A", "x", 3), ("A", "y", 1), ("A", "x", 2), ("A", None, 0)], "train string, what string, at long")
    assert causes.first_of_each(rows, "train", "what", 8, "at").first()["first"] == ["y", "x"]
    assert [tuple(x) for x in causes.counts_of_each(rows, "train", "what", 1).first().top] == [("x", 2)]


def test_ways_meet_as_services_would(spark):
    """Ways with shared ends, against every pair of services."""
    rng = random.Random(5)
    rows = [(k, rng.choice(["RE", "RB"]), rng.choice("AB"), rng.choice("AB"), sorted(rng.sample("STUVWXYZ", rng.randrange(1, 6)))) for k in range(120)]
    rows += [(200 + k, *rows[k][1:]) for k in range(20)]
    df = spark.createDataFrame(rows, "service long, train_type string, first string, last string, states array<string>")
    want = {}
    for u, kind, f, l, us in rows:
        if u % 3:
            continue
        found = []
        for c, k2, f2, l2, cs in rows:
            if c % 3 and k2 == kind and (f == f2 or l == l2):
                bonus = 1.0 if f == f2 and l == l2 else 0.55 if f == f2 else 0.25
                score = round(0.45 * bonus + 0.55 * len({*us} & {*cs}) / len({*us} | {*cs}) + 1e-12, 4)
                if score >= 0.5:
                    found.append((-score, c))
        if found:
            want[u] = (min(found)[1], -min(found)[0], len(found) > 1)
    got = {r.service: (r.num, r.score, r.several) for r in timetable.numbers_by_similarity(df.where("service % 3 = 0"), df.where("service % 3 <> 0")).collect()}
    assert got == want
