"""Rides and train-days: from stops in order to a train's history, its prediction, and its route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RIDE = ("ride_id", "train", "train_type", "line", "date")


def clean_stops(stops: DataFrame, *columns: str) -> DataFrame:
    """One row for each station number of a ride: an aggregate, combined before the shuffle.

    ``columns`` are those needed besides the keys (all, if none are named): Spark can't tell that parts of a chosen row aren't read.
    """
    keys, order = ("ride_id", "station_num"), ("pk", "sk", "price")
    rest = [c for c in columns or stops.columns if c not in keys]
    row = F.min(F.struct(*order, *(c for c in rest if c not in order)))
    return stops.groupBy(*keys).agg(row.alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def monotone(stops: DataFrame) -> DataFrame:
    """Stops whose planned minute is beyond all before them in the ride."""
    w = Window.partitionBy("ride_id").orderBy("station_num")
    before = F.max("plan_min").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return stops.withColumn("__b", before).where("__b is null or plan_min > __b").drop("__b")


def rides(clean: DataFrame) -> DataFrame:
    """A row for each ride: stops, end delay, largest delay and its first station, ends, departure."""
    return clean.groupBy(*RIDE).agg(
        F.count("*").alias("n_stops"),
        F.max_by("delay", "station_num").alias("end_delay"),
        F.max("delay").alias("max_delay"),
        F.min_by("station", F.struct(-F.col("delay"), F.col("station_num"))).alias("max_station"),
        F.min_by("is_canceled", "station_num").alias("first_canceled"),
        F.min_by("station", "station_num").alias("first_station"),
        F.max_by("station", "station_num").alias("last_station"),
        F.min_by("plan_min", "station_num").alias("dep_min"),
        F.max_by("state", "station_num").alias("last_state"),
    )


def train_days(of_rides: DataFrame) -> DataFrame:
    """A row for each train and date: mean end delay, largest delay and where, number of rides, longest ride."""
    return of_rides.groupBy("train", "date").agg(
        F.round(F.avg("end_delay"), 1).alias("end_delay"),
        F.max_by("max_station", F.struct(F.col("max_delay"), -F.col("ride_id"))).alias("max_station"),
        F.count("*").alias("n_rides"),
        F.max("n_stops").alias("n_stops"),
        F.max("max_delay").alias("max_delay"),
    )


def train_day_details(clean: DataFrame, station: str = "station") -> DataFrame:
    """As ``train_days``, with the stops of the longest ride (the first of equally long ones) and each station's delay in the first ride that knows it.

    (train, date, end_delay, max_delay, max_station, n_rides, n_stops, canceled, sample, delays); sample has num, station, delay of
    each stop in order, delays maps lower-case stations. A day is canceled if the first stop of a ride is, or most of its stops are.
    """
    # a train's day is together from here on: rides, then days are grouped within it
    rows = clean.repartition("train", "date")
    call = F.struct(F.col("station_num").alias("num"), F.col(station).alias("station"), "delay")
    each = rows.groupBy("train", "date", "ride_id").agg(
        F.count("*").alias("n_stops"), F.max_by("delay", "station_num").alias("end_delay"), F.max("delay").alias("max_delay"),
        F.min_by(station, F.struct(-F.col("delay"), F.col("station_num"))).alias("max_station"),
        F.min_by("is_canceled", "station_num").alias("first_canceled"), F.count_if("is_canceled").alias("n_canceled"), F.array_sort(F.collect_list(call)).alias("stops"),
    )
    days = each.groupBy("train", "date").agg(
        F.round(F.avg("end_delay"), 1).alias("end_delay"), F.max("max_delay").alias("max_delay"),
        F.max_by("max_station", F.struct(F.col("max_delay"), -F.col("ride_id"))).alias("max_station"),
        F.count("*").alias("n_rides"), F.max("n_stops").alias("n_stops"),
        (F.bool_or("first_canceled") | (F.sum("n_canceled") > 0.5 * F.sum("n_stops"))).alias("canceled"),
        F.max_by("stops", F.struct(F.col("n_stops"), -F.col("ride_id"))).alias("sample"),
        F.array_sort(F.collect_list(F.struct("ride_id", "stops"))).alias("all"),
    )
    known = F.filter(F.flatten(F.transform("all", lambda r: r["stops"])), lambda x: x["delay"].isNotNull() & (F.trim(x["station"]) != ""))
    named = F.transform(known, lambda x: F.struct(F.lower(F.trim(x["station"])).alias("station"), x["delay"].alias("delay")))
    days = days.withColumn("known", named).withColumn("names", F.array_distinct(F.transform("known", lambda x: x["station"])))
    first = F.transform("names", lambda n: F.get(F.filter("known", lambda x: x["station"] == n), 0)["delay"])
    return days.withColumn("delays", F.map_from_arrays("names", first)).drop("all", "known", "names")


def station_delays(clean: DataFrame) -> DataFrame:
    """(train, date, station) -> delay of the first ride that has it."""
    return clean.groupBy("train", "date", "station").agg(F.min_by("delay", F.struct("ride_id", "station_num")).alias("delay"))


def charted(delay: Column) -> Column:
    """A delay as charts show it: early is 0, unknown (-1 or none) is null."""
    return F.when(delay != -1, F.greatest(delay, F.lit(0.0)))


def station_delay_maps(clean: DataFrame, n_days: int = 10) -> DataFrame:
    """Each train's last days: the map of stations to their delays as charted, without those unknown."""
    recent = last_dates(clean.select("train", "date").distinct(), n_days)
    known = station_delays(clean).join(recent, ["train", "date"]).withColumn("delay", charted(F.col("delay"))).where("delay is not null")
    return known.groupBy("train", "date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("station", "delay")))).alias("delays"))


def baseline(days: DataFrame) -> DataFrame:
    """A row for each train: median, p10, p90, shares of at least 15 and 30 minutes, on time, over days that aren't early or cancelled."""
    d = F.when(F.col("end_delay") >= 0, F.col("end_delay"))
    p = F.percentile(d, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    mean = lambda c: F.round(F.avg(F.when(d.isNotNull(), F.when(c, 1.0).otherwise(0.0))), 4)
    return days.groupBy("train").agg(p.alias("p"), mean(d >= 15).alias("prob_ge15"), mean(d >= 30).alias("prob_ge30"), mean(d < 15).alias("on_time"), F.count(d).alias("n")).where("n > 0").select(
        "train", F.round(F.col("p")[1], 3).alias("median"), F.round(F.col("p")[0], 3).alias("p10"), F.round(F.col("p")[2], 3).alias("p90"), "prob_ge15", "prob_ge30", "on_time", "n"
    )


def segments(asked: DataFrame, details: DataFrame, n_days: int = 10) -> DataFrame:
    """For each asked (train, origin, destination): delays at the destination over the train's last days, or why there are none.

    ``details`` are those of ``train_day_details``. The route is the train's
    longest day; a station off it gives an error, as does a destination that no
    recent day knows. A query reads its destination in the days' maps, so that
    pairs of stations are never listed. A cancelled day counts, without delay.
    """
    w = Window.partitionBy("train")
    route = F.max_by("sample", F.struct("n_stops", "date")).over(w)
    recent = details.withColumn("route", route).withColumn("k", F.row_number().over(w.orderBy(F.desc("date")))).where(F.col("k") <= n_days)
    trains = recent.groupBy("train").agg(F.first("route").alias("route"), F.collect_list(F.struct("date", "canceled", F.map_entries("delays").alias("d"))).alias("days"))
    key = lambda c: F.lower(F.trim(F.col(c)))
    met = asked.join(trains, "train", "left").withColumn("names", F.transform("route", lambda x: F.lower(F.trim(x["station"]))))
    there = lambda c: F.coalesce(F.array_contains("names", key(c)), F.lit(False))
    at = F.transform("days", lambda x: F.struct(x["date"].alias("date"), x["canceled"].alias("canceled"), F.get(F.filter(x["d"], lambda e: e["key"] == key("destination")), 0)["value"].alias("delay")))
    found = met.withColumn("at", F.filter(at, lambda x: x["delay"].isNotNull() & (x["canceled"] | (x["delay"] != -1))))
    ran = F.filter("at", lambda x: ~x["canceled"])
    found = found.withColumn("samples", F.transform(ran, lambda x: F.greatest(x["delay"], F.lit(0.0)))).withColumn("canceled_days", F.size(F.filter("at", lambda x: x["canceled"])).cast("long"))
    error = F.when(~there("origin"), "from_not_in_route").when(~there("destination"), "to_not_in_route").when(F.size("at") == 0, "no_segment_data")
    n = F.size("samples").cast("long")
    ok = error.isNull()
    return found.withColumn("s", F.array_sort("samples")).select(
        "train", "origin", "destination", error.alias("error"), F.when(ok, n).alias("n_days"), F.when(ok, F.col("canceled_days")).alias("canceled_days"),
        *(F.when(ok & (n > 0), F.round(quantile_of_sorted(F.col("s"), q), 2)).alias(name) for name, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))),
        F.when(ok & (n > 0), F.round(F.size(F.filter("s", lambda x: x >= 15)) / n, 4)).alias("prob_ge15"),
    )


def quantile_of_sorted(values: Column, q: float) -> Column:
    """The quantile of a sorted array, between two values in proportion."""
    place = (F.size(values) - 1) * q
    low = F.floor(place).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (place - low)


def cancel_probability(of_rides: DataFrame, days: int = 20, least: int = 5) -> DataFrame:
    """Share of rides cancelled at their first stop over each train's last dates; of rides into its main state, else of all."""
    # one exchange: dates, their rank and the train are all grouped within the train
    dates = of_rides.repartition("train").groupBy("train", "date").agg(F.collect_list(F.struct(F.col("last_state").alias("state"), F.col("first_canceled").alias("canceled"))).alias("r"))
    recent = dates.withColumn("k", F.row_number().over(Window.partitionBy("train").orderBy(F.desc("date")))).where(F.col("k") <= days)
    per = recent.groupBy("train").agg(F.flatten(F.collect_list("r")).alias("r"))
    states = F.filter(F.array_distinct(F.transform("r", lambda x: x["state"])), lambda s: s.isNotNull())
    main = F.array_min(F.transform(states, lambda s: F.struct((-F.size(F.filter("r", lambda x: x["state"] == s))).alias("less"), s.alias("state"))))["state"]
    per = per.withColumn("main", main).withColumn("same", F.filter("r", lambda x: x["state"] == F.col("main")))
    use = F.size("same") >= least
    per = per.withColumn("of", F.when(use, F.col("same")).otherwise(F.col("r")))
    return per.select("train", F.round(F.size(F.filter("of", lambda x: x["canceled"])) / F.size("of"), 4).alias("prob"), use.alias("same_state"), F.size("of").cast("long").alias("n"))


def last_dates(rows: DataFrame, n: int) -> DataFrame:
    """Rows of each train's last n dates."""
    w = Window.partitionBy("train").orderBy(F.desc("date"))
    return rows.withColumn("__k", F.dense_rank().over(w)).where(F.col("__k") <= n).drop("__k")


def whole_day_cancelled(clean: DataFrame) -> DataFrame:
    """Train-days with more than half of their stops cancelled; days of zeros alone are marked, and not cancelled."""
    share = F.count_if("is_canceled") / F.count("*")
    return clean.groupBy("train", "date").agg(F.round(share, 4).alias("share"), (share > 0.5).alias("cancelled"), F.every(F.col("delay") == 0).alias("all_zero"))


def ride_list(of_rides: DataFrame) -> DataFrame:
    """Line, origin and departure with the days seen."""
    return of_rides.groupBy("line", "first_station", "dep_min").agg(F.count_distinct("date").alias("days"), F.min("ride_id").alias("ride_id"))


def templates(stops: DataFrame, least_stops: int = 5, least: int = 3, k: int = 10, station: str = "state", minute: str = "plan_min") -> DataFrame:
    """(line, k, stations, times, n, first_ride): distinct sequences of stops of each line (adjacent repeats are one), those seen often, the most frequent first; times are the first ride's (-1: unknown)."""
    w = Window.partitionBy("ride_id").orderBy("station_num")
    steps = stops.withColumn("before", F.lag(station).over(w)).where(f"before is null or before <> {station}")
    calls = F.array_sort(F.collect_list(F.struct("station_num", F.col(station).alias("s"), F.coalesce(minute, F.lit(-1)).alias("m"))))
    seen = steps.groupBy("ride_id", "line").agg(calls.alias("c")).where(F.size("c") >= least_stops)
    ways = seen.select("line", "ride_id", F.transform("c", lambda x: x["s"]).alias("stations"), F.transform("c", lambda x: x["m"]).alias("times"))
    counts = ways.groupBy("line", "stations").agg(F.count("*").alias("n"), F.min("ride_id").alias("first_ride"), F.min_by("times", "ride_id").alias("times")).where(F.col("n") >= least)
    ranked = Window.partitionBy("line").orderBy(F.desc("n"), F.array_join("stations", ">"))
    return counts.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= k)


def line_statistics(of_rides: DataFrame, clean: DataFrame, k: int = 3) -> DataFrame:
    """A row for each line: rides, mean, p95, share of no delay, cancelled, and its worst stations by mean delay."""
    per = of_rides.groupBy("line").agg(
        F.count("*").alias("rides"), F.round(F.avg("end_delay"), 4).alias("avg_delay"), F.round(F.percentile("end_delay", 0.95), 4).alias("p95"),
        F.round(100.0 * F.count_if(F.col("end_delay") == 0) / F.count("*"), 4).alias("zero_pct"), F.round(100.0 * F.count_if("first_canceled") / F.count("*"), 4).alias("cancel_pct"),
    )
    worst = clean.groupBy("line", "station").agg(F.avg("delay").alias("d"))
    ranked = worst.withColumn("k", F.row_number().over(Window.partitionBy("line").orderBy(F.desc("d"), "station"))).where(F.col("k") <= k)
    tops = ranked.groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "station"))), lambda x: x["station"]), "|").alias("worst"))
    return per.join(tops, "line", "left")


def smoothed_states(clean: DataFrame) -> DataFrame:
    """Each stop's state, replaced where the two known neighbours on either side agree with three votes at least."""
    w = Window.partitionBy("ride_id").orderBy("station_num")
    before, after = F.collect_list("state").over(w.rowsBetween(-2, -1)), F.collect_list("state").over(w.rowsBetween(1, 2))
    rows = clean.withColumn("b", before).withColumn("a", after)
    pick = F.get(F.array_sort(F.concat("b", "a")), 1)  # who has three of four votes, or of three, is second in order
    votes = F.size(F.filter(F.concat("b", "a"), lambda x: x == F.get(F.array_sort(F.concat("b", "a")), 1)))
    agree = (F.size("b") > 0) & (F.size("a") > 0) & (votes >= 3) & F.array_contains("b", pick) & F.array_contains("a", pick)
    return rows.withColumn("smooth", F.when(F.coalesce(agree, F.lit(False)), pick).otherwise(F.col("state"))).drop("a", "b")


def fingerprint(smoothed: DataFrame, k: int = 4, least: float = 0.05, keys: tuple[str, ...] = ("line",)) -> DataFrame:
    """The states of a line (or of other keys), in order: at most k, with at least this share of the leader's votes."""
    votes = smoothed.groupBy(*keys, F.col("smooth").alias("state")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = votes.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "state"))).withColumn("top", F.max("n").over(w))
    kept = ranked.where((F.col("k") <= k) & (F.col("n") >= least * F.col("top")))
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("state")).alias("states"))


def main_set(day_states: DataFrame) -> DataFrame:
    """(train, main): the states on half of those days (train, date, states) that have the train's most frequent state."""
    each = day_states.select("train", "date", F.explode("states").alias("state"))
    seed = each.groupBy("train", "state").agg(F.count("*").alias("n")).groupBy("train").agg(F.min_by("state", F.struct(-F.col("n"), F.col("state"))).alias("seed"))
    seeded = day_states.join(seed, "train").where(F.array_contains("states", F.col("seed")))
    days = seeded.groupBy("train").agg(F.count("*").alias("days"))
    return (
        seeded.select("train", F.explode("states").alias("state")).groupBy("train", "state").agg(F.count("*").alias("n")).join(days, "train")
        .where(F.col("n") >= 0.5 * F.col("days")).groupBy("train").agg(F.array_sort(F.collect_list("state")).alias("main"))
    )


def main_states(day_states: DataFrame, overlap: float = 0.6) -> DataFrame:
    """Days (train, date, states) that agree with the train's main states."""
    share = F.size(F.array_intersect("states", "main")) / F.size("states")
    return day_states.join(main_set(day_states), "train").select("train", "date", F.array_join("main", ",").alias("main"), F.round(share, 4).alias("share"), (share >= overlap).alias("kept"))


def gap_fill(live: DataFrame, history: DataFrame, mains: DataFrame, today: str) -> DataFrame:
    """Live days (train, date, end_delay), and past days of the history (with state: that of the station of the largest delay) that no live day has.

    A history day of a known state that is not among the train's main states
    belongs to another line of that name and is left out; a day of unknown
    state, or of a train without main states, stays.
    """
    past = history.where(F.col("date") < F.lit(today).cast("date")).join(live.select("train", "date"), ["train", "date"], "left_anti")
    same_line = F.col("state").isNull() | F.col("main").isNull() | F.array_contains("main", F.col("state"))
    added = past.join(mains, "train", "left").where(same_line)
    columns = ("train", "date", "end_delay")
    return live.select(*columns, F.lit("live").alias("source")).unionByName(added.select(*columns, F.lit("history").alias("source")))


def coverage(details: DataFrame) -> DataFrame:
    """A row for each train: days, those with an end delay, those limited to few stops, the span of days with data, and the days cancelled."""
    valid = F.col("end_delay").isNotNull()
    return details.groupBy("train").agg(
        F.count("*").alias("days"), F.count_if(valid).alias("valid"), F.count_if(F.col("n_stops") < 3).alias("limited"),
        F.min(F.when(valid, F.col("date"))).alias("first"), F.max(F.when(valid, F.col("date"))).alias("last"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("canceled"), F.col("date").cast("string")))), ",").alias("canceled_days"),
    )


def calls_of_rides(clean: DataFrame) -> DataFrame:
    """(line, date, ride_id, calls): each ride with its calls, one for each state: the first minute and number there, and the last number."""
    call = clean.groupBy("line", "date", "ride_id", "state").agg(F.min_by("plan_min", "station_num").alias("minute"), F.min("station_num").alias("first_num"), F.max("station_num").alias("last_num"))
    return call.groupBy("line", "date", "ride_id").agg(F.collect_list(F.struct("state", "minute", "first_num", "last_num")).alias("calls"))


def rides_of_days(clean: DataFrame) -> DataFrame:
    """(line, date, rides): each ride of a line's day with its calls."""
    return calls_of_rides(clean).groupBy("line", "date").agg(F.collect_list(F.struct("ride_id", "calls")).alias("rides"))


def nearest_ride(furthest: int = 90) -> Column:
    """Of ``rides`` the (gap, ride_id) whose call at ``state`` is nearest to ``minute``, within the limit, and that goes on to ``destination`` (if there is one)."""
    def offer(r: Column) -> Column:
        here = F.get(F.filter(r["calls"], lambda c: c["state"] == F.col("state")), 0)
        on = F.col("destination").isNull() | F.exists(r["calls"], lambda c: (c["state"] == F.col("destination")) & (c["last_num"] > here["first_num"]))
        gap = F.abs(F.col("minute") - here["minute"])
        return F.when(on & (gap <= furthest), F.struct(gap.alias("gap"), r["ride_id"].alias("ride_id")))

    return F.array_min(F.filter(F.transform("rides", offer), lambda x: x.isNotNull()))


def ride_for_query(asked: DataFrame, days: DataFrame, furthest: int = 90) -> DataFrame:
    """For (query, line, date, state, minute, destination) the nearest ride of that line's day (``rides_of_days``)."""
    found = asked.join(days, ["line", "date"]).withColumn("best", nearest_ride(furthest)).where("best is not null")
    return found.select("query", "best.ride_id", "best.gap")


def nearest_of_own_days(calls: DataFrame, furthest: int = 90) -> DataFrame:
    """``ride_for_query`` where each ride (``calls_of_rides``) has a query ``asked`` (state, destination, minute) of its own line's day.

    A ride offers each state with each one it goes on to. Offers and queries of a
    pair are put in order of time, so that each query looks at the offers just
    before and after it, however many rides the day has.
    """
    pair = lambda a, b: F.struct(a["state"].alias("state"), b["state"].alias("destination"), a["minute"].alias("minute"), F.lit(0).alias("asks"))
    offers = F.flatten(F.transform("calls", lambda a: F.transform(F.filter("calls", lambda b: b["last_num"] > a["first_num"]), lambda b: pair(a, b))))
    asks = F.array(F.struct("asked.state", "asked.destination", "asked.minute", F.lit(1).alias("asks")))
    rows = calls.select("line", "date", "ride_id", F.explode(F.concat(offers, asks)).alias("x")).select("line", "date", "ride_id", "x.*")
    of_pair = Window.partitionBy("line", "date", "state", "destination")
    offer = F.when(F.col("asks") == 0, F.struct("minute", "ride_id"))
    # of offers of one minute the smallest ride is last, and all are before a query of that minute
    near = [F.last(offer, True).over(of_pair.orderBy(by, "asks", F.desc("ride_id")).rowsBetween(Window.unboundedPreceding, 0)) for by in (F.asc("minute"), F.desc("minute"))]
    found = rows.withColumn("before", near[0]).withColumn("after", near[1]).where("asks = 1")
    gaps = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("minute") - F.col(f"{c}.minute")).alias("gap"), F.col(f"{c}.ride_id").alias("ride_id"))) for c in ("before", "after")))
    best = found.select(F.col("ride_id").alias("query"), F.array_min(F.filter(gaps, lambda x: x.isNotNull() & (x["gap"] <= furthest))).alias("best"))
    return best.where("best is not null").select("query", "best.ride_id", "best.gap")


def prediction_errors(predictions: DataFrame, days: DataFrame, today: str) -> DataFrame:
    """Predictions beside what happened: error, whether it was cancelled, and whether a past one lacks its day."""
    joined = predictions.join(days.select("train", "date", "end_delay"), ["train", "date"], "left")
    past = F.col("date") < F.lit(today).cast("date")
    return joined.select(
        "train", "date", F.round(F.col("predicted") - F.when(F.col("end_delay") != -1, F.col("end_delay")), 1).alias("error"), F.coalesce(F.col("end_delay") == -1, F.lit(False)).alias("cancelled"),
        F.when(past, F.when(F.col("end_delay").isNull(), "yes").otherwise("no")).alias("needs_backfill"),
    )


def transfer_risk(clean: DataFrame) -> DataFrame:
    """For each stop and the next of its ride: the buffer, and the chance to miss it."""
    w = Window.partitionBy("ride_id").orderBy("station_num")
    buffer = F.pmod(F.lead("plan_min").over(w) - F.col("plan_min"), F.lit(1440))
    risk = F.greatest("delay", F.lit(0.0)) / 30
    factor = F.when(F.col("buffer") <= 8, 1.3).when(F.col("buffer") <= 15, 0.65).otherwise(0.25)
    rows = clean.withColumn("buffer", buffer).where("buffer is not null")
    return rows.select("ride_id", "station_num", "buffer", F.round(F.least(F.greatest(risk * factor, F.lit(0.02)), F.lit(0.95)), 4).alias("miss"))


def jump_segments(rows: DataFrame, jump: int = 15) -> DataFrame:
    """The longest run of each ride, in its order, without a jump back of more than the limit."""
    w = Window.partitionBy("ride_id").orderBy("station_num")
    broken = F.when(F.lag("plan_min").over(w) - F.col("plan_min") > jump, 1).otherwise(0)
    runs = rows.withColumn("b", broken).withColumn("run", F.sum("b").over(w))
    sizes = runs.groupBy("ride_id", "run").agg(F.count("*").alias("n"), F.min("station_num").alias("first_num"), F.max("station_num").alias("last_num"))
    return sizes.groupBy("ride_id").agg(F.min_by(F.struct("n", "first_num", "last_num"), F.struct(-F.col("n"), F.col("run"))).alias("r")).select("ride_id", "r.*")


def mixed_days(rows: DataFrame, jump: int = 15) -> DataFrame:
    """Train-days whose departures go back by more than the limit, in the order of their stops."""
    w = Window.partitionBy("train", "date").orderBy("ride_id", "station_num")
    back = F.last("plan_min", True).over(w.rowsBetween(Window.unboundedPreceding, -1)) - F.col("plan_min") > jump
    return rows.withColumn("b", F.coalesce(back, F.lit(False))).groupBy("train", "date").agg(F.bool_or("b").alias("mixed"))


def reference_route(clean: DataFrame) -> DataFrame:
    """The stops of each train's longest day, the latest of equally long ones."""
    day = clean.groupBy("train", "date", "ride_id").agg(F.array_sort(F.collect_list(F.struct("station_num", "station"))).alias("s"))
    best = day.groupBy("train").agg(F.max_by(F.struct("date", "s"), F.struct(F.size("s"), F.col("date"), -F.col("ride_id"))).alias("b"))
    return best.select("train", F.col("b.date").alias("date"), F.transform("b.s", lambda x: x["station"]).alias("stations"))


def curves(details: DataFrame, n_days: int = 3, n_earlier: int = 3) -> DataFrame:
    """Each train's last days over the stations of its longest day: the delay as charted, and whether the train ran without stopping there.

    Where all these days ended without delay, up to ``n_earlier`` earlier days
    that were late (and know some station's delay) come as ``historical`` ones.
    One pass over the days (``train_day_details``): each train's window depends
    on its own rows.
    """
    by = Window.partitionBy("train")
    newest = by.orderBy(F.desc("date"))
    days = details.withColumn("route", F.max_by("sample", F.struct("n_stops", "date")).over(by)).withColumn("k", F.row_number().over(newest))
    recent, late = F.col("k") <= n_days, F.coalesce(F.col("end_delay") > 0, F.lit(False))
    days = days.withColumn("moved", F.bool_or(recent & (F.coalesce("end_delay", F.lit(0.0)) != 0)).over(by))
    days = days.withColumn("e", F.sum(F.when(~recent & late, 1).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.where(recent | (~F.col("moved") & late & (F.col("e") <= n_earlier)))
    own = F.transform("sample", lambda x: F.lower(F.trim(x["station"])))
    here = F.array_union(own, F.map_keys("delays"))
    cells = days.select("train", "date", (~recent).alias("historical"), "canceled", "delays", here.alias("here"), F.posexplode("route").alias("pos", "call"))
    name = F.lower(F.trim(F.col("call.station")))
    delay = F.when(~F.col("canceled"), charted(F.element_at("delays", name)))
    cells = cells.select("train", "date", "historical", "pos", F.col("call.station").alias("station"), delay.alias("delay"), (~F.array_contains("here", name)).alias("skipped"))
    known = F.count("delay").over(Window.partitionBy("train", "date"))
    return cells.withColumn("known", known).where("not historical or known > 0").drop("known")


def last_actual(days: DataFrame, today: str) -> DataFrame:
    """The last day's value of each train that isn't early, and whether it is of today."""
    ok = days.where("end_delay >= 0")
    return ok.groupBy("train").agg(F.max_by("end_delay", "date").alias("end_delay"), F.max("date").alias("date")).withColumn("is_today", F.col("date") == F.lit(today).cast("date"))


def partial_days(days: DataFrame) -> DataFrame:
    """Whether a day has fewer stops than the train ever had, or no end delay."""
    most = F.max("n_stops").over(Window.partitionBy("train"))
    return days.select("train", "date", (F.col("end_delay").isNull() | (F.col("n_stops") < most)).alias("partial"))


def pending_days(snapshots: DataFrame, k: int = 4) -> DataFrame:
    """Snapshots written on their own day are not final: their values go, and the newest k of a train are pulled again."""
    pending = F.to_date("written") == F.col("date")
    w = Window.partitionBy("train", "pending").orderBy(F.desc("date"))
    rows = snapshots.withColumn("pending", pending).withColumn("k", F.row_number().over(w))
    return rows.select("train", "date", "pending", F.when(~F.col("pending"), F.col("end_delay")).alias("end_delay"), (F.col("pending") & (F.col("k") <= k)).alias("pull_again"))


def tiers(trains: DataFrame, own: DataFrame, of_line: DataFrame, overall: DataFrame, least: int = 8) -> DataFrame:
    """A train's value from its own profile if that has enough stops, else its line's, else the network's."""
    joined = trains.join(own, "train", "left").join(of_line, "line", "left").join(F.broadcast(overall))
    use_own, use_line = F.coalesce(F.col("own_n") >= least, F.lit(False)), F.col("line_value").isNotNull()
    return joined.select("train", "line", F.when(use_own, "train").when(use_line, "line").otherwise("network").alias("tier"), F.when(use_own, F.col("own_value")).when(use_line, F.col("line_value")).otherwise(F.col("all_value")).alias("value"))


def tolerant_lookup(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The known train of a number: of the type asked for, else the first of RE, RB, IC, ICE."""
    order = F.when(F.col("type") == F.col("known_type"), 0)
    for k, t in enumerate(("RE", "RB", "IC", "ICE"), 1):
        order = order.when(F.col("known_type") == t, k)
    rows = asked.join(known, "number").withColumn("k", order).where("k is not null")
    return rows.groupBy("type", "number").agg(F.min_by("known_type", F.struct("k", "known_type")).alias("found"))


def parity(days: DataFrame, source: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Counters of train-days that agree with their source within the tolerance."""
    both = days.join(source, ["train", "date"])
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    return both.agg(F.count("*").alias("days"), F.count_if(near("end_delay", "src_end")).alias("end_ok"), F.count_if(near("max_delay", "src_max")).alias("max_ok"), F.count_if(F.col("end_delay") == 0).alias("zero"), F.count_if(F.col("end_delay") == -1).alias("minus_one"))


def route_region(stops: DataFrame, regions: DataFrame) -> DataFrame:
    """The region of a ride: that of its last station that has one."""
    known = stops.join(regions, "station")
    return known.groupBy("ride_id").agg(F.max_by("known_region", "station_num").alias("region"))


def corrected_destination(asked: DataFrame, of_rides: DataFrame, seen: DataFrame, mains: DataFrame) -> DataFrame:
    """(train, dest, corrected, conflict): destinations outside the train's main states, or where the train never stops, are replaced by its most frequent terminal within them.

    ``asked`` has train, dest and state (null if unknown: only the second test
    applies), ``seen`` the (train, station) that the train stops at, ``mains``
    (train, main). Without such a terminal, or main states, the destination stays.
    """
    ends = of_rides.groupBy("train", "last_station", "last_state").agg(F.count("*").alias("n"))
    ends = ends.join(mains, "train").where(F.array_contains("main", F.col("last_state"))).groupBy("train", "last_station").agg(F.sum("n").alias("n"))
    usual = ends.groupBy("train").agg(F.min_by("last_station", F.struct(-F.col("n"), F.col("last_station"))).alias("usual"))
    known = seen.select("train", F.col("station").alias("dest"), F.lit(True).alias("known")).distinct()
    met = asked.join(known, ["train", "dest"], "left").join(mains, "train", "left").join(usual, "train", "left")
    outside = F.coalesce(~F.array_contains("main", F.col("state")), F.lit(False))
    wrong = F.col("main").isNotNull() & (outside | F.col("known").isNull())
    corrected = F.when(wrong, F.coalesce("usual", "dest")).otherwise(F.col("dest"))
    return met.select("train", "dest", corrected.alias("corrected"), (corrected != F.col("dest")).alias("conflict"))


def decomposed(predictions: DataFrame, own: DataFrame, of_line: DataFrame, overall: DataFrame, least: int = 8) -> DataFrame:
    """Minutes of each prediction (train, line, value) by cause, the largest first, and whose shares they rest on.

    ``own`` has train, coded (stops with a code), category and pct, ``of_line``
    line, category and pct, ``overall`` category and pct. A train of enough
    coded stops has its own shares, else its line's if there are any, else the
    network's.
    """
    listed = lambda rows, key, name: rows.groupBy(key).agg(F.collect_list(F.struct("category", "pct")).alias(name))
    network = overall.agg(F.collect_list(F.struct("category", "pct")).alias("all_shares"))
    met = predictions.join(listed(own.where(F.col("coded") >= least), "train", "own_shares"), "train", "left").join(listed(of_line, "line", "line_shares"), "line", "left").join(F.broadcast(network))
    tier = F.when(F.col("own_shares").isNotNull(), "train").when(F.col("line_shares").isNotNull(), "line").otherwise("network")
    rows = met.select("train", "line", "value", tier.alias("tier"), F.explode(F.coalesce("own_shares", "line_shares", "all_shares")).alias("s"))
    rows = rows.select("train", "line", "tier", "s.category", F.round(F.col("value") * F.col("s.pct") / 100 + 1e-9, 3).alias("minutes"))
    w = Window.partitionBy("train", "line").orderBy(F.desc("minutes"), "category")
    return rows.withColumn("rank", F.row_number().over(w))
