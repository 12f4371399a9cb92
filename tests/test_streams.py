"""Streams in several batches: journeys, upserts, days evaluated again."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleiswerk.streaming import jobs
from gleiswerk.streaming.upserts import Upserts

SUMS = "day date, event_type string, n long, ge5 long"
STOPS = "ts timestamp, event_id long, train long, day date, stop long, last_stop long, delay double, real_time boolean, at timestamp, planned timestamp"
DAY = dt.date(2026, 3, 1)


def clock(minute):
    return dt.datetime(2026, 3, 1, 8) + dt.timedelta(minutes=minute)


def stop(k, train, minute, n, delay, at=None, live=True, planned=60, last=3):
    return (clock(minute), k, train, DAY, n, last, delay, live, clock(minute if at is None else at), clock(planned))


def feed(spark, path, *batches):
    """One file, so one batch, for each list of rows."""
    import time

    for rows in batches:
        spark.createDataFrame(rows, STOPS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(STOPS).option("maxFilesPerTrigger", 1).parquet(path)


def test_journeys_end_at_their_terminal_or_by_time(spark, tmp_path):
    first = [
        stop(1, 1, 0, 1, 5.0), stop(2, 1, 10, 2, 7.0),
        stop(3, 2, 0, 1, 1.0), stop(4, 2, 20, 3, 9.0, live=False),  # the terminal is not real-time yet
        stop(5, 3, 0, 2, 4.0, planned=30), stop(6, 4, 0, 1, 2.0, at=400),  # 4: an event to come
        stop(7, 5, 5, 1, 3.0, live=False, planned=20),
    ]
    second = [stop(8, 1, 30, 3, 8.0), stop(9, 1, 31, 2, 99.0), stop(10, 2, 40, 2, 6.0)]
    third = [stop(11, 9, 300, 1, 0.0, planned=900)]
    got = jobs.drain(jobs.running_trains(feed(spark, str(tmp_path / "in"), first, second, third)), "append", *jobs.JOURNEY)
    found = {r.train: (r.stop, r.delay, r.n, r.status) for r in got.collect()}
    assert found == {
        1: (3, 8.0, 4, "terminal"),  # by its last stop; what comes later from before doesn't take it back
        2: (2, 6.0, 3, "time"),
        3: (2, 4.0, 1, "time"),
        4: (1, 2.0, 1, "running"),  # its event to come keeps it
        5: (0, 0.0, 1, "time"),  # no real-time stop ever
        9: (1, 0.0, 1, "running"),
    }


def test_a_late_event_takes_an_end_by_time_back(spark, tmp_path):
    batches = [[stop(1, 1, 0, 1, 5.0, planned=10)], [stop(2, 2, 100, 1, 0.0, planned=900)], [stop(3, 1, 95, 2, 6.0, planned=10), stop(4, 2, 101, 1, 0.0, planned=900)]]
    got = jobs.drain(jobs.running_trains(feed(spark, str(tmp_path / "in"), *batches)), "append", *jobs.JOURNEY)
    assert {r.train: (r.stop, r.n, r.status) for r in got.collect()} == {1: (2, 2, "running"), 2: (1, 2, "running")}


def test_journeys_of_a_day_are_kept_in_few_groups(spark, tmp_path):
    """So many journeys at once, one of no train, take no call of Python and no row of state each."""
    trains = [*range(-3, 1500), None]
    batches = [[stop(2 * i + k, t, 5 * k + i % 4, k + (t or 0) % 3, i / 4, live=i % 5 > 0) for i, t in enumerate(trains)] for k in (0, 1)]
    query = jobs.running_trains(feed(spark, str(tmp_path / "in"), *batches)).writeStream.outputMode("append").foreachBatch(lambda df, k: df.write.mode("append").parquet(str(tmp_path / f"out/k={k}")))
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= jobs.GROUPS + 1
    got = spark.read.schema(jobs.STATUS + ", k long").parquet(str(tmp_path / "out")).collect()
    for k in (0, 1):
        want = {t: (k + (t or 0) % 3, i / 4, k + 1, "terminal" if k + (t or 0) % 3 == 3 else "running") if i % 5 else (0, 0.0, k + 1, "running") for i, t in enumerate(trains)}
        assert {r.train: (r.stop, r.delay, r.n, r.status) for r in got if r.k == k} == want
    assert len(got) == 2 * len(trains)


def test_upserts_are_folded_and_replays_change_nothing(spark, tmp_path):
    table = Upserts(spark, "file://" + str(tmp_path / "t"), StructType.fromDDL("key string, value long"), ("key",), every=3)
    assert table.table().count() == 0
    batches = [[("a", 1), ("b", 1)], [("a", 2)], [("c", 3)], [("b", 4)], [("a", 5)]]
    want = {}
    for k, rows in enumerate(batches):
        want |= dict(rows)
        batch = spark.createDataFrame(rows, "key string, value long")
        for _ in range(2):  # each batch comes twice
            table.put(batch, k)
            assert dict(map(tuple, table.table().collect())) == want
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["base=2", "batch=3", "batch=4"]
    assert dict(map(tuple, table.table(before=4).collect())) == want | {"a": 2}
    table.put(spark.createDataFrame([("a", 99)], "key string, value long"), 1)  # long since folded in
    assert dict(map(tuple, table.table().collect())) == want


def test_a_base_half_written_doesnt_count(spark, tmp_path):
    table = Upserts(spark, "file://" + str(tmp_path / "t"), StructType.fromDDL("key string, value long"), ("key",))
    table.put(spark.createDataFrame([("a", 1)], "key string, value long"), 0)
    (tmp_path / "t" / "base=7").mkdir()
    assert [tuple(r) for r in table.table().collect()] == [("a", 1)]


def test_changed_days_are_evaluated_again(spark):
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 1, 2)
    forecasts = spark.createDataFrame([(d1, "x", 0.5), (d1, "y", 0.25), (d2, "x", 1.0)], "day date, event_type string, predicted double")
    job = jobs.Reevaluation(spark, forecasts, StructType.fromDDL(SUMS), every=2)

    def history():
        return {r.day.day: (r.data_sig, r.n_types, r.mae, r.evaluations) for r in job.history.table().collect()}

    batches = [
        [(d1, "x", 4, 2), (d2, "x", 2, 1), (d2, "z", 5, 5)],
        [(d1, "y", 4, 2)],  # a late shard: day 1 has more rows
        [(d2, "x", 2, 0)],  # as many rows as before: the signature is the same, so is the evaluation
        [(dt.date(2026, 1, 3), "x", 1, 1)],  # no forecast
    ]
    want = [{1: (4, 1, 0.0, 1), 2: (7, 1, 0.5, 1)}, {1: (8, 2, 0.125, 2), 2: (7, 1, 0.5, 1)}]
    for k, rows in enumerate(batches):
        for _ in range(2):
            job.put(spark.createDataFrame(rows, SUMS), k)
            assert history() == want[min(k, 1)]


def test_reevaluated_days_of_a_stream(spark, tmp_path):
    d1 = dt.date(2026, 1, 1)
    events = "ts timestamp, event_type string, value double"
    for rows in ([(dt.datetime(2026, 1, 1, 5), "x", 9.0)], [(dt.datetime(2026, 1, 1, 6), "x", 1.0), (dt.datetime(2026, 1, 2, 1), "x", 1.0)]):
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    forecasts = spark.createDataFrame([(d1, "x", 0.5)], "day date, event_type string, predicted double")
    got = jobs.reevaluated_days(jobs.day_sums(stream), forecasts).collect()
    assert [(r.day, r.data_sig, r.mae, r.evaluations) for r in got] == [(d1, 2, 0.0, 2)]
    assert F is not None
