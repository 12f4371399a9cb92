"""The same jobs as streams: latest change, day statistics, running trains, visitors, re-evaluated days.

Each function takes a streaming DataFrame; ``drain`` runs one over what is
there and returns the table that it left in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.files import scratch
from .upserts import Upserts

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed as a stream; files in turn."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")


def drain(stream: DataFrame, mode: str, *keys: str, every: int = 8) -> DataFrame:
    """Run a stream until its input is used up, and return its table: with keys, the last batch that wrote a key's row holds the row."""
    out = Upserts(stream.sparkSession, scratch(stream.sparkSession, "stream"), stream.schema, keys, every)
    run(stream, mode, out.put)
    return out.table()


def run(stream: DataFrame, mode: str, put: Callable[[DataFrame, int], None]) -> None:
    """Hand each batch of a stream to ``put`` until its input is used up."""
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", scratch(stream.sparkSession, "state")).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_change(stream: DataFrame) -> DataFrame:
    """The latest observation of each stop: one row of state for each."""
    return stream.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "ts"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_type", "r.value", "r.ts")


def day_sums(stream: DataFrame) -> DataFrame:
    """Mergeable sums of each day; late rows change a day until the watermark passes it."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", "2 days").groupBy(day, "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 5).alias("ge5"), F.max("value").alias("top")).select(F.to_date("window.start").alias("day"), "event_type", "n", "ge5", "top")


def visitors(stream: DataFrame) -> DataFrame:
    """Each visitor once within a year."""
    return stream.withWatermark("ts", "365 days").dropDuplicatesWithinWatermark(["user_id"]).select("user_id")


JOURNEY = ("train", "day")
STATUS = "train long, day date, stop long, delay double, n long, status string"
GRACE = pd.Timedelta(minutes=20)
#: A finished journey is forgotten so long after its day began.
KEPT = pd.Timedelta(days=3)
#: Journeys of a day are kept in so many groups, by their trains; one more holds those of no train.
GROUPS = 32
#: What a group keeps of each journey: times in microseconds, the timer in milliseconds.
NEVER = np.iinfo(np.int64).min
_JOURNEY = np.dtype([("train", "i8"), ("stop", "i8"), ("seen", "i8"), ("seen_id", "i8"), ("delay", "f8"), ("planned", "i8"), ("latest", "i8"), ("n", "i8"), ("last_stop", "i8"), ("timer", "i8"), ("done", "?")])


def stop_events(stream: DataFrame) -> DataFrame:
    """The feed as events of stops: train and day of the journey, stop of ``last_stop``, delay, whether it is real-time, when it is (which may be to come), and the planned arrival at the destination."""
    day = F.to_date("ts")
    return stream.select(
        "ts", "event_id", F.col("user_id").alias("train"), day.alias("day"), (F.get_json_object("props", "$.k").cast("long") % 8 + 1).alias("stop"), F.lit(8).cast("long").alias("last_stop"),
        F.col("value").alias("delay"), (F.col("event_id") % 5 != 0).alias("real_time"), F.timestamp_add("MINUTE", ((F.col("event_id") % 7 - 3) * 10).cast("int"), F.col("ts")).alias("at"),
        F.timestamp_add("HOUR", (6 + F.col("user_id") % 12).cast("int"), day.cast("timestamp")).alias("planned"),
    )


def _microseconds(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _merged(held: np.ndarray, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The journeys ``held``, in order of their trains, with the events of ``rows``; and whether there were any of each."""
    train, n = np.unique(rows["train"].to_numpy(np.int64), return_counts=True)
    new = train[~np.isin(train, held["train"])]
    added = np.zeros(len(new), _JOURNEY)
    added["train"], added["seen"], added["latest"] = new, NEVER, NEVER
    out = np.concatenate([held, added])
    out = out[np.argsort(out["train"])]
    at = np.searchsorted(out["train"], train)
    out["n"][at] += n
    own = np.searchsorted(out["train"], rows["train"].to_numpy(np.int64))
    out["planned"][own], out["last_stop"][own] = _microseconds(rows["planned"]), rows["last_stop"]
    live = rows["real_time"].to_numpy(bool)
    if live.any():
        own, rows = own[live], rows[live]
        np.maximum.at(out["latest"], own, _microseconds(rows["at"]))
        stop, seen, seen_id, delay = rows["stop"].to_numpy(np.int64), _microseconds(rows["ts"]), rows["event_id"].to_numpy(np.int64), rows["delay"].to_numpy(np.float64)
        order = np.lexsort((seen_id, seen, stop, own))
        last = order[np.append(np.diff(own[order]) != 0, True)]  # each journey's best of these
        i = own[last]
        was = out[i]
        better = (was["seen"] == NEVER) | (stop[last] > was["stop"]) | (stop[last] == was["stop"]) & ((seen[last] > was["seen"]) | (seen[last] == was["seen"]) & (seen_id[last] > was["seen_id"]))
        i, last = i[better], last[better]
        out["stop"][i], out["seen"][i], out["seen_id"][i], out["delay"][i] = stop[last], seen[last], seen_id[last], delay[last]
    return out, np.isin(out["train"], train)


def _running(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each journey's furthest real-time stop with its last known delay, and whether the journey is over.

    It is over when its last stop is real-time (``terminal``); or (``time``)
    when the planned arrival at the destination and the last event are both 20
    minutes old, which a later event in time to come puts off. The first timer
    is for that, the second forgets what is over. A group's own timer is its
    journeys' earliest; their timers are looked at in each batch that it has.
    """
    day, group = key
    now = state.getCurrentWatermarkMs()
    over = int((pd.Timestamp(day) + KEPT).timestamp() * 1000)

    def said(of: np.ndarray, status: np.ndarray | str) -> pd.DataFrame:
        train = pd.Series(of["train"], dtype="Int64") if group >= 0 else pd.Series([None] * len(of), dtype="Int64")
        return pd.DataFrame({"train": train, "day": [day] * len(of), "stop": of["stop"], "delay": np.where(np.isnan(of["delay"]), 0.0, of["delay"]), "n": of["n"], "status": status})

    held = np.frombuffer(state.get[0], _JOURNEY) if state.exists else np.zeros(0, _JOURNEY)
    if state.hasTimedOut:
        held = held.copy()
    else:
        touched = np.zeros(0, np.int64)
        for rows in batches:
            held, here = _merged(held, rows)
            touched = np.union1d(touched, held["train"][here])
        here = np.isin(held["train"], touched)
        terminal = held["stop"] >= held["last_stop"]  # it stays so, as the furthest stop is kept
        held["done"][here] = terminal[here]
        last = (np.maximum(held["planned"], held["latest"]) + GRACE // pd.Timedelta(microseconds=1)) // 1000
        held["timer"][here] = np.maximum(np.where(terminal, over, last), now + 1)[here]
        yield said(held[here], np.where(terminal[here], "terminal", "running"))
    due = held["timer"] < now
    ended = due & ~held["done"]
    if ended.any():
        yield said(held[ended], "time")
    held["done"][ended], held["timer"][ended] = True, max(over, now + 1)
    held = held[~due | ended]
    if len(held):
        state.update((held.tobytes(),))
        state.setTimeoutTimestamp(max(int(held["timer"].min()), now + 1))
    else:
        state.remove()


def running_trains(stream: DataFrame) -> DataFrame:
    """Position, delay and status of each journey, kept by train and day: many journeys in a group, as a call for each would take longer than its events."""
    group = F.when(F.col("train").isNull(), -1).otherwise(F.pmod(F.xxhash64("train"), F.lit(GROUPS)).cast("int"))
    known = {c: F.coalesce(c, F.lit(0)) for c in ("train", "stop", "event_id")} | {"real_time": F.coalesce("real_time", F.lit(False))}
    rows = stream.withWatermark("ts", "10 minutes").withColumn("group", group).withColumns(known)
    return rows.groupBy("day", "group").applyInPandasWithState(_running, STATUS, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


EVALUATION = "day date, data_sig long, n_types long, mae double, evaluations long"


def evaluated(days: DataFrame, forecasts: DataFrame) -> DataFrame:
    """(day, data_sig, n_types, mae) of day sums (day, event_type, n, ge5): the mean error of the forecast shares, with the number of rows it rests on as signature."""
    sig = F.sum("n").alias("data_sig")
    errors = days.join(forecasts, ["day", "event_type"]).groupBy("day").agg(F.count("*").alias("n_types"), F.round(F.avg(F.abs(F.col("predicted") - F.col("ge5") / F.col("n"))), 4).alias("mae"))
    return days.groupBy("day").agg(sig).join(errors, "day").select("day", "data_sig", "n_types", "mae")


class Reevaluation:
    """Days whose sums a batch changes are evaluated again, and upserted where their signature differs from that of the history."""

    def __init__(self, spark: SparkSession, forecasts: DataFrame, sums: StructType, every: int = 8):
        self.forecasts = forecasts
        self.actual = Upserts(spark, scratch(spark, "actual"), sums, ("day", "event_type"), every)
        self.history = Upserts(spark, scratch(spark, "history"), StructType.fromDDL(EVALUATION), ("day",), every)

    def put(self, batch: DataFrame, k: int) -> None:
        self.actual.put(batch, k)
        days = self.actual.table().join(batch.select("day").distinct(), "day", "left_semi")
        old = self.history.table(before=k).select("day", F.col("data_sig").alias("old_sig"), F.col("evaluations").alias("before"))
        new = evaluated(days, self.forecasts).join(old, "day", "left").where("old_sig is null or old_sig <> data_sig")
        self.history.put(new.withColumn("evaluations", F.coalesce("before", F.lit(0)).cast("long") + 1), k)


def reevaluated_days(stream: DataFrame, forecasts: DataFrame, every: int = 8) -> DataFrame:
    """The accuracy history of a stream of day sums, kept up by day."""
    job = Reevaluation(stream.sparkSession, forecasts, stream.schema, every)
    run(stream, "update", job.put)
    return job.history.table()
