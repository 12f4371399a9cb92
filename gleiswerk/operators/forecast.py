"""Features of the daily statistics, the next day's forecast, and its evaluation.

Everything here works on the aggregated table (a row for each date and train
type), so its windows are small whatever the stop facts are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.files import scratch

WEATHER = ("temp", "precip", "snow", "gust", "wet_regions")
INPUTS = ("lag1", "lag3", "lag7", "cancel_lag7", "roll7", *WEATHER, "weekday", "month")
TARGETS = ("avg_delay", "pct_ge5")
FIT_LEAST, HOLD_OUT_DAYS, FITS_AT_ONCE = 30, 30, 4


def by_target(stats: DataFrame) -> DataFrame:
    """A row for each day, type and target, with the target's value as y."""
    return stats.select("date", "train_type", "n_stops", "cancel_rate", *[F.col(t).cast("double") for t in TARGETS]).unpivot(["date", "train_type", "n_stops", "cancel_rate"], list(TARGETS), "target", "y")


def by_type() -> WindowSpec:
    return Window.partitionBy("train_type", "target").orderBy("date")


def lags(rows: DataFrame) -> DataFrame:
    """The target's value 1, 3 and 7 rows before, and the cancel rate 7 rows before."""
    w = by_type()
    return rows.withColumns({f"lag{n}": F.lag("y", n).over(w) for n in (1, 3, 7)} | {"cancel_lag7": F.lag("cancel_rate", 7).over(w)})


def rolling(rows: DataFrame) -> DataFrame:
    """The target's mean over the 7 rows before, from 3 observations on."""
    w = by_type().rowsBetween(-7, -1)
    return rows.withColumn("roll7", F.when(F.count("y").over(w) >= 3, F.round(F.avg("y").over(w), 6)))


def with_calendar(rows: DataFrame, date: str) -> DataFrame:
    return rows.withColumn("weekday", F.weekday(date)).withColumn("month", F.month(date))


def serving(stats: DataFrame, national: DataFrame) -> DataFrame:
    """Features of the day after the last, by calendar days (training goes by rows; they differ where days are missing).

    What was not observed, the day's weather included, is null.
    """
    target = stats.agg(F.date_add(F.max("date"), 1).alias("target_date"))
    back = F.datediff("target_date", "date")
    at = lambda c, k: F.max(F.when(back == k, F.col(c)))
    rows = by_target(stats).join(F.broadcast(target)).groupBy("train_type", "target", "target_date").agg(
        at("y", 1).alias("lag1"), at("y", 3).alias("lag3"), at("y", 7).alias("lag7"), at("cancel_rate", 7).alias("cancel_lag7"), F.round(F.avg(F.when(back.between(1, 7), F.col("y"))), 6).alias("roll7")
    )
    return with_calendar(rows.join(national.select(F.col("date").alias("target_date"), *WEATHER), "target_date", "left"), "target_date")


def time_split(rows: DataFrame, days: int = HOLD_OUT_DAYS) -> DataFrame:
    """Marks the last days of each type."""
    return rows.withColumn("hold_out", F.col("date") > F.date_sub(F.max("date").over(Window.partitionBy("train_type")), days))


def features(stats: DataFrame, national: DataFrame) -> DataFrame:
    """Lags and rolling mean of each target, weather and calendar; rows without one of them are left out."""
    rows = rolling(lags(by_target(stats))).join(national.select("date", *WEATHER), "date")
    return with_calendar(rows, "date").na.drop(subset=["y", *INPUTS])


def _model(rows: DataFrame):
    vectors = VectorAssembler(inputCols=list(INPUTS), outputCol="features", handleInvalid="keep")
    return GBTRegressor(featuresCol="features", labelCol="y", maxIter=10, maxDepth=3, seed=7).fit(vectors.transform(rows)), vectors


def _fitted(rows: DataFrame) -> list[tuple[str, str, int]]:
    """Types and targets with rows enough to fit; a row for each comes to the driver."""
    counts = rows.groupBy("train_type", "target").agg(F.count("*").alias("n")).where(F.col("n") >= FIT_LEAST)
    return sorted((r.train_type, r.target, r.n) for r in counts.collect())


def _written(rows: DataFrame) -> DataFrame:
    """The small table of features as a file of the shared folder, which every fit reads; nothing stays cached."""
    path = scratch(rows.sparkSession, "features")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _of_each(rows: DataFrame, work: Callable[[str, str, int], DataFrame], schema: str) -> DataFrame:
    """What ``work`` makes of each type and target, a few of them at a time: fits are many small jobs."""
    with ThreadPool(FITS_AT_ONCE) as pool:
        parts = pool.starmap(work, _fitted(rows))
    return reduce(DataFrame.unionByName, parts, rows.sparkSession.createDataFrame([], schema))


def fit_and_check(rows: DataFrame) -> DataFrame:
    """A model of each type and target, from 30 rows on: rows fitted, and mean absolute error of the last 30 days beside that of the mean."""
    rows = _written(time_split(rows))

    def check(kind: str, target: str, n: int) -> DataFrame:
        own = rows.where((F.col("train_type") == kind) & (F.col("target") == target))
        model, vectors = _model(own.where("not hold_out"))
        mean = own.where("not hold_out").agg(F.avg("y")).first()[0]
        return model.transform(vectors.transform(own.where("hold_out"))).agg(
            F.lit(kind).alias("train_type"), F.lit(target).alias("target"), F.lit(n).cast("long").alias("n_fit"), F.round(F.avg(F.abs(F.col("prediction") - F.col("y"))), 3).alias("mae"), F.round(F.avg(F.abs(F.lit(mean) - F.col("y"))), 3).alias("mae_of_mean")
        )

    return _of_each(rows.where("not hold_out"), check, "train_type string, target string, n_fit long, mae double, mae_of_mean double")


def predict_next(stats: DataFrame, national: DataFrame) -> DataFrame:
    """Both targets of the day after the last, of each type, by the calendar's features; what is unknown of them takes each tree's upper branch."""
    rows, asked = _written(features(stats, national)), _written(serving(stats, national))

    def predict(kind: str, target: str, _: int) -> DataFrame:
        own = (F.col("train_type") == kind) & (F.col("target") == target)
        model, vectors = _model(rows.where(own))
        return model.transform(vectors.transform(asked.where(own))).select("target_date", "train_type", "target", F.round("prediction", 3).alias("value"))

    return _of_each(rows, predict, "target_date date, train_type string, target string, value double")


def as_guess(predicted: DataFrame) -> DataFrame:
    """Predictions with a column for each target, as they are evaluated."""
    value = lambda t: F.max(F.when(F.col("target") == t, F.col("value")))
    return predicted.groupBy(F.col("target_date").alias("date"), "train_type").agg(value("avg_delay").alias("f_avg"), value("pct_ge5").alias("f_pct"))


def type_errors(guess: DataFrame, stats: DataFrame) -> DataFrame:
    """Absolute errors of both targets for each day and type."""
    both = guess.join(stats.select("date", "train_type", "n_stops", "avg_delay", "pct_ge5"), ["date", "train_type"])
    return both.select("date", "train_type", "n_stops", F.round(F.abs(F.col("avg_delay") - F.col("f_avg")), 6).alias("err_avg"), F.round(F.abs(F.col("pct_ge5") - F.col("f_pct")), 6).alias("err_pct"))


def evaluate(guess: DataFrame, stats: DataFrame) -> DataFrame:
    """Mean absolute errors of a day over its types, and the signature of its data."""
    return type_errors(guess, stats).groupBy("date").agg(
        F.count("*").alias("n_types"), F.round(F.avg("err_avg"), 6).alias("mae_avg"), F.round(F.avg("err_pct"), 6).alias("mae_pct"), F.sum("n_stops").alias("data_sig")
    )


def upsert_history(past: DataFrame, now: DataFrame) -> DataFrame:
    """The history with days whose data changed evaluated anew; days of one signature stay as they are. Doing it twice changes nothing."""
    changed = now.join(past.select("date", "data_sig"), ["date", "data_sig"], "left_anti").withColumn("state", F.lit("evaluated"))
    kept = past.join(changed.select("date"), "date", "left_anti").withColumn("state", F.lit("kept"))
    return kept.unionByName(changed)


def back_check(past: DataFrame, now: DataFrame, days: int = 10) -> DataFrame:
    """The history with the last days (of those evaluated) that are missing or whose data changed evaluated; older days stay."""
    last = now.agg(F.max("date").alias("last"))
    recent = now.join(F.broadcast(last)).where(F.col("date") > F.date_sub("last", days)).drop("last")
    return upsert_history(past, recent)
