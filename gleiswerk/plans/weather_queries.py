"""Queries of weather and of the forecast's features: A26-A30, U2, J7-J9, W1-W3, W15, F1-F5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delays, forecast, weather
from .registry import query
from .testmodel import cte

MIN = "(CASE WHEN snow >= 1 THEN 8 ELSE 0 END + CASE WHEN snow >= 3 THEN 20 ELSE 0 END + CASE WHEN gust >= 60 THEN 15 ELSE 0 END + CASE WHEN precip >= 20 THEN 5 ELSE 0 END)"
REGION = f"""SELECT region, date, round(avg(temp), 4) AS temp_mean, max(temp) AS temp_max, min(temp) AS temp_min, CAST(max(snow) >= 1 AS INTEGER) AS snow_risk, CAST(max(snow) >= 3 AS INTEGER) AS heavy_snow_risk,
CAST(max(gust) >= 60 AS INTEGER) AS strong_wind_risk, CAST(max(precip) >= 20 AS INTEGER) AS heavy_precip_risk, round(avg({MIN}), 4) AS weather_delay_min FROM weather GROUP BY region, date"""


@query("a26_region_days", cte("weather") + REGION, dates=("date",))
def a26(m):
    return weather.region_days(m.weather)


COMPLETE = """SELECT h.region, date, n, n_all FROM (SELECT region, date, count(DISTINCT station) AS n FROM weather GROUP BY 1, 2) h
JOIN (SELECT region, count(DISTINCT station) AS n_all FROM weather GROUP BY 1) a ON h.region = a.region WHERE n >= 0.8 * n_all"""


@query("a27_complete_days", cte("weather").replace("CAST(l_shipdate AS DATE) AS date", "CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date") + COMPLETE, dates=("date",))
def a27(m):
    """With the contract's share, over quarters: on a day of the given tables few stations report."""
    return weather.complete_days(m.weather.withColumn("date", F.trunc("date", "quarter")))


@query("a27_fifth_complete_days", cte("weather") + COMPLETE.replace("0.8", "0.2"), dates=("date",))
def a27b(m):
    """As a27 from a fifth of the stations on: on few days of the given tables more report."""
    return weather.complete_days(m.weather, 0.2)


@query("a28_daily_of_hours", cte("weather") + "SELECT region, date, round(avg(temp), 4) AS temp, sum(precip) AS precip, sum(snow) AS snow, max(gust) AS gust, count(DISTINCT hour) AS hours, max(gust / 2) AS wind, round(avg(hour * 4 % 100), 4) AS code FROM weather GROUP BY 1, 2", dates=("date",))
def a28(m):
    """Wind is half of the gust here, and the weather code follows the hour."""
    return weather.daily_of_hours(m.weather.withColumn("wind", F.col("gust") / 2).withColumn("code", F.col("hour") * 4 % 100))


DAYS = "SELECT region, date, round(avg(temp), 4) AS temp, sum(precip) AS precip, sum(snow) AS snow, max(gust) AS gust FROM weather GROUP BY 1, 2"
NATIONAL = f"SELECT date, round(avg(temp), 6) AS temp, max(precip) AS precip, max(snow) AS snow, max(gust) AS gust, count(*) FILTER (precip > 2) AS wet_regions FROM ({DAYS}) GROUP BY date"


@query("a29_national_days", cte("weather") + NATIONAL, dates=("date",))
def a29(m):
    return weather.national_days(weather.daily_of_hours(m.weather))


@query("a30_weather_impact", cte("weather") + f"SELECT region, round(avg(weather_delay_min), 6) AS avg_min, round(sum(weather_delay_min), 3) AS sum_min, max(weather_delay_min) AS max_min, count(*) FILTER (weather_delay_min > 0) AS days, count(*) FILTER (snow_risk = 1 OR strong_wind_risk = 1 OR heavy_precip_risk = 1) AS risk_days FROM ({REGION}) GROUP BY ROLLUP (region)")
def a30(m):
    return weather.impact(weather.region_days(m.weather))


@query("u02_weather_precedence", cte("weather") + f""", d AS ({DAYS}) SELECT region, date, CASE WHEN date >= DATE '1999-01-01' THEN 'fresh' WHEN date >= DATE '1998-01-01' THEN 'archive' ELSE 'history' END AS source, temp FROM d""", dates=("date",))
def u02(m):
    days = weather.daily_of_hours(m.weather).select("region", "date", "temp")
    parts = [days.withColumn("source", F.lit("history")), days.where("date >= '1998-01-01'").withColumn("source", F.lit("archive")), days.where("date >= '1999-01-01'").withColumn("source", F.lit("fresh"))]
    return weather.by_source(parts)


@query("j07_features_with_weather", cte("stats", "weather") + f", w AS ({NATIONAL}) SELECT s.date, train_type, avg_delay, temp, precip, wet_regions FROM stats s LEFT JOIN w ON s.date = w.date", dates=("date",))
def j07(m):
    days = weather.national_days(weather.daily_of_hours(m.weather)).select("date", "temp", "precip", "wet_regions")
    return delays.day_type_statistics(m.stops).select("date", "train_type", "avg_delay").join(days, "date", "left")


@query("j08_weather_coverage", cte("weather", "stops") + f""", d AS ({REGION} HAVING max(snow) >= 1 OR date > DATE '1996-01-01'), a AS (SELECT DISTINCT region, date FROM stops)
SELECT a.region, a.date, weather_delay_min, weather_delay_min IS NULL OR a.date NOT BETWEEN (SELECT min(date) FROM d) AND (SELECT max(date) FROM d) AS no_data FROM a LEFT JOIN d ON a.region = d.region AND a.date = d.date""", dates=("date",))
def j08(m):
    days = weather.region_days(m.weather).where("snow_risk = 1 or date > '1996-01-01'")
    return weather.with_coverage(m.stops.select("region", "date").distinct(), days)


@query("j09_incidents_on_day", cte("stops", "incidents") + """SELECT d.region, d.date, incident_id, delay_min FROM (SELECT DISTINCT region, date FROM stops) d JOIN incidents i ON d.region = i.region AND d.date BETWEEN start_date AND end_date""", dates=("date",))
def j09(m):
    return weather.incidents_on(m.stops.select("region", "date").distinct(), m.incidents)


# -- features and forecast -----------------------------------------------------------------

W = "PARTITION BY train_type, target ORDER BY date"
LONG = "SELECT date, train_type, n_stops, cancel_rate, 'avg_delay' AS target, avg_delay AS y FROM stats UNION ALL SELECT date, train_type, n_stops, cancel_rate, 'pct_ge5', pct_ge5 FROM stats"
LAGS = f"""SELECT date, train_type, target, y, lag(y, 1) OVER ({W}) AS lag1, lag(y, 3) OVER ({W}) AS lag3, lag(y, 7) OVER ({W}) AS lag7, lag(cancel_rate, 7) OVER ({W}) AS cancel_lag7 FROM ({LONG})"""
ROLL = f"SELECT date, train_type, target, CASE WHEN count(y) OVER w >= 3 THEN round(avg(y) OVER w, 6) END AS roll7 FROM ({LONG}) WINDOW w AS ({W} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
WX = "w.temp, w.precip, w.snow, w.gust, w.wet_regions"


def long_stats(m):
    return forecast.by_target(delays.day_type_statistics(m.stops))


def national(m):
    return weather.national_days(weather.daily_of_hours(m.weather))


@query("w01_lag_features", cte("stats") + LAGS, dates=("date",))
def w01(m):
    return forecast.lags(long_stats(m)).select("date", "train_type", "target", "y", "lag1", "lag3", "lag7", "cancel_lag7")


@query("w02_rolling_mean", cte("stats") + ROLL, dates=("date",))
def w02(m):
    return forecast.rolling(long_stats(m)).select("date", "train_type", "target", "roll7")


@query("w03_serving_features", cte("stats", "weather") + f""", w AS ({NATIONAL}), t AS (SELECT max(date) + 1 AS target_date FROM stats), x AS ({LONG})
SELECT x.train_type, x.target, t.target_date, max(y) FILTER (x.date = t.target_date - 1) AS lag1, max(y) FILTER (x.date = t.target_date - 3) AS lag3, max(y) FILTER (x.date = t.target_date - 7) AS lag7,
max(cancel_rate) FILTER (x.date = t.target_date - 7) AS cancel_lag7, round(avg(y) FILTER (x.date BETWEEN t.target_date - 7 AND t.target_date - 1), 6) AS roll7, {WX},
CAST(isodow(t.target_date) - 1 AS INTEGER) AS weekday, CAST(month(t.target_date) AS INTEGER) AS month FROM x CROSS JOIN t LEFT JOIN w ON w.date = t.target_date GROUP BY x.train_type, x.target, t.target_date, {WX}""", dates=("target_date",))
def w03(m):
    return forecast.serving(delays.day_type_statistics(m.stops), national(m))


@query("w15_time_split", cte("stats") + """SELECT train_type, date > max(date) OVER (PARTITION BY train_type) - 30 AS hold_out, date FROM stats""", dates=("date",))
def w15(m):
    return forecast.time_split(delays.day_type_statistics(m.stops)).select("train_type", "hold_out", "date")


FEATURES = f"""SELECT l.*, n.n_stops, n.cancel_rate, r.roll7, {WX}, CAST(isodow(l.date) - 1 AS INTEGER) AS weekday, CAST(month(l.date) AS INTEGER) AS month
FROM ({LAGS}) l JOIN ({ROLL}) r ON l.date = r.date AND l.train_type = r.train_type AND l.target = r.target JOIN stats n ON l.date = n.date AND l.train_type = n.train_type JOIN w ON l.date = w.date
WHERE y IS NOT NULL AND lag1 IS NOT NULL AND lag3 IS NOT NULL AND lag7 IS NOT NULL AND cancel_lag7 IS NOT NULL AND roll7 IS NOT NULL AND temp IS NOT NULL AND precip IS NOT NULL AND snow IS NOT NULL AND gust IS NOT NULL"""


def features(m):
    return forecast.features(delays.day_type_statistics(m.stops), national(m))


@query("f01_feature_table", cte("stats", "weather") + f", w AS ({NATIONAL}) {FEATURES}", dates=("date",))
def f01(m):
    return features(m)


@query("f02_hold_out_error")
def f02(m):
    """Gradient-boosted trees of each type and target; no SQL fits them, tests compare with the mean."""
    return forecast.fit_and_check(features(m))


@query("f03_next_day_forecast")
def f03(m):
    return forecast.predict_next(delays.day_type_statistics(m.stops), national(m))


@query("f04_forecast_errors")
def f04_forecast(m):
    """Forecasts of the last day, made from the days before it, evaluated by what that day was."""
    stats = delays.day_type_statistics(m.stops)
    last = stats.agg(F.max("date").alias("last"))
    before = stats.join(F.broadcast(last)).where("date < last").drop("last")
    return forecast.type_errors(forecast.as_guess(forecast.predict_next(before, national(m))), stats)


ERRORS = """, p AS (SELECT date, train_type, lag(avg_delay) OVER (PARTITION BY train_type ORDER BY date) AS f_avg, lag(pct_ge5) OVER (PARTITION BY train_type ORDER BY date) AS f_pct FROM stats),
e AS (SELECT s.date, s.train_type, s.n_stops, round(abs(s.avg_delay - f_avg), 6) AS err_avg, round(abs(s.pct_ge5 - f_pct), 6) AS err_pct FROM stats s JOIN p ON s.date = p.date AND s.train_type = p.train_type WHERE f_avg IS NOT NULL)"""


def naive(m):
    """Yesterday's values as a forecast."""
    from pyspark.sql import Window

    w = Window.partitionBy("train_type").orderBy("date")
    stats = delays.day_type_statistics(m.stops)
    return stats, stats.select("date", "train_type", F.lag("avg_delay").over(w).alias("f_avg"), F.lag("pct_ge5").over(w).alias("f_pct")).where("f_avg is not null")


@query("f04_evaluate_day", cte("stats") + ERRORS + "SELECT date, count(*) AS n_types, round(avg(err_avg), 6) AS mae_avg, round(avg(err_pct), 6) AS mae_pct, CAST(sum(n_stops) AS BIGINT) AS data_sig FROM e GROUP BY date", dates=("date",))
def f04(m):
    stats, guess = naive(m)
    return forecast.evaluate(guess, stats)


@query("f04_type_errors", cte("stats") + ERRORS + "SELECT date, train_type, n_stops, err_avg, err_pct FROM e", dates=("date",))
def f04_types(m):
    stats, guess = naive(m)
    return forecast.type_errors(guess, stats)


@query("f05_accuracy_history", cte("stats") + ERRORS + """, n AS (SELECT date, round(avg(err_avg), 6) AS mae_avg, CAST(sum(n_stops) AS BIGINT) AS data_sig FROM e GROUP BY date)
SELECT date, mae_avg, data_sig, CASE WHEN month(date) % 2 = 0 THEN 'kept' ELSE 'evaluated' END AS state FROM n""", dates=("date",))
def f05(m):
    past, now = histories(m)
    return forecast.upsert_history(past, now)


def histories(m):
    """A history that is up to date for every second month and stale for the others, and today's evaluation."""
    stats, guess = naive(m)
    now = forecast.evaluate(guess, stats).select("date", "mae_avg", "data_sig")
    fresh = F.month("date") % 2 == 0
    past = now.withColumn("data_sig", F.when(fresh, F.col("data_sig")).otherwise(F.col("data_sig") - 1)).withColumn("mae_avg", F.when(fresh, F.col("mae_avg")).otherwise(F.lit(-1.0)))
    return past, now


@query("f05_back_check", cte("stats") + ERRORS + """, n AS (SELECT date, round(avg(err_avg), 6) AS mae_avg, CAST(sum(n_stops) AS BIGINT) AS data_sig, month(date) % 2 = 0 AS fresh, date > (SELECT max(date) FROM e) - 10 AS recent FROM e GROUP BY date)
SELECT date, CASE WHEN fresh OR recent THEN mae_avg ELSE -1.0 END AS mae_avg, CASE WHEN fresh OR recent THEN data_sig ELSE data_sig - 1 END AS data_sig, CASE WHEN recent AND NOT fresh THEN 'evaluated' ELSE 'kept' END AS state FROM n""", dates=("date",))
def f05_back(m):
    return forecast.back_check(*histories(m))
