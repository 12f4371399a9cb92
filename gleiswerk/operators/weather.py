"""Weather: from station hours to region days, and its joins with delays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import weather_delay


def region_days(station_days: DataFrame) -> DataFrame:
    """Region and date: mean, most and least of the stations, risk flags of the worst, delay minutes by mean."""
    minutes = weather_delay(F.col("snow"), F.col("gust"), F.col("precip"))
    return station_days.withColumn("minutes", minutes).groupBy("region", "date").agg(
        F.round(F.avg("temp"), 4).alias("temp_mean"),
        F.max("temp").alias("temp_max"),
        F.min("temp").alias("temp_min"),
        F.max(F.when(F.col("snow") >= 1, 1).otherwise(0)).alias("snow_risk"),
        F.max(F.when(F.col("snow") >= 3, 1).otherwise(0)).alias("heavy_snow_risk"),
        F.max(F.when(F.col("gust") >= 60, 1).otherwise(0)).alias("strong_wind_risk"),
        F.max(F.when(F.col("precip") >= 20, 1).otherwise(0)).alias("heavy_precip_risk"),
        F.round(F.avg("minutes"), 4).alias("weather_delay_min"),
    )


def complete_days(station_days: DataFrame, least: float = 0.8) -> DataFrame:
    """Region-days on which at least this share of the region's stations reported."""
    have = station_days.groupBy("region", "date").agg(F.count_distinct("station").alias("n"))
    need = station_days.groupBy("region").agg(F.count_distinct("station").alias("n_all"))
    return have.join(need, "region").where(F.col("n") >= least * F.col("n_all")).select("region", "date", "n", "n_all")


def daily_of_hours(hours: DataFrame) -> DataFrame:
    """Hourly rows as region-days: mean temperature, sums of rain and snow, strongest gust; strongest wind and mean weather code where the rows have them."""
    more = [x for c, x in (("wind", F.max("wind").alias("wind")), ("code", F.round(F.avg("code"), 4).alias("code"))) if c in hours.columns]
    return hours.groupBy("region", "date").agg(F.round(F.avg("temp"), 4).alias("temp"), F.sum("precip").alias("precip"), F.sum("snow").alias("snow"), F.max("gust").alias("gust"), F.count_distinct("hour").alias("hours"), *more)


def national_days(days: DataFrame) -> DataFrame:
    """Region-days as one row for each date."""
    return days.groupBy("date").agg(
        F.round(F.avg("temp"), 6).alias("temp"), F.max("precip").alias("precip"), F.max("snow").alias("snow"), F.max("gust").alias("gust"), F.count_if(F.col("precip") > 2).alias("wet_regions")
    )


def impact(days: DataFrame) -> DataFrame:
    """A row for each region, and one for all (null region): mean, sum and most minutes of delay, days with any, days of any risk."""
    m = F.col("weather_delay_min")
    risk = (F.col("snow_risk") == 1) | (F.col("strong_wind_risk") == 1) | (F.col("heavy_precip_risk") == 1)
    return days.rollup("region").agg(F.round(F.avg(m), 6).alias("avg_min"), F.round(F.sum(m), 3).alias("sum_min"), F.max(m).alias("max_min"), F.count_if(m > 0).alias("days"), F.count_if(risk).alias("risk_days"))


def by_source(sources: list[DataFrame]) -> DataFrame:
    """The union of region-days; where several sources have one, the last wins."""
    rows = sources[0].withColumn("__k", F.lit(0))
    for k, df in enumerate(sources[1:], 1):
        rows = rows.unionByName(df.withColumn("__k", F.lit(k)))
    w = Window.partitionBy("region", "date").orderBy(F.desc("__k"))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__k")


def with_coverage(asked: DataFrame, days: DataFrame) -> DataFrame:
    """Minutes of delay of a date and region; no data (null) is told apart from none (0)."""
    span = days.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    found = asked.join(days.select("region", "date", "weather_delay_min"), ["region", "date"], "left").join(F.broadcast(span))
    return found.select("region", "date", "weather_delay_min", (F.col("weather_delay_min").isNull() | ~F.col("date").between(F.col("lo"), F.col("hi"))).alias("no_data"))


def incidents_on(days: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents of the region whose span holds the date.

    Both sides meet on the region and the span's days, so the join is by
    equality however many incidents there are.
    """
    spread = incidents.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    return days.join(spread, ["region", "date"]).select("region", "date", "incident_id", "delay_min")
