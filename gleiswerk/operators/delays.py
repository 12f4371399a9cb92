"""Stop facts: deduplication, joins, and daily delay statistics.

Each function takes and returns DataFrames. Groups are combined before they are
shuffled wherever the aggregate allows it; exact percentiles are the exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Percent of rows that meet the condition; null counts as not met."""
    return F.round(100 * F.avg(F.when(condition, 1.0).otherwise(0.0)), 4)


def first_row(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in an order: an aggregate, so combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def latest_row(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key: an aggregate, so combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def plan_with_changes(plan: DataFrame, latest: DataFrame, key: str = "sid") -> DataFrame:
    """Every planned stop, with its latest change where there is one."""
    return plan.join(latest, key, "left")


#: The columns of a stop fact.
FACTS = (
    "sid", "eva", "station", "date", "train_cat", "train_num", "train_label", "line", "sched_arr", "sched_dep", "real_arr", "real_dep",
    "delay_arr_min", "delay_dep_min", "cancelled", "delay_codes", "msg_cats",
)
#: Minutes below this are of a changed plan, not of a train ahead of time.
LEAST = -15


def stop_facts(joined: DataFrame) -> DataFrame:
    """Both sides of each planned stop with its latest change: delay minutes of arrival and departure (null where a time is missing, or below -15), whether either is cancelled, the service date (departure's, else arrival's), and the train's label (its sid where it has neither type nor number)."""

    def minutes(side: str) -> Column:
        late = (F.unix_timestamp(f"real_{side}") - F.unix_timestamp(f"sched_{side}")) / 60
        return F.when(late >= LEAST, late).alias(f"delay_{side}_min")

    cancelled = lambda side: F.coalesce(F.col(f"cl_{side}").isin("1", "c"), F.lit(False))
    label = F.trim(F.concat(F.coalesce("train_cat", F.lit("")), F.lit(" "), F.coalesce("train_num", F.lit(""))))
    return joined.withColumns({
        "date": F.to_date(F.coalesce("sched_dep", "sched_arr")), "train_label": F.when(label == "", F.col("sid").cast("string")).otherwise(label),
        "delay_arr_min": minutes("arr"), "delay_dep_min": minutes("dep"), "cancelled": cancelled("arr") | cancelled("dep"),
    }).select(*FACTS)


def departures(facts: DataFrame) -> DataFrame:
    """Stop facts as the statistics of days and types read them: valid departures run, others are only counted."""
    runs = F.col("sched_dep").isNotNull() & F.col("real_dep").isNotNull() & ~F.col("cancelled")
    return facts.select("date", F.col("train_label").alias("ride_id"), F.col("train_cat").alias("train_type"), F.col("cancelled").alias("is_canceled"), F.col("delay_dep_min").alias("delay"), runs.alias("runs"), "delay_codes")


def daily_statistics(stops: DataFrame) -> DataFrame:
    """A row for each date: stops, trips, cancelled, mean, median and 90th percentile of delays, shares over thresholds."""
    run = F.col("runs") if "runs" in stops.columns else ~F.col("is_canceled")
    d = F.when(run & (F.col("delay") >= LEAST), F.col("delay"))

    def part(condition: Column) -> Column:
        return F.round(100 * F.sum(F.when(run & condition, 1.0).otherwise(0.0)) / F.sum(F.when(run, 1.0)), 4)

    return (
        stops.groupBy("date")
        .agg(
            F.count("*").alias("stops_total"),
            F.count_distinct(F.when(run, F.col("ride_id"))).alias("trips"),
            F.count_if("is_canceled").alias("cancelled"),
            F.round(F.avg(d), 4).alias("avg_delay"),
            F.round(F.percentile(d, 0.5), 4).alias("med_delay"),
            F.round(F.percentile(d, 0.9), 4).alias("p90_delay"),
            part(d <= 1).alias("pct_le1"),
            part(d >= 3).alias("pct_ge3"),
            part(d >= 5).alias("pct_ge5"),
            part(d >= 10).alias("pct_ge10"),
            part(d >= 30).alias("pct_ge30"),
            F.count_if(run).alias("n_run"),
        )
        .where("n_run > 0").drop("n_run")
    )


def top_codes(stops: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent delay codes of each date, as 'code:n | ...'."""
    counts = stops.groupBy("date", "code").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("n"), "code"))).where(F.col("k") <= k)
    said = F.array_sort(F.collect_list(F.struct("k", F.concat_ws(":", F.col("code").cast("string"), F.col("n").cast("string")).alias("s"))))
    return ranked.groupBy("date").agg(F.array_join(F.transform(said, lambda x: x["s"]), " | ").alias("top_codes"))


def day_type_statistics(stops: DataFrame) -> DataFrame:
    """Day and train type: all rows are counted, delays are of those that ran, from -15 minutes on."""
    ok = F.when(~F.col("is_canceled") & (F.col("delay") >= -15), F.col("delay"))
    return stops.where("train_type is not null").groupBy("date", "train_type").agg(
        F.count("*").alias("n_stops"),
        F.count_if("is_canceled").alias("n_cancel"),
        F.round(F.count_if("is_canceled") / F.count("*"), 4).alias("cancel_rate"),
        F.round(F.avg(ok), 4).alias("avg_delay"),
        F.round(F.percentile(ok, 0.5), 4).alias("med_delay"),
        F.round(F.percentile(ok, 0.9), 4).alias("p90_delay"),
        F.round(100.0 * F.count_if(ok >= 5) / F.nullif(F.count(ok), F.lit(0)), 4).alias("pct_ge5"),
        F.round(100.0 * F.count_if(ok >= 10) / F.nullif(F.count(ok), F.lit(0)), 4).alias("pct_ge10"),
    )


def partial_sums(stops: DataFrame, *keys: str) -> DataFrame:
    """Mergeable parts of the day and type statistics, by any finer key."""
    ok = F.when(~F.col("is_canceled") & (F.col("delay") >= -15), F.col("delay"))
    return stops.where("train_type is not null").groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("is_canceled").alias("cancel"), F.count(ok).alias("cnt"), F.coalesce(F.sum(ok), F.lit(0.0)).alias("total"), F.count_if(ok >= 5).alias("ge5"), F.count_if(ok >= 10).alias("ge10")
    )


def merge_partials(parts: DataFrame) -> DataFrame:
    """Day and type statistics from their parts, however the parts were cut."""
    return (
        parts.groupBy("date", "train_type").agg(*(F.sum(c).alias(c) for c in ("n", "cancel", "cnt", "total", "ge5", "ge10")))
        .select("date", "train_type", F.col("n").alias("n_stops"), F.col("cancel").alias("n_cancel"), F.round(F.col("cancel") / F.col("n"), 4).alias("cancel_rate"), F.round(F.col("total") / F.nullif(F.col("cnt"), F.lit(0)), 4).alias("avg_delay"),
                F.round(100.0 * F.col("ge5") / F.nullif(F.col("cnt"), F.lit(0)), 4).alias("pct_ge5"), F.round(100.0 * F.col("ge10") / F.nullif(F.col("cnt"), F.lit(0)), 4).alias("pct_ge10"))
    )


def by_precedence(sources: list[DataFrame], *keys: str) -> DataFrame:
    """The union of sources; where several have a key, the last one wins."""
    columns = [c for c in sources[0].columns if c not in keys]
    ranked = sources[0].withColumn("__k", F.lit(0))
    for k, df in enumerate(sources[1:], 1):
        ranked = ranked.unionByName(df.withColumn("__k", F.lit(k)))
    return ranked.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__k").alias("r")).select(*keys, "r.*")


def type_volume(stats: DataFrame, k: int = 8) -> DataFrame:
    """The k train types of the most stops."""
    return stats.groupBy("train_type").agg(F.sum("n_stops").alias("volume")).orderBy(F.desc("volume"), "train_type").limit(k)
