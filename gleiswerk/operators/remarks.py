"""The remark archive: what free-text remarks say and what delays go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import severity, text_category
from .causes import with_percent


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite, or not a number, where b is 0."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(F.try_divide(a, b))


def marked(archive: DataFrame) -> DataFrame:
    """The archive with the larger of both delays, the remark's category, and whether there is a remark."""
    return archive.select(
        "*",
        F.greatest("max_delay", "last_delay").alias("delay"),
        text_category(F.col("remark")).alias("category"),
        (F.trim(F.coalesce("remark", F.lit(""))) != "").alias("has"),
    )


def totals(rows: DataFrame) -> DataFrame:
    has = F.col("has")
    return rows.agg(
        F.count("*").alias("records"),
        F.count_if(has).alias("with_remark"),
        F.round(100.0 * F.count_if(has) / F.count("*"), 4).alias("pct_with"),
        F.round(F.avg(F.when(has, F.col("delay"))), 4).alias("avg_with"),
        F.round(F.avg(F.when(~has, F.col("delay"))), 4).alias("avg_without"),
        F.count_distinct(F.when(has, F.col("remark"))).alias("distinct_remarks"),
    )


def text_frequency(rows: DataFrame) -> DataFrame:
    return with_percent(rows.where("has").groupBy("remark", "category").agg(F.count("*").alias("n")))


def category_strength(rows: DataFrame) -> DataFrame:
    per = rows.where("has").groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("delay"), 4).alias("avg_delay"), F.max("delay").alias("max_delay"))
    return with_percent(per.withColumn("severity", severity(F.col("category"))))


def detail(rows: DataFrame) -> DataFrame:
    """Train, date and category: number, sum, largest and mean delay, severity."""
    per = rows.where("has").groupBy("slug", "date", "category").agg(F.count("*").alias("n"), F.sum("delay").alias("sum_delay"), F.max("delay").alias("max_delay"), F.round(F.avg("delay"), 4).alias("avg_delay"))
    return per.withColumn("severity", severity(F.col("category")))


def train_profile(rows: DataFrame) -> DataFrame:
    """A row for each train: remarks, mean and largest delay, the most frequent category, number of categories."""
    per = rows.where("has").groupBy("slug", "category").agg(F.count("*").alias("n"), F.sum("delay").alias("s"), F.max("delay").alias("mx"))
    return per.groupBy("slug").agg(
        F.round(F.sum("s") / F.sum("n"), 4).alias("avg_delay"), F.max("mx").alias("max_delay"), F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("dominant"), F.count("*").alias("n_categories"), F.sum("n").alias("n")
    )


def impact_by_type(rows: DataFrame) -> DataFrame:
    """Type and cause: rate of remarks, delay with over without a remark, share of records and of delays, and delay share over record share."""
    has = F.col("has")
    kinds = rows.groupBy("kind").agg(
        F.round(F.count_if(has) / F.count("*"), 4).alias("remark_rate"), F.round(ratio(F.avg(F.when(has, F.col("delay"))), F.avg(F.when(~has, F.col("delay")))), 4).alias("signal_ratio")
    )
    per = rows.where(has).groupBy("kind", "category").agg(F.count("*").alias("n"), F.sum("delay").alias("total"))
    w = Window.partitionBy("kind")
    rec, late = F.col("n") / F.sum("n").over(w), ratio(F.col("total"), F.sum("total").over(w))
    shares = per.select("kind", "category", F.round(100.0 * F.col("n") / F.sum("n").over(w), 4).alias("rec_pct"), F.round(ratio(100.0 * F.col("total"), F.sum("total").over(w)), 4).alias("delay_pct"), F.round(late / rec, 4).alias("impact_ratio"))
    return shares.join(kinds, "kind")


def contribution(rows: DataFrame) -> DataFrame:
    """Minutes of delay that go with each category, their share, and that over the share of records."""
    per = rows.where("has").groupBy("category").agg(F.count("*").alias("n"), F.avg("delay").alias("a"))
    all_ = per.agg(F.sum(F.col("n") * F.col("a")).alias("minutes_all"), F.sum("n").alias("n_all"))
    minutes = F.col("n") * F.col("a")
    return per.join(F.broadcast(all_)).select(
        "category", "n", F.round(minutes, 4).alias("minutes"), F.round(100.0 * F.col("n") * F.col("a") / F.col("minutes_all"), 4).alias("delay_pct"), F.round((minutes / F.col("minutes_all")) / (F.col("n") / F.col("n_all")), 4).alias("impact_ratio")
    )
