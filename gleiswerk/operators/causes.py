"""Causes of delays: codes and messages of stops, their frequencies, and what they cost.

Long rows (train, key, n) inside; arrays and maps only at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import code_category, construction_kind
from ..functions.scalars import message_name, tokens

PIVOT = ("kaskade", "einsatz", "wetter", "sonstiges", "passagier", "bereitstellung", "fahrzeug", "wagen", "bau", "infrastruktur", "strecke", "keine")


def percent(n: str = "n", *by: str) -> F.Column:
    """Share of n in its group's sum, in percent."""
    return F.round(100.0 * F.col(n) / F.sum(n).over(Window.partitionBy(*by)), 4)


def with_percent(counts: DataFrame, *by: str) -> DataFrame:
    """Counts with their share of the total, joined from an aggregate (no window over all rows in one task)."""
    if by:
        return counts.withColumn("pct", percent("n", *by))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).withColumn("pct", F.round(100.0 * F.col("n") / F.col("__total"), 4)).drop("__total")


def stop_reasons(rows: DataFrame, key: str = "id") -> DataFrame:
    """The union of codes and messages of each stop over all polls."""
    return rows.groupBy(key).agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.array_sort(F.collect_set("msg")).alias("msgs"),
        F.bool_or(F.coalesce(F.col("msg").contains("törung"), F.lit(False))).alias("has_stoerung"),
        F.bool_or(F.coalesce(F.col("msg").contains("Bauarbeiten"), F.lit(False))).alias("has_bau"),
        F.bool_or(F.coalesce(F.col("msg").startswith("Groß"), F.lit(False))).alias("has_gross"),
    )


def cause_frequency(stops: DataFrame) -> DataFrame:
    """Rank, count and percent of each category over all remarks of stops; a construction message decides."""
    category = F.when(F.lower(F.coalesce("msg", F.lit(""))).contains("bauarbeiten"), "bau").otherwise(code_category(F.col("code")))
    counts = with_percent(stops.groupBy(category.alias("category")).agg(F.count("*").alias("n")))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")))  # a row for each category


def construction_frequency(stops: DataFrame) -> DataFrame:
    """Kinds of construction, in percent of them."""
    bau = stops.where(F.lower(F.coalesce("msg", F.lit(""))).contains("bauarbeiten") | (code_category(F.col("code")) == "bau"))
    return with_percent(bau.groupBy(construction_kind(F.col("code")).alias("kind")).agg(F.count("*").alias("n")))


def code_frequency(polls: DataFrame) -> DataFrame:
    """How often each code was seen, once for each response and stop, and when first and last."""
    return polls.select("doc", "id", "code", "obs_ts").groupBy("doc", "id", "code").agg(F.min("obs_ts").alias("a"), F.max("obs_ts").alias("b")).groupBy("code").agg(
        F.count("*").alias("n"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen")
    )


def cause_composition(reasons: DataFrame) -> DataFrame:
    """Categories by distinct stop and code, with percent."""
    rows = reasons.select("id", F.explode("codes").alias("code"))
    return with_percent(rows.groupBy(code_category(F.col("code")).alias("category")).agg(F.count("*").alias("n")))


def measured_by_code(reasons: DataFrame, stops: DataFrame, key: str = "id") -> DataFrame:
    """Mean delay and cancelled percent of the stops that a code is on."""
    rows = reasons.select(key, F.explode("codes").alias("code")).join(stops.select(key, "delay", "is_canceled"), key)
    return rows.groupBy("code", code_category(F.col("code")).alias("category")).agg(
        F.count("*").alias("n"), F.round(F.avg("delay"), 4).alias("avg_delay"), F.round(100.0 * F.count_if("is_canceled") / F.count("*"), 4).alias("cancel_pct")
    )


def top_codes(reasons: DataFrame, stops: DataFrame, k: int = 12, key: str = "id") -> DataFrame:
    """The codes on most stops, with mean delay and cancelled percent."""
    return measured_by_code(reasons, stops, key).orderBy(F.desc("n"), "code").limit(k).drop("category")


def with_and_without(stops: DataFrame, coded: DataFrame, key: str = "id") -> DataFrame:
    """Stops with and without a reason: number, mean delay, percent of at least 5 minutes, percent cancelled."""
    known = coded.select(key).distinct().withColumn("has_code", F.lit(True))
    both = stops.join(known, key, "left").withColumn("has_code", F.coalesce("has_code", F.lit(False)))
    return both.groupBy("has_code").agg(
        F.count("*").alias("n"), F.round(F.avg("delay"), 4).alias("avg_delay"), F.round(100.0 * F.count_if(F.col("delay") >= 5) / F.count("*"), 4).alias("pct_ge5"), F.round(100.0 * F.count_if("is_canceled") / F.count("*"), 4).alias("cancel_pct")
    )


def train_profile(stops: DataFrame, min_stops: int = 5) -> DataFrame:
    """A row for each train: days, stops, coded stops, stops with a message, mean and largest delay, cancelled percent."""
    return stops.groupBy("train").agg(
        F.count_distinct("date").alias("days"),
        F.count("*").alias("stops"),
        F.count_if(F.col("code") != 99).alias("coded"),
        F.count("msg").alias("with_msg"),
        F.round(F.avg("delay"), 4).alias("avg_delay"),
        F.greatest(F.max("delay"), F.lit(0.0)).alias("max_delay"),
        F.round(100.0 * F.count_if("is_canceled") / F.count("*"), 4).alias("cancel_pct"),
    ).where(F.col("stops") >= min_stops)


def train_causes(stops: DataFrame) -> DataFrame:
    """Each train's causes in percent, and as minutes of its mean delay."""
    per = stops.groupBy("train", code_category(F.col("code")).alias("category")).agg(F.count("*").alias("n"), F.sum("delay").alias("total"))
    w = Window.partitionBy("train")
    share = F.col("n") / F.sum("n").over(w)
    mean = F.sum("total").over(w) / F.sum("n").over(w)
    return per.select("train", "category", F.col("n"), F.round(100 * share, 4).alias("pct"), F.round(mean * share + 1e-9, 4).alias("minutes"))


def coded_shares(stops: DataFrame, *by: str) -> DataFrame:
    """Share of each cause among the coded stops of each ``by``, and their number."""
    counts = stops.where(F.col("code").isNotNull()).groupBy(*by, code_category(F.col("code")).alias("category")).agg(F.count("*").alias("n"))
    coded = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "category", coded.alias("coded"), (100 * (F.col("n") / coded)).alias("pct"))


def as_map(rows: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """Long rows as one map for each group, keys in order."""
    return rows.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("entries"))


def top_of_each(rows: DataFrame, by: str, what: str, k: int) -> DataFrame:
    """The k most frequent values of each group, as an array in order."""
    counts = rows.where(F.col(what).isNotNull()).groupBy(by, what).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), what))).where(F.col("k") <= k)
    return ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", what))), lambda x: x[what]).alias("top"))


def counts_of_each(rows: DataFrame, by: str, what: str, k: int) -> DataFrame:
    """The k most frequent values of each group with their counts, as an array in order; a sink makes a map of it."""
    counts = rows.where(F.col(what).isNotNull()).groupBy(by, what).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), what))).where(F.col("k") <= k)
    return ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(what).cast("string").alias("value"), "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))


def first_of_each(rows: DataFrame, by: str, what: str, k: int, *order: str) -> DataFrame:
    """The first k distinct values of each group by an order, as an array."""
    seen = rows.where(F.col(what).isNotNull()).groupBy(by, what).agg(F.min(F.struct(*order)).alias("first"))
    ranked = seen.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("first", what))).where(F.col("k") <= k)
    return ranked.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", what))), lambda x: x[what]).alias("first"))


def baseline_shares(stops: DataFrame, kept: DataFrame) -> DataFrame:
    """Shares of causes over the kept trains."""
    rows = stops.join(kept.select("train"), "train", "left_semi")
    return with_percent(rows.groupBy(code_category(F.col("code")).alias("category")).agg(F.count("*").alias("n")))


def type_by_cause(reasons: DataFrame, stops: DataFrame, key: str = "id") -> DataFrame:
    """Train types by causes: a matrix of fixed columns."""
    rows = reasons.select(key, F.explode("codes").alias("code")).join(stops.select(key, "train_type"), key)
    return rows.withColumn("category_of", code_category(F.col("code"))).groupBy("train_type").pivot("category_of", list(PIVOT)).agg(F.count("code")).na.fill(0)


def message_combinations(reasons: DataFrame, k: int = 8) -> DataFrame:
    """The k most frequent combinations of messages."""
    said = F.array_join(F.array_sort(F.array_distinct(F.transform("msgs", message_name))), "+")
    return reasons.groupBy(said.alias("combination")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "combination").limit(k)


def exploded_tokens(rows: DataFrame, column: str) -> DataFrame:
    """Comma- or semicolon-separated tokens as integers, a row each; others are skipped."""
    return rows.withColumn("token", F.explode(tokens(F.col(column)))).withColumn("token", F.col("token").try_cast("int")).where("token is not null")
