"""Sources and sinks: archived responses, monthly files, JSON, CSV, and what a folder already holds.

Paths go to Spark's own readers and writers, so any store they open will do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REMARK = "service_date string, train string, train_slug string, weekday string, last_delay_min int, max_delay_min int, remarks string"
SERVICE = "line_number string, train_type string, stations array<string>, planned_times array<string>, n_days int, region string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleiswerk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query at its end.
FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a file in the shared folder: what is read several times is made once, and its shuffle files are gone."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(FREE_SHUFFLE, "false")
    spark.conf.set(FREE_SHUFFLE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLE, before)
    return spark.read.schema(df.schema).parquet(path)


def raw_archive(spark: SparkSession, path: str, api: str | None = None) -> DataFrame:
    """Responses of status 200 (a string), of one API if named."""
    rows = spark.read.parquet(path).where(F.col("status_code").cast("string") == "200")
    return rows.where(F.col("api_name") == api) if api else rows


def monthly_stops(spark: SparkSession, glob: str, *columns: str) -> DataFrame:
    """Monthly files, only the columns asked for, with the file's month."""
    rows = spark.read.parquet(glob)
    return rows.select(*columns, F.regexp_extract(F.col("_metadata.file_path"), r"month=(\d{4}-\d{2})", 1).alias("file_month"))


def one_train(rows: DataFrame, number: int, kind: str, line: str) -> DataFrame:
    """(number and type) or line: reaches the Parquet scan as a pushed filter."""
    return rows.where(((F.col("train_num") == number) & (F.col("train_type") == kind)) | (F.col("line") == line))


def remark_archive(spark: SparkSession, glob: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(REMARK).option("mode", "DROPMALFORMED").json(glob)


def timetable_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of services."""
    return spark.read.schema(SERVICE).option("multiLine", True).json(path)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Per-train, per-day files: train and date are of the path, the day written of the file."""
    path = F.col("_metadata.file_path")
    return spark.read.schema("bhf string, adelay string, ddelay string").option("recursiveFileLookup", True).json(folder).select(
        "*", F.regexp_extract(path, r"train=([^/]+)", 1).alias("train"), F.regexp_extract(path, r"date=([0-9-]+)", 1).cast("date").alias("date"), F.to_date("_metadata.file_modification_time").alias("written")
    )


def quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header; a byte order mark is dropped and fields are trimmed."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return rows.toDF(*(c.replace("﻿", "").strip() for c in rows.columns))


def write_facts(facts: DataFrame, path: str) -> None:
    """Stop facts as Parquet by month, lines together within a month."""
    rows = facts.withColumn("month", F.date_format("date", "yyyy-MM"))
    rows.repartition("month", F.pmod(F.hash("line"), F.lit(4))).sortWithinPartitions("month", "line").write.partitionBy("month").parquet(path)


def write_text(table: DataFrame, path: str, kind: str) -> None:
    """Small tables as CSV or JSON."""
    (table.write.option("header", True).csv if kind == "csv" else table.write.json)(path)


def shard_name(path: Column, pattern: str = r"([^/]+)$") -> Column:
    """A shard's name as ``pattern`` finds it in its path, without what differs between copies: all up to ``_date_``, a leading ``date_``, and marks of copies."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    name = F.regexp_replace(F.regexp_extract(plain, pattern, 1), "^(.*?_)?date_", "")
    return F.regexp_replace(name, r"( \(\d+\)|-copy)(?=\.)", "")


def distinct_shards(spark: SparkSession, folder: str, pattern: str = r"([^/]+)$") -> DataFrame:
    """Files under normalised names: one of equal content; same name and other content are both kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.col("_metadata.file_path")
    rows = files.select(shard_name(path, pattern).alias("name"), "length", F.sha2("content", 256).alias("sum"), path.alias("path"))
    return rows.groupBy("name", "length", "sum").agg(F.min("path").alias("path"))


def shard_rows(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(name, value): the lines of the kept shards, each once for a name, as shards of one name may overlap."""
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.join(shards.select("path", "name"), "path").select("name", "value").distinct()


def days_to_load(listing: DataFrame, end: str) -> DataFrame:
    """From file names: the days after the last one taken, up to the end, that no file has."""
    have = listing.select(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("day")).where("day is not null").distinct()
    last = have.agg(F.max("day").alias("last"))
    days = last.select(F.explode(F.sequence(F.date_add("last", 1), F.greatest(F.lit(end).cast("date"), F.date_add("last", 1)))).alias("day")).where(F.col("day") <= F.lit(end).cast("date"))
    return days.join(have, "day", "left_anti")
