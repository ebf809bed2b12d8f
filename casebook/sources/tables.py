"""Typed scans of the archive tables: Parquet, CSV and JDBC, plus snapshot pulls."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from casebook import schemas
from casebook.functions.dates import ntz


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One archive table from Parquet with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in schemas.TABLES}


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Analyst CSV with a header and a declared schema.

    Files whose cells hold line ends need multi_line, which reads a file per task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return reader.schema(schema).csv(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str = "id", partitions: int = 64, quote: str = '"', **options: str,
) -> DataFrame:
    """Database table read in id ranges by parallel tasks; the database gives the bounds.

    `quote` is the database's mark around column names, whose case then counts.
    """
    def source() -> DataFrameReader:  # a reader keeps every option it is given
        return spark.read.format("jdbc").options(url=url, **options)

    column = f"{quote}{partition_column}{quote}"
    bounds = f"SELECT min({column}) AS low, max({column}) AS high FROM {table}"
    low, high = source().option("query", bounds).load().first()
    if low is None:
        return source().option("dbtable", table).load()
    ranges = {"partitionColumn": partition_column, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(partitions)}
    return source().options(dbtable=table, **ranges).load()


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 1000, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **options).mode(mode).save()


def snapshot(tables: dict[str, DataFrame], start: dt.datetime, end: dt.datetime) -> dict[str, DataFrame]:
    """Tables cut to a window: sources by fetch time, events by event date,
    incidents deduplicated by id."""
    time_of = {"source_google_news": "fetched_at", "raw_event": "event_date", "unique_event": "event_date"}
    out = {}
    for name, df in tables.items():
        if name in time_of:
            df = df.where(F.col(time_of[name]).between(ntz(start), ntz(end)))
        out[name] = df.dropDuplicates(["id"]) if name == "unique_event" else df
    return out


def write_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def write_incidents(incidents: DataFrame, path: str) -> None:
    """Incidents laid out for the read side: one folder per month, sorted by city,
    so date and city filters prune files and row groups."""
    (
        incidents.withColumn("month", F.date_format("event_date", "yyyy-MM"))
        .repartition("month", F.pmod(F.xxhash64("id"), F.lit(16)))
        .sortWithinPartitions("city", "event_date")
        .write.mode("overwrite").partitionBy("month").parquet(path)
    )
