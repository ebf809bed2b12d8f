"""Sinks: public exports, pair reports, audits, the attempt log, label documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed, schemas
from casebook.operators import stats
from casebook.operators.lists import export_rows, export_truncated


def export_csv(df: DataFrame, condition: Column, path: str, columns: list[str] | None = None, cap: int | None = None) -> None:
    export_rows(df, condition, columns, cap).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, condition: Column, path: str, columns: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Write the JSON export; returns the one-row (exported, truncated) report."""
    export_rows(df, condition, columns, cap).write.mode("overwrite").json(path)
    return export_truncated(df, condition, cap)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Near-duplicate pair report as CSV in the declared column order."""
    names = [c.split()[0] for c in schemas.PAIR_REPORT.split(", ")]
    tagged = pairs if "failure_tags" in pairs.columns else pairs.withColumn("failure_tags", F.lit(None).cast("string"))
    tagged.select(*names).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schemas.PAIR_REPORT).csv(path)


def write_taxonomy_audit(df: DataFrame, path: str) -> None:
    stats.taxonomy_audit(df).write.mode("overwrite").option("header", True).csv(path)


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append-only attempt log with whole failure details."""
    attempts.write.mode("append").parquet(path)


def read_cases(spark: SparkSession, path: str, input_ddl: str, expected_ddl: str, multi_line: bool = True) -> DataFrame:
    """Cases of label or report documents, one row per case.

    Documents are small files that each hold one document, or, without
    multi_line, lines of files of any size.
    """
    documents = spark.read.schema(schemas.fixture(input_ddl, expected_ddl)).option("multiLine", multi_line).json(path)
    return documents.select(F.explode("cases").alias("c")).select("c.*")
