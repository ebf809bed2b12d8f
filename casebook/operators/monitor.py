"""Observability: inventory gauges, histograms, alerts, heartbeats, request limits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.dates import ntz
from casebook.operators.lifecycle import is_stuck
from casebook.operators.ranking import running_sum


def metric_rows(df: DataFrame, metric: str, *labels: str) -> DataFrame:
    """Counts as (metric, label, value) with the labels joined by '/'."""
    return df.groupBy(*labels).agg(F.count("*").alias("value")).select(
        F.lit(metric).alias("metric"), F.concat_ws("/", *labels).alias("label"), "value"
    )


def inventory(sources: DataFrame, attempts: DataFrame, records: DataFrame, incidents: DataFrame,
              as_of: dt.datetime, window_hours: int = 24) -> DataFrame:
    """All gauges in long form, one aggregate per table.

    Stuck counts are zero-filled for every transient status.
    """
    stuck = F.coalesce(is_stuck(as_of), F.lit(False))
    per_source = sources.agg(
        *[F.count_if(stuck & (F.col("status") == s)).alias(s) for s in fixed.STUCK_RETURNS],
        F.count_if(F.col("is_violent_death")).alias("violent_death"),
        F.count("*").alias("sources"),
    )
    long = per_source.unpivot([], [*fixed.STUCK_RETURNS, "violent_death", "sources"], "label", "value")
    gauges = long.select(
        F.when(F.col("label").isin(list(fixed.STUCK_RETURNS)), "stuck").otherwise("total").alias("metric"), "label", "value"
    )
    recent = attempts.where(
        (F.col("created_at") >= ntz(as_of - dt.timedelta(hours=window_hours)))
        & F.col("failure_reason").isNotNull() & F.col("outcome").isin("failure", "discarded")
    )
    by_reason = recent.groupBy("outcome", "stage", "failure_reason").agg(F.count("*").alias("value")).select(
        F.when(F.col("outcome") == "failure", "failures").otherwise("discards").alias("metric"),
        F.concat_ws("/", "stage", "failure_reason").alias("label"), "value",
    )
    out = metric_rows(sources, "status", "status").unionByName(gauges).unionByName(by_reason)
    for name, table in (("records", records), ("incidents", incidents)):
        out = out.unionByName(table.agg(F.count("*").alias("value")).select(
            F.lit("total").alias("metric"), F.lit(name).alias("label"), "value"))
    return out


def zero_filled(current: DataFrame, known_labels: DataFrame) -> DataFrame:
    """Metric rows with a zero for every label seen before and absent now."""
    keys = known_labels.select("metric", "label").unionByName(current.select("metric", "label")).distinct()
    return keys.join(current, ["metric", "label"], "left").fillna(0, ["value"])


def attempt_counters(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("stage", "outcome", F.coalesce("failure_reason", F.lit("none")).alias("reason")).agg(
        F.count("*").alias("attempts")
    )


def histogram(df: DataFrame, value: str, buckets: list[float], *labels: str) -> DataFrame:
    """Cumulative fixed-bucket histogram per label set: (labels, le, count)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*labels).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)],
        F.count("*").alias("inf"),
    )
    entries = [F.struct(F.lit(str(float(b))).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)]
    entries.append(F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("count")))
    return counted.select(*labels, F.explode(F.array(*entries)).alias("e")).select(*labels, "e.le", "e.count")


def alert_rules(spark: SparkSession) -> DataFrame:
    """Alert thresholds: five fixed rows."""
    return spark.createDataFrame(fixed.ALERT_RULES, "metric string, threshold double, severity string, rule string")


def alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with its current value and whether it fires."""
    return rules.join(values, "metric", "left").select(
        "rule", "severity", "metric", "threshold", F.col("value").cast("double").alias("value"),
        F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("firing"),
    )


def health_values(sources: DataFrame, runs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """(metric, value) rows the alert rules look at.  runs: finished_at, ok."""
    per_source = sources.agg(
        F.count_if(is_stuck(as_of)).cast("double").alias("stuck_sources"),
        F.count_if(F.col("status") == "ready_for_classification").cast("double").alias("ready_for_classification"),
    ).unpivot([], ["stuck_sources", "ready_for_classification"], "metric", "value")
    age = minutes_since(runs.where(F.col("ok")), "finished_at", as_of)
    return per_source.unionByName(age.select(F.lit("minutes_since_success").alias("metric"), F.col("minutes").alias("value")))


def minutes_since(df: DataFrame, time: str, as_of: dt.datetime, *keys: str) -> DataFrame:
    """Minutes from the latest row to as_of, per key."""
    gap = (F.unix_timestamp(ntz(as_of).cast("timestamp")) - F.unix_timestamp(F.max(time).cast("timestamp"))) / 60.0
    return df.groupBy(*keys).agg(gap.alias("minutes"))


def recent_activity(df: DataFrame, time: str, as_of: dt.datetime, minutes: int) -> DataFrame:
    return df.where(F.col(time) >= ntz(as_of - dt.timedelta(minutes=minutes))).agg(F.count("*").alias("events"))


def heartbeat_misses(beats: DataFrame, worker: str, time: str, ok: str, limit: int = 5) -> DataFrame:
    """Longest run of consecutive misses per worker, and whether it reaches the limit.

    The run of misses is counted per stretch between two successful beats.
    """
    keyed = beats.select(worker, time, ok)
    stretched = running_sum(
        keyed, [worker], [time, ok], F.date_trunc("hour", F.col(time)), F.col(ok).cast("int"), "_stretch"
    )
    runs = stretched.where(~F.col(ok)).groupBy(worker, "_stretch").count()
    return runs.groupBy(worker).agg(F.max("count").alias("longest_miss_run")).withColumn(
        "alarm", F.col("longest_miss_run") >= limit
    )


def requests_over_limit(requests: DataFrame, client: str, time: str, limit: int, width: str) -> DataFrame:
    """Tumbling windows in which a client exceeded its request limit."""
    span = F.window(F.col(time).cast("timestamp"), width)
    return (
        requests.groupBy(client, span.alias("w"))
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") > limit)
        .select(client, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "requests")
    )
