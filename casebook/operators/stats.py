"""Public and admin statistics.

Every figure is a partial aggregate (map-side combined) over the scanned rows;
windows and sorts only ever see the grouped result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.dates import date_key, hour_bucket, ntz, rolling_window
from casebook.functions.places import haversine_km, in_bounds, radius_bounds
from casebook.operators import filters


def percent_of_total(df: DataFrame, count: str = "count") -> DataFrame:
    """Share of each group, one decimal, half up.  The input is already grouped."""
    total = F.sum(count).over(Window.partitionBy())
    return df.withColumn("percent", F.round(F.col(count) * 100.0 / total, 1))


def overview(df: DataFrame, as_of: dt.datetime, fallback: dt.date) -> DataFrame:
    """Public totals, last 7 and 30 days, and the earliest mapped day of the year window.
    Future and undated rows count in the total only."""
    date = F.col("event_date")
    mapped = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.where(filters.public_incident()).agg(
        F.count("*").alias("total"),
        F.count_if(rolling_window(date, as_of, 7)).alias("last_7_days"),
        F.count_if(rolling_window(date, as_of, 30)).alias("last_30_days"),
        F.coalesce(
            F.min(F.when(mapped & rolling_window(date, as_of, fixed.MAP_WINDOW_DAYS), F.to_date(date))),
            F.lit(fallback),
        ).alias("since"),
    )


def by_type(df: DataFrame) -> DataFrame:
    """Count and percent per label over all rows, unlabelled ones included."""
    label = F.coalesce(F.col("homicide_type"), F.lit(fixed.TYPE_UNCLASSIFIED))
    return percent_of_total(df.groupBy(label.alias("type")).count()).orderBy(F.col("count").desc(), "type")


def by_state(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("state").isNotNull()).groupBy("state").count().orderBy(F.col("count").desc(), "state")
    )


def by_day(df: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Public incidents per day since as_of - days; no upper bound, no empty days."""
    cutoff = ntz(as_of - dt.timedelta(days=days))
    return (
        df.where(filters.public_incident() & (F.col("event_date") >= cutoff))
        .groupBy(date_key(F.col("event_date")).alias("day"))
        .count()
        .orderBy("day")
    )


def security_force(df: DataFrame) -> DataFrame:
    """Involved, not involved, unknown."""
    flag = F.col("security_force_involved")
    return df.agg(
        F.count_if(flag).alias("involved"),
        F.count_if(~flag).alias("not_involved"),
        F.count_if(flag.isNull()).alias("unknown"),
    )


def nearby_summary(df: DataFrame, lat: float, lng: float, radius_km: float, as_of: dt.datetime, days: int | None) -> DataFrame:
    """Totals within a radius for the current and the previous equal period.

    Without `days` all rows are current and there is no previous period.
    """
    current, previous = _periods(as_of, days)
    n, prev = F.col("total"), F.col("previous_total")
    change = F.when(prev > 0, F.round((n - prev) * 100.0 / prev, 1))
    return (
        _within(df, lat, lng, radius_km)
        .agg(
            F.count_if(current).alias("total"),
            F.coalesce(F.sum(F.when(current, F.col("victim_count"))), F.lit(0)).alias("total_victims"),
            F.count_if(current & F.coalesce(F.col("security_force_involved"), F.lit(False))).alias("security"),
            F.count_if(previous).alias("previous_total"),
        )
        .withColumn("trend_pct", change if days is not None else F.lit(None).cast("double"))
    )


def nearby_breakdown(df: DataFrame, lat: float, lng: float, radius_km: float, as_of: dt.datetime, days: int | None) -> DataFrame:
    """Current-period counts by type and by method with percents, from one scan."""
    current, _ = _periods(as_of, days)
    label = F.coalesce(F.col("homicide_type"), F.lit(fixed.TYPE_UNCLASSIFIED))
    method = F.coalesce(F.col("method_of_death"), F.lit(fixed.METHOD_UNSPECIFIED))
    groups = F.explode(
        F.array(
            F.struct(F.lit("type").alias("dimension"), label.alias("label")),
            F.struct(F.lit("method").alias("dimension"), method.alias("label")),
        )
    )
    counted = (
        _within(df, lat, lng, radius_km)
        .where(current)
        .select(groups.alias("g"))
        .groupBy("g.dimension", "g.label")
        .count()
    )
    share = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy("dimension"))
    return counted.withColumn("percent", F.round(share, 1))


def _within(df: DataFrame, lat: float, lng: float, radius_km: float) -> DataFrame:
    box = in_bounds(F.col("latitude"), F.col("longitude"), radius_bounds(lat, lng, radius_km))
    distance = haversine_km(
        F.lit(lat), F.lit(lng), F.col("latitude").cast("double"), F.col("longitude").cast("double")
    )
    return df.where(box).where(distance <= radius_km)


def _periods(as_of: dt.datetime, days: int | None) -> tuple[Column, Column]:
    if days is None:
        return F.lit(True), F.lit(False)
    cutoff = ntz(as_of - dt.timedelta(days=days))
    earlier = ntz(as_of - dt.timedelta(days=2 * days))
    date = F.col("event_date")
    current = F.coalesce(date >= cutoff, F.lit(False))
    return current, F.coalesce((date >= earlier) & (date < cutoff), F.lit(False))


def period_change(df: DataFrame, date: str, period_days: int) -> DataFrame:
    """Count per consecutive period and its change from the period before."""
    index = F.floor(F.datediff(date, F.lit("1970-01-01")) / period_days).cast("long")
    counted = df.where(F.col(date).isNotNull()).groupBy(index.alias("period")).count()
    before = F.lag("count").over(Window.partitionBy(F.lit(0)).orderBy("period"))
    return counted.withColumn("previous", before).withColumn(
        "change_pct", F.round((F.col("count") - F.col("previous")) * 100.0 / F.col("previous"), 1)
    )


def incident_summary(df: DataFrame) -> DataFrame:
    mapped = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum("victim_count"), F.lit(0)).alias("victims"),
        F.count_if(mapped).alias("geocoded"),
        F.count_if(F.col("confirmed")).alias("confirmed"),
        F.count_if(F.col("security_force_involved")).alias("security"),
    )


def daily_victims(df: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Victims per day over the window; days without incidents read zero."""
    first, last = (as_of - dt.timedelta(days=days)).date(), as_of.date()
    daily = (
        df.where(F.col("event_date").between(ntz(dt.datetime.combine(first, dt.time())), ntz(as_of)))
        .groupBy(F.to_date("event_date").alias("day"))
        .agg(F.sum(F.coalesce(F.col("victim_count"), F.lit(0))).alias("victims"))
    )
    calendar = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("day")
    )
    return calendar.join(daily, "day", "left").select(
        "day", F.coalesce("victims", F.lit(0)).cast("long").alias("victims")
    )


def record_summary(df: DataFrame, top: int = 10) -> DataFrame:
    """Totals, by type, and the largest cities in long form: (dimension, label, count)."""
    by_label = df.groupBy(F.coalesce("homicide_type", F.lit(fixed.TYPE_UNCLASSIFIED)).alias("label")).count()
    by_city = (
        df.where(F.col("city").isNotNull())
        .groupBy(F.col("city").alias("label"))
        .count()
        .orderBy(F.col("count").desc(), "label")
        .limit(top)
    )
    totals = df.agg(
        F.count("*").alias("total"), F.count_if(F.col("security_force_involved")).alias("security")
    ).unpivot([], ["total", "security"], "label", "count")

    def tagged(part: DataFrame, name: str) -> DataFrame:
        return part.select(F.lit(name).alias("dimension"), "label", "count")

    return (
        tagged(by_label, "type").unionByName(tagged(by_city, "city")).unionByName(tagged(totals, "total"))
    )


def status_counts(sources: DataFrame) -> DataFrame:
    """Rows per status with the grand total, from one rollup."""
    return sources.rollup("status").agg(F.count("*").alias("count"), F.grouping("status").alias("is_total"))


def hourly_status(sources: DataFrame, as_of: dt.datetime, hours: int, statuses: list[str] | None = None) -> DataFrame:
    """Rows per hour in one column per status, plus the hour's total."""
    names = statuses or fixed.HOURLY_STATUSES
    counted = [F.count_if(F.col("status") == s).alias(s) for s in names]
    return (
        sources.where(F.col("fetched_at") >= ntz(as_of - dt.timedelta(hours=hours)))
        .groupBy(hour_bucket(F.col("fetched_at")).alias("hour"))
        .agg(*counted, F.count("*").alias("total"))
    )


def dashboard(sources: DataFrame, records: DataFrame, incidents: DataFrame, statuses: list[str]) -> DataFrame:
    """All dashboard counters in long form: (counter, value)."""
    per_source = sources.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses],
        F.count_if(F.col("is_violent_death")).alias("positive"),
        F.count_if(~F.col("is_violent_death")).alias("negative"),
        F.count("*").alias("sources"),
    )
    names = [*statuses, "positive", "negative", "sources"]
    long = per_source.unpivot([], names, "counter", "value")
    for name, table in (("records", records), ("incidents", incidents)):
        long = long.unionByName(table.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value"))
    return long


def city_ingest(city_stats: DataFrame, configured: int) -> DataFrame:
    """Configured, tracked and sharded city counts."""
    return city_stats.agg(
        F.lit(configured).cast("long").alias("configured"),
        F.count("*").alias("tracked"),
        F.count_if(F.col("needs_sharding")).alias("sharded"),
    )


def city_ranking(city_stats: DataFrame) -> DataFrame:
    return city_stats.orderBy(F.col("last_result_count").desc_nulls_last(), "city_name")


def ingest_summary(city_runs: DataFrame) -> DataFrame:
    """Per-country ingest totals and their grand total."""
    return city_runs.rollup("country").agg(
        F.count("*").alias("cities"),
        F.sum("entries").alias("entries"),
        F.sum("errors").alias("errors"),
        F.count_if(F.col("entries") >= fixed.SHARDING_THRESHOLD).alias("over_cap"),
    )


def outcome_counts(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("count"))


def digest(incidents: DataFrame, *keys: str, n: int = 5) -> DataFrame:
    """Count, first n distinct cities and first n ids per group, with the overflow.

    The rank filter is pushed into the map side (group limit), so a huge group
    sends at most n rows per task and is never gathered whole.
    """
    cities = incidents.where(F.col("city").isNotNull()).select(*keys, "city").distinct()

    def first_n(df: DataFrame, column: str, name: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(column)
        kept = df.select(*keys, column, F.row_number().over(order).alias("_r")).where(F.col("_r") <= n)
        return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias(name))

    counted = incidents.groupBy(*keys).agg(F.count("*").alias("count"))
    city_n = cities.groupBy(*keys).agg(F.count("*").alias("_cities"))
    by = list(keys)
    out = (
        counted.join(city_n, by, "left")
        .join(first_n(cities, "city", "cities"), by, "left")
        .join(first_n(incidents, "id", "ids"), by, "left")
    )
    return out.select(
        *keys,
        "count",
        F.coalesce("cities", F.array().cast("array<string>")).alias("cities"),
        F.greatest(F.coalesce("_cities", F.lit(0)) - n, F.lit(0)).alias("cities_more"),
        "ids",
        F.greatest(F.col("count") - n, F.lit(0)).alias("ids_more"),
    )


def funnel(sources: DataFrame, records: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows that reached each stage: (stage, count)."""
    passed = {
        "sources": F.count("*"),
        "classified": F.count_if(F.col("is_violent_death").isNotNull()),
        "downloaded": F.count_if(F.col("status").isin("ready_for_extraction", "extracting", "failed_in_extraction", "extracted")),
        "extracted": F.count_if(F.col("status") == "extracted"),
    }
    wide = sources.agg(*[agg.alias(name) for name, agg in passed.items()])
    long = wide.unpivot([], list(passed), "stage", "count")
    for name, table in (("records", records), ("incidents", incidents)):
        long = long.unionByName(table.agg(F.count("*").alias("count")).select(F.lit(name).alias("stage"), "count"))
    return long


def taxonomy_audit(df: DataFrame) -> DataFrame:
    """Rows per legacy label and the pair it maps to."""
    from casebook.functions.taxonomy import legacy_to_pair

    counted = df.groupBy("homicide_type").agg(F.count("*").alias("count"))
    pair = legacy_to_pair(F.col("homicide_type"))
    return counted.select(
        "homicide_type", "count", pair["family"].alias("family"), pair["subtype"].alias("subtype")
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, filled, null and null percent, from one pass."""
    kinds = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    kind = F.create_map(*[F.lit(x) for c in df.columns for x in (c, kinds[c])])
    return counts.unpivot(["_n"], df.columns, "column_name", "non_null").select(
        "column_name",
        F.element_at(kind, F.col("column_name")).alias("dtype"),
        "non_null",
        (F.col("_n") - F.col("non_null")).alias("nulls"),
        F.round((F.col("_n") - F.col("non_null")) * 100.0 / F.col("_n"), 2).alias("null_pct"),
    )


def number_profile(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.percentile(column, F.lit(0.5)).alias("median"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def value_counts(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """n most frequent values of a column."""
    return df.groupBy(F.col(column).alias("value")).count().orderBy(F.col("count").desc(), "value").limit(n)
