"""Lists, pages, projections and top-k reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.payload import PUBLIC_FIELDS
from casebook.functions.places import haversine_km, in_bounds, radius_bounds
from casebook.operators import filters

LIST_COLUMNS = [
    "id", "event_family", "event_subtype", "homicide_type", "method_of_death", "event_date",
    "time_of_day", "country", "state", "city", "neighborhood", "victim_count",
    "security_force_involved", "security_force_victim", "title", "source_count",
]


DETAIL_COLUMNS = [
    "id", "event_date", "time_of_day", "country", "state", "city", "neighborhood", "street", "event_family", "event_subtype",
    "homicide_type", "method_of_death", "victim_count", "victims_summary", "perpetrator_count",
    *PUBLIC_FIELDS, "title", "chronological_description", "latitude", "longitude",
    "location_precision", "formatted_address", "merged_data", "source_count", "created_at", "updated_at",
]


def detail(df: DataFrame) -> DataFrame:
    """Public projection of single incidents: what the archive holds of it; a zero coordinate is no coordinate."""
    shown = {c: F.when(F.col(c) != 0, F.col(c).cast("double")) for c in ("latitude", "longitude")}
    return df.select(*[shown.get(c, F.col(c)).alias(c) for c in DETAIL_COLUMNS if c in df.columns])


def map_points(df: DataFrame) -> DataFrame:
    """Flat short-key map projection; decimals become doubles."""
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "id",
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lng"),
        F.col("event_family").alias("f"),
        F.col("event_subtype").alias("su"),
        F.col("homicide_type").alias("t"),
        F.col("method_of_death").alias("m"),
        F.col("event_date").alias("d"),
        F.col("victim_count").alias("v"),
        F.col("security_force_involved").alias("s"),
        F.col("security_force_victim").alias("sv"),
        F.col("city").alias("c"),
        F.col("neighborhood").alias("n"),
        F.col("state").alias("st"),
        F.col("time_of_day").alias("p"),
    )


def admin_map(df: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None, limit: int | None = None) -> DataFrame:
    """Admin map points within a date range, newest first; all of them unless a limit is asked for."""
    rows = df.where(F.col("latitude").isNotNull() & filters.incident_filter(start=start, end=end))
    return (
        first(rows.orderBy(F.col("event_date").desc_nulls_last(), "id"), limit)
        .select("id", "event_date", "homicide_type", "city", "state", "victim_count", "title",
                F.col("latitude").cast("double").alias("latitude"),
                F.col("longitude").cast("double").alias("longitude"))
    )


def first(ordered: DataFrame, n: int | None) -> DataFrame:
    """The first n rows, or all of them."""
    return ordered if n is None else ordered.limit(n)


def export_columns(requested: list[str] | None) -> list[str]:
    """Allowed export columns in the asked order; unknown names are dropped."""
    if not requested:
        return list(fixed.EXPORT_COLUMNS)
    chosen = [c for c in requested if c in fixed.EXPORT_COLUMNS]
    if not chosen:
        raise ValueError("no known export column requested")
    return chosen


def export_rows(df: DataFrame, condition: Column, columns: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Newest rows first, only the chosen columns; all rows unless a cap is asked for.

    Without a cap the sort is by range, so the export is written by many tasks.
    """
    names = [c for c in export_columns(columns) if c in df.columns]

    def shown(name: str) -> Column:
        if name in ("latitude", "longitude"):
            return F.col(name).cast("double").alias(name)
        return F.col(name)

    ordered = df.where(condition).orderBy(F.col("event_date").desc(), F.col("id").desc())
    return first(ordered, cap).select(*[shown(c) for c in names])


def export_truncated(df: DataFrame, condition: Column, cap: int | None = None) -> DataFrame:
    """One row: exported count and whether a cap cut rows off (reads cap + 1)."""
    if cap is None:
        return df.where(condition).agg(F.count("*").alias("exported"), F.lit(False).alias("truncated"))
    probe = df.where(condition).select("id").limit(cap + 1)
    return probe.agg(
        F.least(F.count("*"), F.lit(cap)).alias("exported"), (F.count("*") > cap).alias("truncated")
    )


def page(df: DataFrame, number: int, size: int, order: str = "event_date", columns: list[str] | None = None) -> DataFrame:
    """One page, newest first, undated last, id as the tie-break."""
    ordered = df.orderBy(F.col(order).desc_nulls_last(), F.col("id").desc())
    rows = ordered.offset((number - 1) * size).limit(size)
    return rows.select(*columns) if columns else rows


def page_info(df: DataFrame, size: int) -> DataFrame:
    """Total rows and page count (at least one page)."""
    return df.agg(F.count("*").alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    )


def nearest(df: DataFrame, lat: float, lng: float, radius_km: float, k: int) -> DataFrame:
    """k nearest incidents within a radius: degree box first, exact distance next."""
    lat_c, lng_c = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    distance = haversine_km(F.lit(lat), F.lit(lng), lat_c, lng_c)
    return (
        df.where(in_bounds(F.col("latitude"), F.col("longitude"), radius_bounds(lat, lng, radius_km)))
        .withColumn("distance", distance)
        .where(F.col("distance") <= radius_km)
        .orderBy("distance", "id")
        .limit(k)
    )


def latest_in_view(df: DataFrame, box, k: int = 50) -> DataFrame:
    """Newest incidents in the viewport, undated last."""
    return filters.in_view(df, box).orderBy(F.col("event_date").desc_nulls_last(), "id").limit(k)


def place_search(places: DataFrame, text: str, k: int = 8) -> DataFrame:
    """Places whose label or parent contains the text: cities, states, then districts."""
    q = text.strip().lower()
    rank = F.when(F.col("kind") == "city", 0).when(F.col("kind") == "state", 1).otherwise(2)
    hit = F.lower("label").contains(q) | F.lower("parent").contains(q)
    return (
        places.where(hit)
        .withColumn("rank", rank)
        .orderBy("rank", F.col("n").desc(), "label", "parent")
        .limit(k)
    )


def capped(df: DataFrame, n: int | None = None) -> DataFrame:
    """Rows by id, the first n if asked for."""
    return first(df.orderBy("id"), n)


def first_per_kind(df: DataFrame, kind: str, order: str, n: int = 10) -> DataFrame:
    """First n rows of each kind (a short report list)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(kind).orderBy(order)))
    return ranked.where(F.col("rank") <= n)


def work_queue(df: DataFrame, condition: Column, order: list[Column], n: int | None = None) -> DataFrame:
    """Work items in the stage's order, the next n if asked for."""
    return first(df.where(condition).orderBy(*order), n)


def reclassify_candidates(sources: DataFrame, limit: int | None = None, since: dt.datetime | None = None, signal: str = "all") -> DataFrame:
    """Discarded rows worth another look, newest first, with their target queue.

    All discarded rows are looked at; a limit cuts the result, not the search.
    """
    scope = (F.col("status") == "discarded") & F.col("headline").isNotNull()
    if since is not None:
        scope = scope & (F.col("updated_at") >= filters.ntz(since))
    newest = [F.col("updated_at").desc(), F.col("id")]
    found = sources.where(scope & filters.reclassify_signal(signal)).withColumn("target_status", filters.requeue_target())
    return first(found.orderBy(*newest), limit)


def incident_articles(records: DataFrame, sources: DataFrame, fallback_title: Column | None = None) -> DataFrame:
    """Articles of each incident: distinct linked sources, and a stand-in row for
    records that carry no source id.  A dangling source id yields nothing.
    Rows come in no order; a page of them sorts by incident and date.
    """
    records = records.where(F.col("unique_event_id").isNotNull())
    linked = (
        records.where(F.col("source_google_news_id").isNotNull())
        .select("unique_event_id", F.col("source_google_news_id").alias("id"))
        .distinct()
        .join(
            sources.select("id", "headline", "publisher_name", F.col("resolved_url").alias("url"), "published_at"),
            "id",
        )
        .withColumn("kind", F.lit("source"))
    )
    title = F.col("title") if fallback_title is None else F.coalesce(F.col("title"), fallback_title)
    orphan = records.where(F.col("source_google_news_id").isNull()).select(
        (-F.col("id")).alias("id"),
        "unique_event_id",
        title.alias("headline"),
        F.lit(None).cast("string").alias("publisher_name"),
        F.lit(None).cast("string").alias("url"),
        F.col("event_date").alias("published_at"),
        F.lit("raw_fallback").alias("kind"),
    )
    return linked.unionByName(orphan)
