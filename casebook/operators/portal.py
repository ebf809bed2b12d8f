"""Portal aggregates: one-pass facets, gazetteer, density grid, trends."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.dates import period_key, period_rank, week_key
from casebook.functions.places import Bounds, grid_cell
from casebook.functions.taxonomy import portal_subtype
from casebook.operators import filters
from casebook.operators.filters import Facets


def shown_subtype() -> Column:
    return portal_subtype(F.col("event_subtype"), F.col("homicide_type"))


def viewport_stats(df: DataFrame) -> DataFrame:
    """Counts and victims by subtype, method, state, city, period, week and month.

    Each row fans out to its facet values and is combined map-side, so only the
    distinct facet values are shuffled.  A slain officer adds one more subtype key.
    """
    day = F.col("event_date")

    def facet(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("facet"), value.cast("string").alias("key"))

    officer = F.when(F.col("security_force_victim"), F.lit(fixed.SLAIN_OFFICER_KEY))
    entries = F.array(
        facet("total", F.lit("all")),
        facet("subtype", shown_subtype()),
        facet("subtype", officer),
        facet("method", F.nullif("method_of_death", F.lit(""))),
        facet("state", F.nullif("state", F.lit(""))),
        facet("city", F.nullif("city", F.lit(""))),
        facet("period", F.nullif("time_of_day", F.lit(""))),
        facet("week", F.date_format(week_key(day), "yyyy-MM-dd")),
        facet("month", F.date_format(day, "yyyy-MM")),
    )
    return (
        df.select(F.explode(entries).alias("e"), F.coalesce("victim_count", F.lit(0)).alias("v"))
        .where(F.col("e.key").isNotNull())
        .groupBy("e.facet", "e.key")
        .agg(F.count("*").alias("incidents"), F.sum("v").alias("victims"))
    )


def cross_filtered(df: DataFrame, facets: Facets, box: Bounds | None) -> DataFrame:
    """Option counts of every facet with that facet's own filter released.

    All facets come from one scan: each row carries only the facet entries whose
    remaining filters it passes.
    """
    columns = {
        "types": shown_subtype(), "methods": F.col("method_of_death"), "states": F.col("state"),
        "cities": F.col("city"), "periods": period_key(F.col("time_of_day")),
    }
    entries = F.array(*[
        F.when(
            facets.without(group).condition(),
            F.struct(F.lit(group).alias("facet"), value.cast("string").alias("key")),
        )
        for group, value in columns.items()
    ])
    return (
        filters.in_view(df, box)
        .select(F.explode(entries).alias("e"))
        .where(F.col("e.key").isNotNull())
        .groupBy("e.facet", "e.key")
        .agg(F.count("*").alias("incidents"))
    )


def density_grid(df: DataFrame, resolution: int, cell: Column | None = None) -> DataFrame:
    """Victims per grid cell; an unknown count weighs one."""
    lat, lng = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    key = grid_cell(lat, lng, resolution) if cell is None else cell
    return (
        df.where(lat.isNotNull() & lng.isNotNull())
        .groupBy(key.alias("cell"))
        .agg(F.sum(F.coalesce("victim_count", F.lit(1))).alias("weight"))
    )


def peak_cell(grid: DataFrame) -> DataFrame:
    return grid.agg(F.coalesce(F.max("weight"), F.lit(0)).alias("peak"))


def centroids(df: DataFrame, key: str) -> DataFrame:
    """Mean point of each state or city."""
    return (
        df.where(F.col(key).isNotNull() & F.col("latitude").isNotNull())
        .groupBy(key)
        .agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng"), F.count("*").alias("n"))
    )


def gazetteer(df: DataFrame) -> DataFrame:
    """Cities, states and districts with centroid and count, in one aggregation."""

    def place(kind: str, label: str, parent: str | None, needs: list[str]) -> Column:
        known = F.lit(True)
        for c in needs:
            known = known & (F.coalesce(F.col(c), F.lit("")) != "")
        parent_c = F.col(parent) if parent else F.col(label)
        return F.when(
            known, F.struct(F.lit(kind).alias("kind"), F.col(label).alias("label"), parent_c.alias("parent"))
        )

    places = F.array(
        place("city", "city", "state", ["city", "state"]),
        place("state", "state", None, ["state"]),
        place("district", "neighborhood", "city", ["neighborhood", "city"]),
    )
    return (
        df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select(F.explode(places).alias("p"), "latitude", "longitude")
        .where(F.col("p").isNotNull())
        .groupBy("p.kind", "p.label", "p.parent")
        .agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lng"), F.count("*").alias("n"))
    )


def weekly_trend(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Victims per Monday week over an inclusive range, empty weeks included."""
    day = F.to_date("event_date")
    first = start - dt.timedelta(days=start.weekday())
    last = end - dt.timedelta(days=end.weekday())
    weekly = (
        df.where(day.between(F.lit(start), F.lit(end)))
        .groupBy(week_key(F.col("event_date")).alias("week"))
        .agg(F.sum(F.coalesce("victim_count", F.lit(0))).alias("victims"))
    )
    calendar = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days"))).alias("week")
    )
    return calendar.join(weekly, "week", "left").select(
        "week", F.coalesce("victims", F.lit(0)).cast("long").alias("victims")
    )


def trailing_months(df: DataFrame, as_of: dt.date, months: int = 12) -> DataFrame:
    """Victims per month for the months ending at the latest one present (or as_of)."""
    monthly = (
        df.where(F.col("event_date").isNotNull())
        .groupBy(F.to_date(F.date_trunc("month", "event_date")).alias("month"))
        .agg(F.sum(F.coalesce("victim_count", F.lit(0))).alias("victims"))
    )
    latest = F.greatest(F.lit(as_of.replace(day=1)), F.max("month"))
    calendar = monthly.agg(latest.alias("m")).select(
        F.explode(
            F.sequence(F.add_months("m", 1 - months), F.col("m"), F.expr("interval 1 month"))
        ).alias("month")
    )
    return calendar.join(monthly, "month", "left").select(
        "month", F.coalesce("victims", F.lit(0)).cast("long").alias("victims")
    )


def last_day(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Incidents and victims of the last 24 hours."""
    return df.where(filters.last_hours(F.col("event_date"), as_of)).agg(
        F.count("*").alias("total"), F.coalesce(F.sum("victim_count"), F.lit(0)).alias("victims")
    )


def filter_values(df: DataFrame) -> DataFrame:
    """Distinct methods, day periods and subtypes with their display rank."""
    subtype_order = F.array(*[F.lit(s) for s in fixed.HOMICIDE_SUBTYPES])
    subtype = shown_subtype()
    period = period_key(F.col("time_of_day"))

    def option(group: str, value: Column, rank: Column) -> Column:
        return F.when(
            F.coalesce(value, F.lit("")) != "",
            F.struct(F.lit(group).alias("facet"), value.alias("value"), rank.cast("int").alias("rank")),
        )

    options = F.array(
        option("method", F.col("method_of_death"), F.lit(0)),
        option("period", period, period_rank(period)),
        option("subtype", subtype, F.array_position(subtype_order, subtype)),
    )
    return df.select(F.explode(options).alias("o")).where(F.col("o").isNotNull()).select("o.*").distinct()
