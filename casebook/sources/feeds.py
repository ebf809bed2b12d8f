"""News feeds: query plans, entry normalisation and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed, schemas
from casebook.functions.text import split_headline
from casebook.operators.ranking import first_wins


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Raw feed entries, one JSON object per line."""
    return spark.read.schema(schemas.FEED_ENTRY).json(path)


def publisher_dim(spark: SparkSession) -> DataFrame:
    """Outlets used to shard a crowded city's query: 37 fixed rows."""
    rows = [("BR", p) for p in fixed.BR_PUBLISHERS] + [("CL", p) for p in fixed.CL_PUBLISHERS]
    return spark.createDataFrame(rows, "country string, publisher string")


def query_plan(cities: DataFrame, publishers: DataFrame, window: str = fixed.FEED_WINDOW) -> DataFrame:
    """One query per city, or one per outlet of its country for sharded cities.

    cities: city, country, needs_sharding.
    """
    base = F.concat_ws(" ", "city", F.lit(f"when:{window}"))
    plain = cities.where(~F.coalesce("needs_sharding", F.lit(False))).select("city", "country", base.alias("query"))
    sharded = (
        cities.where("needs_sharding").join(publishers, "country")
        .select("city", "country", F.concat(base, F.lit(" site:"), F.col("publisher")).alias("query"))
    )
    return plain.unionByName(sharded).withColumn("url", feed_url(F.col("query"), F.col("country")))


def feed_url(query: Column, country: Column) -> Column:
    """Feed URL of a query; ':' stays readable, the country sets the edition."""
    encoded = F.regexp_replace(F.url_encode(query), "%3A", ":")
    tail = F.when(country == "CL", fixed.FEED_PARAMS["CL"]).otherwise(fixed.FEED_PARAMS["BR"])
    return F.concat(F.lit(fixed.FEED_BASE_URL + "?q="), encoded, tail)


def normalise(entries: DataFrame) -> DataFrame:
    """Source rows of raw feed entries; entries without any id drop out."""
    title = split_headline(F.col("title"))
    return entries.where(F.coalesce("id", "link").isNotNull()).select(
        F.coalesce("id", "link").alias("google_news_id"),
        F.col("link").alias("google_news_url"),
        title["headline"].alias("headline"),
        title["publisher"].alias("publisher_name"),
        F.col("source.href").alias("publisher_url"),
        F.col("published").alias("published_at"),
        F.col("_search_query").alias("search_query"),
        F.col("_city").alias("city"),
        F.coalesce("_country", F.lit("BR")).alias("country"),
        F.lit("ready_for_classification").alias("status"),
    )


def new_entries(batch: DataFrame, known: DataFrame, arrival: list[Column], id_col: str = "google_news_id", url_col: str = "resolved_url") -> DataFrame:
    """Entries whose id and resolved URL are new, the first of the batch per id and
    per URL.  NULL URLs never collide."""
    fresh = batch.join(known.select(id_col).distinct(), id_col, "left_anti")
    fresh = fresh.join(known.select(url_col).where(F.col(url_col).isNotNull()).distinct(), url_col, "left_anti")
    once = first_wins(fresh.select(*batch.columns), [id_col], arrival)
    return first_wins(once, [url_col], arrival)


def union_countries(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
