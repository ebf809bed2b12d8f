"""Attach geocoding results: each distinct address is resolved once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.places import address_query, geocode_fields, input_precision


def address_keys(incidents: DataFrame) -> DataFrame:
    """Incidents with their address query and the precision it supports."""
    c = F.col
    return incidents.withColumns({
        "query": address_query(
            c("establishment"), c("street"), c("neighborhood"), c("city"), c("state"), c("country")
        ),
        "granularity": input_precision(c("establishment"), c("street"), c("neighborhood")),
    })


def pending_addresses(keyed: DataFrame) -> DataFrame:
    """Distinct addresses still to be resolved."""
    return keyed.where(F.col("query").isNotNull()).select("query", "granularity").distinct()


def parse_responses(responses: DataFrame) -> DataFrame:
    """Geocoder JSON per (query, granularity) to geolocation columns."""
    parsed = responses.withColumn("g", geocode_fields(F.col("response"), F.col("granularity")))
    return parsed.select("query", "granularity", "g.*")


def attach(keyed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Join results back; an address without a result is marked 'none'.

    `resolved` is keyed by (query, granularity).  The join side is left to the
    optimizer: a response table grows with the archive.
    """
    out = keyed.join(resolved, ["query", "granularity"], "left")
    source: Column = F.coalesce("geocoding_source", F.lit("none"))
    return out.withColumn("geocoding_source", source)
