"""Geographic expressions: distance, boxes, grid cells, addresses, geocoder results."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.taxonomy import literal_map

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


@dataclass(frozen=True)
class Bounds:
    south: float
    west: float
    north: float
    east: float

    def padded(self, share: float = 0.25) -> "Bounds":
        dlat = (self.north - self.south) * share
        dlng = (self.east - self.west) * share
        return Bounds(self.south - dlat, self.west - dlng, self.north + dlat, self.east + dlng)


def radius_bounds(lat: float, lng: float, radius_km: float) -> Bounds:
    """Degree box that encloses a radius; the cosine is kept away from zero."""
    dlat = radius_km / KM_PER_DEGREE
    dlng = radius_km / (KM_PER_DEGREE * max(math.cos(math.radians(lat)), 0.01))
    return Bounds(lat - dlat, lng - dlng, lat + dlat, lng + dlng)


def in_bounds(lat: Column, lng: Column, box: Bounds) -> Column:
    return lat.between(box.south, box.north) & lng.between(box.west, box.east)


def grid_resolution(zoom: Column) -> Column:
    return F.when(zoom < 5, 4).when(zoom < 7, 5).when(zoom < 9, 6).otherwise(7)


def grid_cell(lat: Column, lng: Column, resolution: int) -> Column:
    """Fixed global cell 'r:row:col'; each resolution step halves the cell edge.

    Resolution 4 has cells of half a degree, 7 of a sixteenth.  Any other cell
    column can be passed to the density aggregate instead.
    """
    per_degree = 2.0 ** (resolution - 3)
    row = F.floor((lat + 90.0) * per_degree).cast("int")
    col = F.floor((lng + 180.0) * per_degree).cast("int")
    return F.concat_ws(":", F.lit(resolution), row, col)


def plus_code(lat: Column, lng: Column) -> Column:
    """Ten-digit Open Location Code.

    Works on integer counts of the finest cell (1/8000 degree), so no rounding
    error builds up from digit to digit.
    """
    steps = [160_000, 8_000, 400, 20, 1]
    alphabet = F.lit(fixed.PLUS_ALPHABET)
    lat_c = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat.cast("double")))
    lat_n = F.least(F.floor((lat_c + 90.0) * 8000 + 1e-6), F.lit(180 * 8000 - 1)).cast("long")
    lng_n = F.pmod(F.floor((lng.cast("double") + 180.0) * 8000 + 1e-6).cast("long"), F.lit(360 * 8000))

    def digit(n: Column, step: int) -> Column:
        place = F.pmod(F.floor(n / F.lit(step)), F.lit(20)).cast("int")
        return F.substring(alphabet, place + 1, F.lit(1))

    pairs = [F.concat(digit(lat_n, s), digit(lng_n, s)) for s in steps]
    return F.concat(*pairs[:4], F.lit("+"), pairs[4])


# --- addresses and geocoder results -------------------------------------------------
def input_precision(establishment: Column, street: Column, neighborhood: Column) -> Column:
    """Finest precision the known address parts support."""

    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) != ""

    return (
        F.when(filled(establishment) | filled(street), "aproximado")
        .when(filled(neighborhood), "centro do bairro")
        .otherwise("centro da cidade")
    )


def address_query(
    establishment: Column, street: Column, neighborhood: Column, city: Column, state: Column, country: Column
) -> Column:
    """Comma-joined address; NULL without a city."""
    parts = [F.nullif(p, F.lit("")) for p in (establishment, street, neighborhood, city, state)]
    parts.append(F.coalesce(F.nullif(country, F.lit("")), F.lit("Brasil")))
    return F.when(F.coalesce(city, F.lit("")) != "", F.concat_ws(", ", *parts))


def result_precision(types: Column, location_type: Column) -> Column:
    """Precision of a geocoder result from its place types and location type."""

    def any_type(*names: str) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))

    coarse = any_type("locality", "administrative_area_level_2", "administrative_area_level_1", "political")
    fine = any_type("street_address", "premise", "route", "neighborhood", "sublocality")
    return (
        F.when(coarse & ~fine, "centro da cidade")
        .when(any_type("neighborhood", "sublocality", "sublocality_level_1"), "centro do bairro")
        .when(
            any_type("street_address", "premise", "establishment", "point_of_interest")
            | (location_type == "ROOFTOP"),
            "exato",
        )
        .when(any_type("route") | location_type.isin("RANGE_INTERPOLATED", "GEOMETRIC_CENTER"), "aproximado")
        .otherwise("centro da cidade")
    )


def coarser(a: Column, b: Column) -> Column:
    order = F.array(*[F.lit(p) for p in fixed.PRECISION_ORDER])
    return F.element_at(order, F.greatest(F.array_position(order, a), F.array_position(order, b)).cast("int"))


def location_confidence(location_type: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fixed.LOCATION_CONFIDENCE), location_type), F.lit(0.4))


def zoom_for_types(types: Column) -> Column:
    def any_type(*names: str) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))

    return (
        F.when(any_type("country"), 3.6)
        .when(any_type("administrative_area_level_1"), 6.5)
        .when(any_type("locality", "administrative_area_level_2", "administrative_area_level_3"), 11.0)
        .when(
            any_type("route", "neighborhood", "sublocality", "street_address", "premise", "postal_code"), 13.0
        )
        .otherwise(11.0)
    )


GEOCODER_SCHEMA = (
    "types array<string>, geometry struct<location:struct<lat:double,lng:double>, location_type:string>, "
    "plus_code struct<global_code:string>, place_id string, formatted_address string"
)


def geocode_fields(result: Column, granularity: Column) -> Column:
    """Geolocation columns of one geocoder result (JSON text)."""
    r = F.from_json(result, GEOCODER_SCHEMA)
    types = F.coalesce(r["types"], F.array().cast("array<string>"))
    kind = F.coalesce(r["geometry"]["location_type"], F.lit(""))
    lat, lng = r["geometry"]["location"]["lat"], r["geometry"]["location"]["lng"]
    code = F.nullif(r["plus_code"]["global_code"], F.lit(""))
    return F.struct(
        lat.cast("decimal(10,8)").alias("latitude"),
        lng.cast("decimal(11,8)").alias("longitude"),
        F.coalesce(code, plus_code(lat, lng)).alias("plus_code"),
        r["place_id"].alias("place_id"),
        r["formatted_address"].alias("formatted_address"),
        coarser(result_precision(types, kind), granularity).alias("location_precision"),
        F.lit("google_maps").alias("geocoding_source"),
        location_confidence(kind).alias("geocoding_confidence"),
        zoom_for_types(types).alias("zoom"),
    )


def postal_code(c: Column) -> Column:
    """'00000-000' form of an eight-digit code, else NULL."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 8, F.concat(F.substring(digits, 1, 5), F.lit("-"), F.substring(digits, 6, 3)))


def geocode_cache_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
