"""Event taxonomy expressions: legacy labels, validity, regions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import chain
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook import fixed


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def words_fit(contains: Callable, groups: tuple[tuple[str, ...], ...]):
    """Whether each group has a word that `contains` finds; works on Columns and on booleans."""
    return reduce(and_, [reduce(or_, [contains(word) for word in group]) for group in groups])


def label_pair(label: str) -> tuple[str, str]:
    """(family, subtype) of a legacy flat label given as a filter argument."""
    text = label.strip()
    low = text.lower()
    by_words = (pair for groups, pair in fixed.LABEL_WORD_RULES if words_fit(low.__contains__, groups))
    return fixed.LEGACY_LABELS.get(text) or next(by_words, fixed.UNKNOWN_PAIR)


def legacy_to_pair(label: Column) -> Column:
    """struct(family, subtype) of a legacy flat label: exact first, then by words."""
    text = F.trim(label)
    low = F.lower(text)
    tests = [(text == name, pair) for name, pair in fixed.LEGACY_LABELS.items()]
    tests += [(words_fit(low.contains, groups), pair) for groups, pair in fixed.LABEL_WORD_RULES]

    def struct(pair: tuple[str, str]) -> Column:
        return F.struct(F.lit(pair[0]).alias("family"), F.lit(pair[1]).alias("subtype"))

    return reduce(lambda rest, rule: F.when(rule[0], struct(rule[1])).otherwise(rest), reversed(tests), struct(fixed.UNKNOWN_PAIR))


def pair_to_legacy(family: Column, subtype: Column) -> Column:
    """Flat label of a pair: the legacy label where one exists, else the display label."""
    legacy = {f"{f}:{s}": label for label, (f, s) in fixed.LEGACY_LABELS.items()}
    display = {f"{f}:{s}": pt for f, s, pt, _ in fixed.TAXONOMY_LABELS}
    return F.try_element_at(literal_map({**display, **legacy}), F.concat_ws(":", family, subtype))


def default_subtype(family: Column) -> Column:
    return F.try_element_at(literal_map(fixed.DEFAULT_SUBTYPE), family)


def valid_pair(family: Column, subtype: Column) -> Column:
    pairs = [f"{f}:{s}" for f, subs in fixed.SUBTYPES_BY_FAMILY.items() for s in subs]
    return F.concat(family, F.lit(":"), subtype).isin(pairs)


def portal_subtype(subtype: Column, label: Column) -> Column:
    """Subtype shown on the portal: a valid slug, else read off the label."""
    low = F.lower(label)
    out = F.when(subtype.isin(fixed.HOMICIDE_SUBTYPES), subtype)
    for name, slug in fixed.PORTAL_LABELS.items():
        out = out.when(F.trim(label) == name, slug)
    return (
        out.when(low.contains("feminic"), "feminicidio")
        .when(low.contains("latroc"), "latrocinio")
        .when(low.contains("infantic"), "infanticidio")
        .when(low.contains("interven") | low.contains("policial"), "intervencao_policial")
        .when(low.contains("trânsito") | low.contains("transito"), "morte_transito_doloso")
        .when(low.contains("qualificad"), "qualificado")
        .otherwise("simples")
    )


def region_key(country: Column, value: Column) -> Column:
    """Canonical region: upper-case state code in BR, region name in CL."""
    named = F.try_element_at(literal_map(fixed.CL_REGIONS), value)
    return (
        F.when(country == "BR", F.upper(value))
        .when(country == "CL", F.coalesce(named, value))
        .otherwise(value)
    )


def country_code(country: Column) -> Column:
    """ISO code of a stored country, which may be a name or a code."""
    names = {name.upper(): code for code, name in fixed.COUNTRY_NAMES.items()}
    up = F.upper(F.trim(country))
    return F.coalesce(F.try_element_at(literal_map(names), up), up)


# --- small fixed dimensions ------------------------------------------------------
def label_dim(spark: SparkSession) -> DataFrame:
    """Taxonomy labels: 13 fixed rows."""
    return spark.createDataFrame(
        fixed.TAXONOMY_LABELS, "event_family string, event_subtype string, label_pt string, label_es string"
    )


def region_dim(spark: SparkSession) -> DataFrame:
    """Regions of both countries: 43 fixed rows."""
    rows = [("BR", code, name) for code, name in fixed.BR_STATES.items()]
    rows += [("CL", code, name) for code, name in fixed.CL_REGIONS.items()]
    return spark.createDataFrame(rows, "country string, region_code string, region_name string")
