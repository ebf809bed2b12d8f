"""Registry of the named queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casebook.plans.standins import Archive, with_views
from casebook.session import apply_settings

Builder = Callable[[Archive], DataFrame]

BUILDERS: dict[str, Builder] = {}
CHECKS: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; `sql` is its equivalent over the named stand-in views."""

    def register(build: Builder) -> Builder:
        if name in BUILDERS:
            raise ValueError(f"query {name} registered twice")
        BUILDERS[name] = build
        if sql is not None:
            CHECKS[name] = with_views(sql, *views) if views else sql.strip()
        return build

    return register


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_settings(spark)
        return BUILDERS[name](Archive(spark, folder))

    run.__name__ = name
    return run
