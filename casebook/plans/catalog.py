"""All named queries: importing the catalog modules registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casebook.plans import catalog_link, catalog_more, catalog_ops, catalog_read, catalog_text  # noqa: F401
from casebook.plans.registry import BUILDERS, CHECKS, runnable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runnable(name) for name in BUILDERS}


def oracle_sql() -> dict[str, str]:
    return dict(CHECKS)
