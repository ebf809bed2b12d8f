"""Rule checks that return violation tables, table reconciliation, typed copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.dates import parse_timestamp
from casebook.functions.payload import violations


def record_violations(records: DataFrame, record: Column, key: str = "id") -> DataFrame:
    """(key, rule, message) for every rule a nested record breaks."""
    return records.select(key, F.explode(violations(record)).alias("v")).select(key, "v.rule", "v.message")


def table_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every named condition a row meets."""
    found = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]), lambda r: r.isNotNull())
    return df.select(F.col(key).alias("key"), F.explode(found).alias("rule"))


def fixture_violations(cases: DataFrame) -> DataFrame:
    """Label-file checks: duplicate ids, empty headline, label and status at odds.

    cases: id, headline, label_status, expected.  Duplicates are found by a
    grouped count, which combines map-side.
    """
    rows = table_violations(cases, "id", {
        "empty_headline": F.trim(F.coalesce("headline", F.lit(""))) == "",
        "labeled_without_expected": (F.col("label_status") == "labeled") & F.col("expected").isNull(),
        "pending_with_expected": (F.col("label_status") == "pending") & F.col("expected").isNotNull(),
    })
    repeated = cases.groupBy("id").count().where(F.col("count") > 1)
    return rows.unionByName(repeated.select(F.col("id").alias("key"), F.lit("duplicate_id").alias("rule")))


def expected_in_candidates(cases: DataFrame) -> DataFrame:
    """Match cases whose expected incident is not among their candidates."""
    bad = F.col("match") & ~F.array_contains("candidate_ids", F.col("expected_id"))
    return cases.where(F.coalesce(bad, F.lit(False))).select("id", F.lit("expected_not_candidate").alias("rule"))


def partition_violations(cases: DataFrame) -> DataFrame:
    """Cluster cases whose clusters do not partition 1..n.  cases: id, n, clusters."""
    members = F.array_sort(F.flatten("clusters"))
    whole = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    return cases.where(members != whole).select("id", F.lit("not_a_partition").alias("rule"))


# --- typed copy -----------------------------------------------------------------------
def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns to their declared types; a value that does not fit becomes NULL."""

    def cast(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("timestamp"):
            return F.coalesce(parse_timestamp(c.cast("string")), c.cast("string").try_cast("timestamp")).cast(kind)
        if kind == "boolean":
            low = F.lower(F.trim(c.cast("string")))
            return F.when(low.isin("1", "true", "t", "yes"), True).when(low.isin("0", "false", "f", "no"), False)
        if kind == "json":
            return F.when(F.try_parse_json(c).isNotNull(), c)
        return c.try_cast(kind)

    return df.select(*[cast(c, types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def table_totals(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(table, rows, max_id) of each table."""
    parts = [
        df.agg(F.count("*").alias("rows"), F.max(key).cast("long").alias("max_id")).select(F.lit(name).alias("table"), "rows", "max_id")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts and highest ids of both sides, and whether they agree."""
    s = source.withColumnsRenamed({"rows": "source_rows", "max_id": "source_max_id"})
    t = target.withColumnsRenamed({"rows": "target_rows", "max_id": "target_max_id"})
    agree = F.col("source_rows").eqNullSafe(F.col("target_rows")) & F.col("source_max_id").eqNullSafe(F.col("target_max_id"))
    return s.join(t, "table", "full_outer").withColumn("agree", agree)
