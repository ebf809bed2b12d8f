"""Evaluation: binary, field and cluster scores, run comparison, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import fold


def binary_scores(cases: DataFrame, *keys: str) -> DataFrame:
    """Passed, failed, errors, tp/fp/fn, precision, recall, F1, accuracy.

    cases: expected, actual (booleans), error.  Undefined ratios are NULL.
    """
    ok = F.col("error").isNull()
    exp, act = F.col("expected"), F.col("actual")
    base = cases.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(ok & (exp == act)).alias("passed"),
        F.count_if(ok & ~exp.eqNullSafe(act)).alias("failed"),
        F.count_if(~ok).alias("errors"),
        F.count_if(ok & exp & act).alias("tp"),
        F.count_if(ok & ~exp & act).alias("fp"),
        F.count_if(ok & exp & ~act).alias("fn"),
    )
    tp = F.col("tp")
    precision, recall = F.try_divide(tp, tp + F.col("fp")), F.try_divide(tp, tp + F.col("fn"))
    return base.withColumns({"precision": precision, "recall": recall}).withColumns({
        "f1": F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "accuracy": F.try_divide(F.col("passed"), F.col("total")),
    })


def tag_accuracy(cases: DataFrame) -> DataFrame:
    return (
        cases.select(F.explode("tags").alias("tag"), "passed")
        .groupBy("tag")
        .agg(
            F.count("*").alias("total"),
            F.count_if("passed").alias("passed"),
            F.round(F.avg(F.col("passed").cast("int")), 6).alias("accuracy"),
        )
    )


def field_results(expected: DataFrame, actual: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(key, field, matched): normalised, null-safe comparison of every field."""

    def long(df: DataFrame, name: str) -> DataFrame:
        texts = [F.col(f).cast("string").alias(f) for f in fields]
        return df.select(key, *texts).unpivot([key], fields, "field", name)

    def same(a: str, b: str) -> Column:
        folded = fold(F.col(a)).eqNullSafe(fold(F.col(b)))
        return folded & (F.col(a).isNull() == F.col(b).isNull())

    joined = long(expected, "want").join(long(actual, "got"), [key, "field"])
    return joined.select(key, "field", same("want", "got").alias("matched"))


def case_scores(results: DataFrame, key: str = "id") -> DataFrame:
    """Share of matched fields per case; a case passes when all match."""
    return results.groupBy(key).agg(
        F.round(F.avg(F.col("matched").cast("int")), 6).alias("score"), F.bool_and("matched").alias("passed")
    )


def field_accuracy(results: DataFrame) -> DataFrame:
    return results.groupBy("field").agg(
        F.count("*").alias("total"),
        F.count_if("matched").alias("matched"),
        F.round(F.avg(F.col("matched").cast("int")), 6).alias("accuracy"),
    )


def cluster_scores(expected: DataFrame, actual: DataFrame, case: str = "case_id") -> DataFrame:
    """Exact match and pairwise precision, recall, F1 per case.

    Both inputs: (case, member, cluster).  Same-cluster pairs are counted from
    cluster sizes and from the contingency table of the two partitions, so no
    pair is ever listed; a case with no pairs on either side scores 1.
    """
    joined = expected.select(case, "member", F.col("cluster").alias("e")).join(
        actual.select(case, "member", F.col("cluster").alias("a")), [case, "member"], "full_outer"
    )

    def choose2(c: Column) -> Column:
        return (c * (c - 1) / 2).cast("long")

    def pairs(keys: list[str], name: str) -> DataFrame:
        sized = joined.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()).groupBy(case, *keys).count()
        return sized.groupBy(case).agg(F.sum(choose2(F.col("count"))).alias(name), F.count("*").alias(f"{name}_groups"))

    missing = joined.groupBy(case).agg(F.count_if(F.col("e").isNull() | F.col("a").isNull()).alias("_unmatched"))
    table = (
        missing.join(pairs(["e"], "expected_pairs"), case, "left")
        .join(pairs(["a"], "actual_pairs"), case, "left")
        .join(pairs(["e", "a"], "shared_pairs"), case, "left")
        .fillna(0)
    )
    tp, exp, act = F.col("shared_pairs"), F.col("expected_pairs"), F.col("actual_pairs")
    precision = F.when(act > 0, tp / act).when(exp == 0, 1.0).otherwise(0.0)
    recall = F.when(exp > 0, tp / exp).when(act == 0, 1.0).otherwise(0.0)
    same = (F.col("_unmatched") == 0) & (F.col("expected_pairs_groups") == F.col("shared_pairs_groups")) & (
        F.col("actual_pairs_groups") == F.col("shared_pairs_groups")
    )
    return table.select(
        case, same.alias("exact"), "expected_pairs", "actual_pairs", "shared_pairs",
        precision.alias("precision"), recall.alias("recall"),
    ).withColumn(
        "f1", F.coalesce(
            F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)
        )
    )


def compare_runs(base: DataFrame, candidate: DataFrame, key: str = "id") -> DataFrame:
    """(key, change) for cases both runs share: regression, improvement, unchanged."""
    b = base.select(key, F.col("passed").alias("was"))
    c = candidate.select(key, F.col("passed").alias("now"))
    change = (
        F.when(F.col("was") & ~F.col("now"), "regression")
        .when(~F.col("was") & F.col("now"), "improvement")
        .when(F.col("was"), "unchanged_pass")
        .otherwise("unchanged_fail")
    )
    return b.join(c, key).select(key, change.alias("change"))


def score_rollup(scores: DataFrame) -> DataFrame:
    """Passed / total per fixture, per stage and overall, with all-passed flags."""
    return scores.rollup("stage", "fixture").agg(
        F.sum("passed").alias("passed"),
        F.sum("total").alias("total"),
        F.bool_and(F.col("passed") == F.col("total")).alias("all_passed"),
    )


def recovery(results: DataFrame) -> DataFrame:
    """Share of retried failures that now succeed."""
    ok = F.count_if("ok")
    return results.agg(
        F.count("*").alias("total"), ok.alias("recovered"), F.round(F.try_divide(ok, F.count("*")), 6).alias("rate")
    )


def label_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("label_status") == "labeled").alias("labeled"),
        F.count_if(F.col("label_status") == "pending").alias("pending"),
    )


def merge_cases(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Existing cases plus the new ones whose id is not known yet."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))
