"""Anomaly detectors over the archive, their roll-up and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.text import death_keyword
from casebook.operators.components import connected_components
from casebook.operators.ranking import best_per_key


def _newest(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The report's newest rows; without a limit the whole list."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def classification_anomalies(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Discarded positives, progressed negatives, discarded death-keyword headlines.

    One signal per source: a row that fits several takes the first.
    """
    discarded = F.col("status") == "discarded"
    stored = F.col("is_violent_death")
    keyword = death_keyword(F.col("headline"), fixed.EVAL_DEATH_KEYWORDS)
    signal = (
        F.when(discarded & stored, "false_negative")
        .when(F.col("status").isin(fixed.POSITIVE_STATUSES) & ~stored, "false_positive")
        .when(discarded & keyword, "death_keyword_discarded")
    )
    rows = sources.where(F.col("headline").isNotNull()).withColumn("signal", signal).where(F.col("signal").isNotNull())
    return _newest(rows, limit, F.col("updated_at").desc(), F.col("id")).select(
        F.lit("classification").alias("stage"), "id", "signal", "status", "is_violent_death", "headline"
    )


def gate_anomalies(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles with text that were discarded though positive, or extracted though negative."""
    stored = F.col("is_violent_death")
    signal = (
        F.when((F.col("status") == "discarded") & stored, "gate_false_negative")
        .when((F.col("status") == "extracted") & ~stored, "gate_false_positive")
    )
    rows = sources.where(F.length("content") > 500).withColumn("signal", signal).where(F.col("signal").isNotNull())
    return _newest(rows, limit, F.col("updated_at").desc(), F.col("id")).select(
        F.lit("content-gate").alias("stage"), "id", "signal", "status", "is_violent_death",
        F.length("content").alias("content_length"),
    )


def extraction_anomalies(records: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Failed extractions although the article has text."""
    failed = records.where(~F.coalesce("extraction_success", F.lit(False))).select(
        F.col("id").alias("raw_event_id"), F.col("source_google_news_id").alias("id"), "title"
    )
    articles = sources.where(F.length("content") > 300).select("id", "headline", F.length("content").alias("content_length"))
    joined = failed.join(articles, "id")
    return _newest(joined, limit, F.col("raw_event_id").desc()).select(
        F.lit("extraction").alias("stage"), F.col("raw_event_id").alias("id"), F.lit("extraction_failed").alias("signal"),
        F.col("id").alias("source_id"), F.coalesce("title", "headline").alias("title"), "content_length",
    )


def matched_with_sibling(records: DataFrame, members: DataFrame) -> DataFrame:
    """Matched records whose incident has near-duplicate siblings: record, incident,
    sibling count and the suggested survivor."""
    groups = members.where(F.col("size") > 1).select(
        F.col("id").alias("unique_event_id"), "group_id", "survivor_id", (F.col("size") - 1).alias("siblings")
    )
    matched = records.where(
        (F.col("deduplication_status") == "matched") & F.col("city").isNotNull() & F.col("event_date").isNotNull()
    )
    return matched.join(groups, "unique_event_id").select(
        F.col("id").alias("raw_id"), "unique_event_id", "group_id", "siblings", "survivor_id"
    )


def sibling_rows(flagged: DataFrame, members: DataFrame) -> DataFrame:
    """The siblings themselves, one row each."""
    others = members.select("group_id", F.col("id").alias("sibling_id"))
    return flagged.select("raw_id", "unique_event_id", "group_id").join(others, "group_id").where(
        F.col("sibling_id") != F.col("unique_event_id")
    )


def stale_enrichment(incidents: DataFrame, limit: int | None = None) -> DataFrame:
    rows = incidents.where(F.col("needs_enrichment") & (F.col("source_count") > 0))
    return _newest(rows, limit, F.col("id").desc()).select(
        F.lit("enrichment").alias("stage"), "id", F.lit("needs_enrichment_stale").alias("signal"), "source_count"
    )


def field_mismatch(incidents: DataFrame, records: DataFrame) -> DataFrame:
    """Multi-source incidents disagreeing with a linked record on city or count;
    one row per incident, with its lowest disagreeing record."""
    u = incidents.where(F.col("source_count") > 1).select(
        F.col("id").alias("unique_event_id"), F.col("city").alias("ue_city"), F.col("victim_count").alias("ue_count")
    )
    r = records.select("unique_event_id", F.col("id").alias("raw_id"), "city", "victim_count")
    differs = (F.lower("ue_city") != F.lower("city")) | (F.col("ue_count") != F.col("victim_count"))
    pairs = u.join(r, "unique_event_id").where(F.coalesce(differs, F.lit(False)))
    return best_per_key(pairs, ["unique_event_id"], [-F.col("raw_id")]).select(
        F.lit("enrichment").alias("stage"), F.col("unique_event_id").alias("id"),
        F.lit("field_mismatch").alias("signal"), "raw_id",
    )


def first_signal_wins(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of anomaly lists; a key found twice keeps the earlier list's row."""
    merged = None
    for rank, part in enumerate(parts):
        tagged = part.select("stage", key, "signal", F.lit(rank).alias("_rank"))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return best_per_key(merged, [key], [-F.col("_rank")], ["stage", key, "signal"])


def rollup(anomalies: DataFrame, verified: DataFrame | None = None, examples: int = 3) -> DataFrame:
    """Totals, verified share and first example ids per (stage, signal, sub-signal).

    anomalies: stage, signal, sub_signal, id, priority.  Examples come from a
    group limit, so no cluster is gathered.
    """
    from pyspark.sql import Window

    keys = ["stage", "signal", "sub_signal"]
    flagged = anomalies if verified is None else anomalies.join(verified.select("stage", "id", "verified"), ["stage", "id"], "left")
    ok = F.lit(False) if verified is None else F.coalesce("verified", F.lit(False))
    totals = flagged.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("verified"),
        F.count_distinct("id").alias("ids"),
        F.min("priority").alias("priority"),
    )
    first = (
        anomalies.select(*keys, "id", F.row_number().over(Window.partitionBy(*keys).orderBy("id")).alias("_r"))
        .where(F.col("_r") <= examples)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("id")).alias("examples"))
    )
    return totals.join(first, keys)


def affected_incidents(pairs: DataFrame) -> DataFrame:
    """Incidents behind pair anomalies: components per (city, day) with pair count,
    member count and the lowest id.  pairs: id_a, id_b, city, event_date."""
    found = connected_components(pairs)
    placed = pairs.join(found.withColumnRenamed("id", "id_a"), "id_a")
    day = F.coalesce(F.substring(F.col("event_date").cast("string"), 1, 10), F.lit("?"))
    keys = [F.coalesce("city", F.lit("?")).alias("city"), day.alias("day"), "component"]
    counted = placed.groupBy(*keys).agg(F.count("*").alias("pairs"))
    sizes = found.groupBy("component").agg(F.count("*").alias("incidents"))
    return counted.join(sizes, "component")


def priority_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).when(c == "low", 2).otherwise(9)


def verify(anomalies: DataFrame, reruns: DataFrame) -> DataFrame:
    """Does a re-run of the model confirm the anomaly?

    reruns: stage, id, positive (label), passes (article gate).
    """
    signal = F.col("signal")
    positive, passes = F.col("positive"), F.col("passes")
    confirmed = (
        F.when(signal == "false_negative", positive)
        .when(signal == "false_positive", ~positive)
        .when(signal == "death_keyword_discarded", positive)
        .when(signal == "gate_false_negative", passes)
        .when(signal == "gate_false_positive", ~passes)
    )
    return anomalies.join(reruns, ["stage", "id"]).select(
        "stage", "id", "signal", F.coalesce(confirmed, F.lit(False)).alias("verified")
    )
