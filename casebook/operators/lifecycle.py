"""Lifecycle transitions and backfill jobs, as columns over snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.dates import ntz
from casebook.functions.failures import extraction_reason, is_transient
from casebook.functions.taxonomy import legacy_to_pair, literal_map, pair_to_legacy
from casebook.functions.text import (
    article_rule, article_text, class_reason, override_label, rule_snippet, usable_article,
)
from casebook.operators.filters import requeue_target
from casebook.operators.ranking import preferred_per_key


def is_stuck(as_of: dt.datetime, minutes: int = fixed.STUCK_MINUTES) -> Column:
    cutoff = ntz(as_of - dt.timedelta(minutes=minutes))
    return F.col("status").isin(list(fixed.STUCK_RETURNS)) & (F.col("updated_at") < cutoff)


def recover_stuck(sources: DataFrame, as_of: dt.datetime, minutes: int = fixed.STUCK_MINUTES) -> tuple[DataFrame, DataFrame]:
    """(sources with stuck rows back in their queue, recovered count per status)."""
    stuck = F.coalesce(is_stuck(as_of, minutes), F.lit(False))
    counts = sources.where(stuck).groupBy("status").count()
    back = F.element_at(literal_map(fixed.STUCK_RETURNS), F.col("status"))
    return sources.withColumn("status", F.when(stuck, back).otherwise(F.col("status"))), counts


FAILED_STAGES = {
    "failed_in_download": ("download", "ready_for_download"),
    "failed_in_extraction": ("extraction", "ready_for_extraction"),
}


def attempt_state(attempts: DataFrame) -> DataFrame:
    """Latest failure reason and number of attempts per (source, stage)."""
    return attempts.groupBy("source_google_news_id", "stage").agg(
        F.max_by("failure_reason", F.struct("created_at", "id")).alias("last_reason"),
        F.count("*").alias("attempts"),
    )


def retryable(sources: DataFrame, attempts: DataFrame, max_attempts: int = fixed.RETRY_MAX_ATTEMPTS) -> DataFrame:
    """Failed sources whose latest attempt was transient and within budget."""
    stage = F.create_map(*[F.lit(x) for s, (st, _) in FAILED_STAGES.items() for x in (s, st)])
    failed = sources.where(F.col("status").isin(list(FAILED_STAGES))).select(
        F.col("id").alias("source_google_news_id"), "status", F.element_at(stage, F.col("status")).alias("stage")
    )
    state = attempt_state(attempts)
    return failed.join(state, ["source_google_news_id", "stage"]).where(
        is_transient(F.col("last_reason")) & (F.col("attempts") < max_attempts)
    )


def requeue_failures(sources: DataFrame, attempts: DataFrame, max_attempts: int = fixed.RETRY_MAX_ATTEMPTS) -> DataFrame:
    picked = retryable(sources, attempts, max_attempts).select(F.col("source_google_news_id").alias("id"), F.lit(True).alias("_hit"))
    queue = F.create_map(*[F.lit(x) for s, (_, q) in FAILED_STAGES.items() for x in (s, q)])
    joined = sources.join(picked, "id", "left")
    return joined.withColumn(
        "status", F.when(F.col("_hit"), F.element_at(queue, F.col("status"))).otherwise(F.col("status"))
    ).select(*sources.columns)


def requeue_discarded(sources: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with the chosen discarded rows requeued, count per target queue).

    Classification columns of requeued rows are cleared.
    """
    joined = sources.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "discarded")
    joined = joined.withColumn("_hit", hit).withColumn("_target", requeue_target())
    audit = joined.where("_hit").groupBy(F.col("_target").alias("target_status")).count()
    updates = {"status": F.when(F.col("_hit"), F.col("_target")).otherwise(F.col("status"))}
    for c in ("is_violent_death", "classification_confidence", "classification_reasoning"):
        if c in sources.columns:
            updates[c] = F.when(~F.col("_hit"), F.col(c))
    return joined.withColumns(updates).select(*sources.columns), audit


def taxonomy_backfill(df: DataFrame) -> DataFrame:
    """Fill missing family, subtype and label from the legacy label."""
    missing = F.coalesce("event_family", F.lit("")) == ""
    pair = legacy_to_pair(F.col("homicide_type"))
    return df.withColumns({
        "event_family": F.when(missing, pair["family"]).otherwise(F.col("event_family")),
        "event_subtype": F.when(missing, pair["subtype"]).otherwise(F.col("event_subtype")),
        "homicide_type": F.when(missing, pair_to_legacy(pair["family"], pair["subtype"])).otherwise(F.col("homicide_type")),
    })


def flag_enrichment(incidents: DataFrame, condition: Column) -> DataFrame:
    return incidents.withColumn(
        "needs_enrichment", F.when(condition, F.lit(True)).otherwise(F.col("needs_enrichment"))
    )


def clear_geocode(incidents: DataFrame, condition: Column) -> DataFrame:
    """Empty the geocoding block so the rows are geocoded again."""
    kinds = {f.name: f.dataType for f in incidents.schema}
    return incidents.withColumns({
        c: F.when(condition, F.lit(None).cast(kinds[c])).otherwise(F.col(c))
        for c in fixed.GEOCODE_COLUMNS if c in incidents.columns
    })


# --- stage transitions: model outputs come as prediction tables ------------------------
def classify(sources: DataFrame, predictions: DataFrame) -> DataFrame:
    """Status, label and reason after headline classification.

    predictions: id, is_violent_death, is_single_incident, confidence, reasoning,
    content_class_hint.  No headline discards; no prediction goes back to the queue.
    """
    p = predictions.select("id", F.struct(*[c for c in predictions.columns if c != "id"]).alias("p"))
    corrected = override_label(F.col("headline"), F.col("p.is_violent_death"), F.col("p.confidence"), F.col("p.reasoning"))
    joined = sources.join(p, "id", "left").withColumn("c", corrected)
    label, single = F.col("c.is_violent_death"), F.col("p.is_single_incident")
    hint = F.coalesce("p.content_class_hint", F.lit("non-incident"))
    noted = F.concat(F.col("c.reason"), F.lit(" [single_incident=false, hint="), hint, F.lit("]"))
    no_headline = F.coalesce("headline", F.lit("")) == ""
    failed = F.col("p").isNull()
    return joined.select(
        "id",
        F.when(no_headline, "discarded")
        .when(failed, "ready_for_classification")
        .when(label & single, "ready_for_download")
        .otherwise("discarded").alias("status"),
        F.when(~no_headline, label).alias("is_violent_death"),
        F.when(~no_headline, F.col("c.confidence")).alias("classification_confidence"),
        F.when(~no_headline, F.when(label & ~single, noted).otherwise(F.col("c.reason"))).alias("classification_reasoning"),
    )


def content_gate(articles: DataFrame, predictions: DataFrame, rules: list = fixed.ARTICLE_RULES) -> DataFrame:
    """Outcome of the article gate: a rule discards first, then a model rejection;
    a missing prediction lets the article through.

    Returns id, status, outcome, failure_reason, reasoning.
    """
    text = article_text(F.col("headline"), F.col("content"))
    p = predictions.select("id", F.struct(*[c for c in predictions.columns if c != "id"]).alias("p"))
    joined = articles.withColumn("rule", article_rule(text, rules)).join(p, "id", "left")
    ruled = F.col("rule").isNotNull()
    passes = F.col("p.is_violent_death") & F.col("p.is_single_incident")
    rejected = ~ruled & F.col("p").isNotNull() & ~F.coalesce(passes, F.lit(False))
    detail = rule_snippet(text, F.col("rule.rule"), rules)
    hint = F.coalesce("p.content_class_hint", F.lit("non-incident"))
    title_case = F.initcap(F.coalesce("p.is_single_incident", F.lit(False)).cast("string"))
    by_rule = F.concat(
        F.lit("Heuristic content filter ("), F.col("rule.rule"), F.lit("): "), detail,
        F.lit(" [content_gate=heuristic, hint="), F.col("rule.hint"), F.lit("]"),
    )
    by_model = F.concat(
        F.col("p.reasoning"), F.lit(" [content_gate=llm, single_incident="), title_case, F.lit(", hint="), hint, F.lit("]")
    )
    return joined.select(
        "id",
        F.when(ruled | rejected, "discarded").otherwise("ready_for_extraction").alias("status"),
        F.when(ruled | rejected, "discarded").when(F.col("p").isNull(), "failure").otherwise("success").alias("outcome"),
        F.when(ruled, class_reason(F.col("rule.hint"))).when(rejected, "llm_content_reject")
        .when(F.col("p").isNull(), "llm_unknown").alias("failure_reason"),
        F.when(ruled, by_rule).when(rejected, by_model).alias("reasoning"),
    )


def extraction_step(results: DataFrame) -> DataFrame:
    """Status after extraction.  results: id, error_class, error_message, content_class.

    Validation errors and non-incident classes discard, other errors fail.
    """
    failed = F.coalesce("error_class", "error_message").isNotNull()
    reason = extraction_reason(F.col("error_class"), F.col("error_message"))
    other = F.coalesce("content_class", F.lit("incident")) != "incident"
    return results.select(
        "id",
        F.when(failed & (reason == "validation_error"), "discarded")
        .when(failed, "failed_in_extraction")
        .when(other, "discarded")
        .otherwise("extracted").alias("status"),
        F.when(failed, reason).when(other, class_reason(F.col("content_class"))).alias("failure_reason"),
        F.when(failed & (reason == "validation_error"),
               F.concat(F.lit("Extraction validation failed: "), F.col("error_message")))
        .when(~failed & other, F.concat(F.lit("Extraction content_class="), F.col("content_class"))).alias("reasoning"),
    )


# --- re-extraction -------------------------------------------------------------------------
def reextract_candidates(sources: DataFrame, records: DataFrame, condition: Column | None = None) -> DataFrame:
    """Extracted sources with usable text and their best record: linked, then newest."""
    best = preferred_per_key(
        records.select("id", "source_google_news_id", "unique_event_id", "city", "state", "event_date"),
        ["source_google_news_id"], F.col("unique_event_id").isNotNull(),
    ).withColumnsRenamed({"id": "raw_event_id", "source_google_news_id": "source_id"})
    usable = sources.where((F.col("status") == "extracted") & usable_article(F.col("content")))
    out = usable.select(F.col("id").alias("source_id"), "headline", "content").join(best, "source_id")
    return out if condition is None else out.where(condition)


def keys_changed(old: str = "old", new: str = "new") -> Column:
    """City, state or day differ after normalising (NULL equals NULL)."""
    def place(side: str, c: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(f"{side}.{c}"), F.lit(""))))

    day = F.to_date(F.col(f"{old}.event_date")).eqNullSafe(F.to_date(F.col(f"{new}.event_date")))
    return (place(old, "city") != place(new, "city")) | (place(old, "state") != place(new, "state")) | ~day


def reconcile_reextraction(records: DataFrame, extracted: DataFrame) -> DataFrame:
    """What a re-extraction does to each record: (id, action, unique_event_id).

    unlink: keys changed, back to pending, parent recounted; flag: parent needs
    enrichment; update: no parent; would_discard: no longer an incident, untouched.
    """
    old = records.select("id", "unique_event_id", F.struct("city", "state", "event_date").alias("old"))
    new = extracted.select("id", "content_class", F.struct("city", "state", "event_date").alias("new"))
    linked = F.col("unique_event_id").isNotNull()
    return old.join(new, "id").select(
        "id",
        F.when(F.col("content_class") != "incident", "would_discard")
        .when(linked & keys_changed(), "unlink")
        .when(linked, "flag")
        .otherwise("update").alias("action"),
        "unique_event_id",
    )
