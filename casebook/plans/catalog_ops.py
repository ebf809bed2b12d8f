"""Queries of lifecycle, monitoring, anomalies, evaluation, checks and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from casebook import fixed
from casebook.functions import payload
from casebook.operators import (
    anomalies, filters, lifecycle, lists, monitor, quality, ranking, sampling, scoring, stats,
)
from casebook.plans.catalog_text import any_sql, keyword_sql, low_sql, positive_sql
from casebook.plans.registry import query
from casebook.plans.standins import EVENTS_AS_OF, Archive
from casebook.session import work_folder
from casebook.streaming import ingest, state
from casebook.streaming import resolve as resolve_stream

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TRANSIENT = ", ".join(f"'{r}'" for r in fixed.TRANSIENT_REASONS)
STUCK = f"(status IN ('classifying', 'downloading', 'extracting') AND updated_at < {AS_OF} - INTERVAL 15 MINUTE)"


# --- lifecycle --------------------------------------------------------------------------
@query("stuck_rows", ("source",), f"""
    SELECT id, CASE WHEN {STUCK} THEN CASE status WHEN 'classifying' THEN 'ready_for_classification'
      WHEN 'downloading' THEN 'ready_for_download' ELSE 'ready_for_extraction' END ELSE status END AS status FROM source""")
def stuck_rows(a: Archive) -> DataFrame:
    return lifecycle.recover_stuck(a.source, EVENTS_AS_OF)[0].select("id", "status")


@query("stuck_counts", ("source",), f"SELECT status, count(*) AS count FROM source WHERE {STUCK} GROUP BY 1")
def stuck_counts(a: Archive) -> DataFrame:
    return lifecycle.recover_stuck(a.source, EVENTS_AS_OF)[1]


@query("latest_attempt_retry", ("source", "attempt"), f"""
    WITH s AS (SELECT source_google_news_id, stage, failure_reason, count(*) OVER (PARTITION BY source_google_news_id, stage) AS attempts,
        row_number() OVER (PARTITION BY source_google_news_id, stage ORDER BY created_at DESC, id DESC) AS r FROM attempt)
    SELECT source.id AS source_google_news_id, s.stage, s.failure_reason AS last_reason, s.attempts FROM source
    JOIN s ON s.source_google_news_id = source.id AND s.stage = 'download' AND r = 1
    WHERE source.status = 'failed_in_download' AND s.failure_reason IN ({TRANSIENT}) AND s.attempts < 30""")
def latest_attempt_retry(a: Archive) -> DataFrame:
    return lifecycle.retryable(a.source, a.attempt, 30).drop("status")


@query("requeued_failures", ("source", "attempt"), f"""
    WITH s AS (SELECT source_google_news_id, stage, failure_reason, count(*) OVER (PARTITION BY source_google_news_id, stage) AS attempts,
        row_number() OVER (PARTITION BY source_google_news_id, stage ORDER BY created_at DESC, id DESC) AS r FROM attempt),
    k AS (SELECT source_google_news_id AS id FROM s WHERE r = 1 AND stage = 'download' AND failure_reason IN ({TRANSIENT}) AND attempts < 30)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'failed_in_download' AND id IN (SELECT id FROM k)
      THEN 'ready_for_download' ELSE status END AS status FROM source) GROUP BY 1""")
def requeued_failures(a: Archive) -> DataFrame:
    return lifecycle.requeue_failures(a.source, a.attempt, 30).groupBy("status").agg(F.count("*").alias("n"))


@query("attempt_number", ("attempt",), """
    SELECT id, CAST(row_number() OVER (PARTITION BY source_google_news_id, stage ORDER BY created_at, id) AS BIGINT) AS attempt_no FROM attempt""")
def attempt_number(a: Archive) -> DataFrame:
    return ranking.attempt_numbers(a.attempt, "day").select("id", "attempt_no")


@query("latest_attempt", ("attempt",), """
    SELECT source_google_news_id, stage, id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY source_google_news_id, stage
      ORDER BY created_at DESC, id DESC) AS r FROM attempt) WHERE r = 1""")
def latest_attempt(a: Archive) -> DataFrame:
    return ranking.latest_per_key(a.attempt, ["source_google_news_id", "stage"], "created_at").select(
        "source_google_news_id", "stage", "id", "outcome"
    )


@query("preferred_child", ("article", "raw"), """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY source_google_news_id ORDER BY CASE WHEN unique_event_id IS NULL THEN 0 ELSE 1 END DESC,
        id DESC) AS r FROM raw WHERE source_google_news_id IS NOT NULL)
    SELECT a.id AS source_id, b.id AS raw_event_id, b.unique_event_id FROM article a JOIN b ON b.source_google_news_id = a.id AND r = 1
    WHERE a.status = 'extracted' AND length(trim(a.content)) > 200""")
def preferred_child(a: Archive) -> DataFrame:
    sources = a.article.withColumn("headline", F.lit(None).cast("string"))
    found = lifecycle.reextract_candidates(sources, a.raw.where(F.col("source_google_news_id").isNotNull()))
    return found.select("source_id", "raw_event_id", "unique_event_id")


_STORED = "coalesce(is_violent_death, FALSE)"


@query("reclassify_candidates", ("source",), f"""
    SELECT id, CASE WHEN {_STORED} THEN 'ready_for_download' ELSE 'ready_for_classification' END AS target_status FROM (
      SELECT *, {low_sql('headline')} AS t FROM source WHERE status = 'discarded' AND headline IS NOT NULL)
    WHERE {_STORED} OR {keyword_sql('headline', fixed.DEATH_KEYWORDS)} OR {positive_sql('t')}""")
def reclassify_candidates(a: Archive) -> DataFrame:
    sources = a.source.withColumn("content", F.lit(None).cast("string"))
    return lists.reclassify_candidates(sources).select("id", "target_status")


@query("reclassify_signals", ("source",), f"""
    SELECT id, {_STORED} AS false_negative, {keyword_sql('headline', fixed.DEATH_KEYWORDS)} AS death_keywords,
      {positive_sql('t')} AS heuristic_true FROM (SELECT *, {low_sql('headline')} AS t FROM source)""")
def reclassify_signals(a: Archive) -> DataFrame:
    kinds = ["false_negative", "death_keywords", "heuristic_true"]
    return a.source.select("id", *[filters.reclassify_signal(k).alias(k) for k in kinds])


@query("requeue_targets", ("article",), """
    SELECT target_status, count(*) AS count FROM (SELECT CASE WHEN length(trim(content)) > 200 THEN 'ready_for_extraction'
      WHEN coalesce(is_violent_death, FALSE) THEN 'ready_for_download' ELSE 'ready_for_classification' END AS target_status
      FROM article WHERE status = 'discarded') GROUP BY 1""")
def requeue_targets(a: Archive) -> DataFrame:
    return lifecycle.requeue_discarded(a.article, a.article.select("id"))[1]


@query("classification_step", ("source",), f"""
    SELECT status, is_violent_death, n FROM (
      SELECT CASE WHEN headline IS NULL THEN 'discarded' WHEN id % 7 = 0 THEN 'ready_for_classification'
          WHEN fixed_label AND id % 4 <> 0 THEN 'ready_for_download' ELSE 'discarded' END AS status,
        CASE WHEN headline IS NOT NULL AND id % 7 <> 0 THEN fixed_label END AS is_violent_death, count(*) AS n
      FROM (SELECT id, headline, CASE WHEN neg AND lab THEN FALSE WHEN pos AND NOT lab THEN TRUE ELSE lab END AS fixed_label
        FROM (SELECT id, headline, coalesce(is_violent_death, TRUE) AS lab,
          (NOT {any_sql('t', fixed.EXPLICIT_DEATH)}) AND (regexp_matches(t, '{fixed.SURVIVAL_PATTERN}') OR {any_sql('t', fixed.FOREIGN_MARKERS)}
            OR {any_sql('t', fixed.METAPHOR_MARKERS)} OR {any_sql('t', fixed.ACCIDENT_MARKERS)} OR {any_sql('t', fixed.POLICE_MARKERS)}
            OR (contains(t, 'troca tiros') AND NOT regexp_matches(t, '{fixed.DEATH_HINT_PATTERN}'))) AS neg, {positive_sql('t')} AS pos
          FROM (SELECT *, {low_sql('headline')} AS t FROM source))) GROUP BY 1, 2)""")
def classification_step(a: Archive) -> DataFrame:
    predictions = a.source.where(F.col("id") % 7 != 0).select(
        "id", F.coalesce("is_violent_death", F.lit(True)).alias("is_violent_death"),
        (F.col("id") % 4 != 0).alias("is_single_incident"), F.lit("alta").alias("confidence"),
        F.lit("modelo").alias("reasoning"), F.lit(None).cast("string").alias("content_class_hint"),
    )
    return lifecycle.classify(a.source, predictions).groupBy("status", "is_violent_death").agg(F.count("*").alias("n"))


_RULED = " OR ".join(f"regexp_matches(content, '(?i){p}')" for _, _, p in fixed.ARTICLE_RULES)


@query("content_gate_step", ("article",), f"""
    SELECT status, outcome, count(*) AS n FROM (
      SELECT CASE WHEN ruled OR (id % 5 <> 0 AND id % 3 = 1) THEN 'discarded' ELSE 'ready_for_extraction' END AS status,
        CASE WHEN ruled OR (id % 5 <> 0 AND id % 3 = 1) THEN 'discarded' WHEN id % 5 = 0 THEN 'failure' ELSE 'success' END AS outcome
      FROM (SELECT id, ({_RULED}) AS ruled FROM article)) GROUP BY 1, 2""")
def content_gate_step(a: Archive) -> DataFrame:
    predictions = a.article.where(F.col("id") % 5 != 0).select(
        "id", (F.col("id") % 3 != 1).alias("is_violent_death"), F.lit(True).alias("is_single_incident"),
        F.lit("modelo").alias("reasoning"), F.lit(None).cast("string").alias("content_class_hint"),
    )
    articles = a.article.withColumn("headline", F.lit(None).cast("string"))
    return lifecycle.content_gate(articles, predictions).groupBy("status", "outcome").agg(F.count("*").alias("n"))


@query("extraction_step", ("raw",), """
    SELECT status, failure_reason, count(*) AS n FROM (
      SELECT CASE WHEN id % 11 = 0 THEN 'discarded' WHEN id % 7 = 0 THEN 'failed_in_extraction'
          WHEN content_class <> 'incident' THEN 'discarded' ELSE 'extracted' END AS status,
        CASE WHEN id % 11 = 0 THEN 'validation_error' WHEN id % 7 = 0 THEN 'llm_timeout'
          WHEN content_class <> 'incident' THEN 'non_incident_content' END AS failure_reason FROM raw) GROUP BY 1, 2""")
def extraction_step(a: Archive) -> DataFrame:
    error = F.when(F.col("id") % 11 == 0, "ValidationError").when(F.col("id") % 7 == 0, "ReadTimeout")
    results = a.raw.select("id", "content_class", error.alias("error_class"), F.lit(None).cast("string").alias("error_message"))
    return lifecycle.extraction_step(results).groupBy("status", "failure_reason").agg(F.count("*").alias("n"))


@query("reextract_actions", ("raw",), """
    SELECT action, count(*) AS n FROM (SELECT CASE WHEN content_class <> 'incident' THEN 'would_discard'
      WHEN unique_event_id IS NULL THEN 'update' WHEN id % 4 = 0 OR event_date IS NULL AND id % 10 = 1 THEN 'unlink' ELSE 'flag' END AS action
      FROM raw) GROUP BY 1""")
def reextract_actions(a: Archive) -> DataFrame:
    moved = F.when(F.col("id") % 4 == 0, F.lit("outra")).otherwise(F.upper("city"))
    day = F.coalesce("event_date", F.when(F.col("id") % 10 == 1, F.lit("2020-01-01").cast("timestamp_ntz")))
    extracted = a.raw.select("id", "content_class", moved.alias("city"), "state", day.alias("event_date"))
    return lifecycle.reconcile_reextraction(a.raw, extracted).groupBy("action").agg(F.count("*").alias("n"))


@query("geocode_clearing", ("incident",), """
    SELECT count(*) FILTER (latitude IS NOT NULL AND NOT (lower(state) = 'sp')) +
      count(*) FILTER (latitude IS NOT NULL AND state IS NULL) AS located, count(*) AS total FROM incident""")
def geocode_clearing(a: Archive) -> DataFrame:
    cleared = lifecycle.clear_geocode(a.incident, filters.batch_filter(state="SP"))
    return cleared.agg(F.count("latitude").alias("located"), F.count("*").alias("total"))


@query("enrichment_flags", ("incident",), """
    SELECT count(*) FILTER (needs_enrichment OR coalesce(lower(city) = 'building 3', FALSE)) AS flagged FROM incident""")
def enrichment_flags(a: Archive) -> DataFrame:
    flagged = lifecycle.flag_enrichment(a.incident, filters.batch_filter(city="Building 3"))
    return flagged.agg(F.count_if("needs_enrichment").alias("flagged"))


# --- monitoring --------------------------------------------------------------------------------
@query("stage_inventory", ("source", "attempt", "raw", "incident"), f"""
    SELECT 'status' AS metric, status AS label, count(*) AS value FROM source GROUP BY 2
    UNION ALL SELECT 'stuck', 'classifying', count(*) FILTER ({STUCK} AND status = 'classifying') FROM source
    UNION ALL SELECT 'stuck', 'downloading', count(*) FILTER ({STUCK} AND status = 'downloading') FROM source
    UNION ALL SELECT 'stuck', 'extracting', count(*) FILTER ({STUCK} AND status = 'extracting') FROM source
    UNION ALL SELECT 'total', 'violent_death', count(*) FILTER (is_violent_death) FROM source
    UNION ALL SELECT 'total', 'sources', count(*) FROM source UNION ALL SELECT 'total', 'records', count(*) FROM raw
    UNION ALL SELECT 'total', 'incidents', count(*) FROM incident
    UNION ALL SELECT CASE outcome WHEN 'failure' THEN 'failures' ELSE 'discards' END, stage || '/' || failure_reason, count(*) FROM attempt
      WHERE created_at >= {AS_OF} - INTERVAL 24 HOUR AND failure_reason IS NOT NULL AND outcome IN ('failure', 'discarded') GROUP BY 1, 2""")
def stage_inventory(a: Archive) -> DataFrame:
    return monitor.inventory(a.source, a.attempt, a.raw, a.incident, EVENTS_AS_OF)


@query("zero_filled_failures", ("attempt",), f"""
    WITH k AS (SELECT DISTINCT stage || '/' || failure_reason AS label FROM attempt WHERE failure_reason IS NOT NULL),
    c AS (SELECT stage || '/' || failure_reason AS label, count(*) AS n FROM attempt WHERE failure_reason IS NOT NULL
      AND created_at >= {AS_OF} - INTERVAL 2 HOUR GROUP BY 1)
    SELECT 'failures' AS metric, k.label, coalesce(n, 0) AS value FROM k LEFT JOIN c ON k.label = c.label""")
def zero_filled_failures(a: Archive) -> DataFrame:
    failed = a.attempt.where(F.col("failure_reason").isNotNull())
    known = monitor.metric_rows(failed, "failures", "stage", "failure_reason")
    recent = failed.where(filters.last_hours(F.col("created_at"), EVENTS_AS_OF, 2))
    return monitor.zero_filled(monitor.metric_rows(recent, "failures", "stage", "failure_reason"), known)


@query("attempt_counters", ("attempt",), """
    SELECT stage, outcome, coalesce(failure_reason, 'none') AS reason, count(*) AS attempts FROM attempt GROUP BY 1, 2, 3""")
def attempt_counters(a: Archive) -> DataFrame:
    return monitor.attempt_counters(a.attempt)


def _histogram_sql(value: str, buckets: list, labels: str) -> str:
    parts = [f"SELECT {labels}, '{float(b)}' AS le, count(*) FILTER ({value} <= {b}) AS count FROM attempt GROUP BY ALL" for b in buckets]
    return " UNION ALL ".join([*parts, f"SELECT {labels}, '+Inf', count(*) FROM attempt GROUP BY ALL"])


@query("attempt_histogram", ("attempt",), _histogram_sql("duration_s", fixed.DURATION_BUCKETS, "stage, outcome"))
def attempt_histogram(a: Archive) -> DataFrame:
    return monitor.histogram(a.attempt, "duration_s", fixed.DURATION_BUCKETS, "stage", "outcome")


@query("size_histogram", ("attempt",), _histogram_sql("content_length", fixed.SIZE_BUCKETS, "stage"))
def size_histogram(a: Archive) -> DataFrame:
    return monitor.histogram(a.attempt, "content_length", fixed.SIZE_BUCKETS, "stage")


@query("alert_checks", ("source", "attempt"), f"""
    WITH v AS (SELECT 'stuck_sources' AS metric, CAST(count(*) FILTER ({STUCK}) AS DOUBLE) AS value FROM source
      UNION ALL SELECT 'ready_for_classification', CAST(count(*) FILTER (status = 'ready_for_classification') AS DOUBLE) FROM source
      UNION ALL SELECT 'minutes_since_success', (epoch({AS_OF}) - floor(epoch(max(created_at)))) / 60.0 FROM attempt WHERE outcome = 'success'),
    r AS (SELECT unnest([{', '.join(f"struct_pack(metric := '{m}', threshold := CAST({t} AS DOUBLE), severity := '{s}', rule := '{n}')"
                                     for m, t, s, n in fixed.ALERT_RULES)}], recursive := true))
    SELECT r.rule, r.severity, r.metric, r.threshold, round(v.value, 6) AS value, v.value >= r.threshold AS firing
    FROM r LEFT JOIN v ON r.metric = v.metric""")
def alert_checks(a: Archive) -> DataFrame:
    runs = a.attempt.select(F.col("created_at").alias("finished_at"), (F.col("outcome") == "success").alias("ok"))
    values = monitor.health_values(a.source, runs, EVENTS_AS_OF)
    return monitor.alerts(values, monitor.alert_rules(a.spark)).withColumn("value", F.round("value", 6))


@query("recent_activity", ("attempt",), f"""
    SELECT count(*) AS events FROM attempt WHERE created_at >= {AS_OF} - INTERVAL 240 MINUTE""")
def recent_activity(a: Archive) -> DataFrame:
    return monitor.recent_activity(a.attempt, "created_at", EVENTS_AS_OF, 240)


@query("heartbeat_misses", ("attempt",), """
    WITH s AS (SELECT source_google_news_id AS worker, outcome = 'success' AS ok,
        sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY source_google_news_id ORDER BY created_at, outcome = 'success'
          ROWS UNBOUNDED PRECEDING) AS g FROM attempt),
    r AS (SELECT worker, g, count(*) AS n FROM s WHERE NOT ok GROUP BY 1, 2)
    SELECT worker, max(n) AS longest_miss_run, max(n) >= 5 AS alarm FROM r GROUP BY 1""")
def heartbeat_misses(a: Archive) -> DataFrame:
    beats = a.attempt.select(
        F.col("source_google_news_id").alias("worker"), "created_at", (F.col("outcome") == "success").alias("ok")
    )
    return monitor.heartbeat_misses(beats, "worker", "created_at", "ok")


@query("requests_over_limit", ("source",), """
    SELECT user_id, strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H') AS window_start, count(*) AS requests FROM source
    GROUP BY 1, 2 HAVING count(*) > 1""")
def requests_over_limit(a: Archive) -> DataFrame:
    out = monitor.requests_over_limit(a.source, "user_id", "fetched_at", 1, "1 hour")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


@query("city_ingest", ("source",), """
    WITH c AS (SELECT city, max(results) AS last_result_count, count(*) FILTER (results >= 100) > 8 AS needs_sharding FROM source GROUP BY 1)
    SELECT CAST(160 AS BIGINT) AS configured, count(*) AS tracked, count(*) FILTER (needs_sharding) AS sharded FROM c""")
def city_ingest(a: Archive) -> DataFrame:
    cities = a.source.groupBy(F.col("city").alias("city_name")).agg(
        F.max("results").alias("last_result_count"), (F.count_if(F.col("results") >= 100) > 8).alias("needs_sharding")
    )
    return stats.city_ingest(cities, 160)


@query("city_ranking", ("source",), """
    SELECT city AS city_name, count(*) AS last_result_count FROM source GROUP BY 1""")
def city_ranking(a: Archive) -> DataFrame:
    cities = a.source.groupBy(F.col("city").alias("city_name")).agg(F.count("*").alias("last_result_count"))
    return stats.city_ranking(cities)


# --- anomalies ------------------------------------------------------------------------------------
_POSITIVE = ", ".join(f"'{s}'" for s in fixed.POSITIVE_STATUSES)
_CLASSIFICATION = f"""
    SELECT id, CASE WHEN status = 'discarded' AND is_violent_death THEN 'false_negative'
      WHEN status IN ({_POSITIVE}) AND NOT is_violent_death THEN 'false_positive'
      WHEN status = 'discarded' AND {keyword_sql('headline', fixed.EVAL_DEATH_KEYWORDS)} THEN 'death_keyword_discarded' END AS signal
    FROM source WHERE headline IS NOT NULL"""
_GATE = """
    SELECT id, CASE WHEN status = 'discarded' AND is_violent_death THEN 'gate_false_negative'
      WHEN status = 'extracted' AND NOT is_violent_death THEN 'gate_false_positive' END AS signal
    FROM article WHERE length(content) > 500"""


@query("classification_anomalies", ("source",), f"SELECT * FROM ({_CLASSIFICATION}) WHERE signal IS NOT NULL")
def classification_anomalies(a: Archive) -> DataFrame:
    return anomalies.classification_anomalies(a.source).select("id", "signal")


@query("gate_anomalies", ("article",), f"SELECT * FROM ({_GATE}) WHERE signal IS NOT NULL")
def gate_anomalies(a: Archive) -> DataFrame:
    return anomalies.gate_anomalies(a.article).select("id", "signal")


@query("extraction_anomalies", ("raw", "article"), """
    SELECT r.id, s.id AS source_id, length(s.content) AS content_length FROM raw r JOIN article s ON r.source_google_news_id = s.id
    WHERE length(s.content) > 300 AND NOT coalesce(r.extraction_success, FALSE)""")
def extraction_anomalies(a: Archive) -> DataFrame:
    sources = a.article.withColumn("headline", F.lit(None).cast("string"))
    return anomalies.extraction_anomalies(a.raw, sources).select("id", "source_id", "content_length")


@query("stale_enrichment", ("incident",), """
    SELECT id, source_count FROM incident WHERE needs_enrichment AND source_count > 0""")
def stale_enrichment(a: Archive) -> DataFrame:
    return anomalies.stale_enrichment(a.incident).select("id", "source_count")


@query("field_mismatch", ("incident", "raw"), """
    SELECT u.id, min(r.id) AS raw_id FROM incident u JOIN raw r ON r.unique_event_id = u.id WHERE u.source_count > 1
      AND ((u.city IS NOT NULL AND r.city IS NOT NULL AND lower(u.city) <> lower(r.city))
        OR (u.victim_count IS NOT NULL AND r.victim_count IS NOT NULL AND u.victim_count <> r.victim_count)) GROUP BY 1""")
def field_mismatch(a: Archive) -> DataFrame:
    return anomalies.field_mismatch(a.incident, a.raw).select("id", "raw_id")


@query("matched_with_sibling", ("incident", "raw"), """
    WITH g AS (SELECT id, min(id) OVER w AS group_id, count(*) OVER w AS size FROM incident
      WHERE title IS NOT NULL AND city IS NOT NULL AND event_date IS NOT NULL
      WINDOW w AS (PARTITION BY lower(title), lower(city), event_date))
    SELECT raw.id AS raw_id, raw.unique_event_id, g.group_id, g.size - 1 AS siblings FROM raw JOIN g ON raw.unique_event_id = g.id
    WHERE g.size > 1 AND raw.deduplication_status = 'matched' AND raw.city IS NOT NULL AND raw.event_date IS NOT NULL""")
def matched_with_sibling(a: Archive) -> DataFrame:
    from casebook.operators import merge

    return anomalies.matched_with_sibling(a.raw, merge.exact_groups(a.incident)).drop("survivor_id")


@query("anomaly_rollup", ("source", "article"), f"""
    WITH x AS (SELECT 'classification' AS stage, id, signal FROM ({_CLASSIFICATION}) WHERE signal IS NOT NULL
      UNION ALL SELECT 'content-gate', id, signal FROM ({_GATE}) WHERE signal IS NOT NULL),
    v AS (SELECT *, CASE signal WHEN 'false_negative' THEN id % 2 = 0 WHEN 'false_positive' THEN id % 2 = 1
      WHEN 'death_keyword_discarded' THEN id % 2 = 0 WHEN 'gate_false_negative' THEN id % 3 = 0 ELSE id % 3 <> 0 END AS ok,
      row_number() OVER (PARTITION BY stage, signal ORDER BY id) AS r FROM x)
    SELECT stage, signal, count(*) AS total, count(*) FILTER (ok) AS verified, count(DISTINCT id) AS ids,
      string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (r <= 3) AS examples FROM v GROUP BY 1, 2""")
def anomaly_rollup(a: Archive) -> DataFrame:
    found = anomalies.classification_anomalies(a.source).select("stage", "id", "signal").unionByName(
        anomalies.gate_anomalies(a.article).select("stage", "id", "signal")
    )
    reruns = found.select("stage", "id", (F.col("id") % 2 == 0).alias("positive"), (F.col("id") % 3 == 0).alias("passes"))
    verified = anomalies.verify(found, reruns)
    labelled = found.withColumns({"sub_signal": F.lit(""), "priority": F.lit("medium")})
    out = anomalies.rollup(labelled, verified)
    examples = F.array_join(F.transform("examples", lambda i: i.cast("string")), ",")
    return out.select("stage", "signal", "total", "verified", "ids", examples.alias("examples"))


@query("first_signal_wins", ("source",), f"""
    SELECT coalesce(a.id, b.id) AS id, coalesce(a.signal, b.signal) AS signal FROM
      (SELECT * FROM ({_CLASSIFICATION}) WHERE signal IS NOT NULL) a
      FULL JOIN (SELECT id, 'stuck' AS signal FROM source WHERE {STUCK} OR status = 'discarded') b ON a.id = b.id""")
def first_signal_wins(a: Archive) -> DataFrame:
    stuck = a.source.where(lifecycle.is_stuck(EVENTS_AS_OF) | (F.col("status") == "discarded")).select(
        F.lit("lifecycle").alias("stage"), "id", F.lit("stuck").alias("signal")
    )
    return anomalies.first_signal_wins([anomalies.classification_anomalies(a.source), stuck]).select("id", "signal")


# --- evaluation ----------------------------------------------------------------------------------------
@query("binary_scores", ("scored",), """
    SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, passed / total AS accuracy FROM (
      SELECT count(*) AS total, count(*) FILTER (error IS NULL AND expected = actual) AS passed,
        count(*) FILTER (error IS NULL AND expected <> actual) AS failed, count(*) FILTER (error IS NOT NULL) AS errors,
        count(*) FILTER (error IS NULL AND expected AND actual) AS tp, count(*) FILTER (error IS NULL AND NOT expected AND actual) AS fp,
        count(*) FILTER (error IS NULL AND expected AND NOT actual) AS fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM scored)""")
def binary_scores(a: Archive) -> DataFrame:
    return scoring.binary_scores(a.scored)


@query("tag_accuracy", ("scored",), """
    SELECT tag, count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(CASE WHEN passed THEN 1 ELSE 0 END), 6) AS accuracy
    FROM (SELECT tag, passed FROM scored UNION ALL SELECT tag2, passed FROM scored) GROUP BY 1""")
def tag_accuracy(a: Archive) -> DataFrame:
    return scoring.tag_accuracy(a.scored)


_FIELDS = ["city", "state", "victim_count", "neighborhood"]


def _fields_sql(body: str) -> str:
    same = {
        "city": "upper(r.city) = upper(i.city)", "state": "r.state = i.state",
        "victim_count": "r.victim_count = i.victim_count", "neighborhood": "r.neighborhood = i.neighborhood",
    }
    parts = " UNION ALL ".join(
        f"SELECT i.id, '{f}' AS field, coalesce({cond}, r.{f} IS NULL AND i.{f} IS NULL) AS matched FROM incident i JOIN b r ON r.unique_event_id = i.id"
        for f, cond in same.items()
    )
    return f"""WITH b AS (SELECT unique_event_id, max(upper(city)) AS city, max(state) AS state, max(victim_count) AS victim_count,
        max(neighborhood) AS neighborhood FROM raw WHERE unique_event_id IS NOT NULL GROUP BY 1),
      f AS ({parts}) {body}"""


def _field_results(a: Archive) -> DataFrame:
    actual = a.raw.where(F.col("unique_event_id").isNotNull()).groupBy(F.col("unique_event_id").alias("id")).agg(
        F.max(F.upper("city")).alias("city"), *[F.max(c).alias(c) for c in _FIELDS[1:]]
    )
    return scoring.field_results(a.incident, actual, _FIELDS)


@query("field_scores", ("incident", "raw"), _fields_sql("""
    SELECT id, round(avg(CASE WHEN matched THEN 1 ELSE 0 END), 6) AS score, bool_and(matched) AS passed FROM f GROUP BY 1"""))
def field_scores(a: Archive) -> DataFrame:
    return scoring.case_scores(_field_results(a))


@query("field_accuracy", ("incident", "raw"), _fields_sql("""
    SELECT field, count(*) AS total, count(*) FILTER (matched) AS matched, round(avg(CASE WHEN matched THEN 1 ELSE 0 END), 6) AS accuracy
    FROM f GROUP BY 1"""))
def field_accuracy(a: Archive) -> DataFrame:
    return scoring.field_accuracy(_field_results(a))


@query("cluster_f1", ("raw",), """
    WITH m AS (SELECT city AS case_id, id AS member, unique_event_id AS e, victim_count AS a FROM raw WHERE unique_event_id IS NOT NULL AND victim_count IS NOT NULL),
    p AS (SELECT case_id, sum(n * (n - 1) / 2) AS v, count(*) AS g FROM (SELECT case_id, e, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
    q AS (SELECT case_id, sum(n * (n - 1) / 2) AS v, count(*) AS g FROM (SELECT case_id, a, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT case_id, sum(n * (n - 1) / 2) AS v, count(*) AS g FROM (SELECT case_id, e, a, count(*) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1),
    s AS (SELECT p.case_id, p.g = b.g AND q.g = b.g AS exact, CASE WHEN q.v > 0 THEN b.v / q.v WHEN p.v = 0 THEN 1.0 ELSE 0.0 END AS precision,
      CASE WHEN p.v > 0 THEN b.v / p.v WHEN q.v = 0 THEN 1.0 ELSE 0.0 END AS recall FROM p JOIN q ON p.case_id = q.case_id JOIN b ON b.case_id = p.case_id)
    SELECT case_id, exact, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM s""")
def cluster_f1(a: Archive) -> DataFrame:
    known = a.raw.where(F.col("unique_event_id").isNotNull() & F.col("victim_count").isNotNull())
    member = [F.col("city").alias("case_id"), F.col("id").alias("member")]
    expected = known.select(*member, F.col("unique_event_id").alias("cluster"))
    actual = known.select(*member, F.col("victim_count").alias("cluster"))
    out = scoring.cluster_scores(expected, actual)
    return out.select("case_id", "exact", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("run_regressions", ("scored",), """
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN passed AND NOT actual THEN 'regression' WHEN NOT passed AND actual THEN 'improvement'
      WHEN passed THEN 'unchanged_pass' ELSE 'unchanged_fail' END AS change FROM scored) GROUP BY 1""")
def run_regressions(a: Archive) -> DataFrame:
    candidate = a.scored.select("id", F.col("actual").alias("passed"))
    return stats.outcome_counts(scoring.compare_runs(a.scored, candidate), "change").withColumnRenamed("count", "n")


@query("score_rollup", ("scored",), """
    SELECT stage, fixture, count(*) FILTER (passed) AS passed, count(*) AS total, bool_and(passed) AS all_passed FROM scored GROUP BY ROLLUP (stage, fixture)""")
def score_rollup(a: Archive) -> DataFrame:
    per_fixture = a.scored.groupBy("stage", "fixture").agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    return scoring.score_rollup(per_fixture)


@query("recovery_rate", ("attempt",), """
    SELECT count(*) AS total, count(*) FILTER (outcome = 'success') AS recovered,
      round(count(*) FILTER (outcome = 'success') / count(*), 6) AS rate FROM attempt""")
def recovery_rate(a: Archive) -> DataFrame:
    return scoring.recovery(a.attempt.withColumn("ok", F.col("outcome") == "success"))


@query("recovery_reasons", ("attempt",), """
    SELECT failure_reason, http_status, count(*) AS count FROM attempt WHERE outcome <> 'success' GROUP BY 1, 2""")
def recovery_reasons(a: Archive) -> DataFrame:
    return stats.outcome_counts(a.attempt.where(F.col("outcome") != "success"), "failure_reason", "http_status")


@query("error_lists", ("scored",), """
    SELECT kind, id, rank FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS rank FROM (
      SELECT id, CASE WHEN actual AND NOT expected THEN 'false_positive' WHEN expected AND NOT actual THEN 'false_negative' END AS kind
      FROM scored) WHERE kind IS NOT NULL) WHERE rank <= 10""")
def error_lists(a: Archive) -> DataFrame:
    kind = F.when(F.col("actual") & ~F.col("expected"), "false_positive").when(
        F.col("expected") & ~F.col("actual"), "false_negative"
    )
    rows = a.scored.select("id", kind.alias("kind")).where(F.col("kind").isNotNull())
    return lists.first_per_kind(rows, "kind", "id", 10)


@query("label_counts", ("scored",), """
    SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS labeled, count(*) FILTER (error IS NOT NULL) AS pending FROM scored""")
def label_counts(a: Archive) -> DataFrame:
    status = F.when(F.col("error").isNull(), "labeled").otherwise("pending")
    return scoring.label_counts(a.scored.withColumn("label_status", status))


@query("merged_cases", ("scored",), """
    SELECT doc_id AS id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def merged_cases(a: Archive) -> DataFrame:
    old = a.table("labels").select(F.col("doc_id").alias("id"), F.lit("old").alias("origin"))
    new = a.table("documents").select(F.col("doc_id").alias("id"), F.lit("new").alias("origin"))
    return scoring.merge_cases(old, new)


# --- samples and checks -------------------------------------------------------------------------------------
def _sample(rows: str, n: int, columns: str = "id, stratum, turn") -> str:
    """Checking SQL of a seeded stratified sample of `rows` (with id and stratum)."""
    return f"""
    SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || id), id) AS turn FROM ({rows}))
    ORDER BY turn, md5('42:' || coalesce(stratum, '')), id LIMIT {n}"""


def _bucket(chars: str) -> str:
    return f"CASE WHEN {chars} < 2000 THEN 'short' WHEN {chars} <= 10000 THEN 'medium' ELSE 'long' END"


_USABLE = "content IS NOT NULL AND length(trim(content)) > {}"


@query("stratified_sample", ("source",), _sample("SELECT id, publisher_name AS stratum FROM source", 200))
def stratified_sample(a: Archive) -> DataFrame:
    return ranking.round_robin(a.source.withColumn("stratum", F.col("publisher_name")), "stratum", 200).select("id", "stratum", "turn")


@query("failed_download_sample", ("source",), _sample("""
      SELECT id, coalesce(regexp_extract(resolved_url, '^https://www[.]([^/]+)/', 1), 'unknown') AS stratum
      FROM source WHERE status = 'failed_in_download'""", 100))
def failed_download_sample(a: Archive) -> DataFrame:
    return sampling.download_failures(a.source, 100).select("id", "stratum", "turn")


@query("failed_extraction_sample", ("article",), _sample(f"""
      SELECT id, {_bucket("length(content)")} || '|' || coalesce(publisher_name, 'unknown') AS stratum
      FROM article WHERE status = 'failed_in_extraction' AND content IS NOT NULL""", 60))
def failed_extraction_sample(a: Archive) -> DataFrame:
    return sampling.extraction_failures(a.article, 60).select("id", "stratum", "turn")


@query("classification_case_sample", ("source",), "SELECT 'classification-' || id AS case_id, headline, is_violent_death AS expected FROM (" + _sample("""
      SELECT id, headline, is_violent_death, CASE WHEN is_violent_death THEN 'positive' ELSE 'negative' END || '|' || status AS stratum
      FROM source WHERE headline IS NOT NULL AND is_violent_death IS NOT NULL""", 60, "*") + ")")
def classification_case_sample(a: Archive) -> DataFrame:
    return sampling.classification_cases(a.source, 60).drop("tags")  # headline_tags checks the tags


@query("gate_case_sample", ("article",), _sample(f"""
      SELECT id, status = 'extracted' AS expected, length(content) AS chars,
        CASE WHEN status = 'extracted' THEN 'true' ELSE 'false' END || '|' || {_bucket("length(content)")} AS stratum
      FROM article WHERE {_USABLE.format(200)} AND status IN ('extracted', 'discarded')""", 40, "id, expected, chars"))
def gate_case_sample(a: Archive) -> DataFrame:
    sources = a.article.withColumn("headline", F.lit(None).cast("string"))
    return sampling.gate_cases(sources, 40).select("id", "expected", F.length("content").alias("chars"))


@query("extraction_case_sample", ("raw", "article"), _sample(f"""
      SELECT r.id, coalesce(r.homicide_type, '?') || '|' || {_bucket("length(a.content)")} AS stratum
      FROM raw r JOIN article a ON r.source_google_news_id = a.id WHERE r.extraction_success AND {_USABLE.format(200)}""", 40))
def extraction_case_sample(a: Archive) -> DataFrame:
    sources = a.article.withColumn("headline", F.lit(None).cast("string"))
    return sampling.extraction_cases(a.raw, sources, 40).select("id", "stratum", "turn")


@query("enrichment_case_sample", ("incident", "raw", "article"), _sample(f"""
      SELECT i.id, articles, coalesce(i.state, '?') AS stratum FROM incident i JOIN (
        SELECT unique_event_id AS id, count(*) AS articles FROM raw
        WHERE source_google_news_id IN (SELECT id FROM article WHERE {_USABLE.format(500)}) GROUP BY 1 HAVING count(*) > 1) USING (id)""",
    40, "id, stratum, articles"))
def enrichment_case_sample(a: Archive) -> DataFrame:
    return sampling.enrichment_cases(a.incident, a.raw, a.article, 40).select("id", "stratum", "articles")


@query("label_distribution", (), "SELECT lang, count(*) AS count FROM documents WHERE length(text) >= 50 GROUP BY 1")
def label_distribution(a: Archive) -> DataFrame:
    return sampling.label_distribution(a.table("documents"), "text", "lang")


@query("quality_violations", ("incident",), """
    SELECT id AS key, 'subtype_not_in_family' AS rule FROM incident WHERE event_family IS NOT NULL AND NOT (
        event_family = 'homicidio' OR (event_family = 'tentativa' AND event_subtype IN ('simples', 'feminicidio', 'latrocinio')))
    UNION ALL SELECT id, 'too_many_victims' FROM incident WHERE victim_count > 10
    UNION ALL SELECT id, 'half_a_point' FROM incident WHERE (latitude IS NULL) <> (longitude IS NULL)
    UNION ALL SELECT id, 'no_date' FROM incident WHERE event_date IS NULL""")
def quality_violations(a: Archive) -> DataFrame:
    from casebook.functions.taxonomy import valid_pair

    return quality.table_violations(a.incident, "id", {
        "subtype_not_in_family": ~valid_pair(F.col("event_family"), F.col("event_subtype")),
        "too_many_victims": F.col("victim_count") > 10,
        "half_a_point": F.col("latitude").isNull() != F.col("longitude").isNull(),
        "no_date": F.col("event_date").isNull(),
    })


@query("record_violations", ("raw",), """
    SELECT id, 'victims_identified_count' AS rule FROM raw WHERE id % 4 <> CASE WHEN name IS NULL THEN 0 ELSE 1 END
    UNION ALL SELECT id, 'victims_total' FROM raw WHERE abs(id % 9 - id % 4) > 1
    UNION ALL SELECT id, 'victims_range' FROM raw WHERE id % 9 = 0
    UNION ALL SELECT id, 'date_not_verified' FROM raw WHERE id % 2 = 0
    UNION ALL SELECT id, 'subtype_not_in_family' FROM raw WHERE event_family IS NULL""")
def record_violations(a: Archive) -> DataFrame:
    person = F.struct(F.col("name").alias("name"))
    people = F.when(F.col("name").isNull(), F.array().cast("array<struct<name:string>>")).otherwise(F.array(person))
    verified = F.struct((F.col("id") % 2 != 0).alias("has_explicit_date"), F.lit("texto").alias("date_source"))
    record = F.to_json(F.struct(
        "event_family", "event_subtype",
        F.struct(F.lit("2024-01-01").alias("date"), verified.alias("date_verification")).alias("date_time"),
        F.struct(
            people.alias("identifiable_victims"), (F.col("id") % 4).cast("int").alias("number_of_identifiable_victims"),
            (F.col("id") % 9).cast("int").alias("number_of_victims"),
        ).alias("victims"),
    ))
    parsed = a.raw.select("id", payload.parse(record).alias("r"))
    return quality.record_violations(parsed, F.col("r")).select("id", "rule")


@query("fixture_violations", ("headline",), """
    SELECT conv_id AS key, 'duplicate_id' AS rule FROM headline GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT conv_id, 'labeled_without_expected' FROM headline WHERE role = 'user' AND turn > 0
    UNION ALL SELECT conv_id, 'pending_with_expected' FROM headline WHERE role <> 'user' AND turn = 0""")
def fixture_violations(a: Archive) -> DataFrame:
    cases = a.headline.select(
        F.col("conv_id").alias("id"), "headline",
        F.when(F.col("role") == "user", "labeled").otherwise("pending").alias("label_status"),
        F.when(F.col("turn") == 0, F.lit(True)).alias("expected"),
    )
    return quality.fixture_violations(cases)


@query("typed_copy", ("source",), """
    SELECT id, strftime(date_trunc('second', fetched_at), '%Y-%m-%d %H:%M:%S') AS at, id % 2 = 1 AS flag, CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id AS INT) END AS number FROM source""")
def typed_copy(a: Archive) -> DataFrame:
    text = a.source.select(
        "id", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("at"), (F.col("id") % 2).cast("string").alias("flag"),
        F.when(F.col("id") % 3 == 0, "n/a").otherwise(F.col("id").cast("string")).alias("number"),
    )
    typed = quality.coerce(text, {"at": "timestamp_ntz", "flag": "boolean", "number": "int"})
    return typed.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("table_reconciliation", ("source", "incident"), """
    SELECT 'incident' AS "table", count(*) AS source_rows, max(id) AS source_max_id, count(event_date) AS target_rows,
      max(CASE WHEN event_date IS NOT NULL THEN id END) AS target_max_id,
      count(*) = count(event_date) AND max(id) = max(CASE WHEN event_date IS NOT NULL THEN id END) AS agree FROM incident
    UNION ALL SELECT 'source', count(*), max(id), count(*), max(id), TRUE FROM source""")
def table_reconciliation(a: Archive) -> DataFrame:
    source = quality.table_totals({"incident": a.incident, "source": a.source})
    target = quality.table_totals({"incident": a.incident.where(F.col("event_date").isNotNull()), "source": a.source})
    return quality.reconcile(source, target)


@query("attempt_log", ("attempt",), """
    SELECT id, stage, length(repeat(stage, 300)) AS detail_length FROM attempt""")
def attempt_log(a: Archive) -> DataFrame:
    from casebook.session import work_folder
    from casebook.sources.exports import append_attempts

    folder = work_folder(a.spark, "attempts")
    append_attempts(a.attempt.withColumn("failure_detail", F.repeat(F.col("stage"), F.lit(300))), folder)
    return a.spark.read.parquet(folder).select("id", "stage", F.length("failure_detail").alias("detail_length"))


@query("snapshot_window", ("incident",), """
    SELECT id FROM incident WHERE event_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'""")
def snapshot_window(a: Archive) -> DataFrame:
    from casebook.sources.tables import snapshot

    cut = snapshot({"unique_event": a.incident}, dt.datetime(1997, 1, 1), dt.datetime(1997, 12, 31))
    return cut["unique_event"].select("id")


@query("geocode_attach", ("incident",), """
    SELECT i.id, CASE WHEN g.city IS NULL THEN 'none' ELSE 'google_maps' END AS geocoding_source, g.lat AS latitude
    FROM incident i LEFT JOIN (SELECT city, state, round(avg(latitude), 6) AS lat FROM incident
      WHERE latitude IS NOT NULL AND city IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2) g ON i.city = g.city AND i.state = g.state""")
def geocode_attach(a: Archive) -> DataFrame:
    from casebook.functions.places import address_query, input_precision
    from casebook.operators import geocode

    nothing = F.lit(None).cast("string")
    keyed = a.incident.drop("latitude", "longitude").withColumns({
        "query": F.when(F.col("state").isNotNull(), address_query(nothing, nothing, nothing, F.col("city"), F.col("state"), nothing)),
        "granularity": input_precision(nothing, nothing, nothing),
    })
    known = a.incident.where(
        F.col("latitude").isNotNull() & F.col("city").isNotNull() & F.col("state").isNotNull()
    ).groupBy("city", "state").agg(F.round(F.avg("latitude"), 6).alias("latitude"))
    responses = known.select(
        address_query(nothing, nothing, nothing, F.col("city"), F.col("state"), nothing).alias("query"),
        F.lit("centro da cidade").alias("granularity"), "latitude", F.lit("google_maps").alias("geocoding_source"),
    )
    return geocode.attach(keyed, responses).select("id", "geocoding_source", "latitude")


# --- streams, each run to the end of the input and compared with its batch result -----------------------------
def _stream(a: Archive, table: str) -> DataFrame:
    schema = a.table(table).schema
    return a.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(a.folder)


def _run(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Drain a stream into files (never into driver memory) and read them back."""
    folder = work_folder(stream.sparkSession, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    ingest.drain(stream, f"{folder}/state", write, mode)
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")


def _latest(out: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last emitted value per key (update mode emits a key more than once)."""
    return out.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


@query("stream_hour_counts", ("source",), """
    SELECT strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H') AS hour, status, count(*) AS count FROM source GROUP BY 1, 2""")
def stream_hour_counts(a: Archive) -> DataFrame:
    from casebook.plans.standins import SOURCE, spark_exprs

    rows = _stream(a, "events").selectExpr(*spark_exprs(SOURCE)).select("fetched_at", "status")
    out = _latest(_run(ingest.hourly_counts(rows, "fetched_at", "status"), "update", "hours"), ["hour", "status"], "count")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "status", "count")


@query("stream_rolling_counts", ("source",), """
    SELECT strftime(d, '%Y-%m-%d') AS start, count(*) AS count FROM generate_series(TIMESTAMP '2023-12-26', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d)
    JOIN source ON fetched_at >= d AND fetched_at < d + INTERVAL 7 DAY GROUP BY 1""")
def stream_rolling_counts(a: Archive) -> DataFrame:
    rows = _stream(a, "events").select(F.col("ts").alias("fetched_at"))
    out = _latest(_run(ingest.rolling_counts(rows, "fetched_at"), "update", "rolling"), ["start", "end"], "count")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "count")


@query("stream_dedupe", ("source",), "SELECT DISTINCT user_id FROM source")
def stream_dedupe(a: Archive) -> DataFrame:
    """The table arrives in one batch, so every repeat lies inside the watermark."""
    rows = _stream(a, "events").select("user_id", F.col("ts").alias("fetched_at"))
    return _run(ingest.deduplicated(rows, "fetched_at", ["user_id"]), "append", "dedupe").select("user_id")


@query("stream_request_limits", ("source",), """
    SELECT user_id, strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H') AS window_start, count(*) AS requests FROM source
    GROUP BY 1, 2 HAVING count(*) > 1""")
def stream_request_limits(a: Archive) -> DataFrame:
    rows = _stream(a, "events").select("user_id", F.col("ts").alias("fetched_at"))
    over = ingest.requests_over_limit(rows, "user_id", "fetched_at", 1, "1 hour")
    out = _latest(_run(over, "update", "limits"), ["user_id", "window_start"], "requests")
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "requests")


@query("stream_sharding", ("source",), """
    SELECT city, max(results) >= 100 AS needs_sharding, CASE WHEN max(results) >= 100 THEN 1 ELSE 0 END AS hit_limit_count,
      arg_max(results, fetched_at) AS last_result_count FROM source GROUP BY 1""")
def stream_sharding(a: Archive) -> DataFrame:
    from casebook.plans.standins import SOURCE, spark_exprs

    runs = ingest.event_time(_stream(a, "events").selectExpr(*spark_exprs(SOURCE)).select("city", "fetched_at", "results"), "fetched_at")
    out = _run(state.sharding_flags(runs), "update", "sharding")
    return out.groupBy("city").agg(
        F.max_by(F.struct("needs_sharding", "hit_limit_count", "last_result_count"), "batch").alias("s")
    ).select("city", "s.*")


@query("sharding_batch", ("source",), """
    SELECT city, max(results) >= 100 AS needs_sharding, CASE WHEN max(results) >= 100 THEN 1 ELSE 0 END AS hit_limit_count,
      arg_max(results, fetched_at) AS last_result_count FROM source GROUP BY 1""")
def sharding_batch(a: Archive) -> DataFrame:
    return state.sharding_batch(a.source.select("city", "fetched_at", "results")).drop("last_fetch_at")


@query("sharding_history", ("source",), """
    SELECT id, max(results) OVER (PARTITION BY city ORDER BY fetched_at, id ROWS UNBOUNDED PRECEDING) >= 100 AS needs_sharding FROM source""")
def sharding_history(a: Archive) -> DataFrame:
    return state.sharding_history(a.source.select("id", "city", "fetched_at", "results"), "id").select("id", "needs_sharding")


@query("stream_attempt_numbers", ("attempt",), """
    SELECT id, row_number() OVER (PARTITION BY source_google_news_id, stage ORDER BY created_at, id) AS attempt_no FROM attempt""")
def stream_attempt_numbers(a: Archive) -> DataFrame:
    from casebook.plans.standins import ATTEMPT, spark_exprs

    rows = ingest.event_time(_stream(a, "events").selectExpr(*spark_exprs(ATTEMPT)), "created_at")
    return _run(state.attempt_numbers(rows), "append", "attempts").select("id", "attempt_no")


@query("stream_stuck_alerts", ("source",), """
    SELECT id, status, 'ready_for_extraction' AS return_to FROM (
      SELECT user_id AS id, arg_max(status, (fetched_at, id)) AS status, max(fetched_at) AS since FROM source GROUP BY 1)
    WHERE status = 'extracting' AND since + INTERVAL 15 MINUTE < (SELECT max(fetched_at) FROM source) - INTERVAL 2 HOUR""")
def stream_stuck_alerts(a: Archive) -> DataFrame:
    from casebook.plans.standins import SOURCE, spark_exprs

    rows = _stream(a, "events").selectExpr(*spark_exprs(SOURCE)).select(F.col("user_id").alias("id"), "status", "updated_at")
    return _run(state.stuck_alerts(rows), "append", "stuck").select("id", "status", "return_to")


@query("stream_silences", ("source",), """
    SELECT user_id AS worker, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS silent_from FROM (
      SELECT user_id, fetched_at, lead(fetched_at) OVER (PARTITION BY user_id ORDER BY fetched_at) AS next FROM (SELECT DISTINCT user_id, fetched_at FROM source))
    WHERE next - fetched_at > INTERVAL 30 HOUR OR (next IS NULL AND fetched_at + INTERVAL 30 HOUR < (SELECT max(fetched_at) FROM source) - INTERVAL 2 HOUR)""")
def stream_silences(a: Archive) -> DataFrame:
    """Every silence of more than 30 hours between two signs of a user, and those that still last."""
    rows = _stream(a, "events").select(F.col("user_id").alias("worker"), F.col("ts").alias("seen_at"))
    out = _run(state.silence_alarms(rows, 30 * 60), "append", "silences")
    return out.select("worker", F.date_format("silent_from", "yyyy-MM-dd HH:mm:ss").alias("silent_from"))


@query("stream_components", (), """
    WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS a, o_custkey // 3 * 14 + CAST(floor(o_totalprice) AS BIGINT) % 7 * 2 + 1 AS b FROM orders),
    n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
    SELECT x AS id, min(y) AS component FROM r GROUP BY 1""")
def stream_components(a: Archive) -> DataFrame:
    """Customers tied together by neighbourhood and price class; edges arrive in three batches and fold into a stored table."""
    band = F.expr("o_custkey DIV 3 * 14 + CAST(floor(o_totalprice) AS BIGINT) % 7 * 2 + 1")
    edges = a.table("orders").select((F.col("o_custkey") * 2).alias("id_a"), band.alias("id_b"))
    folder = work_folder(a.spark, "components")
    edges.repartition(3, "id_b", "id_a").write.parquet(f"{folder}/in")
    table = resolve_stream.ComponentTable(folder, buckets=8)
    arriving = a.spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    ingest.drain(arriving, f"{folder}/state", table.fold)
    return table.components(a.spark)
