"""Sources, sinks, lifecycle, scoring and streaming on small inputs."""

import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions import taxonomy
from casebook.operators import filters, fusion, lifecycle, lists, merge, monitor, neardup, quality, ranking, scoring, stats
from casebook.sources import exports, feeds
from casebook.streaming import ingest, state

NOW = dt.datetime(2024, 6, 30, 12)


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def public(rows, spark):
    return spark.createDataFrame(
        [(i, "homicidio", "incident", v, s, d, 1.0, 1.0) for i, (v, s, d) in enumerate(rows)],
        "id long, event_family string, content_class string, victim_count int, state string, event_date timestamp_ntz, latitude double, longitude double",
    )


def test_overview_boundaries(spark):
    ages = [0, 7, 7.5, 30, 31, 400, -1]
    rows = [(1, "SP", NOW - dt.timedelta(days=a)) for a in ages] + [(1, None, None), (None, "SP", NOW), (11, "SP", NOW), (1, "Maule", NOW)]
    got = stats.overview(public(rows, spark), NOW, dt.date(2000, 1, 1)).first()
    assert (got["total"], got["last_7_days"], got["last_30_days"]) == (8, 2, 4)
    assert got["since"] == (NOW - dt.timedelta(days=31)).date()


def test_export_window_and_columns(spark):
    rows = [(1, "SP", dt.datetime(2024, 1, 31, 23, 59, 59)), (1, "SP", dt.datetime(2024, 2, 1)), (1, "SP", None)]
    df = public(rows, spark)
    assert df.where(filters.export_window(NOW, start="2024-01-31", end="2024-01-31")).count() == 1
    assert df.where(filters.export_window(NOW, end="2024-02-01")).count() == 2
    with pytest.raises(ValueError):
        filters.export_window(NOW, start="2024-02-02", end="2024-02-01")
    assert lists.export_columns(["title", "secret", "id"]) == ["title", "id"]
    with pytest.raises(ValueError):
        lists.export_columns(["secret"])
    assert len(fixed.EXPORT_COLUMNS) == 38


def test_csv_and_json_export(spark):
    df = public([(1, "SP", NOW - dt.timedelta(days=k)) for k in range(5)], spark)
    path = folder()
    exports.export_csv(df, F.lit(True), path + "/csv", ["id", "state"], cap=3)
    back = spark.read.option("header", True).csv(path + "/csv")
    assert back.columns == ["id", "state"] and back.count() == 3
    report = exports.export_json(df, F.lit(True), path + "/json", ["id"], cap=3).first()
    assert (report["exported"], report["truncated"]) == (3, True)


def test_pair_report_round_trip(spark):
    pairs = spark.createDataFrame(
        [(1, 1, 2, 0.9, "title_fuzzy", 'a "x"', "b", "Natal", dt.date(2024, 1, 1), 1, 5, 2), (1, 2, 3, 0.9, "title_fuzzy", "b", "c", "Natal", dt.date(2024, 1, 1), 5, 1, 2)],
        "group_id long, id_a long, id_b long, similarity double, signal string, title_a string, title_b string, city string, event_date date, "
        "source_count_a int, source_count_b int, suggested_survivor_id long",
    )
    path = folder()
    exports.write_pairs(pairs, path + "/pairs")
    members = neardup.members_from_pairs(exports.read_pairs(spark, path + "/pairs"))
    assert {r["id"]: (r["group_id"], r["survivor_id"]) for r in members.collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2)}


def test_label_documents(spark):
    path = folder()
    document = {"meta": {"v": "1"}, "cases": [{"id": "a", "tags": ["x"], "label_status": "labeled", "input": {"headline": "h"}, "expected": {"is_violent_death": True}},
                                              {"id": "b", "tags": [], "label_status": "pending", "input": {"headline": ""}}]}
    with open(path + "/f.json", "w") as f:
        json.dump(document, f, indent=1)
    cases = exports.read_cases(spark, path + "/f.json", "headline:string", "is_violent_death:boolean")
    flat = cases.select("id", "input.headline", "label_status", F.col("expected.is_violent_death").alias("expected"))
    assert scoring.label_counts(flat).first().asDict() == {"total": 2, "labeled": 1, "pending": 1}
    assert [tuple(r) for r in quality.fixture_violations(flat).collect()] == [("b", "empty_headline")]


def test_feed_entries(spark):
    path = folder()
    with open(path + "/e.json", "w") as f:
        for e in [{"id": "1", "link": "l", "title": "A - B", "source": {"href": "h"}, "_city": "Natal RN"}, {"link": "l2", "title": "C"}, {"title": "no id"}]:
            f.write(json.dumps(e) + "\n")
    got = feeds.normalise(feeds.read_entries(spark, path)).select("google_news_id", "headline", "publisher_name", "country").collect()
    assert {tuple(r) for r in got} == {("1", "A", "B", "BR"), ("l2", "C", None, "BR")}


def test_classification_and_gate(spark):
    sources = spark.createDataFrame([(1, "Corpo amarrado é achado"), (2, None), (3, "Vítima sobrevive"), (4, "Homem morto"), (5, "x")], "id long, headline string")
    predictions = spark.createDataFrame(
        [(1, False, True, "baixa", "r", None), (3, True, True, "alta", "r", None), (4, True, False, "alta", "r", "suicide")],
        "id long, is_violent_death boolean, is_single_incident boolean, confidence string, reasoning string, content_class_hint string",
    )
    got = {r["id"]: (r["status"], r["classification_reasoning"]) for r in lifecycle.classify(sources, predictions).collect()}
    assert got[1] == ("ready_for_download", f"r {fixed.NOTE_FORCED_POSITIVE}")
    assert got[2] == ("discarded", None)
    assert got[3] == ("discarded", f"r {fixed.NOTE_FORCED_NEGATIVE}")
    assert got[4] == ("discarded", "r [single_incident=false, hint=suicide]")
    assert got[5][0] == "ready_for_classification"


def test_running_total_and_hot_key(spark):
    rows = [(i, 1 if i % 3 else 2, "download", NOW + dt.timedelta(minutes=7 * i)) for i in range(60)]
    attempts = spark.createDataFrame(rows, "id long, source_google_news_id long, stage string, created_at timestamp_ntz")
    got = {r["id"]: r["attempt_no"] for r in ranking.attempt_numbers(attempts).collect()}
    seen, want = {}, {}
    for i, key, _, _ in rows:
        seen[key] = seen.get(key, 0) + 1
        want[i] = seen[key]
    assert got == want


def test_heartbeats(spark):
    beats = [(1, NOW + dt.timedelta(minutes=m), ok) for m, ok in enumerate([True] + [False] * 5 + [True, False])]
    got = monitor.heartbeat_misses(spark.createDataFrame(beats, "worker int, at timestamp_ntz, ok boolean"), "worker", "at", "ok").first()
    assert (got["longest_miss_run"], got["alarm"]) == (5, True)


def test_votes(spark):
    rows = [(1, 1, 2, " Natal "), (1, 2, 3, "Recife"), (1, 3, 3, "Natal"), (1, 4, 2, ""), (2, 5, None, None)]
    df = spark.createDataFrame(rows, "unique_event_id long, id long, victim_count int, city string")
    got = {r["unique_event_id"]: (r["victim_count"], r["city"]) for r in fusion.field_consensus(df).collect()}
    assert got == {1: (3, "Natal")}


def test_fusion_overwrites_context_and_keeps_known_fields(spark):
    rich = json.dumps({"victims": {"identifiable_victims": [{"name": "a", "is_security_force": True}]}, "homicide_dynamic": {"title": "t"}})
    poor = json.dumps({"homicide_dynamic": {"title": "t"}})
    incidents = spark.createDataFrame([(1, "old", "Natal", 1, None, False, True), (2, "keep", "Recife", 2, None, True, True)],
                                      "id long, title string, city string, victim_count int, merged_data string, security_force_victim boolean, needs_enrichment boolean")
    records = spark.createDataFrame([(10, 1, 3, "Natal", poor), (11, 1, 3, "Natal", rich)], "id long, unique_event_id long, victim_count int, city string, extraction_data string")
    synthesis = spark.createDataFrame([(1, None)], "id long, title string")
    got = {r["id"]: r for r in fusion.fuse(incidents, synthesis, records).collect()}
    assert (got[1]["title"], got[1]["victim_count"], got[1]["security_force_victim"], got[1]["needs_enrichment"]) == ("old", 3, True, False)
    assert got[1]["merged_data"] == rich
    assert (got[2]["title"], got[2]["security_force_victim"], got[2]["needs_enrichment"]) == ("keep", True, True)


def test_binary_scores_undefined_ratios(spark):
    cases = spark.createDataFrame([(False, False, None), (False, False, "timeout")], "expected boolean, actual boolean, error string")
    got = scoring.binary_scores(cases).first()
    assert (got["passed"], got["errors"], got["precision"], got["recall"], got["f1"]) == (1, 1, None, None, None)


def test_cluster_scores(spark):
    def part(rows):
        return spark.createDataFrame(rows, "case_id string, member int, cluster int")

    expected = part([("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 1, 1), ("b", 2, 2), ("c", 1, 1), ("c", 2, 1)])
    actual = part([("a", 1, 7), ("a", 2, 7), ("a", 3, 7), ("b", 1, 5), ("b", 2, 6), ("c", 1, 3), ("c", 2, 3)])
    got = {r["case_id"]: (r["exact"], round(r["precision"], 3), r["recall"]) for r in scoring.cluster_scores(expected, actual).collect()}
    assert got == {"a": (False, 0.333, 1.0), "b": (True, 1.0, 1.0), "c": (True, 1.0, 1.0)}


def test_partition_check(spark):
    cases = spark.createDataFrame([("a", 3, [[1, 3], [2]]), ("b", 3, [[1], [1, 2]])], "id string, n int, clusters array<array<int>>")
    assert [r["id"] for r in quality.partition_violations(cases).collect()] == ["b"]


def test_stuck_alert_stream_equals_batch(spark):
    path = folder()
    changes = [(1, "extracting", NOW), (2, "extracting", NOW), (2, "extracted", NOW + dt.timedelta(minutes=5)), (3, "discarded", NOW), (4, "extracting", NOW + dt.timedelta(hours=9))]
    spark.createDataFrame(changes[:3], "id long, status string, updated_at timestamp").coalesce(1).write.parquet(path + "/in/a")
    spark.createDataFrame(changes[3:], "id long, status string, updated_at timestamp").coalesce(1).write.parquet(path + "/in/b")
    stream = spark.readStream.schema("id long, status string, updated_at timestamp").option("recursiveFileLookup", True).parquet(path + "/in")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    ingest.drain(state.stuck_alerts(stream), path + "/state", write)
    assert {(r["id"], r["return_to"]) for r in spark.read.parquet(path + "/out").collect()} == {(1, "ready_for_extraction")}


def test_write_new_drops_known_ids(spark):
    path = folder()
    write = ingest.write_new(path + "/known", ["id"])
    write(spark.createDataFrame([(1,), (2,)], "id long"), 0)
    write(spark.createDataFrame([(2,), (3,)], "id long"), 1)
    assert sorted(r["id"] for r in spark.read.parquet(path + "/known").collect()) == [1, 2, 3]


def test_round_robin_is_balanced_and_seeded(spark):
    df = spark.createDataFrame([(i, "big" if i < 90 else f"s{i}") for i in range(95)], "id long, s string")
    picked = ranking.round_robin(df, "s", 12).collect()
    assert len(picked) == 12
    assert {r["s"] for r in picked} == {"big", "s90", "s91", "s92", "s93", "s94"}
    assert picked == ranking.round_robin(df, "s", 12).collect()


def test_stream_resolution_regroups_touched_buckets(spark):
    from casebook.streaming import resolve

    ddl = ("id long, title string, city string, event_date timestamp_ntz, neighborhood string, victims_summary string, "
           "chronological_description string, people array<struct<name:string>>, source_count int, content_class string")
    day = dt.datetime(2024, 1, 1)
    rows = [(1, "Morte no centro", "Natal", day, None, None, None, [], 1, None), (2, "Morte no centro", "natal", day, None, None, None, [], 3, None),
            (3, "Morte no centro", "Recife", day, None, None, None, [], 1, None), (4, "Morte no centro", "Recife", day, None, None, None, [], 1, None)]
    incidents = spark.createDataFrame(rows, ddl)
    seen = []
    run = resolve.resolver(lambda: incidents, lambda members, _: seen.extend(members.collect()))
    run(incidents.where("id = 1"), 0)
    assert {(r["id"], r["survivor_id"]) for r in seen} == {(1, 2), (2, 2)}


def test_resolution_pass_matches_then_clusters(spark):
    from casebook.operators import resolve

    day = dt.datetime(2024, 1, 1)
    ddl = "id long, unique_event_id long, deduplication_status string, city string, state string, neighborhood string, event_date timestamp_ntz, title string, " \
          "chronological_description string, names array<string>, homicide_type string, event_family string, event_subtype string, content_class string, " \
          "method_of_death string, date_precision string, time_of_day string, victim_count int, identified_victim_count int, perpetrator_count int, " \
          "security_force_involved boolean, security_force_victim boolean, extraction_data string, created_at timestamp_ntz"

    def raw(i, title, names):
        return (i, None, "pending", "Natal", "RN", None, day, title, None, names, "Homicídio", None, None, "incident", None, None, None, 1, None, None, None, None, None, day)

    records = spark.createDataFrame([raw(1, "Morte no centro", []), raw(2, "Briga em bar", ["ana lima"]), raw(3, "Outro caso", ["ana lima"])], ddl)
    incidents = spark.createDataFrame(
        [(100, "Morte no centro", "Natal", day, None, None, None, [], [], 1, "incident", False)],
        "id long, title string, city string, event_date timestamp_ntz, neighborhood string, victims_summary string, chronological_description string, "
        "people array<struct<name:string>>, names array<string>, source_count int, content_class string, needs_enrichment boolean")
    matches = spark.createDataFrame([(1, 100, True, 0.9), (2, 100, True, 0.3)], "raw_id long, unique_id long, match boolean, confidence double")
    linked, merged, summary = resolve.resolve_pending(records, incidents, day, matches)
    assert {r["id"]: (r["unique_event_id"], r["deduplication_status"]) for r in linked.collect()} == {
        1: (100, "matched"), 2: (2, "clustered"), 3: (2, "clustered"),
    }
    assert {r["id"]: r["source_count"] for r in merged.collect()} == {100: 2, 2: 2}
    assert {r["step"]: r["rows"] for r in summary.collect()} == {"matched_to_existing": 1, "incidents_created": 1, "groups": 1, "near_merged": 0}


@pytest.mark.parametrize("label", [
    *fixed.LEGACY_LABELS, "Tentativa de feminicídio", "tentativa de latrocínio", "Tentativa", "Policial vitimado", "Homicidio de policial",
    "Homicídio culposo no trânsito", "culposo transito", "Acidente de trânsito", "acidente transito", "nada", "",
])
def test_label_rules_agree_on_driver_and_column(spark, label):
    row = spark.createDataFrame([(label,)], "l string").select(taxonomy.legacy_to_pair(F.col("l")).alias("p")).first()["p"]
    assert tuple(row) == taxonomy.label_pair(label)


def test_type_filter_forms(spark):
    rows = spark.createDataFrame([
        (1, "homicidio", "simples", "Homicídio", True), (2, "tentativa", "feminicidio", None, False), (3, None, None, "Feminicídio", None),
        (4, "homicidio", "feminicidio", None, None),
    ], "id int, event_family string, event_subtype string, homicide_type string, security_force_victim boolean")

    def ids(value):
        return sorted(r["id"] for r in rows.where(filters.type_filter(value)).collect())

    assert ids("Policial Vitimado") == [1]
    assert ids("feminicidio") == [2, 4]
    assert ids("tentativa:feminicidio") == [2]
    assert ids("Feminicídio") == [3, 4]


def test_merge_requests_that_cannot_be_met_are_reported(spark):
    incidents = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    asked = [(1, 2), (2, 3), (4, 5), (5, 4), (6, 7), (8, 7), (99, 1), (1, 98), (3, 3)]
    merged, skipped = merge.plan_from_ids(incidents, spark.createDataFrame(asked, "survivor_id long, loser_id long"))
    assert sorted(tuple(r) for r in merged.select("loser_id", "survivor_id").collect()) == [(2, 1), (3, 1), (7, 6)]
    assert sorted(tuple(r) for r in skipped.collect()) == [
        (1, 98, "loser_missing"), (4, 5, "ring_of_requests"), (5, 4, "ring_of_requests"), (8, 7, "loser_promised_twice"), (99, 1, "survivor_missing"),
    ]


def test_date_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "incidents")
    spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-02 10:00:00' AS event_date, 'x' AS city, 'y' AS state").write.parquet(path)
    df = spark.read.parquet(path)
    for condition in (
        filters.batch_filter(start=dt.date(2024, 1, 1), end=dt.date(2024, 1, 2)),
        filters.Facets(start="2024-01-01", end="2024-01-02").condition(),
    ):
        found = df.where(condition)
        assert found.count() == 1
        pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters:")[1]
        assert "GreaterThanOrEqual(event_date" in pushed and "LessThan(event_date" in pushed


def _files(spark, rows, ddl, name):
    """A stream over a folder, and a way to add rows to it as one more file."""
    path = folder()

    def add(more):
        more = more if hasattr(more, "write") else spark.createDataFrame(more, ddl)
        more.coalesce(1).write.mode("append").parquet(f"{path}/in")

    def drained(build):
        """Start (or restart from the checkpoint) and read all that was written so far."""
        def write(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{path}/out/{name}/batch={batch_id}")

        source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        ingest.drain(build(source), f"{path}/state", write)
        return spark.read.parquet(f"{path}/out/{name}")

    add(rows)
    return add, drained


def test_attempt_numbers_go_on_after_a_restart_and_beyond_one_arrow_batch(spark):
    rows = spark.range(25_000).select(
        ((F.col("id") * 7919) % 25_000).alias("id"), F.lit(1).cast("long").alias("source_google_news_id"), F.lit("download").alias("stage"))
    timed = rows.withColumn("created_at", F.timestamp_seconds(1_700_000_000 + F.col("id")))
    add, drained = _files(spark, timed.where("id < 20000"), timed.schema.simpleString()[7:-1].replace(":", " "), "numbers")
    assert drained(state.attempt_numbers).count() == 20_000
    add(timed.where("id >= 20000"))
    got = drained(state.attempt_numbers)
    assert got.count() == 25_000 and got.where("attempt_no <> id + 1").count() == 0
    assert got.where(F.col("can_retry") != (F.col("attempt_no") < fixed.RETRY_MAX_ATTEMPTS)).count() == 0


def test_a_batch_writes_state_for_its_own_keys_only(spark):
    """State rows updated by a batch follow its keys, not all keys ever seen."""
    every = spark.range(500).select("id", F.col("id").alias("source_google_news_id"), F.lit("download").alias("stage"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("created_at"))
    path = folder()
    every.coalesce(1).write.parquet(f"{path}/in")
    updated = []
    for _ in range(2):
        source = spark.readStream.schema(every.schema).parquet(f"{path}/in")
        run = ingest.drain(state.attempt_numbers(source), f"{path}/state", lambda batch, _: batch.write.format("noop").mode("overwrite").save())
        updated.append(sum(p["stateOperators"][0]["numRowsUpdated"] for p in run.recentProgress if p["numInputRows"]))
        every.where("id < 3").coalesce(1).write.mode("append").parquet(f"{path}/in")
    assert updated[0] >= 500 and updated[1] <= 10


def test_timers_survive_a_restart(spark):
    ddl = "id long, status string, updated_at timestamp"
    at = lambda minutes: NOW + dt.timedelta(minutes=minutes)
    add, drained = _files(spark, [(1, "extracting", at(0)), (2, "downloading", at(0))], ddl, "stuck")
    assert drained(state.stuck_alerts).count() == 0
    add([(2, "ready_for_extraction", at(10)), (3, "discarded", at(11))])
    assert drained(state.stuck_alerts).count() == 0
    add([(9, "discarded", at(600))])
    assert {(r["id"], r["status"], r["return_to"]) for r in drained(state.stuck_alerts).collect()} == {(1, "extracting", "ready_for_extraction")}


def test_silence_is_reported_once_while_it_lasts(spark):
    at = lambda minutes: NOW + dt.timedelta(minutes=minutes)
    build = lambda stream: state.silence_alarms(stream, 60)
    add, drained = _files(spark, [(1, at(0)), (1, at(30)), (2, at(0)), (2, at(90)), (2, at(100)), (3, at(0))], "worker long, seen_at timestamp", "silent")
    assert {(r["worker"], r["silent_from"]) for r in drained(build).collect()} == {(2, at(0))}
    add([(1, at(400)), (3, at(20))])  # 1 was silent from 30; the watermark passes 3's timer and 2's
    add([(2, at(410)), (1, at(420))])
    found = sorted((r["worker"], r["silent_from"]) for r in drained(build).collect())
    assert found == [(1, at(30)), (2, at(0)), (2, at(100)), (3, at(20))]
    add([(3, at(900))])  # the silence of 3 from 20 was reported already; others are silent from their last sign
    found = sorted((r["worker"], r["silent_from"]) for r in drained(build).collect())
    assert found == [(1, at(30)), (1, at(420)), (2, at(0)), (2, at(100)), (2, at(410)), (3, at(20))]


def test_write_new_reads_only_its_buckets(spark):
    path = folder()
    write = ingest.write_new(path + "/known", ["id"], buckets=8)
    write(spark.range(100), 0)
    write(spark.range(50, 120), 1)
    known = spark.read.parquet(path + "/known")
    assert known.count() == 120 and known.select("id").distinct().count() == 120


def test_database_round_trip_in_id_ranges(spark):
    """Written in batches and read back by several tasks through an embedded database."""
    from casebook.sources import tables

    url = f"jdbc:derby:{folder()}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(1000).select(F.col("id"), F.concat(F.lit("cidade "), F.col("id") % 7).alias("city"), (F.col("id") / 4).alias("value"))
    tables.write_jdbc(rows.coalesce(1), url, "incident", batch_size=100, mode="overwrite", **driver)
    tables.write_jdbc(rows.where("id < 3").withColumn("id", F.col("id") + 2000).coalesce(1), url, "incident", **driver)
    got = tables.read_jdbc(spark, url, "incident", partitions=4, **driver)
    assert got.rdd.getNumPartitions() == 4
    got = got.toDF("id", "city", "value")
    want = rows.unionByName(rows.where("id < 3").withColumn("id", F.col("id") + 2000))
    assert got.exceptAll(want).count() == 0 and got.count() == 1003
    tables.write_jdbc(rows.where("id < 0").coalesce(1), url, "nothing", mode="overwrite", **driver)
    assert tables.read_jdbc(spark, url, "nothing", **driver).count() == 0
