"""Queries of readers, sinks, projections and column rules that no other catalog covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions import names, places
from casebook.functions.text import fold
from casebook.operators import anomalies, fusion, lists, merge, quality
from casebook.plans.catalog_text import fold_sql
from casebook.plans.registry import query
from casebook.plans.standins import Archive
from casebook.session import work_folder
from casebook.sources import exports, feeds, tables


# --- readers and sinks ------------------------------------------------------------------------
@query("declared_schema_read", ("incident",), "SELECT id, city, state, title, NULL::VARCHAR AS street FROM incident")
def declared_schema_read(a: Archive) -> DataFrame:
    """Columns that the files lack come back as NULL of the declared type."""
    root = work_folder(a.spark, "archive")
    a.incident.select("id", "city", "state", "title").write.parquet(f"{root}/unique_event")
    return tables.read_table(a.spark, root, "unique_event").select("id", "city", "state", "title", "street")


@query("csv_read", ("headline",), "SELECT conv_id, turn, nullif(headline, '') AS headline FROM headline")
def csv_read(a: Archive) -> DataFrame:
    """All headlines go through CSV, those with line ends and quotes included."""
    return headlines_through_csv(a.headline.select("conv_id", "turn", "headline"), work_folder(a.spark, "headlines"))


def headlines_through_csv(lines: DataFrame, path: str) -> DataFrame:
    """Rows of (conv_id, turn, headline), written to a folder of CSV files and read again, a task per file.

    CSV does not tell an empty cell from a null one: both come back as null.
    """
    lines.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_csv(lines.sparkSession, path, "conv_id bigint, turn bigint, headline string", multi_line=True)


@query("csv_export", ("incident",), "SELECT id, city, state FROM incident WHERE city IS NOT NULL AND state IS NOT NULL")
def csv_export(a: Archive) -> DataFrame:
    path = work_folder(a.spark, "export")
    exports.export_csv(a.incident, F.col("city").isNotNull() & F.col("state").isNotNull(), path, ["id", "city", "state"])
    return tables.read_csv(a.spark, path, "id bigint, city string, state string")


@query("json_export_report", ("incident",), "SELECT count(*) AS exported, FALSE AS truncated FROM incident WHERE city IS NOT NULL")
def json_export_report(a: Archive) -> DataFrame:
    return exports.export_json(a.incident, F.col("city").isNotNull(), work_folder(a.spark, "export"), ["id", "city"])


@query("case_documents", ("scored",), """
    SELECT CAST(id AS VARCHAR) AS id, CASE WHEN error IS NULL THEN 'labeled' ELSE 'pending' END AS label_status, fixture AS headline, expected AS match
    FROM scored""")
def case_documents(a: Archive) -> DataFrame:
    """Label documents written one per line and read back case by case."""
    case = F.struct(
        F.col("id").cast("string").alias("id"), F.col("tags").alias("tags"),
        F.when(F.col("error").isNull(), "labeled").otherwise("pending").alias("label_status"),
        F.struct(F.col("fixture").alias("headline")).alias("input"), F.struct(F.col("expected").alias("match")).alias("expected"),
    )
    document = F.to_json(F.struct(F.create_map(F.lit("stage"), F.col("stage")).alias("meta"), F.array(case).alias("cases")))
    path = work_folder(a.spark, "cases")
    a.scored.select(document.alias("value")).write.text(path)
    cases = exports.read_cases(a.spark, path, "headline string", "match boolean", multi_line=False)
    return cases.select("id", "label_status", "input.headline", "expected.match")


@query("countries_together", ("incident",), """
    SELECT id, city, NULL::VARCHAR AS state FROM incident WHERE country = 'Chile'
    UNION ALL SELECT id, NULL, state FROM incident WHERE country <> 'Chile'""")
def countries_together(a: Archive) -> DataFrame:
    return feeds.union_countries([
        a.incident.where("country = 'Chile'").select("id", "city"), a.incident.where("country <> 'Chile'").select("id", "state"),
    ])


# --- projections and joins ----------------------------------------------------------------------
@query("incident_detail", ("incident",), """
    SELECT id, event_date, time_of_day, country, state, city, neighborhood, event_family, event_subtype, homicide_type, method_of_death,
      victim_count, victims_summary, perpetrator_count, security_force_involved, security_force_victim, title, chronological_description,
      nullif(latitude, 0) AS latitude, nullif(longitude, 0) AS longitude, source_count, created_at, updated_at FROM incident""")
def incident_detail(a: Archive) -> DataFrame:
    return lists.detail(a.incident)


@query("fusion_input", ("raw", "article"), """
    SELECT raw.id, article.publisher_name, article.resolved_url AS url, length(article.content) AS chars
    FROM raw LEFT JOIN article ON raw.source_google_news_id = article.id""")
def fusion_input(a: Archive) -> DataFrame:
    sources = a.article.withColumn("headline", F.lit(None).cast("string"))
    return fusion.fusion_input(a.raw, sources).select("id", "publisher_name", "url", F.length("content").alias("chars"))


@query("affected_incidents", ("incident",), f"""
    SELECT city, day, component, size - 1 AS pairs, size AS incidents FROM (
      SELECT coalesce(any_value(city), '?') AS city, strftime(min(event_date), '%Y-%m-%d') AS day, min(id) AS component, count(*) AS size
      FROM incident WHERE {fold_sql('title')} <> '' AND {fold_sql('city')} <> '' AND event_date IS NOT NULL
      GROUP BY {fold_sql('title')}, {fold_sql('city')}, CAST(event_date AS DATE)) WHERE size > 1""")
def affected_incidents(a: Archive) -> DataFrame:
    groups = merge.exact_groups(a.incident).where("id <> group_id").select(F.col("group_id").alias("id_a"), F.col("id").alias("id_b"))
    placed = a.incident.select(F.col("id").alias("id_a"), "city", "event_date")
    return anomalies.affected_incidents(groups.join(placed, "id_a")).select("city", "day", "component", "pairs", "incidents")


# --- column rules ---------------------------------------------------------------------------------
@query("name_key_overlap", ("raw", "incident"), f"""
    WITH p AS (SELECT r.id AS raw_id, i.id AS unique_id, {fold_sql('r.name')} AS x, {fold_sql("split_part(i.victims_summary, ',', 1)")} AS y
      FROM raw r JOIN incident i ON r.unique_event_id = i.id WHERE r.name IS NOT NULL AND i.victims_summary IS NOT NULL)
    SELECT raw_id, unique_id, x = y OR (length(x) > 5 AND length(y) > 5 AND (contains(x, y) OR contains(y, x))) AS overlap FROM p""")
def name_key_overlap(a: Archive) -> DataFrame:
    pairs = a.raw.where("name IS NOT NULL").select(F.col("id").alias("raw_id"), F.col("unique_event_id").alias("unique_id"), "name").join(
        a.incident.where("victims_summary IS NOT NULL").select(F.col("id").alias("unique_id"), "victims_summary"), "unique_id")
    mine, theirs = F.array(fold(F.col("name"))), F.array(fold(F.substring_index("victims_summary", ",", 1)))
    return pairs.select("raw_id", "unique_id", names.keys_overlap(mine, theirs).alias("overlap"))


def _cue_terms() -> str:
    return " + ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {1 << i} ELSE 0 END" for i, p in enumerate(fixed.CONTEXT_CUES))


@query("circumstance_cues", ("article",), f"""
    SELECT id, CASE WHEN length(t) >= 40 THEN {_cue_terms()} ELSE 0 END AS cues
    FROM (SELECT id, {fold_sql("content || ' com ' || (10 + id % 90) || ' tiros'")} AS t FROM article)""")
def circumstance_cues(a: Archive) -> DataFrame:
    told = F.concat("content", F.lit(" com "), (10 + F.col("id") % 90).cast("string"), F.lit(" tiros"))
    return a.article.select("id", names.context_cues(names.context_text(told, F.lit(None), F.lit(None))).alias("cues"))


@query("address_text", ("incident",), """
    SELECT id, CASE WHEN city IS NOT NULL AND city <> '' THEN concat_ws(', ', nullif(neighborhood, ''), nullif(city, ''), nullif(state, ''),
      coalesce(nullif(country, ''), 'Brasil')) END AS address FROM incident""")
def address_text(a: Archive) -> DataFrame:
    none = F.lit(None).cast("string")
    return a.incident.select("id", places.address_query(
        none, none, F.col("neighborhood"), F.col("city"), F.col("state"), F.col("country")).alias("address"))


_KINDS = ["street_address", "route", "neighborhood", "locality", "country", "establishment"]
_PLACES = ["ROOFTOP", "RANGE_INTERPOLATED", "GEOMETRIC_CENTER", "APPROXIMATE"]


@query("geocoder_results", ("incident",), """
    WITH g AS (SELECT id, ['street_address', 'route', 'neighborhood', 'locality', 'country', 'establishment'][id % 6 + 1] AS kind,
        ['ROOFTOP', 'RANGE_INTERPOLATED', 'GEOMETRIC_CENTER', 'APPROXIMATE'][id % 4 + 1] AS place FROM incident),
    p AS (SELECT *, CASE WHEN kind = 'locality' THEN 'centro da cidade' WHEN kind = 'neighborhood' THEN 'centro do bairro'
        WHEN kind IN ('street_address', 'establishment') OR place = 'ROOFTOP' THEN 'exato'
        WHEN kind = 'route' OR place IN ('RANGE_INTERPOLATED', 'GEOMETRIC_CENTER') THEN 'aproximado' ELSE 'centro da cidade' END AS own FROM g)
    SELECT id, CASE WHEN own = 'exato' THEN 'aproximado' ELSE own END AS location_precision,
      CAST(CASE place WHEN 'ROOFTOP' THEN 0.95 WHEN 'RANGE_INTERPOLATED' THEN 0.75 WHEN 'GEOMETRIC_CENTER' THEN 0.55 ELSE 0.4 END AS DOUBLE) AS confidence,
      CAST(CASE kind WHEN 'country' THEN 3.6 WHEN 'street_address' THEN 13.0 WHEN 'route' THEN 13.0 WHEN 'neighborhood' THEN 13.0 ELSE 11.0 END AS DOUBLE) AS zoom
    FROM p""")
def geocoder_results(a: Archive) -> DataFrame:
    """Precision, confidence and zoom of geocoder results, at best as fine as an address that is only approximate."""
    choose = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values) + 1).cast("int"))
    result = F.to_json(F.struct(
        F.array(choose(_KINDS)).alias("types"),
        F.struct(F.struct(F.lit(-10.5).alias("lat"), F.lit(-50.25).alias("lng")).alias("location"), choose(_PLACES).alias("location_type")).alias("geometry"),
    ))
    fields = places.geocode_fields(result, F.lit("aproximado"))
    return a.incident.select("id", fields.alias("g")).select(
        "id", "g.location_precision", F.col("g.geocoding_confidence").cast("double").alias("confidence"), F.col("g.zoom").cast("double").alias("zoom"))


@query("postal_codes", ("incident",), """
    SELECT id, CASE WHEN length(d) = 8 THEN substr(d, 1, 5) || '-' || substr(d, 6, 3) END AS code, 'rua ' || id || ' centro' AS cache_key
    FROM (SELECT id, CAST(10000000 * (id % 3) + id * 37 AS VARCHAR) AS d FROM incident)""")
def postal_codes(a: Archive) -> DataFrame:
    number = (10_000_000 * (F.col("id") % 3) + F.col("id") * 37).cast("string")
    written = F.concat_ws(" ", F.substring(number, 1, 3), F.substring(number, 4, 2), F.concat(F.lit("- "), F.expr(f"substring(CAST({10_000_000} * (id % 3) + id * 37 AS STRING), 6)")))
    address = F.concat(F.lit("  RUA "), F.col("id").cast("string"), F.lit("  \t Centro "))
    return a.incident.select("id", places.postal_code(written).alias("code"), places.geocode_cache_key(address).alias("cache_key"))


# --- label checks -----------------------------------------------------------------------------------
@query("cluster_partitions", ("scored",), "SELECT id, 'not_a_partition' AS rule FROM scored WHERE id % 4 <> 0")
def cluster_partitions(a: Archive) -> DataFrame:
    """Clusters that lack, repeat or add a member are no partition of 1..3."""
    parts = [[[1, 2], [3]], [[1], [3]], [[1, 2], [2, 3]], [[1, 2, 3], [4]]]
    shown = F.array(*[F.array(*[F.array(*[F.lit(n) for n in c]) for c in p]) for p in parts])
    cases = a.scored.select("id", F.lit(3).alias("n"), F.element_at(shown, (F.col("id") % 4 + 1).cast("int")).alias("clusters"))
    return quality.partition_violations(cases)


@query("expected_candidates", ("scored",), "SELECT id, 'expected_not_candidate' AS rule FROM scored WHERE expected AND id % 5 NOT IN (id % 3, id % 7)")
def expected_candidates(a: Archive) -> DataFrame:
    cases = a.scored.select(
        "id", F.col("expected").alias("match"), F.array(F.col("id") % 3, F.col("id") % 7).alias("candidate_ids"), (F.col("id") % 5).alias("expected_id"))
    return quality.expected_in_candidates(cases)


