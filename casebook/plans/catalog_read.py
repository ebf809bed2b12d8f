"""Queries of the read side: scopes, statistics, portal facets, places, lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions import dates, places, taxonomy
from casebook.functions.places import Bounds
from casebook.operators import filters, lists, portal, stats
from casebook.operators.filters import Facets
from casebook.plans.registry import query
from casebook.plans.standins import EVENTS_AS_OF, ORDERS_AS_OF, Archive

UFS = ", ".join(f"'{s}'" for s in fixed.BR_STATES)
PUBLIC = (
    "event_family = 'homicidio' AND content_class = 'incident' AND victim_count <= 10 "
    f"AND (state IN ({UFS}) OR state IS NULL)"
)
AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
EV_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "strftime({}, '%Y-%m-%d')"
BOX = Bounds(-20.0, -60.0, -10.0, -45.0)
IN_BOX = "latitude BETWEEN -20.0 AND -10.0 AND longitude BETWEEN -60.0 AND -45.0"
LAT, LNG, RADIUS = -15.0, -50.0, 500.0
DISTANCE = (
    "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(latitude - (-15.0)) / 2), 2) + cos(radians(-15.0)) "
    "* cos(radians(latitude)) * pow(sin(radians(longitude - (-50.0)) / 2), 2))))"
)
SUBTYPE = (
    "CASE WHEN event_subtype IN ('simples','qualificado','feminicidio','latrocinio','infanticidio',"
    "'intervencao_policial','morte_transito_doloso') THEN event_subtype ELSE 'simples' END"
)


def day_text(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


# --- statistics -----------------------------------------------------------------------
@query("overview_counts", ("incident",), f"""
    SELECT count(*) AS total,
      count(*) FILTER (event_date BETWEEN {AS_OF} - INTERVAL 7 DAY AND {AS_OF}) AS last_7_days,
      count(*) FILTER (event_date BETWEEN {AS_OF} - INTERVAL 30 DAY AND {AS_OF}) AS last_30_days,
      strftime(coalesce(min(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL
        AND event_date BETWEEN {AS_OF} - INTERVAL 365 DAY AND {AS_OF} THEN event_date END),
        TIMESTAMP '2000-01-01'), '%Y-%m-%d') AS since
    FROM incident WHERE {PUBLIC}""")
def overview_counts(a: Archive) -> DataFrame:
    out = stats.overview(a.incident, ORDERS_AS_OF, dt.date(2000, 1, 1))
    return out.withColumn("since", day_text("since"))


@query("by_type_pct", ("incident",), """
    SELECT type, count, round(count * 100.0 / sum(count) OVER (), 1) AS percent FROM (
      SELECT coalesce(homicide_type, 'Não classificado') AS type, count(*) AS count FROM incident GROUP BY 1)""")
def by_type_pct(a: Archive) -> DataFrame:
    return stats.by_type(a.incident)


@query("public_by_type_pct", ("incident",), f"""
    SELECT type, count, round(count * 100.0 / sum(count) OVER (), 1) AS percent FROM (
      SELECT coalesce(homicide_type, 'Não classificado') AS type, count(*) AS count
      FROM incident WHERE {PUBLIC} GROUP BY 1)""")
def public_by_type_pct(a: Archive) -> DataFrame:
    return stats.by_type(a.incident.where(filters.public_incident()))


@query("by_state", ("incident",), "SELECT state, count(*) AS count FROM incident WHERE state IS NOT NULL GROUP BY 1")
def by_state(a: Archive) -> DataFrame:
    return stats.by_state(a.incident)


@query("by_day", ("incident",), f"""
    SELECT {DAY.format('event_date')} AS day, count(*) AS count FROM incident
    WHERE {PUBLIC} AND event_date >= {AS_OF} - INTERVAL 90 DAY GROUP BY 1""")
def by_day(a: Archive) -> DataFrame:
    return stats.by_day(a.incident, ORDERS_AS_OF, 90).withColumn("day", day_text("day"))


@query("tri_state", ("incident",), """
    SELECT count(*) FILTER (security_force_involved) AS involved,
      count(*) FILTER (NOT security_force_involved) AS not_involved,
      count(*) FILTER (security_force_involved IS NULL) AS unknown FROM incident""")
def tri_state(a: Archive) -> DataFrame:
    return stats.security_force(a.incident)


@query("incident_summary", ("incident",), """
    SELECT count(*) AS total, CAST(sum(victim_count) AS BIGINT) AS victims,
      count(*) FILTER (latitude IS NOT NULL AND longitude IS NOT NULL) AS geocoded,
      count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (security_force_involved) AS security
    FROM incident""")
def incident_summary(a: Archive) -> DataFrame:
    return stats.incident_summary(a.incident)


@query("daily_dense", ("incident",), f"""
    SELECT strftime(d, '%Y-%m-%d') AS day, CAST(coalesce(sum(victim_count), 0) AS BIGINT) AS victims
    FROM generate_series({AS_OF} - INTERVAL 60 DAY, {AS_OF}, INTERVAL 1 DAY) g(d)
    LEFT JOIN incident ON event_date >= d AND event_date < d + INTERVAL 1 DAY AND event_date <= {AS_OF}
    GROUP BY 1""")
def daily_dense(a: Archive) -> DataFrame:
    return stats.daily_victims(a.incident, ORDERS_AS_OF, 60).withColumn("day", day_text("day"))


@query("record_summary", ("raw",), """
    SELECT 'type' AS dimension, coalesce(homicide_type, 'Não classificado') AS label, count(*) AS count FROM raw GROUP BY 2
    UNION ALL
    SELECT 'city', city, count FROM (SELECT city, count(*) AS count FROM raw WHERE city IS NOT NULL GROUP BY 1
      ORDER BY 2 DESC, 1 LIMIT 10)
    UNION ALL SELECT 'total', 'total', count(*) FROM raw
    UNION ALL SELECT 'total', 'security', count(*) FILTER (security_force_involved) FROM raw""")
def record_summary(a: Archive) -> DataFrame:
    return stats.record_summary(a.raw)


@query("status_counts", ("source",), """
    SELECT status, count(*) AS count, CAST(grouping(status) AS TINYINT) AS is_total FROM source GROUP BY ROLLUP (status)""")
def status_counts(a: Archive) -> DataFrame:
    return stats.status_counts(a.source)


@query("hour_status_pivot", ("source",), f"""
    SELECT strftime(date_trunc('hour', fetched_at), '%Y-%m-%d %H:00') AS hour,
      {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in fixed.HOURLY_STATUSES)},
      count(*) AS total
    FROM source WHERE fetched_at >= {EV_AS_OF} - INTERVAL 168 HOUR GROUP BY 1""")
def hour_status_pivot(a: Archive) -> DataFrame:
    return stats.hourly_status(a.source, EVENTS_AS_OF, 168)


@query("dashboard_counts", ("source", "raw", "incident"), f"""
    {' UNION ALL '.join(f"SELECT '{s}' AS counter, count(*) FILTER (status = '{s}') AS value FROM source"
                         for s in fixed.SOURCE_STATUSES)}
    UNION ALL SELECT 'positive', count(*) FILTER (is_violent_death) FROM source
    UNION ALL SELECT 'negative', count(*) FILTER (NOT is_violent_death) FROM source
    UNION ALL SELECT 'sources', count(*) FROM source
    UNION ALL SELECT 'records', count(*) FROM raw UNION ALL SELECT 'incidents', count(*) FROM incident""")
def dashboard_counts(a: Archive) -> DataFrame:
    return stats.dashboard(a.source, a.raw, a.incident, fixed.SOURCE_STATUSES)


@query("run_funnel", ("source", "raw", "incident"), """
    SELECT 'sources' AS stage, count(*) AS count FROM source
    UNION ALL SELECT 'classified', count(*) FROM source WHERE is_violent_death IS NOT NULL
    UNION ALL SELECT 'downloaded', count(*) FROM source
      WHERE status IN ('ready_for_extraction', 'extracting', 'failed_in_extraction', 'extracted')
    UNION ALL SELECT 'extracted', count(*) FROM source WHERE status = 'extracted'
    UNION ALL SELECT 'records', count(*) FROM raw UNION ALL SELECT 'incidents', count(*) FROM incident""")
def run_funnel(a: Archive) -> DataFrame:
    return stats.funnel(a.source, a.raw, a.incident)


@query("period_change", ("incident",), """
    SELECT period, count, lag(count) OVER (ORDER BY period) AS previous,
      round((count - lag(count) OVER (ORDER BY period)) * 100.0 / lag(count) OVER (ORDER BY period), 1) AS change_pct
    FROM (SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(event_date AS DATE)) / 30) AS BIGINT) AS period,
      count(*) AS count FROM incident WHERE event_date IS NOT NULL GROUP BY 1)""")
def period_change(a: Archive) -> DataFrame:
    return stats.period_change(a.incident, "event_date", 30)


@query("taxonomy_audit", ("raw",), """
    SELECT homicide_type, count(*) AS count,
      CASE homicide_type WHEN 'Tentativa de Homicídio' THEN 'tentativa' WHEN 'Tentativa de feminicídio' THEN 'tentativa'
        WHEN 'Homicídio Culposo' THEN 'acidente_fatal' WHEN 'Outro' THEN 'nao_classificado'
        ELSE CASE WHEN homicide_type IS NULL THEN 'nao_classificado' ELSE 'homicidio' END END AS family,
      CASE homicide_type WHEN 'Homicídio' THEN 'simples' WHEN 'Homicídio Qualificado' THEN 'qualificado'
        WHEN 'Feminicídio' THEN 'feminicidio' WHEN 'Latrocínio' THEN 'latrocinio' WHEN 'Infanticídio' THEN 'infanticidio'
        WHEN 'Intervenção policial' THEN 'intervencao_policial' WHEN 'Morte no trânsito' THEN 'morte_transito_doloso'
        WHEN 'Tentativa de Homicídio' THEN 'simples' WHEN 'Tentativa de feminicídio' THEN 'feminicidio'
        WHEN 'Homicídio Culposo' THEN 'culposo' ELSE 'outro' END AS subtype
    FROM raw GROUP BY 1""")
def taxonomy_audit(a: Archive) -> DataFrame:
    return stats.taxonomy_audit(a.raw)


@query("new_incident_digest", ("incident",), """
    WITH c AS (SELECT state, city, row_number() OVER (PARTITION BY state ORDER BY city) r,
        count(*) OVER (PARTITION BY state) n
      FROM (SELECT DISTINCT state, city FROM incident WHERE city IS NOT NULL AND state IS NOT NULL)),
    i AS (SELECT state, id, row_number() OVER (PARTITION BY state ORDER BY id) r FROM incident WHERE state IS NOT NULL)
    SELECT s.state, s.count, cc.cities, cc.cities_more, ii.ids, greatest(s.count - 5, 0) AS ids_more
    FROM (SELECT state, count(*) AS count FROM incident WHERE state IS NOT NULL GROUP BY 1) s
    JOIN (SELECT state, string_agg(city, ', ' ORDER BY city) AS cities, greatest(max(n) - 5, 0) AS cities_more
      FROM c WHERE r <= 5 GROUP BY 1) cc ON s.state = cc.state
    JOIN (SELECT state, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS ids FROM i WHERE r <= 5 GROUP BY 1) ii
      ON s.state = ii.state""")
def new_incident_digest(a: Archive) -> DataFrame:
    out = stats.digest(a.incident.where(F.col("state").isNotNull()), "state")
    return out.withColumns({
        "cities": F.array_join("cities", ", "),
        "ids": F.array_join(F.transform("ids", lambda i: i.cast("string")), ", "),
    })


@query("ingest_run_summary", ("source",), """
    SELECT country, count(*) AS cities, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(errors) AS BIGINT) AS errors,
      count(*) FILTER (entries >= 100) AS over_cap
    FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'CL' ELSE 'BR' END AS country, city, count(*) AS entries,
      count(*) FILTER (status = 'failed_in_download') AS errors FROM source GROUP BY 1, 2) GROUP BY ROLLUP (country)""")
def ingest_run_summary(a: Archive) -> DataFrame:
    country = F.when(F.col("user_id") % 5 == 0, "CL").otherwise("BR")
    runs = a.source.groupBy(country.alias("country"), "city").agg(
        F.count("*").alias("entries"), F.count_if(F.col("status") == "failed_in_download").alias("errors")
    )
    return stats.ingest_summary(runs)


@query("stage_run_summary", ("attempt",), """
    SELECT stage, outcome, count(*) AS count FROM attempt GROUP BY 1, 2""")
def stage_run_summary(a: Archive) -> DataFrame:
    return stats.outcome_counts(a.attempt, "stage", "outcome")


@query("column_profile", ("incident",), """
    SELECT column_name, n - nulls AS non_null, nulls, round(nulls * 100.0 / n, 2) AS null_pct FROM (
      SELECT count(*) AS n, unnest([struct_pack(column_name := 'homicide_type', nulls := count(*) FILTER (homicide_type IS NULL)),
        struct_pack(column_name := 'event_date', nulls := count(*) FILTER (event_date IS NULL)),
        struct_pack(column_name := 'state', nulls := count(*) FILTER (state IS NULL)),
        struct_pack(column_name := 'latitude', nulls := count(*) FILTER (latitude IS NULL)),
        struct_pack(column_name := 'victim_count', nulls := count(*) FILTER (victim_count IS NULL))], recursive := true)
      FROM incident)""")
def column_profile(a: Archive) -> DataFrame:
    df = a.incident.select("homicide_type", "event_date", "state", "latitude", "victim_count")
    return stats.profile(df).drop("dtype")


@query("number_profile", ("incident",), """
    SELECT count(victim_count) AS n, round(avg(victim_count), 6) AS mean, CAST(median(victim_count) AS DOUBLE) AS median,
      min(victim_count) AS min, max(victim_count) AS max FROM incident""")
def number_profile(a: Archive) -> DataFrame:
    return stats.number_profile(a.incident, "victim_count").withColumn("mean", F.round("mean", 6))


@query("top_values", ("incident",), """
    SELECT city AS value, count(*) AS count FROM incident GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10""")
def top_values(a: Archive) -> DataFrame:
    return stats.value_counts(a.incident, "city")


# --- geography -------------------------------------------------------------------------
@query("nearby_topk", ("incident",), f"""
    SELECT id, round({DISTANCE}, 2) AS distance_km FROM incident
    WHERE {DISTANCE} <= 500.0 ORDER BY {DISTANCE}, id LIMIT 50""")
def nearby_topk(a: Archive) -> DataFrame:
    return lists.nearest(a.incident, LAT, LNG, RADIUS, 50).select("id", F.round("distance", 2).alias("distance_km"))


@query("nearby_summary", ("incident",), f"""
    SELECT total, total_victims, security, previous_total,
      CASE WHEN previous_total > 0 THEN round((total - previous_total) * 100.0 / previous_total, 1) END AS trend_pct
    FROM (SELECT count(*) FILTER (cur) AS total, CAST(coalesce(sum(victim_count) FILTER (cur), 0) AS BIGINT) AS total_victims,
      count(*) FILTER (cur AND security_force_involved) AS security, count(*) FILTER (prev) AS previous_total
      FROM (SELECT *, coalesce(event_date >= {AS_OF} - INTERVAL 365 DAY, FALSE) AS cur,
        coalesce(event_date >= {AS_OF} - INTERVAL 730 DAY AND event_date < {AS_OF} - INTERVAL 365 DAY, FALSE) AS prev
        FROM incident WHERE {DISTANCE} <= 500.0))""")
def nearby_summary(a: Archive) -> DataFrame:
    return stats.nearby_summary(a.incident, LAT, LNG, RADIUS, ORDERS_AS_OF, 365)


@query("nearby_breakdown", ("incident",), f"""
    WITH c AS (SELECT * FROM incident WHERE {DISTANCE} <= 500.0 AND event_date >= {AS_OF} - INTERVAL 365 DAY)
    SELECT dimension, label, count, round(count * 100.0 / sum(count) OVER (PARTITION BY dimension), 1) AS percent FROM (
      SELECT 'type' AS dimension, coalesce(homicide_type, 'Não classificado') AS label, count(*) AS count FROM c GROUP BY 2
      UNION ALL SELECT 'method', coalesce(method_of_death, 'Não especificado'), count(*) FROM c GROUP BY 2)""")
def nearby_breakdown(a: Archive) -> DataFrame:
    return stats.nearby_breakdown(a.incident, LAT, LNG, RADIUS, ORDERS_AS_OF, 365)


@query("grid_density", ("incident",), """
    SELECT '6:' || CAST(CAST(floor((latitude + 90.0) * 8.0) AS INT) AS VARCHAR) || ':' ||
      CAST(CAST(floor((longitude + 180.0) * 8.0) AS INT) AS VARCHAR) AS cell,
      CAST(sum(coalesce(victim_count, 1)) AS BIGINT) AS weight
    FROM incident WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1""")
def grid_density(a: Archive) -> DataFrame:
    return portal.density_grid(a.incident, 6)


@query("grid_peak", ("incident",), f"""
    SELECT coalesce(max(w), 0) AS peak FROM (SELECT CAST(sum(coalesce(victim_count, 1)) AS BIGINT) AS w FROM incident
      WHERE {IN_BOX} GROUP BY floor((latitude + 90.0) * 4.0), floor((longitude + 180.0) * 4.0))""")
def grid_peak(a: Archive) -> DataFrame:
    return portal.peak_cell(portal.density_grid(filters.in_view(a.incident, BOX), 5))


@query("plus_code_cells", ("incident",), """
    WITH n AS (SELECT victim_count, CAST(floor((latitude + 90.0) * 8000 + 0.000001) AS BIGINT) AS a,
        CAST(floor((longitude + 180.0) * 8000 + 0.000001) AS BIGINT) AS b FROM incident
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
    d AS (SELECT '23456789CFGHJMPQRVWX' AS s)
    SELECT substr(s, CAST((a // 160000) % 20 + 1 AS INT), 1) || substr(s, CAST((b // 160000) % 20 + 1 AS INT), 1)
      || substr(s, CAST((a // 8000) % 20 + 1 AS INT), 1) || substr(s, CAST((b // 8000) % 20 + 1 AS INT), 1)
      || substr(s, CAST((a // 400) % 20 + 1 AS INT), 1) || substr(s, CAST((b // 400) % 20 + 1 AS INT), 1)
      || substr(s, CAST((a // 20) % 20 + 1 AS INT), 1) || substr(s, CAST((b // 20) % 20 + 1 AS INT), 1) || '+'
      || substr(s, CAST(a % 20 + 1 AS INT), 1) || substr(s, CAST(b % 20 + 1 AS INT), 1) AS cell,
      CAST(sum(coalesce(victim_count, 1)) AS BIGINT) AS weight
    FROM n, d GROUP BY 1""")
def plus_code_cells(a: Archive) -> DataFrame:
    return portal.density_grid(a.incident, 0, places.plus_code(F.col("latitude"), F.col("longitude")))


@query("centroids", ("incident",), """
    SELECT state, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lng, count(*) AS n
    FROM incident WHERE state IS NOT NULL AND latitude IS NOT NULL GROUP BY 1""")
def centroids(a: Archive) -> DataFrame:
    return portal.centroids(a.incident, "state").withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


GAZETTEER = """
    SELECT kind, label, parent, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lng, count(*) AS n FROM (
      SELECT 'city' AS kind, city AS label, state AS parent, latitude, longitude FROM incident
        WHERE city IS NOT NULL AND state IS NOT NULL
      UNION ALL SELECT 'state', state, state, latitude, longitude FROM incident WHERE state IS NOT NULL
      UNION ALL SELECT 'district', neighborhood, city, latitude, longitude FROM incident
        WHERE neighborhood IS NOT NULL AND city IS NOT NULL)
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1, 2, 3"""


@query("place_gazetteer", ("incident",), GAZETTEER)
def place_gazetteer(a: Archive) -> DataFrame:
    return portal.gazetteer(a.incident).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query("place_search", ("incident",), f"""
    SELECT kind, label, parent, n, CASE kind WHEN 'city' THEN 0 WHEN 'state' THEN 1 ELSE 2 END AS rank
    FROM ({GAZETTEER}) WHERE contains(lower(label), 'ma') OR contains(lower(parent), 'ma')
    ORDER BY rank, n DESC, label, parent LIMIT 8""")
def place_search(a: Archive) -> DataFrame:
    return lists.place_search(portal.gazetteer(a.incident), "Ma ").drop("lat", "lng")


@query("region_labels", ("incident",), """
    SELECT DISTINCT CASE WHEN country = 'Chile' THEN 'CL' ELSE 'BR' END AS country_code, state AS region,
      CASE WHEN country = 'Chile' THEN state ELSE CASE state """
       + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.BR_STATES.items())
       + """ END END AS region_name FROM incident WHERE state IS NOT NULL""")
def region_labels(a: Archive) -> DataFrame:
    code = taxonomy.country_code(F.col("country"))
    keyed = a.incident.where(F.col("state").isNotNull()).select(
        code.alias("country_code"), taxonomy.region_key(code, F.col("state")).alias("region")
    ).distinct()
    dim = taxonomy.region_dim(a.spark)
    return keyed.join(
        F.broadcast(dim), (F.col("country_code") == F.col("country")) & (F.col("region") == F.col("region_code")), "left"
    ).select("country_code", "region", F.coalesce("region_name", "region").alias("region_name"))


@query("taxonomy_labels", ("incident",), """
    SELECT event_family, event_subtype, count(*) AS n,
      CASE event_subtype WHEN 'simples' THEN 'Homicídio simples' WHEN 'qualificado' THEN 'Homicídio qualificado'
        WHEN 'feminicidio' THEN 'Feminicídio' WHEN 'latrocinio' THEN 'Latrocínio'
        WHEN 'intervencao_policial' THEN 'Intervenção policial' END AS label_pt
    FROM incident WHERE event_family = 'homicidio' GROUP BY 1, 2
    UNION ALL
    SELECT event_family, event_subtype, count(*),
      CASE WHEN event_family = 'tentativa' THEN CASE event_subtype WHEN 'simples' THEN 'Tentativa de homicídio'
        WHEN 'feminicidio' THEN 'Tentativa de feminicídio' WHEN 'latrocinio' THEN 'Tentativa de latrocínio' END END
    FROM incident WHERE event_family IS NOT NULL AND event_family <> 'homicidio' GROUP BY 1, 2""")
def taxonomy_labels(a: Archive) -> DataFrame:
    counted = a.incident.where(F.col("event_family").isNotNull()).groupBy("event_family", "event_subtype").agg(
        F.count("*").alias("n")
    )
    dim = taxonomy.label_dim(a.spark).drop("label_es")
    return counted.join(F.broadcast(dim), ["event_family", "event_subtype"], "left")


# --- portal ------------------------------------------------------------------------------
@query("viewport_facets", ("incident",), f"""
    WITH p AS (SELECT *, coalesce(victim_count, 0) AS v, {SUBTYPE} AS sub FROM incident WHERE {IN_BOX}),
    e AS (SELECT 'total' AS facet, 'all' AS key, v FROM p
      UNION ALL SELECT 'subtype', sub, v FROM p
      UNION ALL SELECT 'subtype', 'security_force_victim', v FROM p WHERE security_force_victim
      UNION ALL SELECT 'method', method_of_death, v FROM p UNION ALL SELECT 'state', state, v FROM p
      UNION ALL SELECT 'city', city, v FROM p UNION ALL SELECT 'period', time_of_day, v FROM p
      UNION ALL SELECT 'week', strftime(date_trunc('week', event_date), '%Y-%m-%d'), v FROM p
      UNION ALL SELECT 'month', strftime(event_date, '%Y-%m'), v FROM p)
    SELECT facet, key, count(*) AS incidents, CAST(sum(v) AS BIGINT) AS victims FROM e WHERE key IS NOT NULL GROUP BY 1, 2""")
def viewport_facets(a: Archive) -> DataFrame:
    return portal.viewport_stats(filters.in_view(a.incident, BOX))


FACETS = Facets(
    types=["qualificado", "simples", fixed.SLAIN_OFFICER_KEY], methods=["Arma de fogo", "Arma branca"],
    periods=["manhã", "noite"], start="1997-01-01", end="2000-12-31",
)
_T = f"({SUBTYPE} IN ('qualificado', 'simples') OR coalesce(security_force_victim, FALSE))"
_M = "method_of_death IN ('Arma de fogo', 'Arma branca')"
_P = "time_of_day IN ('manhã', 'manha', 'noite')"
_D = "event_date >= DATE '1997-01-01' AND event_date < DATE '2001-01-01'"


@query("cross_filter_facets", ("incident",), f"""
    WITH p AS (SELECT *, {SUBTYPE} AS sub FROM incident WHERE {IN_BOX} AND {_D}),
    e AS (SELECT 'types' AS facet, sub AS key FROM p WHERE {_M} AND {_P}
      UNION ALL SELECT 'methods', method_of_death FROM p WHERE {_T} AND {_P}
      UNION ALL SELECT 'states', state FROM p WHERE {_T} AND {_M} AND {_P}
      UNION ALL SELECT 'cities', city FROM p WHERE {_T} AND {_M} AND {_P}
      UNION ALL SELECT 'periods', CASE WHEN time_of_day = 'manha' THEN 'manhã' ELSE time_of_day END FROM p WHERE {_T} AND {_M})
    SELECT facet, key, count(*) AS incidents FROM e WHERE key IS NOT NULL GROUP BY 1, 2""")
def cross_filter_facets(a: Archive) -> DataFrame:
    return portal.cross_filtered(a.incident, FACETS, BOX)


@query("portal_filter", ("incident",), f"""
    SELECT id FROM incident WHERE {_T} AND {_M} AND {_P} AND {_D}""")
def portal_filter(a: Archive) -> DataFrame:
    return a.incident.where(FACETS.condition()).select("id")


@query("viewport_cull", ("incident",), """
    SELECT id FROM incident WHERE latitude BETWEEN -22.5 AND -7.5 AND longitude BETWEEN -63.75 AND -41.25""")
def viewport_cull(a: Archive) -> DataFrame:
    return filters.cull(a.incident, BOX).select("id")


@query("weekly_trend", ("incident",), """
    SELECT strftime(w, '%Y-%m-%d') AS week, CAST(coalesce(sum(victim_count), 0) AS BIGINT) AS victims
    FROM generate_series(TIMESTAMP '1996-12-30', TIMESTAMP '1998-06-29', INTERVAL 7 DAY) g(w)
    LEFT JOIN (SELECT * FROM incident WHERE event_date >= DATE '1997-01-01' AND event_date < DATE '1998-07-01')
      ON event_date >= w AND event_date < w + INTERVAL 7 DAY GROUP BY 1""")
def weekly_trend(a: Archive) -> DataFrame:
    out = portal.weekly_trend(a.incident, dt.date(1997, 1, 1), dt.date(1998, 6, 30))
    return out.withColumn("week", day_text("week"))


@query("trailing_months", ("incident",), """
    WITH m AS (SELECT greatest(DATE '1999-01-01', max(date_trunc('month', event_date))) AS latest FROM incident)
    SELECT strftime(t, '%Y-%m-%d') AS month, CAST(coalesce(sum(victim_count), 0) AS BIGINT) AS victims
    FROM m, generate_series(latest - INTERVAL 11 MONTH, latest, INTERVAL 1 MONTH) g(t)
    LEFT JOIN incident ON date_trunc('month', event_date) = t GROUP BY 1""")
def trailing_months(a: Archive) -> DataFrame:
    out = portal.trailing_months(a.incident, dt.date(1999, 1, 1))
    return out.withColumn("month", day_text("month"))


@query("last_24_hours", ("incident",), f"""
    SELECT count(*) AS total, CAST(coalesce(sum(victim_count), 0) AS BIGINT) AS victims FROM incident
    WHERE event_date >= {AS_OF} - INTERVAL 24 HOUR""")
def last_24_hours(a: Archive) -> DataFrame:
    return portal.last_day(a.incident, ORDERS_AS_OF)


@query("filter_options", ("incident",), f"""
    SELECT DISTINCT 'method' AS facet, method_of_death AS value, 0 AS rank FROM incident WHERE method_of_death IS NOT NULL
    UNION ALL SELECT DISTINCT 'period', CASE WHEN time_of_day = 'manha' THEN 'manhã' ELSE time_of_day END,
      CASE time_of_day WHEN 'madrugada' THEN 1 WHEN 'tarde' THEN 4 WHEN 'noite' THEN 5 ELSE 2 END
      FROM incident WHERE time_of_day IS NOT NULL
    UNION ALL SELECT DISTINCT 'subtype', sub, CASE sub WHEN 'simples' THEN 1 WHEN 'qualificado' THEN 2 WHEN 'feminicidio' THEN 3
      WHEN 'latrocinio' THEN 4 WHEN 'intervencao_policial' THEN 6 END FROM (SELECT {SUBTYPE} AS sub FROM incident)""")
def filter_options(a: Archive) -> DataFrame:
    return portal.filter_values(a.incident)


# --- lists and filters ----------------------------------------------------------------------
@query("paged_list", ("incident",), f"""
    SELECT id, strftime(event_date, '%Y-%m-%d') AS day, title, city FROM incident WHERE {PUBLIC}
    ORDER BY event_date DESC NULLS LAST, id DESC LIMIT 20 OFFSET 40""")
def paged_list(a: Archive) -> DataFrame:
    rows = lists.page(a.incident.where(filters.public_incident()), 3, 20)
    return rows.select("id", day_text("event_date").alias("day"), "title", "city")


@query("page_info", ("incident",), f"""
    SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) AS pages FROM incident WHERE {PUBLIC}""")
def page_info(a: Archive) -> DataFrame:
    return lists.page_info(a.incident.where(filters.public_incident()), 20)


@query("source_page", ("source",), """
    SELECT id, status FROM source ORDER BY fetched_at DESC, id DESC LIMIT 25 OFFSET 25""")
def source_page(a: Archive) -> DataFrame:
    return lists.page(a.source, 2, 25, "fetched_at").select("id", "status")


@query("search_list", ("incident",), f"""
    SELECT id FROM incident WHERE {PUBLIC} AND (title ILIKE '%urgent%' OR city ILIKE '%urgent%'
      OR chronological_description ILIKE '%urgent%')""")
def search_list(a: Archive) -> DataFrame:
    return a.incident.where(filters.public_incident() & filters.search("URGENT", *filters.PUBLIC_SEARCH)).select("id")


@query("admin_list", ("incident",), """
    SELECT id FROM incident WHERE homicide_type = 'Feminicídio' AND city ILIKE '%building%' AND neighborhood ILIKE '%bairro 3%'
      AND event_date >= TIMESTAMP '1996-01-01' AND event_date <= TIMESTAMP '2000-01-01' AND confirmed
      AND latitude IS NOT NULL AND longitude IS NOT NULL""")
def admin_list(a: Archive) -> DataFrame:
    wanted = filters.incident_filter(
        type_="Feminicídio", city="building", neighborhood="bairro 3", start=dt.datetime(1996, 1, 1),
        end=dt.datetime(2000, 1, 1), confirmed=True, geocoded=True,
    )
    return a.incident.where(wanted).select("id")


@query("record_list", ("raw",), """
    SELECT id FROM raw WHERE is_gold_standard AND security_force_involved AND city ILIKE '%machinery%'""")
def record_list(a: Archive) -> DataFrame:
    columns = a.raw.withColumns({"latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")})
    return columns.where(filters.record_filter(gold=True, security_force=True, city="machinery")).select("id")


@query("source_list", ("source",), """
    SELECT id FROM source WHERE status = 'discarded' AND (coalesce(headline, '') ILIKE '%polícia%'
      OR coalesce(publisher_name, '') ILIKE '%polícia%')""")
def source_list(a: Archive) -> DataFrame:
    return a.source.where(filters.status_filter("discarded", "polícia")).select("id")


@query("type_filter_union", ("incident",), """
    SELECT id FROM incident WHERE coalesce(security_force_victim, FALSE) OR event_subtype = 'feminicidio'
      OR (event_family = 'tentativa' AND event_subtype = 'simples')
      OR homicide_type = 'Homicídio Qualificado' OR (event_family = 'homicidio' AND event_subtype = 'qualificado')""")
def type_filter_union(a: Archive) -> DataFrame:
    wanted = ["Policial vitimado", "feminicidio", "tentativa:simples", "Homicídio Qualificado"]
    return a.incident.where(filters.types_filter(wanted)).select("id")


@query("public_record_scope", ("incident",), """
    SELECT id FROM incident WHERE event_family = 'homicidio' AND content_class = 'incident'
      AND (victim_count IS NULL OR victim_count <= 10)""")
def public_record_scope(a: Archive) -> DataFrame:
    scope = filters.public_record(
        F.col("event_family"), F.col("event_subtype"), F.col("content_class"), F.col("victim_count")
    )
    return a.incident.where(scope).select("id")


@query("rolling_window", ("incident",), f"""
    SELECT id FROM incident WHERE event_date BETWEEN {AS_OF} - INTERVAL 180 DAY AND {AS_OF}""")
def rolling_window(a: Archive) -> DataFrame:
    return a.incident.where(dates.rolling_window(F.col("event_date"), ORDERS_AS_OF, 180)).select("id")


@query("bounding_box", ("incident",), "SELECT id FROM incident WHERE latitude BETWEEN -20 AND -10")
def bounding_box(a: Archive) -> DataFrame:
    return a.incident.where(filters.bounding_box(south=-20.0, north=-10.0, west=-60.0)).select("id")


EXPORT_WHERE = f"""latitude IS NOT NULL AND longitude IS NOT NULL AND event_date IS NOT NULL AND {PUBLIC}
      AND event_date >= TIMESTAMP '1996-01-01' AND event_date <= TIMESTAMP '2000-12-31 23:59:59.999999'
      AND country IN ('BR', 'Brasil') AND time_of_day IN ('manhã', 'manha', 'noite')"""


def _export_condition() -> F.Column:
    window = filters.export_window(ORDERS_AS_OF, start="1996-01-01", end="2000-12-31")
    return filters.export_filter(window, country="br", periods=["manhã", "noite"])


@query("export_rows", ("incident",), f"""
    SELECT id, event_subtype, state, latitude, longitude, victim_count, title FROM incident WHERE {EXPORT_WHERE}
    ORDER BY event_date DESC, id DESC""")
def export_rows(a: Archive) -> DataFrame:
    columns = ["id", "event_subtype", "state", "latitude", "longitude", "victim_count", "secret", "title"]
    return lists.export_rows(a.incident, _export_condition(), columns)


@query("export_truncated", ("incident",), f"""
    SELECT least(count(*), 200) AS exported, count(*) > 200 AS truncated FROM incident WHERE {EXPORT_WHERE}""")
def export_truncated(a: Archive) -> DataFrame:
    return lists.export_truncated(a.incident, _export_condition(), cap=200)


@query("map_points", ("incident",), f"""
    SELECT id, latitude AS lat, longitude AS lng, event_family AS f, event_subtype AS su, homicide_type AS t,
      method_of_death AS m, strftime(event_date, '%Y-%m-%d') AS d, victim_count AS v, security_force_involved AS s,
      security_force_victim AS sv, city AS c, neighborhood AS n, state AS st, time_of_day AS p
    FROM incident WHERE {PUBLIC} AND latitude IS NOT NULL AND longitude IS NOT NULL
      AND event_date BETWEEN {AS_OF} - INTERVAL 365 DAY AND {AS_OF}""")
def map_points(a: Archive) -> DataFrame:
    scope = filters.public_incident() & dates.rolling_window(F.col("event_date"), ORDERS_AS_OF, fixed.MAP_WINDOW_DAYS)
    return lists.map_points(a.incident.where(scope)).withColumn("d", day_text("d"))


@query("admin_map", ("incident",), """
    SELECT id, homicide_type, city, latitude, longitude FROM incident WHERE latitude IS NOT NULL
      AND event_date >= TIMESTAMP '2000-01-01'""")
def admin_map(a: Archive) -> DataFrame:
    rows = lists.admin_map(a.incident, start=dt.datetime(2000, 1, 1))
    return rows.select("id", "homicide_type", "city", "latitude", "longitude")


@query("feed_in_view", ("incident",), f"""
    SELECT id FROM incident WHERE {IN_BOX} ORDER BY event_date DESC NULLS LAST, id LIMIT 50""")
def feed_in_view(a: Archive) -> DataFrame:
    return lists.latest_in_view(a.incident, BOX).select("id")


@query("scatter_cap", ("incident",), "SELECT id FROM incident ORDER BY id")
def scatter_cap(a: Archive) -> DataFrame:
    return lists.capped(a.incident).select("id")


@query("batch_selector", ("incident",), """
    SELECT id FROM incident WHERE CAST(event_date AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1999-03-31'
      AND lower(city) = 'building 3' AND lower(state) = 'am'""")
def batch_selector(a: Archive) -> DataFrame:
    wanted = filters.batch_filter(dt.date(1997, 3, 1), dt.date(1999, 3, 31), "Building 3", "AM")
    return a.incident.where(wanted).select("id")


@query("pending_queue", ("raw",), """
    SELECT id FROM raw WHERE deduplication_status = 'pending' ORDER BY event_date DESC NULLS LAST, id""")
def pending_queue(a: Archive) -> DataFrame:
    pending = F.col("deduplication_status") == "pending"
    return lists.work_queue(a.raw, pending, [F.col("event_date").desc_nulls_last(), F.col("id")]).select("id")


@query("claimable_work", ("source",), """
    SELECT id FROM source WHERE status = 'ready_for_classification' AND headline IS NOT NULL""")
def claimable_work(a: Archive) -> DataFrame:
    return a.source.where(filters.claimable("ready_for_classification")).select("id")


@query("incident_articles", ("raw", "source"), """
    SELECT DISTINCT r.unique_event_id, s.id, s.headline, 'source' AS kind
    FROM raw r JOIN source s ON r.source_google_news_id = s.id WHERE r.unique_event_id IS NOT NULL
    UNION ALL
    SELECT unique_event_id, -id, title, 'raw_fallback' FROM raw
    WHERE source_google_news_id IS NULL AND unique_event_id IS NOT NULL""")
def incident_articles(a: Archive) -> DataFrame:
    sources = a.source.withColumn("published_at", F.col("fetched_at"))
    return lists.incident_articles(a.raw, sources).select("unique_event_id", "id", "headline", "kind")
