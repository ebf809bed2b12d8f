"""Queries of the text rules, corrections, feeds and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions import corrections, dates, documents, failures, names, payload, taxonomy, text
from casebook.operators import lifecycle
from casebook.plans.registry import query
from casebook.plans.standins import Archive
from casebook.sources import feeds

SPACE = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def fold_sql(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '{SPACE}', ' ', 'g'))"


def low_sql(c: str) -> str:
    return f"strip_accents(lower(coalesce({c}, '')))"


def any_sql(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def negative_sql(t: str) -> str:
    return (
        f"(NOT {any_sql(t, fixed.EXPLICIT_DEATH)} AND (regexp_matches({t}, '{fixed.SURVIVAL_PATTERN}')"
        f" OR {any_sql(t, fixed.FOREIGN_MARKERS)} OR {any_sql(t, fixed.METAPHOR_MARKERS)}"
        f" OR {any_sql(t, fixed.ACCIDENT_MARKERS)} OR {any_sql(t, fixed.POLICE_MARKERS)}"
        f" OR (contains({t}, 'troca tiros') AND NOT regexp_matches({t}, '{fixed.DEATH_HINT_PATTERN}'))))"
    )


def positive_sql(t: str) -> str:
    return f"(NOT {negative_sql(t)} AND {any_sql(t, fixed.IMPLIED_FATAL)})"


def keyword_sql(c: str, pattern: str) -> str:
    return f"regexp_matches(coalesce({c}, ''), '(?i){pattern.removeprefix('(?iU)')}')"


def method_sql(t: str) -> str:
    arms = " ".join(f"WHEN {any_sql(t, words)} THEN '{label}'" for label, words in fixed.METHOD_RULES)
    return f"CASE {arms} END"


@query("fold_text", ("article",), f"SELECT id, md5({fold_sql('content')}) AS folded FROM article")
def fold_text(a: Archive) -> DataFrame:
    return a.article.select("id", F.md5(text.fold(F.col("content"))).alias("folded"))


@query("title_split", ("article",), """
    WITH t AS (SELECT id, 'Manchete - ' || lang || ' - ' || publisher_name AS title FROM article)
    SELECT id, regexp_extract(title, '^(.*) - (.*)$', 1) AS headline, regexp_extract(title, '^(.*) - (.*)$', 2) AS publisher FROM t""")
def title_split(a: Archive) -> DataFrame:
    title = F.concat_ws(" - ", F.lit("Manchete"), "lang", "publisher_name")
    return a.article.select("id", text.split_headline(title).alias("s")).select("id", "s.headline", "s.publisher")


@query("url_domain", (), """
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages""")
def url_domain(a: Archive) -> DataFrame:
    return a.table("pages").select("page_id", failures.url_domain(F.col("url")).alias("domain"))


@query("headline_rules", ("headline",), f"""
    SELECT conv_id, turn, {negative_sql('t')} AS negative, {positive_sql('t')} AS positive,
      {keyword_sql('headline', fixed.DEATH_KEYWORDS)} AS keyword
    FROM (SELECT *, {low_sql('headline')} AS t FROM headline)""")
def headline_rules(a: Archive) -> DataFrame:
    h = F.col("headline")
    return a.headline.select(
        "conv_id", "turn", text.forced_negative(h).alias("negative"), text.forced_positive(h).alias("positive"),
        text.death_keyword(h).alias("keyword"),
    )


@query("event_headline_rules", ("source",), f"""
    SELECT id, {negative_sql('t')} AS negative, {positive_sql('t')} AS positive,
      {keyword_sql('headline', fixed.DEATH_KEYWORDS)} AS keyword
    FROM (SELECT *, {low_sql('headline')} AS t FROM source WHERE headline IS NOT NULL)""")
def event_headline_rules(a: Archive) -> DataFrame:
    h = F.col("headline")
    return a.source.where(h.isNotNull()).select(
        "id", text.forced_negative(h).alias("negative"), text.forced_positive(h).alias("positive"),
        text.death_keyword(h).alias("keyword"),
    )


@query("label_overrides", ("source",), f"""
    SELECT id, CASE WHEN neg AND lab THEN FALSE WHEN pos AND NOT lab THEN TRUE ELSE lab END AS is_violent_death,
      CASE WHEN (neg AND lab) OR (pos AND NOT lab) THEN 'alta' ELSE 'media' END AS confidence,
      CASE WHEN neg AND lab THEN 'base {fixed.NOTE_FORCED_NEGATIVE}'
        WHEN pos AND NOT lab THEN 'base {fixed.NOTE_FORCED_POSITIVE}' ELSE 'base' END AS reason
    FROM (SELECT id, is_violent_death AS lab, {negative_sql('t')} AS neg, {positive_sql('t')} AS pos
      FROM (SELECT *, {low_sql('headline')} AS t FROM source WHERE headline IS NOT NULL))""")
def label_overrides(a: Archive) -> DataFrame:
    fixed_label = text.override_label(F.col("headline"), F.col("is_violent_death"), F.lit("media"), F.lit("base"))
    rows = a.source.where(F.col("headline").isNotNull()).select("id", fixed_label.alias("c"))
    return rows.select("id", "c.is_violent_death", "c.confidence", "c.reason")


def _tag_sql(tag: str, words: list[str] | None) -> str:
    hit = keyword_sql("headline", fixed.EVAL_DEATH_KEYWORDS) if words is None else any_sql("lower(headline)", words)
    return f"CASE WHEN {hit} THEN '{tag}' END"


@query("headline_tags", ("headline",), f"""
    SELECT conv_id, turn, concat_ws(',', role, {', '.join(_tag_sql(t, w) for t, w in fixed.HEADLINE_TAGS)}) AS tags
    FROM headline""")
def headline_tags(a: Archive) -> DataFrame:
    tags = text.headline_tags(F.col("headline"), F.col("role"))
    return a.headline.select("conv_id", "turn", F.array_join(tags, ",").alias("tags"))


_RULE_SQL = " ".join(
    f"WHEN regexp_matches(content, '(?i){pattern}') THEN '{rule}'" for _, rule, pattern in fixed.ARTICLE_RULES
)


@query("content_class", ("article",), f"""
    SELECT id, rule, CASE WHEN rule IN ({', '.join(f"'{r}'" for h, r, _ in fixed.ARTICLE_RULES if h == 'aggregate_statistics')})
        THEN 'aggregate_statistics' WHEN rule LIKE 'foreign%' THEN 'foreign' WHEN rule IS NOT NULL THEN 'non_incident' END AS hint
    FROM (SELECT id, CASE {_RULE_SQL} END AS rule FROM article)""")
def content_class(a: Archive) -> DataFrame:
    return a.article.select("id", text.article_rule(F.col("content")).alias("r")).select("id", "r.rule", "r.hint")


@query("rule_snippets", ("article",), """
    WITH m AS (SELECT id, content, regexp_extract(content, '(?i)\\bbalan[çc]o\\s+(anual|de\\s+mortes|crim(?:inal|inalidade))\\b', 0) AS hit
      FROM article),
    p AS (SELECT id, content, instr(content, hit) AS s, length(hit) AS n FROM m WHERE hit <> '')
    SELECT id, trim(substr(content, greatest(1, s - 20), s + n + 40 - greatest(1, s - 20)), chr(10) || ' ') AS snippet FROM p""")
def rule_snippets(a: Archive) -> DataFrame:
    rules = [r for r in fixed.ARTICLE_RULES if r[1] == "annual_balance"]
    found = a.article.withColumn("r", text.article_rule(F.col("content"), rules)).where(F.col("r").isNotNull())
    snippet = text.rule_snippet(F.col("content"), F.col("r.rule"), rules)
    return found.select("id", F.btrim(snippet, F.lit("\n ")).alias("snippet"))


@query("language_vote", ("article",), f"""
    SELECT id, CASE WHEN {' + '.join(f"CAST(contains(c, '{m}') AS INT)" for m in fixed.SPANISH_MARKERS)}
        + CASE WHEN {any_sql("lower(publisher_name)", fixed.CHILE_HINTS)} OR {any_sql("lower(resolved_url)", fixed.CHILE_HINTS)} THEN 3 ELSE 0 END
      > {' + '.join(f"CAST(contains(c, '{m}') AS INT)" for m in fixed.PORTUGUESE_MARKERS)} THEN 'es' ELSE 'pt' END AS language
    FROM (SELECT *, lower(content) AS c FROM article)""")
def language_vote(a: Archive) -> DataFrame:
    vote = text.language_vote(F.col("content"), F.col("publisher_name"), F.col("resolved_url"))
    return a.article.select("id", vote.alias("language"))


@query("length_buckets", ("article",), """
    SELECT CASE WHEN length(content) < 2000 THEN 'short' WHEN length(content) <= 10000 THEN 'medium' ELSE 'long' END AS bucket,
      count(*) AS n FROM article GROUP BY 1""")
def length_buckets(a: Archive) -> DataFrame:
    return a.article.groupBy(text.length_bucket(F.length("content")).alias("bucket")).agg(F.count("*").alias("n"))


@query("excerpts", ("article",), f"""
    SELECT id, CASE WHEN f = '' THEN '—' WHEN length(f) > 140 THEN substr(f, 1, 139) || '…' ELSE f END AS excerpt
    FROM (SELECT id, trim(regexp_replace(content, '{SPACE}', ' ', 'g')) AS f FROM article)""")
def excerpts(a: Archive) -> DataFrame:
    return a.article.select("id", text.clip(F.col("content"), 140).alias("excerpt"))


# --- extraction corrections ---------------------------------------------------------------
_T = "strip_accents(lower(content || ' '))"
_GUN = f"(coalesce({{m}} = 'Arma de fogo', FALSE) AND {any_sql('t', fixed.GUN_EVIDENCE)})"


def _hypothesis_sql(t: str) -> str:
    near = " OR ".join(
        f"(instr({t}, '{m}') > 0 AND contains(substr({t}, instr({t}, '{m}'), 140), 'executado'))"
        for m in fixed.HYPOTHESIS_MARKERS
    )
    return f"({any_sql(t, fixed.ELSEWHERE_MARKERS)} OR {near})"


@query("method_of_death", ("article",), f"""
    SELECT id, {method_sql('t')} AS method FROM (SELECT id, {_T} AS t FROM article)""")
def method_of_death(a: Archive) -> DataFrame:
    t = corrections.source_text(F.col("content"), F.lit(None).cast("string"))
    return a.article.select("id", corrections.method_of_death(t).alias("method"))


@query("case_predicates", ("article",), f"""
    SELECT id,
      (NOT {_GUN.format(m='m')}) AND ({any_sql('t', fixed.UNSPECIFIED_METHOD)} OR (contains(t, 'corpo') AND contains(t, 'encontrado')
        AND m IS NULL AND {any_sql('t', fixed.CAUSE_WORDS)})) AS unspecified,
      (NOT {_hypothesis_sql('t')}) AND ({any_sql('t', fixed.QUALIFIED_MARKERS)}
        OR (contains(t, 'executado') AND coalesce(m = 'Arma de fogo', FALSE))
        OR (regexp_matches(t, '\\bexecu(?:cao|ção)\\b') AND contains(t, 'tiro'))) AS qualified,
      {any_sql('t', fixed.POLICE_WORDS)} AND {any_sql('t', fixed.PATROL_MARKERS)} AS patrol,
      contains(t, 'corpo') AND m IS NULL AND NOT {any_sql('t', fixed.VIOLENT_WORDS)} AND {any_sql('t', fixed.SCANT_MARKERS)} AS insufficient
    FROM (SELECT id, t, {method_sql('t')} AS m FROM (SELECT id, {_T} AS t FROM article))""")
def case_predicates(a: Archive) -> DataFrame:
    t, m = F.col("t"), F.col("m")
    rows = a.article.select("id", corrections.source_text(F.col("content"), F.lit(None).cast("string")).alias("t"))
    return rows.withColumn("m", corrections.method_of_death(t)).select(
        "id", corrections.method_unspecified(t, m).alias("unspecified"), corrections.qualified(t, m).alias("qualified"),
        corrections.patrol_shootout(t).alias("patrol"), corrections.insufficient_case(t, m).alias("insufficient"),
    )


@query("fatal_counts", ("article",), f"""
    SELECT id, CASE WHEN regexp_matches(t, '\\b(tres)\\s+mortos\\s+e\\s+2\\s+ferid') THEN 3 END AS victims
    FROM (SELECT id, {_T} AS t FROM article)""")
def fatal_counts(a: Archive) -> DataFrame:
    t = corrections.source_text(F.col("content"), F.lit(None).cast("string"))
    return a.article.select("id", corrections.fatal_count(t).alias("victims"))


@query("date_fixes", ("article",), """
    SELECT id, CASE WHEN contains(content, 'domingo (10)') THEN '2024-03-10'
      WHEN regexp_matches(content, '(?i)neste domingo\\b') THEN '2024-03-10' END AS fixed_date FROM article""")
def date_fixes(a: Archive) -> DataFrame:
    fix = corrections.date_fix(F.col("content"), F.col("published_at"), F.lit("2024-03-09"))
    return a.article.select("id", fix.alias("fixed_date"))


@query("record_corrections", ("article",), f"""
    SELECT id, CASE WHEN ins THEN 'nao_classificado' ELSE 'homicidio' END AS family,
      CASE WHEN ins THEN 'outro' WHEN qual THEN 'qualificado' ELSE 'simples' END AS subtype,
      CASE WHEN uns THEN 'Não especificado' ELSE m END AS method,
      CASE WHEN regexp_matches(t, '\\btres\\s+mortos\\s+e\\s+2\\s+ferid') THEN 3 ELSE 1 END AS victims
    FROM (SELECT *,
      contains(t, 'corpo') AND m IS NULL AND NOT {any_sql('t', fixed.VIOLENT_WORDS)} AND {any_sql('t', fixed.SCANT_MARKERS)} AS ins,
      (NOT {_GUN.format(m='m')}) AND ({any_sql('t', fixed.UNSPECIFIED_METHOD)} OR (contains(t, 'corpo') AND contains(t, 'encontrado')
        AND m IS NULL AND {any_sql('t', fixed.CAUSE_WORDS)})) AS uns,
      (NOT {_hypothesis_sql('t')}) AND ({any_sql('t', fixed.QUALIFIED_MARKERS)}
        OR (contains(t, 'executado') AND coalesce(m = 'Arma de fogo', FALSE))
        OR (regexp_matches(t, '\\bexecu(?:cao|ção)\\b') AND contains(t, 'tiro'))) AS qual
      FROM (SELECT id, t, {method_sql('t')} AS m FROM (SELECT id, {_T} AS t FROM article)))""")
def record_corrections(a: Archive) -> DataFrame:
    bare = F.from_json(
        F.lit('{"event_family":"homicidio","event_subtype":"simples","content_class":"incident",'
              '"victims":{"number_of_victims":1},"homicide_dynamic":{"title":"x"},'
              '"date_time":{"date":"2024-03-09"},"location_info":{"city":"Natal"}}'),
        payload.schemas.EXTRACTION,
    )
    rows = a.article.withColumns({"record": bare, "headline": F.lit(None).cast("string")})
    return corrections.correct_records(rows).select(
        "id", F.col("record.event_family").alias("family"), F.col("record.event_subtype").alias("subtype"),
        F.col("record.homicide_dynamic.method").alias("method"), F.col("record.victims.number_of_victims").alias("victims"),
    )


# --- failures -------------------------------------------------------------------------------
@query("http_reasons", ("attempt",), """
    SELECT http_status, CASE WHEN http_status IN (401, 403, 429) THEN 'fetch_blocked' WHEN http_status IN (404, 410) THEN 'fetch_not_found'
      WHEN http_status >= 500 THEN 'fetch_server_error' ELSE 'fetch_network_error' END AS reason, count(*) AS n
    FROM attempt GROUP BY 1, 2""")
def http_reasons(a: Archive) -> DataFrame:
    reason = failures.http_reason(F.col("http_status"))
    return a.attempt.groupBy("http_status", reason.alias("reason")).agg(F.count("*").alias("n"))


MESSAGES = [
    ("IncompleteOutputException", "The output is incomplete", "llm_max_tokens"),
    ("ValidationError", "1 validation error", "validation_error"),
    ("ClientError", "429 RESOURCE_EXHAUSTED per day", "llm_quota"),
    ("ClientError", "429 Too many requests", "llm_rate_limit"),
    ("ReadTimeout", "slow", "llm_timeout"),
    ("ServerError", "blocked by safety settings", "llm_safety_block"),
    ("ClientError", "input token count exceeds the limit", "content_too_long"),
    ("RuntimeError", "boom", "llm_unknown"),
]


def _choose(column: str, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


@query("extraction_reasons", ("attempt",), f"""
    SELECT reason, transient, count(*) AS n FROM (
      SELECT CASE id % 8 {' '.join(f"WHEN {i} THEN '{m[2]}'" for i, m in enumerate(MESSAGES))} END AS reason,
        id % 8 IN (2, 3, 4) AS transient FROM attempt) GROUP BY 1, 2""")
def extraction_reasons(a: Archive) -> DataFrame:
    reason = failures.extraction_reason(
        _choose("id", [m[0] for m in MESSAGES]), _choose("id", [m[1] for m in MESSAGES])
    )
    return (
        a.attempt.select(reason.alias("reason"))
        .groupBy("reason", failures.is_transient(F.col("reason")).alias("transient")).agg(F.count("*").alias("n"))
    )


@query("download_reasons", ("attempt",), """
    SELECT CASE WHEN id % 3 = 0 THEN 'fetch_timeout' WHEN id % 3 = 2 THEN 'fetch_network_error'
      WHEN http_status = 429 THEN 'fetch_blocked' WHEN http_status = 404 THEN 'fetch_not_found'
      WHEN http_status >= 500 THEN 'fetch_server_error' ELSE 'fetch_network_error' END AS reason, count(*) AS n
    FROM attempt GROUP BY 1""")
def download_reasons(a: Archive) -> DataFrame:
    error = _choose("id", ["ConnectTimeout", "HTTPStatusError", "SSLError"])
    return a.attempt.groupBy(failures.download_reason(error, F.col("http_status")).alias("reason")).agg(F.count("*").alias("n"))


# --- taxonomy -------------------------------------------------------------------------------
@query("legacy_labels", ("raw",), """
    SELECT DISTINCT homicide_type, CASE homicide_type WHEN 'Homicídio' THEN 'homicidio:simples'
      WHEN 'Homicídio Qualificado' THEN 'homicidio:qualificado' WHEN 'Feminicídio' THEN 'homicidio:feminicidio'
      WHEN 'Latrocínio' THEN 'homicidio:latrocinio' WHEN 'Infanticídio' THEN 'homicidio:infanticidio'
      WHEN 'Intervenção policial' THEN 'homicidio:intervencao_policial' WHEN 'Morte no trânsito' THEN 'homicidio:morte_transito_doloso'
      WHEN 'Tentativa de Homicídio' THEN 'tentativa:simples' WHEN 'Tentativa de feminicídio' THEN 'tentativa:feminicidio'
      WHEN 'Homicídio Culposo' THEN 'acidente_fatal:culposo' ELSE 'nao_classificado:outro' END AS pair,
      CASE WHEN homicide_type IS NULL THEN 'Outro' ELSE homicide_type END AS label
    FROM raw""")
def legacy_labels(a: Archive) -> DataFrame:
    pair = taxonomy.legacy_to_pair(F.col("homicide_type"))
    return a.raw.select("homicide_type").distinct().select(
        "homicide_type", F.concat_ws(":", pair["family"], pair["subtype"]).alias("pair"),
        taxonomy.pair_to_legacy(pair["family"], pair["subtype"]).alias("label"),
    )


@query("portal_subtypes", ("raw",), """
    SELECT subtype, count(*) AS n FROM (SELECT CASE WHEN event_subtype = 'simples' THEN 'simples' ELSE
      CASE homicide_type WHEN 'Homicídio Qualificado' THEN 'qualificado' WHEN 'Feminicídio' THEN 'feminicidio'
        WHEN 'Latrocínio' THEN 'latrocinio' WHEN 'Infanticídio' THEN 'infanticidio'
        WHEN 'Intervenção policial' THEN 'intervencao_policial' WHEN 'Morte no trânsito' THEN 'morte_transito_doloso'
        WHEN 'Tentativa de feminicídio' THEN 'feminicidio' ELSE 'simples' END END AS subtype FROM raw) GROUP BY 1""")
def portal_subtypes(a: Archive) -> DataFrame:
    shown = taxonomy.portal_subtype(F.col("event_subtype"), F.col("homicide_type"))
    return a.raw.groupBy(shown.alias("subtype")).agg(F.count("*").alias("n"))


@query("taxonomy_backfill", ("raw",), """
    SELECT event_family, event_subtype, homicide_type, count(*) AS n FROM (
      SELECT CASE WHEN event_family IS NOT NULL THEN event_family WHEN homicide_type LIKE 'Tentativa%' THEN 'tentativa'
          WHEN homicide_type = 'Homicídio Culposo' THEN 'acidente_fatal' WHEN homicide_type IS NULL OR homicide_type = 'Outro' THEN 'nao_classificado'
          ELSE 'homicidio' END AS event_family,
        CASE WHEN event_family IS NOT NULL THEN event_subtype ELSE CASE homicide_type WHEN 'Homicídio' THEN 'simples'
          WHEN 'Homicídio Qualificado' THEN 'qualificado' WHEN 'Feminicídio' THEN 'feminicidio' WHEN 'Latrocínio' THEN 'latrocinio'
          WHEN 'Infanticídio' THEN 'infanticidio' WHEN 'Intervenção policial' THEN 'intervencao_policial'
          WHEN 'Morte no trânsito' THEN 'morte_transito_doloso' WHEN 'Tentativa de Homicídio' THEN 'simples'
          WHEN 'Tentativa de feminicídio' THEN 'feminicidio' WHEN 'Homicídio Culposo' THEN 'culposo' ELSE 'outro' END END AS event_subtype,
        CASE WHEN event_family IS NULL AND homicide_type IS NULL THEN 'Outro' ELSE homicide_type END AS homicide_type
      FROM raw) GROUP BY 1, 2, 3""")
def taxonomy_backfill(a: Archive) -> DataFrame:
    done = lifecycle.taxonomy_backfill(a.raw.select("event_family", "event_subtype", "homicide_type"))
    return done.groupBy("event_family", "event_subtype", "homicide_type").agg(F.count("*").alias("n"))


# --- names, dates, JSON -----------------------------------------------------------------------
@query("victim_names", ("raw",), f"""
    SELECT name, {fold_sql('name')} AS folded, count(*) AS n FROM raw WHERE name IS NOT NULL GROUP BY 1, 2""")
def victim_names(a: Archive) -> DataFrame:
    people = F.array(F.struct(F.col("name")))
    return (
        a.raw.where(F.col("name").isNotNull())
        .select("name", F.explode(names.record_names(people, F.col("title"))).alias("folded"))
        .groupBy("name", "folded").agg(F.count("*").alias("n"))
    )


@query("prose_names", ("incident",), f"""
    SELECT id, {fold_sql("split_part(victims_summary, ',', 1)")} AS name FROM incident WHERE victims_summary IS NOT NULL""")
def prose_names(a: Archive) -> DataFrame:
    prose = F.concat(F.lit("Morreu ontem. A vítima "), F.col("victims_summary"), F.lit(", era conhecida"))
    found = names.names_in_prose(prose)
    return a.incident.where(F.col("victims_summary").isNotNull()).select("id", F.explode(found).alias("name"))


@query("name_keys", ("incident",), f"""
    SELECT id, {fold_sql("split_part(victims_summary, ',', 1)")} AS name_key FROM incident WHERE victims_summary IS NOT NULL""")
def name_keys(a: Archive) -> DataFrame:
    people = F.array().cast("array<struct<name:string>>")
    keys = names.victim_keys(people, F.col("victims_summary"))
    return a.incident.select("id", F.explode(keys).alias("name_key"))


@query("timestamp_formats", ("source",), """
    SELECT id, strftime(CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 2 THEN date_trunc('day', fetched_at)
      WHEN id % 5 IN (1, 3) THEN date_trunc('second', fetched_at) ELSE fetched_at END, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM source""")
def timestamp_formats(a: Archive) -> DataFrame:
    ts = F.col("fetched_at")
    raw = (
        F.when(F.col("id") % 5 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(F.col("id") % 5 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("id") % 5 == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("id") % 5 == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
        .otherwise(F.lit("06/07/2026 às 10:00"))
    )
    return a.source.select("id", F.date_format(dates.parse_timestamp(raw), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query("json_paths", ("source",), """
    SELECT id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM source""")
def json_paths(a: Archive) -> DataFrame:
    return a.source.select("id", payload.variant_path(F.col("props"), "k", "int").alias("k"))


@query("local_hours", ("source",), """
    SELECT strftime(fetched_at - INTERVAL 3 HOUR, '%d/%m %H:00') AS label, count(*) AS n FROM source GROUP BY 1""")
def local_hours(a: Archive) -> DataFrame:
    return a.source.groupBy(dates.local_hour(F.col("fetched_at")).alias("label")).agg(F.count("*").alias("n"))


# --- feeds ------------------------------------------------------------------------------------
@query("feed_query_plan", ("source",), f"""
    WITH c AS (SELECT city, CASE WHEN user_id % 5 = 0 THEN 'CL' ELSE 'BR' END AS country, count(*) >= 70 AS sharded
      FROM source GROUP BY 1, 2),
    p AS (SELECT unnest([{', '.join(f"'{p}'" for p in fixed.BR_PUBLISHERS)}]) AS publisher, 'BR' AS country
      UNION ALL SELECT unnest([{', '.join(f"'{p}'" for p in fixed.CL_PUBLISHERS)}]), 'CL')
    SELECT city, country, query, '{fixed.FEED_BASE_URL}?q=' || replace(query, ' ', '+')
      || CASE country WHEN 'CL' THEN '{fixed.FEED_PARAMS["CL"]}' ELSE '{fixed.FEED_PARAMS["BR"]}' END AS url
    FROM (SELECT city, country, city || ' when:1h' AS query FROM c WHERE NOT sharded
      UNION ALL SELECT c.city, c.country, c.city || ' when:1h site:' || publisher FROM c JOIN p ON c.country = p.country WHERE sharded)""")
def feed_query_plan(a: Archive) -> DataFrame:
    country = F.when(F.col("user_id") % 5 == 0, "CL").otherwise("BR")
    cities = a.source.groupBy("city", country.alias("country")).agg((F.count("*") >= 70).alias("needs_sharding"))
    return feeds.query_plan(cities, feeds.publisher_dim(a.spark))


@query("feed_entries", (), """
    SELECT url AS google_news_id, 'Página ' || CAST(page_id AS VARCHAR) AS headline,
      regexp_extract(url, '//([^/]+)/', 1) AS publisher_name, 'BR' AS country FROM pages""")
def feed_entries(a: Archive) -> DataFrame:
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    entries = a.table("pages").select(
        F.lit(None).cast("string").alias("id"), F.col("url").alias("link"),
        F.concat(F.lit("Página "), F.col("page_id").cast("string"), F.lit(" - "), host).alias("title"),
        F.struct(host.alias("href")).alias("source"), F.lit(None).cast("timestamp").alias("published"),
        F.lit("q").alias("_search_query"), F.lit("c").alias("_city"), F.lit(None).cast("string").alias("_country"),
    )
    return feeds.normalise(entries).select("google_news_id", "headline", "publisher_name", "country")


@query("feed_dedupe", ("source",), """
    WITH known AS (SELECT google_news_id, resolved_url FROM source WHERE status = 'extracted'),
    b AS (SELECT id, google_news_id, resolved_url, fetched_at FROM source WHERE status <> 'extracted'
      AND google_news_id NOT IN (SELECT google_news_id FROM known)
      AND (resolved_url IS NULL OR resolved_url NOT IN (SELECT resolved_url FROM known WHERE resolved_url IS NOT NULL))),
    f AS (SELECT *, row_number() OVER (PARTITION BY google_news_id ORDER BY fetched_at, id) AS r FROM b),
    g AS (SELECT *, row_number() OVER (PARTITION BY resolved_url ORDER BY fetched_at, id) AS u FROM f WHERE r = 1)
    SELECT id, google_news_id FROM g WHERE resolved_url IS NULL OR u = 1""")
def feed_dedupe(a: Archive) -> DataFrame:
    columns = ["id", "google_news_id", "resolved_url", "fetched_at"]
    known = a.source.where(F.col("status") == "extracted")
    batch = a.source.where(F.col("status") != "extracted").select(*columns)
    return feeds.new_entries(batch, known, [F.col("fetched_at"), F.col("id")]).select("id", "google_news_id")


# --- rendered documents -------------------------------------------------------------------------
@query("record_documents", ("raw",), f"""
    SELECT id, md5('- ID: ' || CAST(id AS VARCHAR) || chr(10) || '- Vítima(s): ' || coalesce({fold_sql('name')}, '')
        || CASE WHEN name IS NULL THEN 'Não identificado' ELSE '' END || chr(10)
      || '- Local: ' || concat_ws(', ', neighborhood, city, state) || chr(10)
      || '- Data: ' || coalesce(strftime(event_date, '%Y-%m-%d'), 'Não especificada') || chr(10)
      || '- Tipo: ' || coalesce(homicide_type, 'Não especificado') || chr(10)
      || '- Descrição: ' || chronological_description) AS document FROM raw""")
def record_documents(a: Archive) -> DataFrame:
    c = F.col
    document = documents.record_document(
        c("id"), c("names"), c("neighborhood"), c("city"), c("state"), c("event_date"), c("homicide_type"),
        c("chronological_description"), c("title"),
    )
    return a.named_raw.select("id", F.md5(document).alias("document"))


@query("extraction_documents", ("article",), """
    SELECT id, length('## METADADOS DA NOTÍCIA / METADATOS DE LA NOTICIA' || chr(10) || chr(10)
      || '**Fonte / Medio:** ' || publisher_name || chr(10) || chr(10)
      || '**URL:** ' || resolved_url || chr(10) || chr(10)
      || chr(10) || '## CONTEÚDO DA NOTÍCIA / CONTENIDO DE LA NOTICIA' || chr(10) || chr(10) || content) AS chars FROM article""")
def extraction_documents(a: Archive) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    document = documents.extraction_document(
        F.col("content"), none, F.lit(None).cast("string"), F.col("publisher_name"), F.col("resolved_url")
    )
    return a.article.select("id", F.length(document).alias("chars"))
