"""Queries of entity resolution: blocking, duplicates, merges, fusion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions import payload
from casebook.operators import candidates, fusion, merge, neardup, ranking, resolve, sampling
from casebook.operators.components import connected_components
from casebook.plans.catalog_text import fold_sql
from casebook.plans.registry import query
from casebook.plans.standins import ORDERS_AS_OF, Archive
from casebook.session import cut, shelved

DAY_CITY = "CAST(event_date AS DATE)"


def ratio_steps(pairs: str) -> str:
    """Recursive steps ending in scored(a, b, score): the sequence ratio of distinct text pairs (a, b).

    Each step takes the longest common block, the earliest in a and then in b,
    and goes on with what lies left and right of it.
    """
    found = (
        "list_max(flatten([[CASE WHEN contains(y, substr(x, i, n)) THEN n * 100000 + 99999 - i ELSE 0 END"
        " FOR n IN range(1, length(x) - i + 2)] FOR i IN range(1, length(x) + 1)]))"
    )
    return f"""
    text_pair AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''),
    block AS (
      SELECT a, b, a AS x, b AS y, CAST(0 AS BIGINT) AS m FROM text_pair
      UNION ALL
      SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + n)]), unnest([substr(y, 1, j - 1), substr(y, j + n)]), unnest([n, 0])
      FROM (SELECT a, b, x, y, i, n, instr(y, substr(x, i, n)) AS j
        FROM (SELECT a, b, x, y, 99999 - best % 100000 AS i, best // 100000 AS n
          FROM (SELECT a, b, x, y, {found} AS best FROM block WHERE x <> '' AND y <> '') WHERE best > 0))),
    scored AS (SELECT a, b, 2.0::DOUBLE * sum(m) / (length(a) + length(b)) AS score FROM block GROUP BY a, b)"""


_RAW_TITLES = f"(SELECT *, lower(city) AS c, {fold_sql('title')} AS t FROM raw)"
_INCIDENT_TITLES = f"(SELECT *, lower(city) AS c, {fold_sql('title')} AS t FROM incident)"
_NAMES = f"""
    rn AS (SELECT id, lower(city) AS c, event_date, {fold_sql('name')} AS n FROM raw WHERE name IS NOT NULL),
    un AS (SELECT id, lower(city) AS c, event_date, {fold_sql("trim(split_part(victims_summary, ',', 1))")} AS n FROM incident WHERE victims_summary IS NOT NULL)"""
_TITLE_PAIRS = f"SELECT r.t AS a, u.t AS b FROM (SELECT DISTINCT c, t FROM {_RAW_TITLES}) r JOIN (SELECT DISTINCT c, t FROM {_INCIDENT_TITLES}) u USING (c)"
_NAME_PAIRS = "SELECT r.n AS a, u.n AS b FROM (SELECT DISTINCT c, n FROM rn) r JOIN (SELECT DISTINCT c, n FROM un) u USING (c)"
_BY_TITLE = f"""
    SELECT r.id AS raw_id, u.id AS unique_id, score FROM {_RAW_TITLES} r JOIN {_INCIDENT_TITLES} u ON r.c = u.c
      AND u.event_date BETWEEN r.event_date - INTERVAL 3 DAY AND r.event_date + INTERVAL 3 DAY
    JOIN scored ON a = r.t AND b = u.t WHERE score >= 0.8"""
_BY_NAME = """
    SELECT DISTINCT r.id AS raw_id, u.id AS unique_id FROM rn r JOIN un u ON r.c = u.c JOIN scored ON a = r.n AND b = u.n
    WHERE (score >= 0.85 OR contains(a, b) OR contains(b, a)) AND (u.event_date IS NULL
      OR u.event_date BETWEEN r.event_date - INTERVAL 10 DAY AND r.event_date + INTERVAL 10 DAY
      OR (r.event_date IS NULL AND u.event_date BETWEEN TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AND TIMESTAMP '2001-08-01'))"""
_ALL_CANDIDATES = f"""
    c AS (SELECT raw_id, unique_id, 0 AS rank FROM ({_BY_NAME})
      UNION ALL SELECT raw_id, unique_id, 1 FROM ({_BY_TITLE})
      UNION ALL SELECT r.id, u.id, 2 FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
        AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY
      UNION ALL SELECT r.id, u.id, 3 FROM raw r JOIN incident u ON lower(r.city) = lower(u.city) AND lower(r.neighborhood) = lower(u.neighborhood)
        AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY WHERE r.name IS NULL)"""


# --- blocking ---------------------------------------------------------------------------
@query("block_date_city", ("raw", "incident"), """
    SELECT r.id AS raw_id, u.id AS unique_id FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
      AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY""")
def block_date_city(a: Archive) -> DataFrame:
    return candidates.by_date_city(a.raw, a.incident).select(F.col("r_id").alias("raw_id"), F.col("u_id").alias("unique_id"))


@query("block_neighborhood", ("raw", "incident"), """
    SELECT r.id AS raw_id, u.id AS unique_id FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
      AND lower(r.neighborhood) = lower(u.neighborhood)
      AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY
    WHERE r.name IS NULL""")
def block_neighborhood(a: Archive) -> DataFrame:
    unnamed = a.raw.where(F.col("name").isNull())
    return candidates.by_neighborhood(unnamed, a.incident).select(
        F.col("r_id").alias("raw_id"), F.col("u_id").alias("unique_id")
    )


@query("title_fuzzy_block", ("raw", "incident"), f"""
    WITH RECURSIVE {ratio_steps(_TITLE_PAIRS)}
    SELECT raw_id, unique_id, round(score, 6) AS similarity FROM ({_BY_TITLE})""")
def title_fuzzy_block(a: Archive) -> DataFrame:
    return candidates.by_title(a.raw, a.incident).select(
        F.col("r_id").alias("raw_id"), F.col("u_id").alias("unique_id"), F.round("similarity", 6).alias("similarity")
    )


@query("title_equal_block", ("raw", "incident"), f"""
    SELECT r.id AS raw_id, u.id AS unique_id FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
      AND u.event_date BETWEEN r.event_date - INTERVAL 3 DAY AND r.event_date + INTERVAL 3 DAY
      AND {fold_sql('r.title')} = {fold_sql('u.title')}""")
def title_equal_block(a: Archive) -> DataFrame:
    from casebook.functions.text import fold

    same = [(F.lower("city"), F.lower("city")), (fold(F.col("title")), fold(F.col("title")))]
    pairs = candidates.window_join(a.raw, a.incident, 3, same)
    return pairs.select(F.col("r_id").alias("raw_id"), F.col("u_id").alias("unique_id"))


@query("victim_name_block", ("raw", "incident"), f"""
    WITH RECURSIVE {_NAMES}, {ratio_steps(_NAME_PAIRS)} SELECT raw_id, unique_id FROM ({_BY_NAME})""")
def victim_name_block(a: Archive) -> DataFrame:
    needed = ["id", "city", "event_date", "names"]  # read for the repeats, the names and each kind of date
    records, incidents = (shelved(df.select(*needed), "named") for df in (a.named_raw, a.named_incident))
    return candidates.by_victim_name(records, incidents, ORDERS_AS_OF).select(
        F.col("r_id").alias("raw_id"), F.col("u_id").alias("unique_id")
    )


@query("candidate_union", ("raw", "incident"), """
    WITH p AS (
      SELECT r.id AS raw_id, u.id AS unique_id, 2 AS rank FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
        AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY
      UNION ALL
      SELECT r.id, u.id, 3 FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
        AND lower(r.neighborhood) = lower(u.neighborhood)
        AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY WHERE r.name IS NULL)
    SELECT raw_id, unique_id, CASE min(rank) WHEN 2 THEN 'date_city' ELSE 'neighborhood' END AS strategy,
      count(DISTINCT rank) AS strategies FROM p GROUP BY 1, 2""")
def candidate_union(a: Archive) -> DataFrame:
    records, incidents = candidates.with_repeats(a.raw), candidates.with_repeats(a.incident)
    return candidates.union_candidates({"date_city": candidates.by_date_and_place(records, incidents, F.col("name").isNull())})


@query("all_candidates", ("raw", "incident"), f"""
    WITH RECURSIVE {_NAMES}, {ratio_steps(f"{_TITLE_PAIRS} UNION {_NAME_PAIRS}")}, {_ALL_CANDIDATES}
    SELECT raw_id, unique_id, ['victim_name', 'title', 'date_city', 'neighborhood'][min(rank) + 1] AS strategy,
      count(DISTINCT rank) AS strategies FROM c GROUP BY 1, 2""")
def all_candidates(a: Archive) -> DataFrame:
    return candidates.find_candidates(a.named_raw, a.named_incident, ORDERS_AS_OF)


@query("nearest_k", ("raw", "incident"), """
    SELECT raw_id, unique_id, gap_days, rank FROM (
      SELECT r.id AS raw_id, u.id AS unique_id, CAST(abs(date_diff('day', CAST(r.event_date AS DATE), CAST(u.event_date AS DATE))) AS INT) AS gap_days,
        row_number() OVER (PARTITION BY r.id ORDER BY abs(date_diff('day', CAST(r.event_date AS DATE), CAST(u.event_date AS DATE))), u.id) AS rank
      FROM raw r JOIN incident u ON lower(r.city) = lower(u.city)
        AND u.event_date BETWEEN r.event_date - INTERVAL 7 DAY AND r.event_date + INTERVAL 7 DAY
      WHERE abs(date_diff('day', CAST(r.event_date AS DATE), CAST(u.event_date AS DATE))) >= 2) WHERE rank <= 3""")
def nearest_k(a: Archive) -> DataFrame:
    near = candidates.nearest_in_time(a.raw, a.incident, 3, 2, 7)
    return near.select(F.col("r_id").alias("raw_id"), F.col("u_id").alias("unique_id"), "gap_days", "rank")


# --- duplicates ---------------------------------------------------------------------------
@query("exact_duplicates", ("incident",), f"""
    SELECT group_id, id, survivor_id, size FROM (
      SELECT id, min(id) OVER w AS group_id, count(*) OVER w AS size,
        first_value(id) OVER (PARTITION BY t, c, d ORDER BY source_count DESC, id) AS survivor_id
      FROM (SELECT id, source_count, {fold_sql('title')} AS t, {fold_sql('city')} AS c, {DAY_CITY} AS d FROM incident)
      WHERE t <> '' AND c <> '' AND d IS NOT NULL
      WINDOW w AS (PARTITION BY t, c, d)) WHERE size > 1""")
def exact_duplicates(a: Archive) -> DataFrame:
    return merge.exact_groups(a.incident).select("group_id", "id", "survivor_id", "size")


@query("components", (), """
    WITH RECURSIVE e AS (SELECT conv_id * 2 AS a, doc_id * 2 + 1 AS b FROM conversations JOIN documents
        ON md5(conversations.text) = md5(documents.text)
      UNION SELECT c_custkey * 2, c_nationkey * 200000 + CAST(floor(c_acctbal / 100) AS BIGINT) * 2 + 1 FROM customer),
    n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r(x, y) AS (SELECT x, x FROM n UNION SELECT r.x, n.y FROM r JOIN n ON r.y = n.x)
    SELECT x AS id, min(y) AS component FROM r GROUP BY 1""")
def components(a: Archive) -> DataFrame:
    """Customers tied together by nation and balance band, found as graph components."""
    band = F.col("c_nationkey") * 200000 + F.floor(F.col("c_acctbal") / 100).cast("long") * 2 + 1
    edges = a.table("customer").select((F.col("c_custkey") * 2).alias("id_a"), band.alias("id_b"))
    same = a.table("conversations").select("conv_id", F.md5("text").alias("h")).join(
        a.table("documents").select("doc_id", F.md5("text").alias("h")), "h"
    ).select((F.col("conv_id") * 2).alias("id_a"), (F.col("doc_id") * 2 + 1).alias("id_b"))
    return connected_components(edges.unionByName(same))


@query("near_dup_native", ("incident",), f"""
    WITH RECURSIVE t AS (SELECT id, {fold_sql('title')} AS t, {fold_sql("coalesce(city, '')")} AS c, {DAY_CITY} AS d,
        {fold_sql("split_part(victims_summary, ',', 1)")} AS k,
        {fold_sql("chronological_description")} AS g FROM incident
      WHERE (content_class IS NULL OR content_class = 'incident') AND city IS NOT NULL AND event_date IS NOT NULL),
    e AS (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.c = y.c AND x.d = y.d AND x.id <> y.id
      WHERE (x.k <> '' AND y.k <> '' AND (x.k = y.k OR contains(x.k, y.k) OR contains(y.k, x.k)))
        OR contains(x.t, y.t) OR contains(y.t, x.t) OR x.g = y.g),
    r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT x AS id, min(y) AS component FROM r GROUP BY 1""")
def near_dup_native(a: Archive) -> DataFrame:
    from casebook.operators.filters import scan_scope

    rows = cut(neardup.features(a.named_incident.where(scan_scope())))
    return neardup.native_components(rows)


# Members of the near-duplicate groups of the incidents since 1995: steps t ... m, then the rows.
_NEAR_STEPS = f"""
    t AS (SELECT id, coalesce(source_count, 1) AS n, {fold_sql('title')} AS t, {fold_sql('city')} AS c, {DAY_CITY} AS d,
        coalesce({fold_sql("split_part(victims_summary, ',', 1)")}, '') AS k, {fold_sql("chronological_description")} AS g FROM incident
      WHERE (content_class IS NULL OR content_class = 'incident') AND city IS NOT NULL AND event_date >= TIMESTAMP '1995-01-01'),
    o AS (SELECT x.id AS x, y.id AS y, x.t AS xt, y.t AS yt, x.g AS xg, y.g AS yg, x.k AS xk, y.k AS yk
      FROM t x JOIN t y ON x.c = y.c AND x.d = y.d AND x.id <> y.id),
    {ratio_steps("SELECT xt AS a, yt AS b FROM o UNION SELECT xg, yg FROM o")},
    e AS (SELECT DISTINCT x AS a, y AS b FROM o JOIN scored s ON s.a = xt AND s.b = yt JOIN scored g ON g.a = xg AND g.b = yg
      WHERE (xk <> '' AND yk <> '' AND (xk = yk OR contains(xk, yk) OR contains(yk, xk)))
        OR contains(xt, yt) OR contains(yt, xt) OR s.score >= 0.8 OR g.score >= 0.55),
    w(x, y) AS (SELECT a, a FROM e UNION SELECT w.x, e.b FROM w JOIN e ON w.y = e.a),
    m AS (SELECT x AS id, min(y) AS group_id FROM w GROUP BY 1)"""
_NEAR_ROWS = """
    SELECT group_id, id, first_value(id) OVER (PARTITION BY group_id ORDER BY n DESC, id) AS survivor_id,
      count(*) OVER (PARTITION BY group_id) AS size FROM m JOIN t USING (id)"""


@query("near_dup_groups", ("incident",), f"WITH RECURSIVE {_NEAR_STEPS} {_NEAR_ROWS}")
def near_dup_groups(a: Archive) -> DataFrame:
    members = neardup.near_duplicate_members(a.named_incident, dt.date(1995, 1, 1))
    return members.select("group_id", "id", "survivor_id", "size")


def _bits(text: str) -> str:
    return "CASE WHEN length(" + text + ") < 40 THEN 0 ELSE " + " + ".join(
        f"CASE WHEN regexp_matches({text}, '{p}') THEN {1 << i} ELSE 0 END" for i, p in enumerate(fixed.CONTEXT_CUES)) + " END"


_STOPWORDS = "[" + ", ".join(f"'{w}'" for w in fixed.NAME_STOPWORDS) + "]"
_INSIDE = "length(p) > 5 AND length(q) > 5 AND (contains(p, q) OR contains(q, p))"
# Records in comparable form, contents under their smallest id, their pairs in one block, and each pair's first signal.
_SIGNALS = f"""
    f AS (SELECT id, coalesce(source_count, 1) AS n, title, city, CAST(event_date AS DATE) AS day, {fold_sql('city')} AS c, {fold_sql('title')} AS t,
        {fold_sql('chronological_description')} AS g, {fold_sql('victims_summary')} AS v,
        {fold_sql("concat_ws(' ', nullif(chronological_description, ''), nullif(victims_summary, ''), nullif(neighborhood, ''))")} AS x
      FROM report WHERE (content_class IS NULL OR content_class = 'incident') AND city IS NOT NULL AND event_date IS NOT NULL),
    k AS (SELECT *, {_bits('x')} AS cues, CASE WHEN v = '' THEN [] ELSE list_distinct([v, w[1] || ' ' || w[-1]]
        || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS keys
      FROM (SELECT *, [p FOR p IN string_split(v, ' ') IF NOT list_contains({_STOPWORDS}, p)] AS w FROM f)),
    u AS (SELECT *, min(id) OVER (PARTITION BY day, c, t, g, v, x) AS class_id FROM k),
    o AS (SELECT a.id AS id_a, b.id AS id_b, a.t AS ta, b.t AS tb, a.g AS ga, b.g AS gb, a.x AS xa, b.x AS xb, a.cues & b.cues > 0 AS cued,
        list_has_any(a.keys, b.keys) OR len([1 FOR p IN a.keys IF len([1 FOR q IN b.keys IF {_INSIDE}]) > 0]) > 0 AS named
      FROM u a JOIN u b ON a.day = b.day AND a.c = b.c AND a.id < b.id WHERE a.id = a.class_id AND b.id = b.class_id),
    open AS (SELECT * FROM o WHERE NOT named AND NOT (ta <> '' AND tb <> '' AND (contains(ta, tb) OR contains(tb, ta)))),
    {ratio_steps("SELECT ta AS a, tb AS b FROM open UNION SELECT ga, gb FROM open UNION SELECT xa, xb FROM open WHERE cued")},
    r AS (SELECT o.*, t.score AS title, g.score AS text, coalesce(cued AND x.score >= 0.28, FALSE) AS told
      FROM o LEFT JOIN scored t ON t.a = ta AND t.b = tb LEFT JOIN scored g ON g.a = ga AND g.b = gb LEFT JOIN scored x ON x.a = xa AND x.b = xb),
    s AS (SELECT id_a, id_b, CASE WHEN named THEN 'victim_name' WHEN ta <> '' AND tb <> '' AND (contains(ta, tb) OR contains(tb, ta)) THEN 'title_substring'
        WHEN title >= 0.8 THEN 'title_fuzzy' WHEN title >= 0.72 AND told THEN 'title_soft_mo' WHEN text >= 0.55 THEN 'description_fuzzy'
        WHEN told THEN 'mo_context' END AS signal, title, text FROM r)"""
_SCORE = """CASE signal WHEN 'victim_name' THEN 1.0 WHEN 'title_substring' THEN 0.95 WHEN 'mo_context' THEN 0.85
        WHEN 'description_fuzzy' THEN s.text ELSE s.title END"""


@query("near_dup_pairs", ("report",), f"""
    WITH RECURSIVE {_SIGNALS}
    SELECT id_a, id_b, round({_SCORE}, 3) AS similarity, signal, a.title AS title_a, b.title AS title_b, a.city, a.day AS event_date,
      a.n AS source_count_a, b.n AS source_count_b, CASE WHEN a.n >= b.n THEN id_a ELSE id_b END AS suggested_survivor_id
    FROM s JOIN f a ON a.id = id_a JOIN f b ON b.id = id_b WHERE signal IS NOT NULL""")
def near_dup_pairs(a: Archive) -> DataFrame:
    """Every pair of different contents with a signal, a content standing for all its copies."""
    pairs, _ = neardup.near_duplicate_pairs(a.report)
    return neardup.pair_rows(pairs, a.report).withColumn("title_a", F.nullif("title_a", F.lit(""))).withColumn("title_b", F.nullif("title_b", F.lit("")))


@query("near_dup_members", ("report",), f"""
    WITH RECURSIVE {_SIGNALS},
    e AS (SELECT id_a AS a, id_b AS b FROM s WHERE signal IS NOT NULL UNION SELECT id_b, id_a FROM s WHERE signal IS NOT NULL
      UNION SELECT id, class_id FROM u WHERE id <> class_id UNION SELECT class_id, id FROM u WHERE id <> class_id),
    w(p, q) AS (SELECT a, a FROM e UNION SELECT w.p, e.b FROM w JOIN e ON w.q = e.a),
    m AS (SELECT p AS id, min(q) AS group_id FROM w GROUP BY 1)
    SELECT group_id, id, first_value(id) OVER (PARTITION BY group_id ORDER BY n DESC, id) AS survivor_id,
      count(*) OVER (PARTITION BY group_id) AS size FROM m JOIN f USING (id)""")
def near_dup_members(a: Archive) -> DataFrame:
    """Group, survivor and size of every report that shares a group."""
    return neardup.near_duplicate_members(a.report).select("group_id", "id", "survivor_id", "size")


@query("near_dup_classes", ("report",), f"""
    WITH RECURSIVE {_SIGNALS},
    l AS (SELECT id_a AS i FROM s WHERE signal IS NOT NULL UNION ALL SELECT id_b FROM s WHERE signal IS NOT NULL)
    SELECT u.id, class_id, count(i) AS links FROM u LEFT JOIN l ON i = class_id GROUP BY 1, 2""")
def near_dup_classes(a: Archive) -> DataFrame:
    """Every report in scope with its content's class and how many other contents that class links to."""
    pairs, classes = neardup.near_duplicate_pairs(a.report)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return classes.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


@query("largest_duplicate_groups", ("incident",), f"""
    SELECT group_id, survivor_id, size FROM (
      SELECT min(id) AS group_id, count(*) AS size, arg_max(id, (source_count, -id)) AS survivor_id
      FROM (SELECT id, coalesce(source_count, 1) AS source_count, {fold_sql('title')} AS t, {fold_sql('city')} AS c, {DAY_CITY} AS d FROM incident)
      WHERE t <> '' AND c <> '' AND d IS NOT NULL GROUP BY t, c, d HAVING count(*) > 1)
    ORDER BY size DESC, group_id LIMIT 15""")
def largest_duplicate_groups(a: Archive) -> DataFrame:
    groups = merge.exact_groups(a.incident).select("group_id", "survivor_id", "size").distinct()
    return ranking.largest_groups(groups)


_PENDING = f"""
    p AS (SELECT id, CASE WHEN event_date IS NOT NULL AND coalesce(city, '') <> '' THEN CAST(CAST(event_date AS DATE) AS VARCHAR) ELSE 'no_date' END AS gd,
        CASE WHEN coalesce(city, '') <> '' THEN lower(city) ELSE 'unknown' END AS gc, CAST(event_date AS DATE) AS day, {fold_sql('city')} AS c,
        event_date IS NOT NULL AND city IS NOT NULL AS placed, CASE WHEN name IS NULL THEN '' ELSE {fold_sql('name')} END AS n, {fold_sql('title')} AS t
      FROM raw WHERE deduplication_status = 'pending')"""


def _pending_pairs(block: str, names: bool) -> str:
    """o: pairs of one block, smaller id first; scored: the ratios of their texts."""
    texts = "SELECT ta AS a, tb AS b FROM o" + (" UNION SELECT na, nb FROM o" if names else "")
    return f"""o AS (SELECT x.id AS x, y.id AS y, x.t AS ta, y.t AS tb, x.n AS na, y.n AS nb FROM p x JOIN p y ON {block} AND x.id < y.id),
    {ratio_steps(texts)}"""


_PENDING_STEPS = f"""{_PENDING}, {_pending_pairs("x.gd = y.gd AND x.gc = y.gc", True)},
    m AS (SELECT x, y FROM o LEFT JOIN scored t ON t.a = ta AND t.b = tb LEFT JOIN scored s ON s.a = na AND s.b = nb
      WHERE (na <> '' AND nb <> '' AND (contains(na, nb) OR contains(nb, na) OR s.score >= 0.85)) OR (ta <> '' AND ta = tb) OR t.score >= 0.8),
    e AS (SELECT x AS a, y AS b FROM m UNION SELECT y, x FROM m),
    w(p, q) AS (SELECT a, a FROM e UNION SELECT w.p, e.b FROM w JOIN e ON w.q = e.a)"""
_PENDING_ROWS = "SELECT id, coalesce(min(q), id) AS cluster_id FROM p LEFT JOIN w ON w.p = id GROUP BY id"


@query("pending_clusters", ("raw",), f"WITH RECURSIVE {_PENDING_STEPS} {_PENDING_ROWS}")
def pending_clusters(a: Archive) -> DataFrame:
    pending = a.named_raw.where(F.col("deduplication_status") == "pending")
    grouped = neardup.pending_groups(pending)
    return neardup.cluster_groups(grouped, resolve.GROUP)


@query("model_clusters", ("raw",), f"""
    WITH RECURSIVE {_PENDING_STEPS}, c AS ({_PENDING_ROWS}),
    k AS (SELECT id, gd, gc, row_number() OVER (PARTITION BY gd, gc ORDER BY id) AS no FROM p WHERE n = '' AND id NOT IN (SELECT a FROM e))
    SELECT id, cluster_id FROM c WHERE id NOT IN (SELECT id FROM k)
    UNION ALL SELECT id, CASE WHEN no <= 2 THEN min(id) FILTER (no <= 2) OVER (PARTITION BY gd, gc) ELSE id END FROM k WHERE no <= 3""")
def model_clusters(a: Archive) -> DataFrame:
    """Pending clusters where a model put the first two nameless records of each group together and the third alone."""
    grouped = neardup.pending_groups(a.named_raw.where(F.col("deduplication_status") == "pending"))
    said = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(900_000_000)))
    predictions = grouped.select(*resolve.GROUP).distinct().withColumn("clusters", said)
    return neardup.cluster_groups(grouped, resolve.GROUP, predictions)


@query("pending_overlaps", ("raw",), f"""
    WITH RECURSIVE {_PENDING}, {_pending_pairs("x.day = y.day AND x.c = y.c AND x.placed AND y.placed", False)},
    m AS (SELECT x, y FROM o LEFT JOIN scored t ON t.a = ta AND t.b = tb
      WHERE (na <> '' AND na = nb) OR (length(na) >= 6 AND length(nb) >= 6 AND (contains(na, nb) OR contains(nb, na))) OR ta = tb OR t.score >= 0.7)
    SELECT day, c AS city_key, count(*) AS members, min(id) AS first_id, max(id) AS last_id
    FROM p WHERE id IN (SELECT x FROM m UNION SELECT y FROM m) GROUP BY 1, 2""")
def pending_overlaps(a: Archive) -> DataFrame:
    pending = a.named_raw.where(F.col("deduplication_status") == "pending")
    return neardup.pending_overlaps(pending)


# --- merges ----------------------------------------------------------------------------------
_PLAN = f"""plan AS (SELECT id AS loser, survivor FROM (
      SELECT id, count(*) OVER (PARTITION BY t, c, d) AS size,
        first_value(id) OVER (PARTITION BY t, c, d ORDER BY source_count DESC, id) AS survivor
      FROM (SELECT id, source_count, {fold_sql('title')} AS t, {fold_sql('city')} AS c, {DAY_CITY} AS d FROM incident)
      WHERE t <> '' AND c <> '' AND d IS NOT NULL) WHERE size > 1 AND id <> survivor)"""


# What is left of the incidents after the merges of `plan`.
_AFTER_MERGE = """
    links AS (SELECT coalesce(survivor, unique_event_id) AS u, count(*) AS n FROM raw LEFT JOIN plan ON unique_event_id = loser
      WHERE unique_event_id IS NOT NULL GROUP BY 1),
    donor AS (SELECT survivor, min(loser) AS loser FROM plan JOIN incident ON id = loser WHERE latitude IS NOT NULL GROUP BY 1)
    SELECT i.id, CAST(CASE WHEN i.id IN (SELECT survivor FROM plan) THEN coalesce(links.n, 0) ELSE i.source_count END AS INT) AS source_count,
      coalesce(i.latitude, g.latitude) AS latitude,
      CASE WHEN i.latitude IS NULL THEN g.longitude ELSE i.longitude END AS longitude,
      CASE WHEN i.id IN (SELECT survivor FROM plan) THEN TRUE ELSE i.needs_enrichment END AS needs_enrichment
    FROM incident i LEFT JOIN links ON i.id = links.u LEFT JOIN donor d ON i.id = d.survivor LEFT JOIN incident g ON g.id = d.loser
    WHERE i.id NOT IN (SELECT loser FROM plan)"""


@query("survivor_merge", ("incident", "raw"), f"WITH {_PLAN}, {_AFTER_MERGE}")
def survivor_merge(a: Archive) -> DataFrame:
    merged, _, _ = merge.merge_exact(a.incident, a.raw)
    return merged.select("id", "source_count", "latitude", "longitude", "needs_enrichment")


@query("near_merge", ("incident", "raw"), f"""
    WITH RECURSIVE {_NEAR_STEPS}, near AS ({_NEAR_ROWS}), plan AS (SELECT id AS loser, survivor_id AS survivor FROM near WHERE id <> survivor_id),
    {_AFTER_MERGE}""")
def near_merge(a: Archive) -> DataFrame:
    """Incidents after the near-duplicate merge."""
    merged, _, _ = merge.merge_near(a.named_incident, a.raw, dt.date(1995, 1, 1))
    return merged.select("id", "source_count", "latitude", "longitude", "needs_enrichment")


@query("near_merge_audit", ("incident", "raw"), f"""
    WITH RECURSIVE {_NEAR_STEPS}, near AS ({_NEAR_ROWS}), plan AS (SELECT id AS loser, survivor_id AS survivor FROM near WHERE id <> survivor_id)
    SELECT survivor AS survivor_id, count(DISTINCT loser) AS events_merged, count(raw.id) AS records_relinked
    FROM plan LEFT JOIN raw ON unique_event_id = loser GROUP BY 1""")
def near_merge_audit(a: Archive) -> DataFrame:
    """Per survivor, the incidents merged into it and the records that moved."""
    _, _, audit = merge.merge_near(a.named_incident, a.raw, dt.date(1995, 1, 1))
    return audit


@query("relink_links", ("incident", "raw"), f"""
    WITH {_PLAN}
    SELECT raw.id, coalesce(survivor, unique_event_id) AS unique_event_id,
      CASE WHEN survivor IS NOT NULL THEN 'matched' ELSE deduplication_status END AS deduplication_status
    FROM raw LEFT JOIN plan ON unique_event_id = loser""")
def relink_links(a: Archive) -> DataFrame:
    plan = merge.plan_from_members(merge.exact_groups(a.incident))
    return merge.relink(a.raw, plan).select("id", "unique_event_id", "deduplication_status")


@query("merge_audit", ("incident", "raw"), f"""
    WITH {_PLAN}
    SELECT count(DISTINCT survivor) AS groups, count(*) AS events_merged,
      (SELECT count(*) FROM raw JOIN plan ON unique_event_id = loser) AS records_relinked FROM plan""")
def merge_audit(a: Archive) -> DataFrame:
    _, _, audit = merge.merge_exact(a.incident, a.raw)
    return merge.merge_totals(audit)


@query("merge_by_ids", ("incident",), """
    WITH asked AS (SELECT id AS survivor_id, id + 1 AS loser_id FROM incident WHERE id % 4 = 0)
    SELECT loser_id, survivor_id, CASE WHEN loser_id IN (SELECT id FROM incident) THEN 'merge' ELSE 'loser_missing' END AS outcome FROM asked""")
def merge_by_ids(a: Archive) -> DataFrame:
    asked = a.incident.where(F.col("id") % 4 == 0).select(F.col("id").alias("survivor_id"), (F.col("id") + 1).alias("loser_id"))
    plan, skipped = merge.plan_from_ids(a.incident, asked)
    return plan.select("loser_id", "survivor_id", F.lit("merge").alias("outcome")).unionByName(
        skipped.select("loser_id", "survivor_id", F.col("problem").alias("outcome"))
    )


@query("source_counts", ("incident", "raw"), """
    SELECT i.id, CAST(count(r.id) AS INT) AS source_count FROM incident i LEFT JOIN raw r ON r.unique_event_id = i.id GROUP BY 1""")
def source_counts(a: Archive) -> DataFrame:
    return merge.refresh_source_counts(a.incident, a.raw).select("id", "source_count")


# --- fusion -----------------------------------------------------------------------------------
_VOTES = """
    n AS (SELECT unique_event_id AS k, victim_count AS v, count(*) AS c FROM raw WHERE victim_count IS NOT NULL
      AND unique_event_id IS NOT NULL GROUP BY 1, 2),
    ni AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, v DESC) r FROM n) WHERE r = 1),
    t AS (SELECT unique_event_id AS k, trim(city) AS v, count(*) AS c, min(id) AS f FROM raw WHERE trim(city) <> ''
      AND unique_event_id IS NOT NULL GROUP BY 1, 2),
    ti AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c DESC, f) r FROM t) WHERE r = 1)"""


@query("majority_vote", ("raw",), f"""
    WITH {_VOTES}
    SELECT coalesce(ni.k, ti.k) AS unique_event_id, ni.v AS victim_count, ti.v AS city FROM ni FULL JOIN ti ON ni.k = ti.k""")
def majority_vote(a: Archive) -> DataFrame:
    return fusion.field_consensus(a.raw.where(F.col("unique_event_id").isNotNull()))


@query("best_row", ("raw",), """
    SELECT unique_event_id, id FROM (SELECT unique_event_id, id, row_number() OVER (PARTITION BY unique_event_id ORDER BY
      CASE WHEN name IS NULL THEN 0 ELSE 1 END DESC, CASE WHEN neighborhood IS NULL THEN 0 ELSE 1 END DESC,
      CASE WHEN event_date IS NULL THEN 0 ELSE 1 END DESC, created_at DESC, id) AS r FROM raw WHERE unique_event_id IS NOT NULL) WHERE r = 1""")
def best_row(a: Archive) -> DataFrame:
    linked = a.named_raw.where(F.col("unique_event_id").isNotNull())
    return fusion.best_records(linked, "unique_event_id").select("unique_event_id", "id")


@query("cluster_incidents", ("raw",), """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY unique_event_id ORDER BY CASE WHEN name IS NULL THEN 0 ELSE 1 END DESC,
        CASE WHEN neighborhood IS NULL THEN 0 ELSE 1 END DESC, CASE WHEN event_date IS NULL THEN 0 ELSE 1 END DESC,
        created_at DESC, id) AS r, count(*) OVER (PARTITION BY unique_event_id) AS n FROM raw WHERE unique_event_id IS NOT NULL)
    SELECT unique_event_id AS id, city, victim_count, title, CAST(n AS INT) AS source_count, content_class,
      security_force_involved FROM b WHERE r = 1""")
def cluster_incidents(a: Archive) -> DataFrame:
    clustered = _raw_event(a).where(F.col("unique_event_id").isNotNull()).withColumn("cluster_id", F.col("unique_event_id"))
    incidents, _ = fusion.incidents_from_clusters(clustered)
    return incidents.select("id", "city", "victim_count", "title", "source_count", "content_class", "security_force_involved")


def _raw_event(a: Archive) -> DataFrame:
    """Records with every raw-event column incident creation reads."""
    nothing = {c: F.lit(None).cast("string") for c in ("extraction_data", "date_precision", "time_of_day")}
    numbers = {c: F.lit(None).cast("int") for c in ("identified_victim_count", "perpetrator_count")}
    return a.named_raw.withColumns({**nothing, **numbers, "security_force_victim": F.lit(None).cast("boolean")})


@query("fused_incidents", ("incident", "raw"), f"""
    WITH {_VOTES}
    SELECT i.id, coalesce(ni.v, i.victim_count) AS victim_count, coalesce(ti.v, i.city) AS city, 'Novo ' || i.title AS title,
      FALSE AS needs_enrichment FROM incident i LEFT JOIN ni ON i.id = ni.k LEFT JOIN ti ON i.id = ti.k""")
def fused_incidents(a: Archive) -> DataFrame:
    synthesis = a.incident.select("id", F.concat(F.lit("Novo "), F.col("title")).alias("title"))
    incidents = a.incident.withColumn("merged_data", F.lit(None).cast("string"))
    records = _raw_event(a).where(F.col("unique_event_id").isNotNull())
    return fusion.fuse(incidents, synthesis, records).select("id", "victim_count", "city", "title", "needs_enrichment")


@query("public_field_derivation", ("raw",), """
    SELECT id, CASE WHEN name IS NOT NULL AND l % 3 = 0 THEN TRUE WHEN name IS NOT NULL THEN FALSE END AS security_force_victim,
      CASE WHEN l % 2 = 0 THEN 'facao a; facao b' END AS criminal_groups,
      CASE WHEN l % 2 = 0 THEN TRUE END AS criminal_group_connected
    FROM (SELECT id, name, id AS l FROM raw)""")
def public_field_derivation(a: Archive) -> DataFrame:
    victim = F.when(
        F.col("name").isNotNull(),
        F.array(F.struct(F.col("name").alias("name"), (F.col("id") % 3 == 0).alias("is_security_force"))),
    ).otherwise(F.array().cast("array<struct<name:string,is_security_force:boolean>>"))
    group = F.struct(
        F.array(F.lit(" facao a "), F.lit(""), F.lit("facao b")).alias("groups"), F.lit("disputa").alias("activity")
    )
    record = F.to_json(F.struct(
        F.struct(victim.alias("identifiable_victims")).alias("victims"),
        F.struct(F.when(F.col("id") % 2 == 0, group).alias("criminal_group_context")).alias("homicide_dynamic"),
    ))
    parsed = a.raw.select("id", payload.parse(record).alias("r"))
    fields = payload.public_fields(F.col("r"))
    return parsed.withColumn("f", fields).select("id", "f.security_force_victim", "f.criminal_groups", "f.criminal_group_connected")


_DATE_TEXTS = "CASE id % 4 WHEN 0 THEN '2024-02-31' WHEN 1 THEN 'sem data' ELSE strftime(event_date, '%Y-%m-%d') END"


@query("raw_event_columns", ("raw",), """
    SELECT id, CASE WHEN id % 4 > 1 THEN date_trunc('day', event_date) END AS event_date, city, state, neighborhood, victim_count,
      CAST(id % 3 AS INT) AS identified_victim_count, event_family, event_subtype,
      CASE WHEN event_family = 'homicidio' THEN 'Homicídio' END AS homicide_type, method_of_death, title, chronological_description, content_class,
      TRUE AS extraction_success FROM raw""")
def raw_event_columns(a: Archive) -> DataFrame:
    """Flat columns of nested records; days that no calendar has become null."""
    parsed = _nested(a).select("id", payload.raw_columns(F.col("r")).alias("c")).select("id", "c.*")
    return parsed.select(
        "id", F.col("event_date").cast("timestamp_ntz").alias("event_date"), "city", "state", "neighborhood", "victim_count", "identified_victim_count",
        "event_family", "event_subtype", "homicide_type", "method_of_death", "title", "chronological_description", "content_class", "extraction_success")


@query("scored_case_fields", ("raw",), f"""
    SELECT id, {_DATE_TEXTS} AS date, id % 2 = 0 AS has_explicit_date, city, state, neighborhood, victim_count AS number_of_victims,
      event_family, event_subtype, method_of_death AS method FROM raw""")
def scored_case_fields(a: Archive) -> DataFrame:
    """Fields of nested records that evaluation compares."""
    return _nested(a).select("id", payload.scored_fields(F.col("r")).alias("f")).select("id", "f.*")


def _nested(a: Archive) -> DataFrame:
    """(id, r): each record written as JSON and parsed back."""
    day = F.when(F.col("id") % 4 == 0, "2024-02-31").when(F.col("id") % 4 == 1, "sem data").otherwise(F.date_format("event_date", "yyyy-MM-dd"))
    record = F.struct(
        F.struct("city", "state", "neighborhood").alias("location_info"),
        F.struct(day.alias("date"), F.struct((F.col("id") % 2 == 0).alias("has_explicit_date")).alias("date_verification")).alias("date_time"),
        F.struct(F.col("victim_count").alias("number_of_victims"), (F.col("id") % 3).cast("int").alias("number_of_identifiable_victims")).alias("victims"),
        F.struct("title", F.col("method_of_death").alias("method"), "chronological_description").alias("homicide_dynamic"),
        "event_family", "event_subtype", "content_class",
    )
    return a.raw.select("id", payload.parse(F.to_json(record)).alias("r"))


# --- resolution pass and case building -----------------------------------------------------------
@query("accepted_matches", ("raw", "incident"), f"""
    WITH RECURSIVE {_NAMES}, {ratio_steps(f"{_TITLE_PAIRS} UNION {_NAME_PAIRS}")}, {_ALL_CANDIDATES},
    first AS (SELECT city, CAST(event_date AS DATE) AS day, min(id) AS unique_id FROM incident WHERE event_date IS NOT NULL GROUP BY 1, 2),
    said AS (SELECT raw.id AS raw_id, unique_id, (raw.id % 10)::DOUBLE / 10 AS confidence FROM raw JOIN first ON raw.city = first.city
      AND CAST(raw.event_date AS DATE) = day)
    SELECT raw_id, unique_id, confidence FROM said WHERE confidence >= 0.6 AND (raw_id, unique_id) IN (SELECT (raw_id, unique_id) FROM c)""")
def accepted_matches(a: Archive) -> DataFrame:
    return candidates.accept_matches(_predictions(a), a.named_raw, a.named_incident, ORDERS_AS_OF)


def _predictions(a: Archive) -> DataFrame:
    """Model answers: every record is proposed the lowest incident of its day and city."""
    first = a.incident.where(F.col("event_date").isNotNull()).groupBy("city", F.to_date("event_date").alias("day")).agg(
        F.min("id").alias("unique_id")
    )
    confidence = (F.col("id") % 10).cast("double") / 10
    return a.raw.withColumn("day", F.to_date("event_date")).join(first, ["city", "day"]).select(
        F.col("id").alias("raw_id"), "unique_id", F.lit(True).alias("match"), confidence.alias("confidence")
    )


@query("resolution_pass")
def resolution_pass(a: Archive) -> DataFrame:
    _, _, summary = resolve.resolve_pending(
        _raw_event(a), a.named_incident.withColumn("method_of_death", F.col("method_of_death")), ORDERS_AS_OF, _predictions(a)
    )
    return summary


_WORDS_OF = "list_filter(string_split({0}, ' '), lambda q: q <> '')"
_PAIR_IN = "len([1 FOR i IN range(1, len({0})) IF contains({1}, {0}[i] || ' ' || {0}[i + 1])]) > 0"


@query("match_cases", ("raw", "incident"), f"""
    WITH RECURSIVE
    r AS (SELECT id, unique_event_id, lower(city) AS c, event_date, CASE WHEN name IS NULL THEN '' ELSE {fold_sql('name')} END AS n, {fold_sql('title')} AS t,
        {fold_sql('chronological_description')} AS g, {fold_sql("concat_ws(' ', title, chronological_description)")} AS whole FROM raw),
    u AS (SELECT id, lower(city) AS c, event_date, trim(split_part({fold_sql('victims_summary')}, ',', 1)) AS head, {fold_sql('title')} AS t,
        {fold_sql('chronological_description')} AS g, {fold_sql("concat_ws(' ', victims_summary, title, chronological_description)")} AS whole FROM incident),
    o AS (SELECT r.id AS raw_id, u.id AS unique_id, r.t AS ta, u.t AS tb, r.g AS ga, u.g AS gb, r.whole AS ra, u.whole AS ub, n,
        {_WORDS_OF.format('n')} AS nw, {_WORDS_OF.format('head')} AS hw,
        abs(date_diff('day', CAST(r.event_date AS DATE), CAST(u.event_date AS DATE))) AS gap
      FROM r JOIN u ON r.c = u.c AND u.event_date BETWEEN r.event_date - INTERVAL 7 DAY AND r.event_date + INTERVAL 7 DAY
      WHERE r.unique_event_id IS DISTINCT FROM u.id),
    {ratio_steps("SELECT ta AS a, tb AS b FROM o UNION SELECT ga, gb FROM o")},
    d AS (SELECT raw_id, unique_id, gap FROM o LEFT JOIN scored t ON t.a = ta AND t.b = tb LEFT JOIN scored g ON g.a = ga AND g.b = gb
      WHERE NOT ((n <> '' AND (contains(ub, n) OR {_PAIR_IN.format('nw', 'ub')} OR (len(nw) >= 2 AND contains(ub, nw[1]) AND contains(ub, nw[-1]))))
        OR {_PAIR_IN.format('hw', 'ra')} OR (ta <> '' AND tb <> '' AND (contains(ta, tb) OR contains(tb, ta)))
        OR coalesce(t.score >= 0.7, FALSE) OR coalesce(g.score >= 0.55, FALSE))),
    k AS (SELECT raw_id, unique_id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY gap, unique_id) AS INT) AS rank FROM d)
    SELECT id AS raw_id, unique_event_id AS candidate_id, 0 AS rank, TRUE AS is_match FROM raw WHERE unique_event_id IS NOT NULL
    UNION ALL SELECT raw_id, unique_id, rank, FALSE FROM k WHERE rank <= 3""")
def match_cases(a: Archive) -> DataFrame:
    records = a.named_raw.withColumn("description", F.col("chronological_description"))
    incidents = a.incident.withColumnsRenamed({"victims_summary": "summary", "chronological_description": "description"})
    return sampling.match_cases(records, incidents)


@query("cluster_cases", ("raw",), """
    WITH p AS (SELECT r.id AS case_id, u.id, u.unique_event_id AS label, row_number() OVER (PARTITION BY r.id ORDER BY u.id) AS n
      FROM raw r JOIN raw u ON lower(r.city) = lower(u.city) AND r.unique_event_id <> u.unique_event_id
        AND u.event_date BETWEEN r.event_date - INTERVAL 1 DAY AND r.event_date + INTERVAL 1 DAY),
    m AS (SELECT case_id, id, label FROM p
      UNION ALL SELECT id, id, unique_event_id FROM raw WHERE unique_event_id IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) AS member_no, count(*) OVER (PARTITION BY case_id) AS size FROM m)
    SELECT case_id, id, label, member_no FROM k WHERE size > 1""")
def cluster_cases(a: Archive) -> DataFrame:
    return sampling.cluster_cases(a.raw)
