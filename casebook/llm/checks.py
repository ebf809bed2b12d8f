"""Checking SQL of the queries that SQL can express."""

from __future__ import annotations

from casebook.llm import decontamination, mixing, quality, secrets

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
HAS_WORD = r"'[^\x20\x09-\x0D]'"


# --- quality rules ---------------------------------------------------------------------------


def _odds(votes: list[str]) -> str:
    """Log odds of a vote pattern under model columns p, g and b (lists per rule)."""
    terms = [
        f"CASE {v} WHEN 1 THEN ln(g[{i}] / (1 - b[{i}])) WHEN -1 THEN ln((1 - g[{i}]) / b[{i}]) ELSE 0 END"
        for i, v in enumerate(votes, 1)
    ]
    return "ln(p / (1 - p)) + " + " + ".join(terms)


def _step(share: str, right: int, start: float, bounds: tuple[float, float]) -> str:
    """List of updated accuracies: how often rule i voted `right` among the documents counted by `share`."""
    per_rule = [
        f"greatest({bounds[0]}, least({bounds[1]}, (sum(CASE WHEN {v} = {right} THEN {share} ELSE 0 END) + {start})"
        f" / (sum(CASE WHEN {v} <> 0 THEN {share} ELSE 0 END) + 1)))"
        for v in quality.VOTES
    ]
    return "[" + ", ".join(per_rule) + "]"


def _quality() -> str:
    votes = ", ".join(f"{quality.vote_sql(good, bad)} AS {name}" for name, (_, good, bad) in zip(quality.VOTES, quality.RULES, strict=True))
    k = len(quality.VOTES)
    names = ", ".join(quality.VOTES)
    low, high = quality.PRIOR_BOUNDS
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, {WORDS} AS ws FROM d),
t AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT *, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, word, i, CASE WHEN w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT rid, word, max(again) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM r),
per_word AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, sum(covered) AS n_repeat_words, count(DISTINCT word) AS n_distinct,
    sum(CASE WHEN regexp_matches(word, '[#*$%&|<>]') THEN 1 ELSE 0 END) AS n_symbol_words
  FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
per_line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(CASE WHEN regexp_matches(line, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END) AS n_ended
  FROM l WHERE regexp_matches(line, {HAS_WORD}) GROUP BY rid),
f AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_ended, 0) AS n_ended,
    coalesce(n_distinct, 0) AS n_distinct, len(regexp_extract_all(text, '[A-Z]')) AS n_upper,
    len(regexp_extract_all(text, '[a-z]')) AS n_lower, len(regexp_extract_all(text, '!')) AS n_bang,
    len(regexp_extract_all(text, '[.!?]')) AS n_stops, coalesce(n_symbol_words, 0) AS n_symbol_words
  FROM d LEFT JOIN per_word USING (rid) LEFT JOIN per_line USING (rid)),
v AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PCT} * n_words AS base_failed, {votes} FROM f),
patterns AS (SELECT {names}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
em AS (
  SELECT 0 AS step, {quality.START_PRIOR}::DOUBLE AS p, {[quality.START_GOOD] * k}::DOUBLE[] AS g, {[quality.START_BAD] * k}::DOUBLE[] AS b
  UNION ALL
  SELECT * FROM (
    SELECT any_value(step) + 1 AS step, greatest({low}, least({high}, sum(n * q) / sum(n))) AS p,
      {_step("n * q", 1, quality.START_GOOD, quality.GOOD_BOUNDS)} AS g, {_step("n * (1 - q)", -1, quality.START_BAD, quality.BAD_BOUNDS)} AS b
    FROM (SELECT patterns.*, em.step, 1 / (1 + exp(-({_odds(quality.VOTES)}))) AS q FROM patterns, em WHERE em.step < {quality.ROUNDS})
    HAVING count(*) > 0)),
model AS (SELECT p, g, b FROM em ORDER BY step DESC LIMIT 1)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 1 / (1 + exp(-({_odds(quality.VOTES)}))) >= {quality.MIN_POSTERIOR} AS kept
FROM v, model"""


# --- source mix ------------------------------------------------------------------------------


def _position(share: str) -> str:
    def invert(segments: list[mixing.Segment]) -> str:
        out = "1.0::DOUBLE"
        for s in reversed(segments):
            rest, slope = f"({share} - {s.u0!r}::DOUBLE)", (s.w1 - s.w0) / s.width
            if slope == 0:
                within = f"{rest} / {s.w0!r}::DOUBLE"
            else:
                within = f"(sqrt({s.w0 * s.w0!r}::DOUBLE + {rest} * {2 * slope!r}::DOUBLE) - {s.w0!r}::DOUBLE) / {slope!r}::DOUBLE"
            out = f"CASE WHEN {share} < {s.u1!r}::DOUBLE THEN {s.t0!r}::DOUBLE + {within} ELSE {out} END"
        return out

    cases = " ".join(f"WHEN {i} THEN {invert(mixing.integrate(knots))}" for i, knots in enumerate(mixing.SCHEDULES))
    return f"CASE schedule {cases} END"


def _mix() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    epochs = " + ".join(f"CASE WHEN middle + {e} * source_size <= target THEN 1 ELSE 0 END" for e in range(mixing.MAX_EPOCHS))
    return rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS order_key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
q AS (SELECT *, place % {len(mixing.WEIGHTS)} AS schedule, CASE place % {len(mixing.WEIGHTS)} {weights} END AS weight,
  {mixing.MAX_EPOCHS} * source_size AS bound FROM r),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(bound) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest_weight,
  row_number() OVER (ORDER BY bound / weight, place) AS turn
  FROM q WINDOW b AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT turn, rest, rest_weight FROM o WHERE bound * rest_weight > weight * rest ORDER BY turn LIMIT 1),
target AS (SELECT o.source, source_size, schedule, CASE WHEN level.turn IS NULL OR o.turn < level.turn THEN bound::DOUBLE
  ELSE (weight * level.rest)::DOUBLE / level.rest_weight::DOUBLE END AS target FROM o LEFT JOIN level ON true),
m AS (SELECT doc_id, size, source_size, target, schedule,
  sum(size) OVER (PARTITION BY d.source ORDER BY order_key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size::DOUBLE / 2 AS middle
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source),
n AS (SELECT *, CASE WHEN size = 0 THEN CASE WHEN middle <= target THEN 1 ELSE 0 END ELSE {epochs} END AS copies,
  CASE WHEN target > 0 THEN middle / target ELSE 0.0::DOUBLE END AS share FROM m)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies::INTEGER AS copies,
  CASE WHEN copies > 0 THEN {_position("share")} END AS position FROM n"""


# --- exact top-k -----------------------------------------------------------------------------

TOPK = """
WITH sound AS (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT rid, vec_id, unnest(list_prepend(0, q)) AS x, unnest(range(len(q) + 1)) AS i FROM sound),
pairs AS (SELECT a.rid AS query_row, a.vec_id AS query_id, b.rid, b.vec_id, sum(a.x * b.x)::BIGINT AS score
  FROM parts a JOIN parts b USING (i) WHERE a.vec_id % 50 = 0 AND a.rid <> b.rid GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


# --- secrets ---------------------------------------------------------------------------------


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, pattern: str, text: str, source: str, group: int = 0) -> str:
    """(rid, start, kind, stop, value) of all matches: positions from the pieces between them."""
    p = _literal(pattern)
    return f"""
SELECT rid, start, {secrets.KINDS.index(kind)} AS kind, start + length(m) AS stop, value FROM (
  SELECT rid, m, value, sum(length(piece)) OVER o + coalesce(sum(length(m)) OVER (
    PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT rid, unnest(ms) AS m, unnest(vs) AS value, unnest(ps[1:len(ms)]) AS piece, unnest(range(len(ms))) AS i
    FROM (SELECT rid, regexp_extract_all({text}, {p}) AS ms, regexp_extract_all({text}, {p}, {group}) AS vs,
      regexp_split_to_array({text}, {p}) AS ps FROM {source} WHERE regexp_matches({text}, {p})))
  WINDOW o AS (PARTITION BY rid ORDER BY i))"""


def _blanked(source: str, pattern: str) -> str:
    p = _literal(pattern)
    return f"""
SELECT rid, CASE WHEN regexp_matches(text, {p}) THEN (SELECT string_agg(piece || coalesce(repeat(' ', length(m)), ''), '' ORDER BY i) FROM (
  SELECT unnest(regexp_split_to_array(text, {p})) AS piece, unnest(regexp_extract_all(text, {p})) AS m,
    unnest(range(len(regexp_split_to_array(text, {p})))) AS i)) ELSE text END AS text FROM {source}"""


def _secrets() -> str:
    kinds = f"[{', '.join(_literal(k) for k in secrets.KINDS)}]"
    spans = "string_agg({0}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)".format(kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner,
  coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
base AS (
  SELECT * FROM ({_found("assign", secrets.ASSIGN, "text", "d", 2)}) WHERE length(value) >= {secrets.MIN_VALUE}
  UNION ALL {_found("access", secrets.ACCESS, "text", "d")}
  UNION ALL {_found("hex", secrets.HEX, "text", "d")}),
e1 AS ({_blanked("d", secrets.ASSIGN)}), e2 AS ({_blanked("e1", secrets.ACCESS)}), e3 AS ({_blanked("e2", secrets.HEX)}),
own AS (SELECT * FROM ({_found("own", secrets.TOKEN, "text", "e3")}) WHERE length(value) <= {secrets.MAX_TOKEN}
  AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
  AND len(list_distinct(regexp_extract_all(value, '.'))) >= {secrets.MIN_LETTERS}),
each AS (SELECT e.*, owner, repository FROM (SELECT * FROM base UNION ALL SELECT * FROM own) e JOIN d USING (rid)),
live AS (SELECT value FROM each GROUP BY value
  HAVING count(DISTINCT owner) < {secrets.EXAMPLE_OWNERS} AND count(DISTINCT (owner, repository)) < {secrets.EXAMPLE_REPOSITORIES}),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  {spans} AS spans FROM base GROUP BY rid),
a AS (SELECT rid, {spans} AS spans FROM (SELECT * FROM base UNION ALL SELECT own.* FROM own JOIN live USING (value)) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_live FROM each JOIN live USING (value) GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN b USING (rid) LEFT JOIN a USING (rid) LEFT JOIN n USING (rid)"""


# --- benchmark passages ------------------------------------------------------------------------
_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}'), '{decontamination.WORD}')"
_FOLLOWING = ", ".join(f"lead(word, {k}) OVER f" for k in range(1, decontamination.WINDOW))
DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWERED} AS ws FROM documents),
i AS (SELECT item_id, {_LOWERED} AS ws FROM benchmark),
w AS (SELECT item_id, least(len(ws), {decontamination.WINDOW}) AS size, ws,
  unnest(range(greatest(len(ws) - {decontamination.WINDOW}, 0) + 1)) AS k FROM i WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[k + 1 : k + size], ' ') AS run FROM w),
sizes AS (SELECT DISTINCT size FROM windows),
t AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS k, len(ws) AS n FROM d),
r AS (SELECT rid, k, n, [word, {_FOLLOWING}] AS ws FROM t WINDOW f AS (PARTITION BY rid ORDER BY k)),
o AS (SELECT rid, k, size, item_id FROM (SELECT rid, k, size, array_to_string(ws[1 : size], ' ') AS run FROM r, sizes WHERE k + size <= n)
  JOIN windows USING (size, run)),
hit AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + size)) AS place FROM o) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM o WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)"""


SQL = {
    "op2_quality_rules": _quality(), "op3_mix": _mix(), "op5_topk": TOPK, "op6_secrets": _secrets(),
    "op11_decontaminate": DECONTAMINATE,
}
