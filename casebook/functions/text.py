"""Text expressions: folding, keyword tests, headline and article rules.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and can be pushed around freely by the optimizer.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import fixed


def _fold_tables() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode data."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _fold_tables()


def strip_accents(c: Column) -> Column:
    """Replace accented Latin letters by their base letter, dropping loose marks."""
    return F.regexp_replace(F.translate(c, _FOLD_FROM, _FOLD_TO), r"\p{M}+", "")


def fold(c: Column) -> Column:
    """Lower-case, accent-free text with single spaces; NULL becomes ''."""
    folded = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def lower_fold(c: Column) -> Column:
    """Lower-case and accent-free, spacing kept (rules look at exact spacing)."""
    return strip_accents(F.lower(F.coalesce(c, F.lit(""))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def first_label(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the first rule with a keyword in the text, else NULL."""
    out = None
    for label, words in rules:
        hit = contains_any(c, words)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


# --- splitting and clipping ---------------------------------------------------
def split_headline(title: Column) -> Column:
    """struct(headline, publisher) split at the last ' - '."""
    has = title.contains(" - ")
    pattern = r"(?s)^(.*) - (.*)$"
    return F.struct(
        F.when(has, F.trim(F.regexp_extract(title, pattern, 1))).otherwise(F.trim(title)).alias("headline"),
        F.when(has, F.trim(F.regexp_extract(title, pattern, 2))).alias("publisher"),
    )


def clip(c: Column, n: int) -> Column:
    """Single-line excerpt of at most n characters; a dash stands for no text."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    shortened = F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)
    return F.when(flat == "", F.lit("—")).otherwise(shortened)


def shared_words(a: Column, b: Column, ignore: list[str] = fixed.GENERIC_WORDS) -> Column:
    """Words of four or more letters two texts share, longest first."""

    def words(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w{4,}"), F.lit(0))

    shared = F.array_except(F.array_intersect(words(a), words(b)), F.array(*[F.lit(w) for w in ignore]))
    keyed = F.array_sort(F.transform(shared, lambda w: F.struct((-F.length(w)).alias("k"), w.alias("w"))))
    return F.transform(keyed, lambda s: s["w"])


def length_bucket(n: Column) -> Column:
    return F.when(n < 2000, "short").when(n <= 10000, "medium").otherwise("long")


def usable_article(content: Column, min_chars: int = 200) -> Column:
    return content.isNotNull() & (F.length(F.trim(content)) > min_chars)


# --- headline rules --------------------------------------------------------------
def forced_negative(headline: Column) -> Column:
    """True when a headline surely is not a violent death in scope."""
    t = lower_fold(headline)
    rejected = (
        t.rlike(fixed.SURVIVAL_PATTERN)
        | contains_any(t, fixed.FOREIGN_MARKERS)
        | contains_any(t, fixed.METAPHOR_MARKERS)
        | contains_any(t, fixed.ACCIDENT_MARKERS)
        | contains_any(t, fixed.POLICE_MARKERS)
        | (t.rlike(fixed.SHOOTOUT_PATTERN) & ~t.rlike(fixed.DEATH_HINT_PATTERN))
    )
    return ~contains_any(t, fixed.EXPLICIT_DEATH) & rejected


def forced_positive(headline: Column) -> Column:
    """True when a headline implies a violent death and nothing rejects it."""
    return ~forced_negative(headline) & contains_any(lower_fold(headline), fixed.IMPLIED_FATAL)


def override_label(headline: Column, label: Column, confidence: Column, reason: Column) -> Column:
    """Correct a predicted label by the headline rules, noting why."""
    to_no = forced_negative(headline) & label
    to_yes = forced_positive(headline) & ~label

    def noted(note: str) -> Column:
        return F.trim(F.concat(F.coalesce(reason, F.lit("")), F.lit(" " + note)))

    return F.struct(
        F.when(to_no, F.lit(False)).when(to_yes, F.lit(True)).otherwise(label).alias("is_violent_death"),
        F.when(to_no | to_yes, F.lit("alta")).otherwise(confidence).alias("confidence"),
        F.when(to_no, noted(fixed.NOTE_FORCED_NEGATIVE))
        .when(to_yes, noted(fixed.NOTE_FORCED_POSITIVE))
        .otherwise(reason)
        .alias("reason"),
    )


def death_keyword(headline: Column, pattern: str = fixed.DEATH_KEYWORDS) -> Column:
    return F.coalesce(headline, F.lit("")).rlike(pattern)


def headline_tags(headline: Column, pool: Column) -> Column:
    low = F.lower(headline)
    tags = [pool]
    for tag, words in fixed.HEADLINE_TAGS:
        hit = death_keyword(headline, fixed.EVAL_DEATH_KEYWORDS) if words is None else contains_any(low, words)
        tags.append(F.when(hit, tag))
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


# --- article rules ---------------------------------------------------------------
def article_text(headline: Column, content: Column) -> Column:
    return F.trim(F.concat(F.coalesce(headline, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))))


def article_rule(text: Column, rules: list[tuple[str, str, str]] = fixed.ARTICLE_RULES) -> Column:
    """struct(hint, rule) of the first rule matching the whole text, else NULL."""
    out = None
    for hint, rule, pattern in rules:
        value = F.struct(F.lit(hint).alias("hint"), F.lit(rule).alias("rule"))
        hit = text.rlike("(?iUd)" + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def rule_snippet(text: Column, rule: Column, rules: list[tuple[str, str, str]] = fixed.ARTICLE_RULES) -> Column:
    """Text around the rule's first match: 20 letters before, 40 after."""
    out = None
    for _, name, pattern in rules:
        regex = F.lit("(?iUd)" + pattern)
        start = F.regexp_instr(text, regex)
        length = F.length(F.regexp_substr(text, regex))
        begin = F.greatest(F.lit(1), start - 20)
        snippet = F.trim(F.substring(text, begin, start + length + 40 - begin))
        hit = rule == F.lit(name)
        out = F.when(hit, snippet) if out is None else out.when(hit, snippet)
    return out


def class_reason(content_class: Column) -> Column:
    """Failure reason recorded for a rejected content class."""
    return (
        F.when(content_class == "aggregate_statistics", fixed.CLASS_REASON["aggregate_statistics"])
        .when(content_class == "foreign", fixed.CLASS_REASON["foreign"])
        .otherwise(fixed.CLASS_REASON_DEFAULT)
    )


# --- language ----------------------------------------------------------------------
def language_vote(content: Column, publisher: Column | None = None, url: Column | None = None) -> Column:
    """'es' or 'pt' by counting marker words; Chilean outlets add a bonus."""
    low = F.lower(content)

    def count(markers: list[str]) -> Column:
        return reduce(lambda a, b: a + b, [low.contains(m).cast("int") for m in markers])

    spanish = count(fixed.SPANISH_MARKERS)
    hints = [
        contains_any(F.lower(F.coalesce(c, F.lit(""))), fixed.CHILE_HINTS)
        for c in (publisher, url)
        if c is not None
    ]
    if hints:
        spanish = spanish + F.when(any_of(hints), fixed.CHILE_BONUS).otherwise(0)
    return F.when(spanish > count(fixed.PORTUGUESE_MARKERS), "es").otherwise("pt")


def quote_regex(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)
