"""Victim-name and context expressions used to recognise the same incident."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.text import fold

_NAME_IN_PROSE = (
    r"(?iU)(?:a\s+)?(?:v[ií]tima\s+)?"
    r"((?:[A-ZÀ-Ú][a-zà-ú]+(?:\s+(?:da|de|do|dos|das|e)\s+|\s+)){0,4}[A-ZÀ-Ú][a-zà-ú]+)"
    r"\s*,\s*\d+\s+anos"
)
_PREFIX = r"(?i)^(?:vitima|a vitima|o vitima|uma vitima|um homem|uma mulher|pessoa)\s+"
_AGE_TAIL = r"(?is),?\s*\d{1,3}\s*anos?\b.*$"
_BREAKS = [". ", "; ", " foi ", " morreu ", " morta ", " morto "]
_EMPTY = "array<string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stopwords() -> Column:
    return F.array(*[F.lit(w) for w in fixed.NAME_STOPWORDS])


def names_in_prose(*texts: Column) -> Column:
    """Folded names in 'Name Surname, NN anos' wording, in order of appearance."""
    found = [
        F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(_NAME_IN_PROSE), F.lit(1)) for t in texts
    ]
    folded = F.transform(F.concat(*found), fold)
    return F.array_distinct(F.filter(folded, lambda n: F.length(n) > 3))


def listed_names(people: Column) -> Column:
    """Folded names of a record's identified people, more than three letters."""
    kept = F.filter(people["name"], lambda n: F.length(F.trim(n)) > 3)
    return F.coalesce(F.array_distinct(F.transform(kept, fold)), F.array().cast(_EMPTY))


def record_names(people: Column, *prose: Column) -> Column:
    """Names of a record: the identified people, else names found in its prose."""
    listed = listed_names(people)
    return F.when(F.size(listed) > 0, listed).otherwise(names_in_prose(*prose))


def incident_names(summary: Column, people: Column) -> Column:
    """Names of an incident: head of the victim summary, then the nested names."""
    head = F.trim(F.get(F.split(summary, ","), F.lit(0)))
    first = F.when(F.length(head) > 3, F.array(fold(head))).otherwise(F.array().cast(_EMPTY))
    return F.array_union(first, listed_names(people))


def person_like(name: Column) -> Column:
    """Folded text looks like a person's name, not a narrative fragment."""
    tokens = F.filter(F.split(name, r"(?U)[^\w]+"), lambda t: t != "")

    def judge(parts: Column) -> Column:
        content = F.filter(parts, lambda t: ~F.array_contains(_stopwords(), t))
        n, k = F.size(parts), F.size(content)
        short_single = (k == 1) & (F.length(F.get(content, F.lit(0))) < 3)
        mostly_stop = (k < 2) & ((n - k) * 2 > n)
        return n.between(1, 6) & (k >= 1) & ~short_single & ~mostly_stop

    return F.coalesce((F.length(name) >= 3) & ~name.rlike(r"(?U)\d") & let(tokens, judge), F.lit(False))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,;-"))


def _clean_name(name: Column) -> Column:
    """Drop brackets, leading role words and a trailing age clause."""
    bare = F.trim(F.regexp_replace(name, r"\([^)]*\)", " "))
    return _strip(F.regexp_replace(F.regexp_replace(bare, _PREFIX, ""), _AGE_TAIL, ""))


def _before_break(name: Column) -> Column:
    """Cut at the first sentence-like break when what is left is short."""
    low = F.lower(name)
    out = None
    for sep in _BREAKS:
        head = _strip(F.substring(name, F.lit(1), F.instr(low, sep) - 1))
        value = F.when(F.length(head).between(3, 60), head).otherwise(name)
        out = F.when(low.contains(sep), value) if out is None else out.when(low.contains(sep), value)
    return out.otherwise(name)


def _before_comma(name: Column) -> Column:
    head = F.trim(F.substring_index(name, ",", 1))
    return F.when(name.contains(",") & person_like(fold(head)), head).otherwise(name)


def _expand(name: Column) -> Column:
    """Full name, first + last token, and adjacent token pairs."""
    tokens = F.filter(F.split(name, " "), lambda t: (t != "") & ~F.array_contains(_stopwords(), t))

    def keys(t: Column) -> Column:
        n = F.size(t)
        pairs = F.transform(
            F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
            lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1)),
        )
        ends = F.array(F.concat_ws(" ", F.get(t, F.lit(0)), F.get(t, n - 1)))
        single = F.when((n == 1) & (F.length(F.get(t, F.lit(0))) >= 3), F.slice(t, 1, 1))
        return F.when(n >= 2, F.concat(ends, pairs)).otherwise(
            F.coalesce(single, F.array().cast(_EMPTY))
        )

    return F.array_distinct(F.concat(F.array(name), let(tokens, keys)))


def name_keys(name: Column) -> Column:
    """Match keys of one name; empty when it does not look like a person."""
    none = F.array().cast(_EMPTY)

    def from_folded(folded: Column) -> Column:
        return F.when(person_like(folded), _expand(folded)).otherwise(none)

    usable = F.length(F.trim(name)) >= 3
    keys = let(
        _clean_name(name),
        lambda c: let(_before_break(c), lambda b: let(_before_comma(b), lambda k: let(fold(k), from_folded))),
    )
    return F.when(usable, keys).otherwise(none)


def victim_keys(people: Column, summary: Column) -> Column:
    """All match keys of an incident from nested names and the summary's first line."""
    nested = F.flatten(F.transform(people["name"], name_keys))
    head = name_keys(F.trim(F.get(F.split(summary, "\n"), F.lit(0))))
    none = F.array().cast(_EMPTY)
    return F.array_distinct(F.concat(F.coalesce(nested, none), F.coalesce(head, none)))


def keys_overlap(a: Column, b: Column) -> Column:
    """A key in common, or one inside the other when both exceed five letters."""

    def inside(x: Column, y: Column) -> Column:
        return (F.length(x) > 5) & (F.length(y) > 5) & (x.contains(y) | y.contains(x))

    return F.arrays_overlap(a, b) | F.exists(a, lambda x: F.exists(b, lambda y: inside(x, y)))


def context_text(description: Column, summary: Column, neighborhood: Column) -> Column:
    filled = [F.nullif(c, F.lit("")) for c in (description, summary, neighborhood)]
    return fold(F.concat_ws(" ", *filled))


def context_cues(text: Column) -> Column:
    """Bit mask of distinctive circumstance cues; 0 for texts under 40 letters."""

    def mask(told: Column) -> Column:
        found = F.lit(0)
        for i, pattern in enumerate(fixed.CONTEXT_CUES):
            found = found + F.when(told.rlike("(?U)" + pattern), 1 << i).otherwise(0)
        return F.when(F.length(told) >= 40, found).otherwise(0)

    return let(text, mask)  # the text is folded once, not for each pattern
