"""Deterministic corrections of extracted records from the article's own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook import fixed
from casebook.functions.taxonomy import literal_map
from casebook.functions.text import any_of, contains_any, first_label, lower_fold

_DAY_NAMES = (
    r"(domingo|segunda(?:-feira)?|ter[cç]a(?:-feira)?|quarta(?:-feira)?|quinta(?:-feira)?"
    r"|sexta(?:-feira)?|s[aá]bado)"
)
_NUMBERS = r"(\d+|um|uma|dois|duas|tres|quatro|cinco|seis|sete|oito|nove|dez)"
_DEAD_AND_WOUNDED = (
    r"(?iU)\b" + _NUMBERS + r"\s+(?:pessoas?\s+)?mort(?:a|o|as|os|es)?\s+e\s+" + _NUMBERS + r"\s+ferid"
)
_LEAVES_DEAD = r"(?iU)deixa\s+" + _NUMBERS + r"\s+mortos?\s+e\s+" + _NUMBERS + r"\s+ferid"


def source_text(content: Column, headline: Column) -> Column:
    """Folded article body and headline; the record's own prose is left out."""
    return lower_fold(F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(headline, F.lit(""))))


def method_of_death(text: Column) -> Column:
    """Method by keyword table over folded text, first rule wins."""
    return first_label(text, fixed.METHOD_RULES)


def method_unspecified(text: Column, method: Column) -> Column:
    """True when the article says the method is unknown.  `method` is the keyword method."""
    shot = F.coalesce(method == "Arma de fogo", F.lit(False)) & contains_any(text, fixed.GUN_EVIDENCE)
    body_found = (
        text.contains("corpo")
        & text.contains("encontrado")
        & method.isNull()
        & contains_any(text, fixed.CAUSE_WORDS)
    )
    return ~shot & (contains_any(text, fixed.UNSPECIFIED_METHOD) | body_found)


def hypothesis_only(text: Column) -> Column:
    """'executado' appears only as an investigative hypothesis."""
    near = []
    for marker in fixed.HYPOTHESIS_MARKERS:
        at = F.instr(text, marker)
        window = F.substring(text, at, F.lit(140))
        near.append((at > 0) & window.contains("executado"))
    return contains_any(text, fixed.ELSEWHERE_MARKERS) | any_of(near)


def qualified(text: Column, method: Column) -> Column:
    """Aggravated homicide by the article's wording."""
    shot_execution = text.contains("executado") & F.coalesce(method == "Arma de fogo", F.lit(False))
    execution_by_gun = text.rlike(r"\bexecu(?:cao|ção)\b") & text.contains("tiro")
    return ~hypothesis_only(text) & (
        contains_any(text, fixed.QUALIFIED_MARKERS) | shot_execution | execution_by_gun
    )


def patrol_shootout(text: Column) -> Column:
    """A patrol exchange of fire rather than a police intervention."""
    return contains_any(text, fixed.POLICE_WORDS) & contains_any(text, fixed.PATROL_MARKERS)


def insufficient_case(text: Column, method: Column) -> Column:
    """Body found, no sign of violence, and the article says little else."""
    return (
        text.contains("corpo")
        & method.isNull()
        & ~contains_any(text, fixed.VIOLENT_WORDS)
        & contains_any(text, fixed.SCANT_MARKERS)
    )


def weekday_day_fix(content: Column, published: Column, current: Column) -> Column:
    """'domingo (10)': that day of the publication month; NULL if nothing changes."""
    day = F.regexp_extract(content, r"(?iU)" + _DAY_NAMES + r"\s*\((\d{1,2})\)", 2)
    built = F.try_to_date(F.concat(F.date_format(published, "yyyy-MM-"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    text = F.date_format(F.when(day != "", built), "yyyy-MM-dd")
    return F.when(~text.eqNullSafe(current), text)


def same_weekday_fix(content: Column, published: Column, current: Column) -> Column:
    """'deste sábado' when the article appeared on that weekday; else NULL."""
    name = F.regexp_extract(content, r"(?iU)(?:neste|nesta|deste|desta)\s+" + _DAY_NAMES + r"\b", 1)
    key = F.regexp_replace(lower_fold(name), "-feira$", "")
    expected = F.try_element_at(literal_map(fixed.WEEKDAYS), key)
    text = F.when(F.weekday(published) == expected, F.date_format(published, "yyyy-MM-dd"))
    return F.when(~text.eqNullSafe(current), text)


def date_fix(content: Column, published: Column, current: Column) -> Column:
    return F.coalesce(
        weekday_day_fix(content, published, current), same_weekday_fix(content, published, current)
    )


def plain_date(c: Column) -> Column:
    """Date part of an ISO date-time text."""
    return F.substring_index(c, "T", 1)


def fatal_count(text: Column) -> Column:
    """Number of dead in 'X mortos e Y feridos' wording, 1 to 20."""

    def count(pattern: str) -> Column:
        token = F.regexp_extract(text, pattern, 1)
        number = F.when(token.rlike(r"^\d{1,9}$"), token.try_cast("int"))
        number = F.when(number.between(1, 20), number)
        return F.coalesce(number, F.try_element_at(literal_map(fixed.COUNT_WORDS), lower_fold(token)))

    return F.coalesce(count(_DEAD_AND_WOUNDED), count(_LEAVES_DEAD))


def state_hint(city: Column, publisher: Column, url: Column) -> Column:
    """'MS' for Campo Grande when the outlet is the local one, else NULL."""
    hinted = contains_any(lower_fold(publisher), fixed.CAMPO_GRANDE_HINTS) | contains_any(
        lower_fold(url), fixed.CAMPO_GRANDE_HINTS
    )
    return F.when((lower_fold(city) == "campo grande") & hinted, F.lit("MS"))


def correct_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Apply every correction to a nested extraction column.

    df: the record column plus content, headline, published_at, publisher_name,
    resolved_url.  Each rule is a column of its own, so it is evaluated once
    however many corrections look at it.
    """
    r = F.col(record)
    family, subtype, method = r["event_family"], r["event_subtype"], r["homicide_dynamic"]["method"]
    text, kind = F.col("_text"), F.col("_method")
    flagged = (
        df.withColumn("_text", source_text(F.col("content"), F.col("headline")))
        .withColumns({
            "_method": method_of_death(text),
            "_patrol": patrol_shootout(text),
            "_fatal": fatal_count(text),
            "_date": date_fix(F.col("content"), F.col("published_at"), r["date_time"]["date"]),
        })
        .withColumns({
            "_unspecified": method_unspecified(text, kind),
            "_qualified": qualified(text, kind),
            "_scant": insufficient_case(text, kind),
        })
    )
    scant = F.col("_scant")
    homicide = ~scant & (family == "homicidio")
    new_subtype = (
        F.when(scant, F.lit("outro"))
        .when(homicide & (subtype == "intervencao_policial") & F.col("_patrol"), "simples")
        .when(homicide & (subtype == "simples") & F.col("_qualified"), "qualificado")
        .when(homicide & (subtype == "qualificado") & ~F.col("_qualified"), "simples")
        .otherwise(subtype)
    )
    new_method = (
        F.when(F.col("_unspecified") | (method == "Outro"), fixed.METHOD_UNSPECIFIED)
        .when(method.isNull(), kind)
        .when((method == "Objeto contundente") & text.contains("espanc"), "Espancamento")
        .otherwise(method)
    )
    place = r["location_info"]
    hint = state_hint(place["city"], F.col("publisher_name"), F.col("resolved_url"))
    fixed_record = (
        r.withField("event_family", F.when(scant, F.lit("nao_classificado")).otherwise(family))
        .withField("event_subtype", new_subtype)
        .withField(
            "content_class",
            F.when(family == "acidente_fatal", F.lit("accident_disaster")).otherwise(r["content_class"]),
        )
        .withField("homicide_dynamic.method", new_method)
        .withField("date_time.date", plain_date(F.coalesce(F.col("_date"), r["date_time"]["date"])))
        .withField("victims.number_of_victims", F.coalesce(F.col("_fatal"), r["victims"]["number_of_victims"]))
        .withField("location_info.state", F.coalesce(hint, place["state"]))
    )
    return flagged.withColumn(record, fixed_record).select(*df.columns)
