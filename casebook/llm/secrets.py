"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are fixed patterns.  The method looks further: long mixed tokens that
no base pattern covers are candidates, and all candidates are hashed and counted
over the whole corpus by distinct repository and owner.  A value that several
owners or many repositories hold is a copied example; a value held by few is
taken for a live credential.  Candidates of the method become spans only if they
are live; base spans always stay.

Positions come from splitting a text at the pattern: the lengths of the pieces
and of the matches, summed along the text.  Sums run in chunks, so a text with a
great many matches stays near linear.

Defined cases: null text is empty and has no spans; a null source or language
counts as one owner or repository of its own; repeated rows hold the same spans;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import stored, text_or_empty

# The base patterns.  A run of hexadecimal digits or an access key
# that is long enough is the same match as the unbounded run with its length test.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ["assign", "access", "hex", "own"]

# Parameters of the method.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
MIN_LETTERS = 10
MAX_TOKEN = 128  # read by the checking SQL only, which leaves out longer tokens; the scan takes tokens of any length
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5
MASK = "[SECRET]"

CHUNK = 256
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _chunk_offsets(sums: Column) -> Column:
    """For each chunk the sum of all earlier chunks."""
    return F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i)))


def _chunk_sums(values: Column) -> Column:
    last = F.floor((F.size(values) - 1) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: _sum(F.slice(values, c * CHUNK + 1, F.lit(CHUNK))))


def _with_starts(pieces: Column, matches: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """transform over the matches with (match, index, start in code points)."""
    steps = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)),
        F.concat(F.array(F.lit("")), matches),
        lambda piece, before: F.coalesce(F.length(piece), F.lit(0)) + F.coalesce(F.length(before), F.lit(0)),
    )  # one more than the matches; the last is not read

    def positions(lengths: Column) -> Column:
        return let(_chunk_offsets_of(lengths), lambda offsets: F.transform(
            matches, lambda m, i: make(m, i, _start(lengths, offsets, i))))

    return let(steps, positions)


def _chunk_offsets_of(lengths: Column) -> Column:
    return let(_chunk_sums(lengths), _chunk_offsets)


def _start(lengths: Column, offsets: Column, i: Column) -> Column:
    chunk = F.floor(i / CHUNK).cast("int")
    return F.element_at(offsets, chunk + 1) + _sum(F.slice(lengths, chunk * CHUNK + 1, i % CHUNK + 1))


def spans_of(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Leftmost matches that do not overlap: array of (start, kind, end, value)."""
    number = F.lit(KINDS.index(kind))

    def found(pieces: Column, matches: Column, values: Column) -> Column:
        return _with_starts(pieces, matches, lambda m, i, start: F.struct(
            start.alias("start"), number.alias("kind"), (start + F.length(m)).alias("end"),
            F.element_at(values, i + 1).alias("value"),
        ))

    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = let(F.split(text, pattern, -1), lambda pieces: let(all_of(0), lambda matches: (
        found(pieces, matches, matches) if value_group == 0
        else let(all_of(value_group), lambda values: found(pieces, matches, values)))))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    assign = F.filter(spans_of(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= MIN_VALUE)
    return F.sort_array(F.concat(assign, spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")))


def blanked(text: Column, pattern: str) -> Column:
    """The text with each match overwritten by as many spaces."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spaced = F.zip_with(F.split(text, pattern, -1), matches, lambda piece, m: F.concat(
        piece, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0)))))
    return F.when(text.rlike(pattern), F.array_join(spaced, "")).otherwise(text)


def token_spans(text: Column) -> Column:
    """Candidates of the method: mixed tokens outside all base matches."""
    rest = text
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = blanked(rest, pattern)
    mixed = lambda s: (
        s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]")
        & (F.size(F.array_distinct(F.split(s["value"], ""))) >= MIN_LETTERS)
    )
    spans = let(rest, lambda blank: F.filter(spans_of(blank, TOKEN, "own"), mixed))
    return F.when(text.rlike(TOKEN), spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def live_values(found: DataFrame) -> DataFrame:
    """(hash, live) of every value in rows of (hash, owner, repository)."""
    places = found.select("hash", "owner", "repository").distinct()
    held = places.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(
        F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    return held.select(
        "hash", ((F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)).alias("live"))


def _owner() -> Column:
    return F.coalesce(F.col("source"), F.lit("")).alias("owner")


def _repository() -> Column:
    return F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))).alias("repository")


def span_text(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _without_values(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans), spans (base and live candidates) and n_live of every document."""
    text = text_or_empty("text")
    found = stored(
        docs.select("doc_id", _owner(), _repository(), text.alias("text"))
        .select("doc_id", "owner", "repository", base_spans(F.col("text")).alias("base"), token_spans(F.col("text")).alias("tokens"))
        .withColumn("row_id", F.monotonically_increasing_id()),
        "secret-spans",
    )
    each = found.where((F.size("base") > 0) | (F.size("tokens") > 0)).select(
        "row_id", "owner", "repository", F.explode(F.concat("base", "tokens")).alias("s"),
    ).withColumn("hash", F.sha2("s.value", 256))
    own = KINDS.index("own")
    live = each.join(live_values(each), "hash").where("live").groupBy("row_id").agg(
        F.count("*").alias("n_live"),
        F.collect_list(F.when(F.col("s.kind") == own, F.struct("s.start", "s.kind", "s.end"))).alias("live_tokens"),
    )
    base = _without_values(F.col("base"))
    return found.join(live, "row_id", "left").select(
        "doc_id", base.alias("base"),
        F.when(F.size("live_tokens") > 0, F.sort_array(F.concat(base, "live_tokens"))).otherwise(base).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, a hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "n_live",
    )


def masked(text: Column, pattern: str, value_group: int = 0, least: int = 1) -> Column:
    """The text with each match whose value is long enough replaced by MASK."""
    all_of = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    shown = F.zip_with(all_of(0), all_of(value_group), lambda m, v: F.when(F.length(v) >= least, MASK).otherwise(m))
    joined = F.zip_with(F.split(text, pattern, -1), shown, lambda piece, m: F.concat(piece, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """All documents with their secrets masked; n_chars, where present, follows the new text.

    Base spans go first (assignments, then keys, then digits), then the live
    tokens.  Only rows that hold token candidates are stored and joined.
    """
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("row"), text_or_empty("text").alias("plain")).withColumn("tokens", token_spans(F.col("plain")))
    hot = stored(
        rows.where(F.size("tokens") > 0).select("row", "plain", "tokens", F.monotonically_increasing_id().alias("row_id")),
        "secret-rows",
    )
    each = hot.select(
        "row_id", F.col("row.source").alias("source"), F.col("row.lang").alias("lang"), F.explode("tokens").alias("s"),
    ).select("row_id", _owner(), _repository(), F.col("s.value").alias("value"), F.sha2("s.value", 256).alias("hash"))
    live = each.join(live_values(each), "hash").where("live").groupBy("row_id").agg(F.collect_set("value").alias("values"))
    # The longest first: a value that starts another one must not leave the other's tail.
    longest_first = F.array_sort(F.coalesce(F.col("values"), F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    hidden = F.aggregate(
        longest_first, _mask_base(F.col("plain")),
        lambda text, value: F.replace(text, value, F.lit(MASK)),
    )
    some = hot.join(live, "row_id", "left").select("row", hidden.alias("hidden"))
    none = rows.where(F.size("tokens") == 0).select("row", _mask_base(F.col("plain")).alias("hidden"))
    text = F.when(F.col("row.text").isNotNull(), F.col("hidden"))
    out = {"text": text}
    if "n_chars" in columns:
        same = F.col("row.text").eqNullSafe(text)
        out["n_chars"] = F.when(same, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return none.unionByName(some).select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])


def _mask_base(text: Column) -> Column:
    first = masked(text, ASSIGN, 2, MIN_VALUE)
    return let(first, lambda a: let(masked(a, ACCESS), lambda b: masked(b, HEX)))
