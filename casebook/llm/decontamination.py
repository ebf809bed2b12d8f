"""Benchmark passages inside documents, by a prefix-filtered set join of word shingles.

A window is a run of WINDOW words of a benchmark item, or a whole shorter item.
Its set holds its shingles.  A document can contain a window only if it holds
every shingle of that set, so any one of them is a sufficient prefix: shingles
are ordered by how many documents' places hold them, and of every window only the
rarest is joined.  Windows with a shingle that no document holds drop out before
the join.  A joined place must leave room for the window before and after it
(positional and length bound), and then the words of the document at that place,
as many as the window has, are compared with the window's words.

Only built-in functions are used.  Words are kept once, in a stored table.  The
benchmark's shingles are broadcast where their counted number is at most
BROADCAST_ROWS; beyond that, they meet the documents' shingles in a shuffled join,
with hot shingles spread over SALTS parts.  Both give the same rows.

Defined cases: a null or empty text has no words; an item without words has no
window; an item without an id marks words but is neither counted nor listed, and
items with one id are one item; repeated documents, and documents without an id,
are rows of their own; texts of any length are read whole; extra columns are
ignored; an empty benchmark leaves every document clean, an empty table of
documents gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import stored, text_or_empty

WINDOW = 10
SHINGLE = 5  # words
BROADCAST_ROWS = 500_000  # of four or five numbers each
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: a word is a run of digits, lower-case letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A to Z lowered."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def with_words(rows: DataFrame, id_column: str, name: str) -> DataFrame:
    """A stored (row_id, id, words, n_words) of `rows`."""
    words = rows.select(F.col(id_column), words_of(text_or_empty(F.col("text").cast("string"))).alias("words"))
    return stored(words.select(F.monotonically_increasing_id().alias("row_id"), id_column, "words", F.size("words").alias("n_words")), name)


def shingles(rows: DataFrame, sizes: list[int], *kept: str) -> DataFrame:
    """`kept`, n_words, place and shingle (a hash) of every run of each size of words.

    A hash skips nulls, so the words behind a text's end change nothing.
    """
    longest = max(sizes)
    runs = F.arrays_zip(*[F.slice("words", k + 1, F.size("words")) for k in range(longest)])
    placed = rows.select(*kept, "n_words", F.posexplode(runs).alias("place", "run"))
    hashed = [F.xxhash64(*[F.col("run").getField(str(k)) for k in range(size)]) for size in sizes]
    fits = [F.col("place") + size <= F.col("n_words") for size in sizes]
    if len(sizes) == 1:
        return placed.where(fits[0]).select(*kept, "n_words", "place", hashed[0].alias("shingle"))
    of_each = F.filter(F.array(*[F.when(fit, h) for fit, h in zip(fits, hashed, strict=True)]), lambda h: h.isNotNull())
    return placed.select(*kept, "n_words", "place", F.explode(of_each).alias("shingle"))


# --- the benchmark's side --------------------------------------------------------------
def windows_of(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Stored (window_id, words, n_words) of each distinct window, and (window_id, item_id) of the items that hold it."""
    last = F.greatest(F.col("n_words") - window, F.lit(0))
    held = items.where(F.col("n_words") > 0).select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, F.lit(window)))).alias("words"))
    held = stored(held.groupBy("item_id", "words").agg(F.first(F.size("words")).alias("n_words")), "decontaminate-held")
    distinct = stored(
        held.select("words", "n_words").distinct().select(F.monotonically_increasing_id().alias("window_id"), "words", "n_words"),
        "decontaminate-windows")
    of_items = held.where(F.col("item_id").isNotNull()).join(distinct, ["words", "n_words"]).select("window_id", "item_id")
    return distinct, of_items


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window_id, n_words, place, shingle); a window of fewer words than a shingle is one shingle."""
    sizes = [r[0] for r in windows.select(F.least("n_words", F.lit(shingle))).distinct().collect()]  # at most `shingle` of them
    none = windows.sparkSession.createDataFrame([], "window_id long, n_words int, place int, shingle long, size int")
    return reduce(DataFrame.unionByName, [
        shingles(windows.where(F.least("n_words", F.lit(shingle)) == size), [size], "window_id").withColumn("size", F.lit(size))
        for size in sizes], none)


# --- the join ---------------------------------------------------------------------------
def shingle_counts(docs: DataFrame, wanted: DataFrame, sizes: list[int], few: bool) -> DataFrame:
    """(shingle, n): how many places of the documents hold each wanted shingle, if any does."""
    found = shingles(docs, sizes)
    if few:
        return found.join(F.broadcast(wanted), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("n"))
    return found.groupBy("shingle").agg(F.count("*").alias("n")).join(wanted, "shingle", "left_semi")


def rarest(of_windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(shingle, place_in, size_in, window_id): of each window the shingle that fewest places hold; none if one is held nowhere."""
    ordered = of_windows.join(counts, "shingle", "left").groupBy("window_id", "n_words").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "place", "size")).alias("p"))
    return ordered.where(F.col("p.n") > 0).select(
        "window_id", F.col("n_words").alias("size_in"), F.col("p.shingle").alias("shingle"), F.col("p.place").alias("place_in"),
        F.col("p.size").alias("shingle_size"))


def candidates(docs: DataFrame, prefixes: DataFrame, sizes: list[int], few: bool, salts: int = SALTS) -> DataFrame:
    """(row_id, start, window_id): places where a window's rarest shingle stands and the window has room."""
    placed, wanted, keys = shingles(docs, sizes, "row_id"), prefixes, ["shingle"]
    if few:
        wanted = F.broadcast(wanted)
    else:
        keys.append("salt")
        placed = placed.withColumn("salt", F.pmod(F.xxhash64("row_id", "place"), F.lit(salts)).cast("int"))
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    start = F.col("place") - F.col("place_in")
    return placed.join(wanted, keys).where((start >= 0) & (start + F.col("size_in") <= F.col("n_words"))).select(
        "row_id", start.alias("start"), "window_id")


def verified(docs: DataFrame, found: DataFrame, windows: DataFrame, broadcast_rows: int) -> DataFrame:
    """(row_id, spans): of the candidates those whose words are the window's, as (start, size, window_id) in order."""
    held = stored(
        found.join(windows, "window_id").groupBy("row_id").agg(
            F.collect_list(F.struct("start", F.col("n_words").alias("size"), "window_id", "words")).alias("found")), "decontaminate-found")
    texts = docs.select("row_id", F.col("words").alias("own"))
    if held.count() <= broadcast_rows:  # only these documents' words are shuffled
        texts = texts.join(F.broadcast(held.select("row_id")), "row_id", "left_semi")
    same = F.filter("found", lambda c: F.slice("own", c["start"] + 1, c["size"]) == c["words"])
    spans = F.array_sort(F.transform(same, lambda c: F.struct(c["start"].alias("start"), c["size"].alias("size"), c["window_id"].alias("window_id"))))
    return texts.join(held, "row_id").select("row_id", spans.alias("spans")).where(F.size("spans") > 0)


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which come in order of their starts."""
    def step(state: Column, s: Column) -> Column:
        end = (s["start"] + s["size"]).cast("long")
        new = F.greatest(end - F.greatest(state["end"], s["start"].cast("long")), F.lit(0).cast("long"))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["hit"] + new).alias("hit"))

    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    return F.aggregate(spans, start, step, lambda state: state["hit"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start, size) and item_ids (as strings, in order) of every document."""
    own = with_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "decontaminate-words")
    items = with_words(benchmark, "item_id", "decontaminate-items")
    windows, of_items = windows_of(items, window)
    of_windows = stored(window_shingles(windows, shingle), "decontaminate-shingles")
    sizes = sorted(r[0] for r in of_windows.select("size").distinct().collect())
    plain = own.select("row_id", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    if not sizes:
        return _digested(plain, None, None)
    wanted = of_windows.select("shingle").distinct()
    counts = stored(shingle_counts(own, wanted, sizes, wanted.count() <= broadcast_rows), "decontaminate-counts")
    prefixes = stored(rarest(of_windows, counts), "decontaminate-prefixes")
    left = sorted(r[0] for r in prefixes.select("shingle_size").distinct().collect())
    if not left:
        return _digested(plain, None, None)
    places = candidates(own, prefixes.drop("shingle_size"), left, prefixes.count() <= broadcast_rows)
    hits = stored(verified(own, places, windows, broadcast_rows), "decontaminate-hits")
    return _digested(plain, hits, of_items)


def _digested(docs: DataFrame, hits: DataFrame | None, of_items: DataFrame | None) -> DataFrame:
    none = F.array().cast("array<struct<start:int,size:int>>")
    no_items = F.array().cast("array<string>")
    if hits is None:
        return docs.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("spans"), no_items.alias("item_ids"))
    by_item = hits.select("row_id", F.explode(F.array_distinct(F.transform("spans", lambda s: s["window_id"]))).alias("window_id")).join(
        of_items, "window_id").groupBy("row_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    plain = F.array_distinct(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"))))
    marked = hits.select("row_id", covered(F.col("spans")).alias("n_hit"), plain.alias("spans"))
    return docs.join(marked, "row_id", "left").join(by_item, "row_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none).alias("spans"),
        F.coalesce("item_ids", no_items).alias("item_ids"))


def digest(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
