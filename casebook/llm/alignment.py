"""Alignment of two tokenizers' ids over the same bytes, with corpus-wide link counts.

Every text is cut twice: by a byte-level vocabulary (A) and by a piece vocabulary
with byte fallback (B).  All work on ids is done on Arrow columns.  Lists of ids
are flattened beside their parent indices, and a cumulative sum of token lengths,
segmented by parent, gives each token's end in its document.  A full outer hash
join of the A and B ends on (document, end) holds each distinct end once: ends of
both close a group, and every row, sorted, is one link, namely of the tokens that
cover the bytes before that end.  Two tokens overlap in one unbroken range, so no
link is met twice.

Links are counted per document by `Table.group_by`, pairs per corpus by
`Table.group_by` in every task and a sum in Spark.  Pairs above a document count
that at most FREQUENT pairs reach are sent to every task as a table of that
bounded size; all others meet their counts in a join, so every count is exact.

Defined cases: a text that is null or empty, or whose tokens of A or B do not
join to a space and the text, has no tokens and all its figures are zero, its
hash the empty string; repeated rows, and rows without an id, are rows of their
own and count as documents of their own; texts of any length are cut whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import as_bytes, portions, stored

FREQUENT = 1_000_000  # pairs in the table that every task gets: 17 MB
HELD_PAIRS = 1_000_000  # pairs a counting task holds before it sends them on
EXACT_LEVELS = 1024  # document counts up to here are levels of their own
DOC_SHIFT = 40  # ends of a document stay below 2 ** 40 bytes
SPACE_MARK = "▁"

PART = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " a array<int>, b array<int>, times array<int>, groups string"
)
PAIRS = "a int, b int, docs long"
PAIRS_SCHEMA = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())])
SCORED = "row_id long, n_best long, count_sum long, a array<int>, b array<int>, times array<int>"
INTS = pa.list_(pa.int32())


class Vocabularies:
    """Encoders of both vocabularies with the bytes and the decimal forms of their ids."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece

        self.encode_a, a_bytes = byte_level(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary())
        self.a_size, self.b_size = len(a_bytes), len(b_bytes)
        # Ids as text with what follows them: `,` or `|` for A; `,` or `;` or nothing for B.
        shown = [b"%d%s" % (i, mark) for i in range(self.a_size) for mark in (b",", b"|")]
        shown += [b"%d%s" % (i, mark) for i in range(self.b_size) for mark in (b",", b";", b"")]
        self.shown = pa.array(shown, pa.binary())

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()


def byte_level(vocabulary: str):
    """(encode, bytes by id) of a byte-level vocabulary with the usual split pattern.

    Where lower ids always merge first, joining the pair with the lowest id gives
    the same ids as the merge list, and the encoder that does so is faster.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary) as source:
        described = json.load(source)
    model, added = described["model"], described["added_tokens"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that byte-level vocabularies write as they are
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    specials = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in specials}
    by_id = [b""] * (max([*ranks.values(), *specials.values()]) + 1)
    for token, i in [*ranks.items(), *((text.encode(), i) for text, i in specials.items())]:
        by_id[i] = token
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged == list(range(len(ranks) - len(merged), len(ranks))) and described["normalizer"] is None:
        ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return ranked.encode_ordinary, by_id
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.encode_special_tokens = True
    return (lambda text: tokenizer.encode(text, add_special_tokens=False).ids), by_id


@lru_cache
def shared_vocabularies(a_file: str, b_file: str) -> Vocabularies:
    """One per process, for all tasks of a worker."""
    return Vocabularies(a_file, b_file)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)


def _pick(values: pa.Array, at: pa.Array) -> tuple[memoryview, np.ndarray]:
    """Joined bytes of the picked values and the offset of each, with the end."""
    picked = values.take(at)
    offsets = np.frombuffer(picked.buffers()[1], np.int32)[picked.offset : picked.offset + len(picked) + 1] if len(picked) else np.zeros(1, np.int32)
    return memoryview(picked.buffers()[2] or b""), offsets


def _sound(lists: list[list[int]], values: pa.Array, spaced: list[bytes]) -> list[bool]:
    """Whether each document's tokens join to its spaced text."""
    ids = pa.array(lists, INTS)
    joined, offsets = _pick(values, ids.flatten())
    cuts = offsets[_offsets(ids)]
    return [bytes(joined[cuts[i] : cuts[i + 1]]) == text for i, text in enumerate(spaced)]


def _ends(ids: pa.ListArray, values: pa.Array) -> pa.Table:
    """(key, at) of the flattened tokens: document and end in it, and the token's place."""
    flat, parents = ids.flatten(), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(values.take(flat)), pa.int64()))
    before = np.concatenate(([0], total.to_numpy(zero_copy_only=False)))[_offsets(ids)[:-1]]  # bytes before each document
    local = pc.subtract(total, pa.array(before, pa.int64()).take(parents))
    key = pc.add(pc.shift_left(pc.cast(parents, pa.int64()), pa.scalar(DOC_SHIFT, pa.int64())), local)
    return pa.table({"key": key, "at": pa.array(np.arange(len(flat)), pa.int64())})


def align_texts(texts: list[bytes], vocabularies: Vocabularies, keep_groups: bool = False) -> dict[str, pa.Array]:
    """The columns of PART but doc_id, a row per text."""
    n = len(texts)
    plain = [t.decode() for t in texts]
    spaced = [b" " + t if t else b"" for t in texts]
    a_lists = [vocabularies.encode_a(" " + t) if t else [] for t in plain]
    b_lists = vocabularies.b.encode(plain, num_threads=1)
    for i, fits in enumerate(zip(_sound(a_lists, vocabularies.a_bytes, spaced), _sound(b_lists, vocabularies.b_bytes, spaced), strict=True)):
        if not all(fits):
            a_lists[i] = b_lists[i] = []
    a, b = pa.array(a_lists, INTS), pa.array(b_lists, INTS)
    a_ids, b_ids = a.flatten(), b.flatten()
    ends = _ends(a, vocabularies.a_bytes).rename_columns(["key", "a_at"]).join(
        _ends(b, vocabularies.b_bytes).rename_columns(["key", "b_at"]), "key", join_type="full outer", use_threads=False)
    ends = ends.combine_chunks().sort_by("key")
    key, a_at, b_at = (ends.column(c).combine_chunks() for c in ("key", "a_at", "b_at"))
    both = pc.and_(a_at.is_valid(), b_at.is_valid()).to_numpy(zero_copy_only=False)
    # The token that covers the bytes before an end is the one whose own end comes next.
    a_at, b_at = pc.fill_null_backward(a_at), pc.fill_null_backward(b_at)
    doc = pc.shift_right(key, pa.scalar(DOC_SHIFT, pa.int64())).to_numpy(zero_copy_only=False)
    pair = pc.add(
        pc.multiply(pc.cast(a_ids.take(a_at), pa.int64()), vocabularies.b_size), pc.cast(b_ids.take(b_at), pa.int64()))
    counted = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.combine_chunks().sort_by([("doc", "ascending"), ("pair", "ascending")])
    lists = np.concatenate(([0], np.cumsum(np.bincount(counted["doc"].to_numpy(), minlength=n)))).astype(np.int32)
    pairs = counted["pair"].to_numpy()
    as_lists = lambda values: pa.ListArray.from_arrays(pa.array(lists), pa.array(values.astype(np.int32)))
    hashes, groups = _groups(
        a, b, a_at.to_numpy(zero_copy_only=False)[both], b_at.to_numpy(zero_copy_only=False)[both], vocabularies, keep_groups)
    return {
        "n_a": pa.array(np.diff(_offsets(a))), "n_b": pa.array(np.diff(_offsets(b))),
        "n_groups": pa.array(np.bincount(doc[both], minlength=n).astype(np.int64)),
        "n_links": pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
        "groups_sha256": pa.array(hashes, pa.string()),
        "a": as_lists(pairs // vocabularies.b_size), "b": as_lists(pairs % vocabularies.b_size),
        "times": as_lists(counted["count_all"].to_numpy()), "groups": pa.array(groups, pa.string()),
    }


def _groups(a: pa.ListArray, b: pa.ListArray, a_last: np.ndarray, b_last: np.ndarray, vocabularies: Vocabularies, keep: bool):
    """(hash, text if kept) of each document's groups; *_last: each group's last token of either side, in order."""
    a_cuts, b_cuts = _offsets(a), _offsets(b)
    n_a, n_b = int(a_cuts[-1]), int(b_cuts[-1])
    closes_a, mark_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
    closes_a[a_last] = 1
    mark_b[b_last] = 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(mark_b) - mark_b
    mark_b[b_cuts[1:][np.diff(b_cuts) > 0] - 1] = 2  # nothing after a document's last group
    # A group's ids of A come before its ids of B.
    place = np.empty(n_a + n_b, np.int64)
    place[np.arange(n_a) + np.concatenate(([0], b_last + 1))[group_a]] = 2 * a.flatten().to_numpy().astype(np.int64) + closes_a
    place[np.arange(n_b) + (a_last + 1)[group_b]] = 2 * vocabularies.a_size + 3 * b.flatten().to_numpy().astype(np.int64) + mark_b
    joined, offsets = _pick(vocabularies.shown, pa.array(place))
    cuts = offsets[a_cuts + b_cuts]
    texts = [joined[cuts[i] : cuts[i + 1]] for i in range(len(a))]
    return [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts], [str(t, "ascii") if keep else None for t in texts]


def _align(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str, keep_groups: bool) -> Iterator[pa.RecordBatch]:
    vocabularies = shared_vocabularies(a_file, b_file)
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for part in portions(texts):
            columns = {"doc_id": batch.column("doc_id")[part.start : part.stop]} | align_texts(texts[part], vocabularies, keep_groups)
            yield pa.RecordBatch.from_pydict(columns)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pair; a document's own pairs are distinct."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        counted = pa.concat_tables(held).group_by(["a", "b"], use_threads=False).aggregate([("docs", "sum")])
        return counted.select(["a", "b", "docs_sum"]).rename_columns(["a", "b", "docs"]).cast(PAIRS_SCHEMA)

    for batch in batches:
        a, b = batch.column("a").flatten(), batch.column("b").flatten()
        held.append(pa.table({"a": a, "b": b, "docs": pa.array(np.ones(len(a), np.int64))}, schema=PAIRS_SCHEMA))
        if sum(map(len, held)) > 2 * HELD_PAIRS:
            held = [merged()]
            if len(held[0]) > HELD_PAIRS:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, docs and best of each linked pair of ids: documents that hold it, and whether that is its A id's most."""
    counts = stored(aligned.select("a", "b").mapInArrow(_count_pairs, PAIRS).groupBy("a", "b").agg(F.sum("docs").alias("docs")), "align-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # at most a row per id of vocabulary A
    return counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _level() -> F.Column:
    """Document counts in order, in a bounded number of steps."""
    return F.when(F.col("docs") <= EXACT_LEVELS, F.col("docs")).otherwise(EXACT_LEVELS + F.floor(16 * F.log2(F.col("docs") / EXACT_LEVELS)) + 1)


def frequent_level(counts: DataFrame, most: int) -> int:
    """The lowest level that, with all above it, holds at most `most` pairs."""
    level, total = EXACT_LEVELS * 16, 0
    for row in sorted(counts.groupBy(_level().alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > most:
            break
        level = row["level"]
    return level


def _look_up(batches: Iterator[pa.RecordBatch], sent: Broadcast, b_size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs in the sent table; the other pairs stay in lists."""
    known, docs, best = sent.value
    for batch in batches:
        lists = batch.column("a")
        cuts = _offsets(lists)
        a, b, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("a", "b", "times"))
        pair = a.astype(np.int64) * b_size + b
        at = np.searchsorted(known, pair)
        hit = np.zeros(len(pair), bool)
        if len(known):
            at = np.minimum(at, len(known) - 1)
            hit = known[at] == pair
        sums = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[cuts])
        weight = np.where(hit, times, 0).astype(np.int64)
        found = (sums(weight * best[at]), sums(weight * docs[at])) if len(known) else (np.zeros(len(lists), np.int64),) * 2
        rest = np.concatenate(([0], np.cumsum(~hit)))[cuts].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), pa.array(found[0]), pa.array(found[1]),
             *[pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~hit])) for v in (a, b, times)]],
            names=["row_id", "n_best", "count_sum", "a", "b", "times"])


def align(docs: DataFrame, a_file: str, b_file: str, keep_groups: bool = False) -> DataFrame:
    """A stored row per document: row_id, the columns of PART, its linked pairs as lists with their times.

    `groups` holds the groups as text if asked for, else null.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut_twice = partial(_align, a_file=a_file, b_file=b_file, keep_groups=keep_groups)
    return stored(texts.mapInArrow(cut_twice, PART).withColumn("row_id", F.monotonically_increasing_id()), "align-texts")


def scored(aligned: DataFrame, counts: DataFrame, b_size: int, frequent: int = FREQUENT) -> DataFrame:
    """`aligned` with n_best and count_sum, its links weighed by the pairs' corpus-wide counts."""
    spark = aligned.sparkSession
    level = frequent_level(counts, frequent)
    table = counts.where(_level() >= level).select((F.col("a").cast("long") * b_size + F.col("b")).alias("pair"), "docs", "best").toArrow()
    table = table.sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy().astype(np.int64) for c in ("pair", "docs", "best")))
    looked_up = stored(
        aligned.select("row_id", "a", "b", "times").mapInArrow(partial(_look_up, sent=sent, b_size=b_size), SCORED), "align-scored")
    rest = looked_up.select("row_id", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("row_id", "p.*")
    others = rest.join(counts.where(_level() < level), ["a", "b"]).groupBy("row_id").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("docs")).alias("more_sum"))
    sums = looked_up.select("row_id", "n_best", "count_sum").join(others, "row_id", "left").select(
        "row_id", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))
    return aligned.join(sums, "row_id")


def alignment(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id with its counts of tokens, groups and links, link weights, and the hash of its groups."""
    import public_tokenizers
    import sentencepiece

    a_file = a_file or public_tokenizers.path("byte_bpe_50k.json")
    b_file = b_file or public_tokenizers.path("piece_bpe_32k.model")
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size()
    aligned = align(docs, a_file, b_file)
    counts = stored(pair_counts(aligned), "align-pairs")
    return scored(aligned, counts, b_size, frequent).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
