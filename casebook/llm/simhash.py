"""Near-duplicates by SimHash, found through a positional byte index.

A fingerprint has eight bytes.  Two fingerprints that differ in at most three
bits share at least five of the eight (position, byte) entries, so a pair is a
candidate only if its count of shared positional bytes reaches five, and then
the bits decide.  Lists of single bytes would hold a 256th of all fingerprints
each.  The index therefore keys on four positions at once: fourteen sets of four
positions (the planes of the cube of three-bit positions) are such that any five
positions contain one of them whole, so every pair with five shared bytes meets
under at least one 32-bit key, and lists stay short.

Equal fingerprints are one entry, whatever the number of copies, and stand for
all their rows.  Pairs are formed inside the join only as far as they link; a
pair is reported by the first of the sets under which it meets.

Defined cases: a text without words (null and empty too) has fingerprint zero
and links like any other; repeated rows share a fingerprint; null ids never
become a component id unless a whole component has no id; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from casebook.llm.common import as_bytes, stored
from casebook.operators.components import connected_components

SHINGLE = 3
SEED = 42
BITS, BYTES = 64, 8
MAX_BITS = 3
MIN_SHARED = BYTES - MAX_BITS
CHUNK = 65_536  # hashes whose bits are counted at once

# The 14 planes {x : parity(x & a) = b} of positions 0..7.
KEY_SETS = [
    [x for x in range(BYTES) if (x & a).bit_count() % 2 == b]
    for a in range(1, BYTES) for b in (0, 1)
]


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, most significant first."""
    words = text.lower().split()
    if not words:
        return bytes(BYTES)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(shingles), CHUNK):
        part = b"".join([digest(s, SEED) for s in shingles[at : at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, BYTES), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


@F.arrow_udf(LongType())
def _fingerprint_udf(text: pa.Array) -> pa.Array:
    prints = b"".join(fingerprint(t) for t in as_bytes(text))
    return pa.array(np.frombuffer(prints, ">i8").astype(np.int64))


def fingerprint_of(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    return _fingerprint_udf.asNondeterministic()(text)


def fingerprint_text(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * (BYTES - 1 - position)).bitwiseAND(F.lit(255))


def _key(value: Column, positions: list[int]) -> Column:
    key = F.lit(0).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(value, p))
    return key


def index_entries(prints: DataFrame) -> DataFrame:
    """(set, key, fp): every fingerprint once under each of the key sets."""
    keys = F.array(*[F.struct(F.lit(i).alias("set"), _key(F.col("fp"), s).alias("key")) for i, s in enumerate(KEY_SETS)])
    return prints.select("fp", F.explode(keys).alias("e")).select("e.set", "e.key", "fp")


def links(prints: DataFrame) -> DataFrame:
    """(fp_a, fp_b): all pairs of distinct fingerprints, fp_a < fp_b, that differ in at most MAX_BITS bits."""
    entries = index_entries(prints)
    a, b = entries.alias("a"), entries.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    shared = [(_byte(differ, p) == 0).cast("int") for p in range(BYTES)]
    count = sum(shared[1:], shared[0])
    first = F.lit(None).cast("int")
    for i in range(len(KEY_SETS) - 1, -1, -1):
        first = F.when(_key(differ, KEY_SETS[i]) == 0, i).otherwise(first)
    meet = (
        (F.col("a.set") == F.col("b.set")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
        & (count >= MIN_SHARED) & (F.bit_count(differ) <= MAX_BITS) & (first == F.col("a.set"))
    )
    return a.join(b, meet).select(F.col("a.fp").alias("fp_a"), F.col("b.fp").alias("fp_b"))


def print_components(prints: DataFrame) -> DataFrame:
    """(fp, root): every distinct fingerprint with the smallest fingerprint of its component."""
    found = connected_components(links(prints), "fp_a", "fp_b").withColumnRenamed("id", "fp")
    return prints.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def component_ids(marked: DataFrame) -> DataFrame:
    """(fp, root, component_id) from rows with fp and doc_id."""
    prints = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-prints")
    roots = stored(print_components(prints.select("fp")), "simhash-roots")
    ids = roots.join(prints, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    return roots.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    marked = stored(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "simhash-rows")
    return marked.join(component_ids(marked), "fp").select(
        "doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns.

    Of rows that repeat this id within the component, any one stays.
    """
    rows = docs.select(F.struct("*").alias("row"))
    marked = stored(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "simhash-rows")
    first = component_ids(marked).alias("c")
    kept = rows.withColumn("fp", fingerprint_of(F.col("row.text"))).alias("r").join(first, "fp").where(
        F.col("row.doc_id").eqNullSafe(F.col("component_id"))
    )
    return kept.dropDuplicates(["root"]).select("row.*")
