"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are bucketed by length and every bucket is cut into blocks of bounded
size, sorted by length.  A first look at the block of longest vectors gives each
query a lower bound for its k-th best product.  For every other block the bound,
divided by the query's length and the block's greatest length, is a local cosine
threshold: above 1 the block is skipped; where it is high, the query's largest
coordinates give intervals that a vector's own coordinates must lie in; where it
is low, only vectors long enough for the bound are taken.  Products of what
remains are computed exactly, as integers.

Blocks and query blocks are single binary rows.  Each block travels once, and
the queries once per block; pairs are dropped in the join where no query of the
block can reach it.  Equal lengths, or equal vectors, are split over blocks by a
hash of the row, so no group grows with the data.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do rows without an id; shorter vectors count as padded with zeros;
repeated rows are rows of their own; fewer than k candidates give all; an empty
table gives an empty result.  Scores beyond 64 bits end at their limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import stored

SCALE = 256
K = 5
BLOCK_ROWS = 4096
QUERY_ROWS = 2048
MAX_BUCKETS = 256
FOCUS = 3  # coordinates looked at by coordinate pruning
COORDINATE_FROM = 0.6  # local cosine threshold from which coordinates are pruned
SLACK = 1e-9  # relative rounding room of the bounds

BLOCK = "bucket long, sub long, rows long, width long, longest double, row_ids binary, ids binary, matrix binary"
FOUND = "query_row long, query_id long, vec_id long, score long"
FOUND_SCHEMA = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(embeddings: DataFrame) -> DataFrame:
    """(row_id, vec_id, q, norm2) of the vectors that take part; norm2 is a double used for bounds only."""
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    norm2 = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return embeddings.where(F.coalesce(sound, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row_id"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"),
    ).withColumn("norm2", norm2)


def _pack(table: pa.Table) -> pa.Table:
    """One block: its rows sorted by length, longest first, as binary columns."""
    table = table.sort_by([("norm2", "descending"), ("vec_id", "ascending")])
    lists = table.column("q").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    matrix = np.zeros((len(lengths), width), "<i8")
    matrix[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    raw = lambda name: table.column(name).to_numpy().astype("<i8").tobytes()
    return pa.table({
        "bucket": [table.column("bucket")[0].as_py()], "sub": [table.column("sub")[0].as_py()], "rows": [len(lengths)],
        "width": [width], "longest": [float(np.sqrt(table.column("norm2")[0].as_py()))], "row_ids": [raw("row_id")],
        "ids": [raw("vec_id")], "matrix": [_small(matrix).tobytes()],
    })


def _small(matrix: np.ndarray) -> np.ndarray:
    fits = not matrix.size or np.abs(matrix).max() < 2**31
    return matrix.astype("<i4") if fits else matrix


def _matrix(raw: bytes, rows: int, width: int) -> np.ndarray:
    size = len(raw) // max(1, rows * width)
    return np.frombuffer(raw, "<i4" if size == 4 else "<i8").reshape(rows, width)


def _fit(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if top < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Block:
    def __init__(self, row_ids: bytes, ids: bytes, matrix: bytes, rows: int, width: int):
        self.row_ids, self.ids = np.frombuffer(row_ids, "<i8"), np.frombuffer(ids, "<i8")
        self.matrix = _matrix(matrix, rows, width)
        self.norms = np.sqrt((self.matrix.astype(np.float64) ** 2).sum(axis=1))


def search(block: Block, queries: Block, floors: np.ndarray, k: int = K) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(query row, query id, ids, scores) of up to k best rows of the block that reach each query's floor (-inf: none)."""
    width = max(block.matrix.shape[1], queries.matrix.shape[1])
    rows, asked = _fit(block.matrix, width), _fit(queries.matrix, width)
    longest = block.norms.max(initial=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(floors > 0, floors / (queries.norms * longest), -1.0)
    bounded = (floors > 0) & (queries.norms > 0)
    local = np.where(bounded, local, np.where(floors > 0, np.inf, -1.0))
    out = []
    by_length = np.flatnonzero(local < COORDINATE_FROM)
    if len(by_length):
        least = np.where(floors[by_length] > 0, floors[by_length] / np.maximum(queries.norms[by_length], 1e-300), 0.0) * (1 - SLACK)
        long_enough = int(np.count_nonzero(block.norms >= least.min()))  # rows lie longest first
        scores = products(asked[by_length], rows[:long_enough])
        for q, own in zip(by_length, scores, strict=True):
            out.append(_best(block, queries, q, np.arange(long_enough), own, floors[q], k))
    unit = None
    for q in np.flatnonzero((local >= COORDINATE_FROM) & (local <= 1 + SLACK)):
        if unit is None:
            unit = rows / np.maximum(block.norms, 1e-300)[:, None]
        at = _by_coordinates(unit, asked[q] / queries.norms[q], min(1.0, local[q]))
        out.append(_best(block, queries, q, at, products(asked[q : q + 1], rows[at])[0], floors[q], k))
    return [found for found in out if len(found[2])]


def _by_coordinates(unit: np.ndarray, query: np.ndarray, threshold: float) -> np.ndarray:
    """Rows whose coordinates allow a cosine of at least the threshold with the query."""
    room = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-7
    fits = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(query), kind="stable")[:FOCUS]:
        spread = room * np.sqrt(max(0.0, 1 - query[f] ** 2)) + 1e-7
        if query[f] >= 0:
            low, high = threshold * query[f] - spread, np.inf if query[f] >= threshold else threshold * query[f] + spread
        else:
            low, high = -np.inf if -query[f] >= threshold else threshold * query[f] - spread, threshold * query[f] + spread
        fits &= (unit[:, f] >= low) & (unit[:, f] <= high)
    return np.flatnonzero(fits)


def _best(block: Block, queries: Block, q: int, at: np.ndarray, scores: np.ndarray, floor: float, k: int):
    good = (scores >= floor) & (block.row_ids[at] != queries.row_ids[q])
    at, scores = at[good], scores[good]
    if len(at) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth
        at, scores = at[near], scores[near]
    order = np.lexsort((block.ids[at], -scores))[:k]
    return int(queries.row_ids[q]), int(queries.ids[q]), block.ids[at[order]], scores[order]


def _search_pairs(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows hold a block, a query block and the queries' floors (empty: none)."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["row_ids"], row["ids"], row["matrix"], row["rows"], row["width"])
            queries = Block(row["q_row_ids"], row["q_ids"], row["q_matrix"], row["q_rows"], row["q_width"])
            floors = np.full(row["q_rows"], -np.inf)
            if row["floors"]:
                order = {r: i for i, r in enumerate(queries.row_ids.tolist())}
                for f in row["floors"]:
                    floors[order[f["query_row"]]] = f["floor"]
            found = search(block, queries, floors, k)
            sizes = [len(f[2]) for f in found]
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([f[0] for f in found], np.int64), sizes)),
                pa.array(np.repeat(np.array([f[1] for f in found], np.int64), sizes)),
                pa.array(np.concatenate([f[2] for f in found] or [none]).astype(np.int64)),
                pa.array(np.concatenate([f[3] for f in found] or [none]).astype(np.int64)),
            ], schema=FOUND_SCHEMA)


def placed_in_blocks(vectors: DataFrame, rows: int, buckets: int) -> DataFrame:
    """`vectors` with bucket and sub, their block of about `rows` rows; bucket 0 holds the longest vectors."""
    parts = max(1, min(buckets, -(-vectors.count() // rows)))
    bucket = F.lit(0).cast("long")
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = vectors.agg(F.percentile_approx("norm2", shares, 10_000).alias("c")).first()["c"]
        for edge in sorted(set(cuts)):
            bucket = bucket + (F.col("norm2") < edge).cast("long")
    placed = vectors.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / rows).alias("subs"))  # a row per bucket
    return placed.join(F.broadcast(sizes), "bucket").withColumn("sub", F.pmod(F.xxhash64("row_id"), "subs")).drop("subs")


def packed(placed: DataFrame) -> DataFrame:
    return placed.select("bucket", "sub", "row_id", "vec_id", "q", "norm2").groupBy("bucket", "sub").applyInArrow(_pack, BLOCK)


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows; ties to the smaller vec_id."""
    vectors = stored(quantised(embeddings), "topk-vectors")
    blocks = stored(packed(placed_in_blocks(vectors, block_rows, MAX_BUCKETS)), "topk-blocks")
    queries = stored(placed_in_blocks(vectors.where(is_query), query_rows, 1), "topk-queries")
    asked = packed(queries).select(
        F.col("sub").alias("q_sub"), *[F.col(c).alias(f"q_{c}") for c in ("rows", "width", "row_ids", "ids", "matrix")])
    asked = stored(asked, "topk-query-blocks")
    pair = [*[c for c in blocks.columns if c not in ("bucket", "sub", "longest")], *[c for c in asked.columns if c != "q_sub"], "floors"]

    def searched(pairs: DataFrame) -> DataFrame:
        return pairs.select(*pair).mapInArrow(partial(_search_pairs, k=k), FOUND)

    # The first look: every query block with the block of longest vectors, one row of bounded size.
    first = blocks.orderBy("bucket", "sub").limit(1)
    no_floors = F.array().cast("array<struct<query_row:bigint,floor:double>>")
    seeds = stored(searched(asked.withColumn("floors", no_floors).join(F.broadcast(first), F.lit(True))), "topk-seeds")
    best_first = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    floors = seeds.withColumn("n", F.row_number().over(best_first)).where(F.col("n") == k).select(
        "query_row", F.col("score").cast("double").alias("floor"))
    reach = F.when(F.coalesce("floor", F.lit(0.0)) <= 0, 0.0).when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(
        F.lit(float("inf")))
    bounds = queries.join(floors, F.col("row_id") == F.col("query_row"), "left").groupBy(F.col("sub").alias("q_sub")).agg(
        F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("query_row", "floor"))).alias("floors"),  # at most a block's queries
        F.min(reach).alias("reach"),
    )
    bounds = stored(bounds, "topk-bounds")
    others = blocks.join(first.select("bucket", "sub"), ["bucket", "sub"], "left_anti")
    # Pairs of query block and block, where some query may reach it: names only.
    pairs = bounds.select("q_sub", "reach").join(
        others.select("bucket", "sub", "longest"), F.col("reach") * (1 - SLACK) <= F.col("longest")).select("q_sub", "bucket", "sub")
    rest = searched(pairs.join(asked, "q_sub").join(bounds.select("q_sub", "floors"), "q_sub").join(others, ["bucket", "sub"]))
    ranked = seeds.unionByName(rest).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
