"""Mixing sources to target weights by a time-varying curriculum.

Sources get shares of all words by weight, at most MAX_EPOCHS times what they
hold; what is over goes to the others by weight until none is above its bound.
Within a source, documents follow one another in the order of a hash of their
id, epoch after epoch, until the target is reached; a document is taken or not,
never cut, so a source misses its target by at most half a document.

Each source also has a schedule, its relative weight along training time 0..1.
Integrating it gives the source's cumulative demand; a document's training
position is the time at which the demand reaches the document's middle word.
Sorting by position (a range sort) gives the training order.

Running totals use slots of the hash: totals inside (source, slot), shifted by
the sums of earlier slots, so a source that holds a third of all rows spreads
over SLOTS groups.  Only the table of sources, a row each, is ranked in one
place.

Defined cases: null text has size 0; null sources are one source, last; empty
documents are taken at most once; documents of equal order key (repeated ids)
are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import stored, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SLOT_DIGITS = 3  # leading hexadecimal digits of the order key: 4096 slots

# Schedules: relative weight at equally spaced times 0..1, linear in between.
# One per place in WEIGHTS: early, even, late.
SCHEDULES = ((1.5, 1.25, 1.0, 0.75, 0.5), (1.0, 1.0, 1.0, 1.0, 1.0), (0.5, 0.75, 1.0, 1.25, 1.5))


@dataclass(frozen=True)
class Segment:
    """Demand share u0..u1 is met during time t0..t0+width, at relative weight w0 at its start, w1 at its end."""

    u0: float
    u1: float
    t0: float
    width: float
    w0: float
    w1: float


def integrate(knots: tuple[float, ...]) -> list[Segment]:
    """Cumulative demand of a schedule, scaled to reach 1 at time 1."""
    width = 1.0 / (len(knots) - 1)
    total = sum((a + b) / 2 * width for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
        after = 1.0 if i == len(knots) - 2 else done + (a + b) / 2 * width / total
        out.append(Segment(done, after, i * width, width, a / total, b / total))
        done = after
    return out


def invert(share: Column, segments: list[Segment]) -> Column:
    """The time at which cumulative demand reaches `share` (0..1)."""
    out = F.lit(1.0)
    for s in reversed(segments):
        rest, slope = share - F.lit(s.u0), (s.w1 - s.w0) / s.width
        if slope == 0:
            within = rest / F.lit(s.w0)
        else:  # w0 * x + slope / 2 * x * x = rest
            within = (F.sqrt(F.lit(s.w0 * s.w0) + rest * F.lit(2 * slope)) - F.lit(s.w0)) / F.lit(slope)
        out = F.when(share < s.u1, F.lit(s.t0) + within).otherwise(out)
    return out


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_rank, schedule, source_size, target) of every source in rows of (source, size)."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("schedule") + 1).cast("long")
    shares = sizes.withColumn("source_rank", place).withColumn("schedule", F.col("source_rank") % len(weights)).withColumn(
        "weight", weight).withColumn("bound", max_epochs * F.col("source_size"))
    # Sources by how soon they reach their bound: those before the first that
    # does not are full, the others share the rest by weight.
    order = Window.orderBy(F.col("bound") / F.col("weight"), "source_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = shares.withColumn(
        "rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    ).withColumn(
        "rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    open_ = F.col("bound") * F.col("rest_weight") > F.col("weight") * F.col("rest")
    level = F.min(F.when(open_, F.struct(
        (F.col("bound") / F.col("weight")).alias("at"), "source_rank", "rest", "rest_weight"))).over(everything)
    ranked = ranked.withColumn("level", level)
    full = F.col("level").isNull() | (
        F.struct((F.col("bound") / F.col("weight")).alias("at"), "source_rank")
        < F.struct(F.col("level.at").alias("at"), F.col("level.source_rank").alias("source_rank")))
    shared = (F.col("weight") * F.col("level.rest")).cast("double") / F.col("level.rest_weight")
    return ranked.select(
        "source", "source_rank", "schedule", "source_size",
        F.when(full, F.col("bound").cast("double")).otherwise(shared).alias("target"),
    )


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    return docs.select(*carry, F.col("doc_id").alias("id"), F.col("source"), word_count(F.col("text")).alias("size"))


def _order_key() -> Column:
    return F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))


def plan(documents: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of `documents` (from `sized`) with source_size, target, copies, taken and positions of the copies.

    `sizes` holds the same rows without carried columns, stored: totals are made from it.
    """
    sources = targets(sizes)
    keyed = documents.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", "source_rank", "schedule", "source_size", "target",
    ).withColumn("order_key", _order_key()).withColumn("slot", F.substring("order_key", 1, SLOT_DIGITS))
    sums = sizes.withColumn("slot", F.substring(_order_key(), 1, SLOT_DIGITS)).groupBy("source", "slot").agg(
        F.sum("size").alias("slot_size")
    ).alias("t").join(
        sources.select("source", F.col("source_rank").alias("r")).alias("u"), F.col("t.source").eqNullSafe(F.col("u.source")),
    ).select(F.col("r").alias("source_rank"), "slot", "slot_size")
    earlier = Window.partitionBy("source_rank").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_rank", "slot", F.coalesce(F.sum("slot_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_rank", "slot").orderBy("order_key", "id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(offsets, ["source_rank", "slot"]).withColumn(
        "middle", F.col("offset") + F.sum("size").over(inside) - F.col("size") / 2)
    share = lambda epoch: (F.col("middle") + epoch * F.col("source_size")) / F.col("target")
    taken = [(F.col("middle") + e * F.col("source_size")) <= F.col("target") for e in range(MAX_EPOCHS)]
    copies = sum([t.cast("int") for t in taken[1:]], taken[0].cast("int"))
    copies = F.when(F.col("size") == 0, taken[0].cast("int")).otherwise(copies)
    counted = placed.withColumn("copies", copies).withColumn(
        "positions", F.slice(F.array(*[_position(share(e)) for e in range(MAX_EPOCHS)]), F.lit(1), F.col("copies")))
    return counted.select(
        *documents.columns, "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "positions",
    )


def _position(share: Column) -> Column:
    known = F.when(F.col("target") > 0, share).otherwise(F.lit(0.0))
    by_schedule = F.lit(0.0)
    for i, knots in enumerate(SCHEDULES):
        by_schedule = F.when(F.col("schedule") == i, invert(known, integrate(knots))).otherwise(by_schedule)
    return by_schedule


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and first position, sorted by position."""
    sizes = stored(sized(docs), "mix-sizes")
    return plan(sizes, sizes).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies",
        F.get("positions", F.lit(0)).alias("position"),
    ).sort(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per copy taken, with all columns, in training order."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", "text")
    planned = plan(sized(rows, "row"), stored(sized(docs), "mix-sizes"))
    copies = planned.select("row", F.explode("positions").alias("position"))
    return copies.sort("position").select("row.*")
