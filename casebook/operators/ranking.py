"""Latest / best / preferred rows, running positions and stratified samples.

One-per-key picks use max_by / min_by over structs: they combine map-side, so a
key holding a large share of all rows never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], score: list[Column], columns: list[str] | None = None) -> DataFrame:
    """The row with the greatest score tuple of each key (NULL ranks lowest)."""
    names = [c for c in (columns or df.columns) if c not in keys]
    ranked = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])
    row = F.max_by(F.struct(*names), ranked).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def latest_per_key(df: DataFrame, keys: list[str], order: str, tie: str = "id") -> DataFrame:
    """Latest row per key, highest id on ties."""
    return best_per_key(df, keys, [F.col(order), F.col(tie)])


def preferred_per_key(df: DataFrame, keys: list[str], preferred: Column, tie: str = "id") -> DataFrame:
    """Preferred rows first, then the highest id."""
    return best_per_key(df, keys, [preferred.cast("int"), F.col(tie)])


def first_wins(df: DataFrame, keys: list[str], arrival: list[Column]) -> DataFrame:
    """First arrival per key; rows whose keys are NULL are all kept."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    names = [c for c in df.columns if c not in keys]
    order = F.struct(*[a.alias(f"a{i}") for i, a in enumerate(arrival)])
    first = (
        df.where(known)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*names), order).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )
    return first.unionByName(df.where(~known))


def running_sum(df: DataFrame, keys: list[str], order: list[str], slot: Column, value: Column, name: str) -> DataFrame:
    """Running total of a value within each key, in the given order.

    Two levels: totals run inside (key, slot) and are shifted by the sums of the
    earlier slots, so a hot key spreads over its slots instead of being sorted
    whole in one task.  `slot` must not decrease along the order.
    """
    slotted = df.withColumn("_slot", slot).withColumn("_v", value.cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*keys, "_slot")
        .agg(F.sum("_v").alias("_sum"))
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_slot").alias("_s"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    match = F.col("_slot").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        slotted.join(offsets, match)
        .withColumn(name, F.sum("_v").over(inside) + F.col("_before"))
        .select(*df.columns, name)
    )


def id_slot(id_col: str = "id", width: int = 100_000) -> Column:
    """Slot for running totals in id order."""
    return F.floor(F.col(id_col) / width)


def attempt_numbers(attempts: DataFrame, grain: str = "hour") -> DataFrame:
    """Attempt number per (source, stage): earlier attempts plus one."""
    keys = ["source_google_news_id", "stage"]
    slot = F.date_trunc(grain, F.col("created_at"))
    return running_sum(attempts, keys, ["created_at", "id"], slot, F.lit(1), "attempt_no")


def round_robin(df: DataFrame, stratum: str, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Seeded stratified sample: one per stratum per pass until n rows are taken.

    The order is that of md5('seed:value'), for rows and for strata.

    No stratum can contribute more than n rows, so ranks above n are cut map-side.
    """
    def shuffled(column: str) -> Column:
        return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit(""))))

    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(id_col), id_col))
    return (
        df.withColumn("turn", turn)
        .where(F.col("turn") <= n)
        .orderBy("turn", shuffled(stratum), id_col)
        .limit(n)
    )


def numbered_members(df: DataFrame, group: str, order: str = "id", most: int | None = None) -> DataFrame:
    """1-based member index inside each group, optionally only the first few."""
    ranked = df.withColumn("member_no", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked if most is None else ranked.where(F.col("member_no") <= most)


def survivor(members: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, id, survivor_id, is_survivor): most sources wins, then the lowest id."""
    picked = members.groupBy(group).agg(
        F.max_by("id", F.struct(F.coalesce("source_count", F.lit(1)), -F.col("id"))).alias("survivor_id"),
        F.count("*").alias("size"),
    )
    return members.join(picked, group).withColumn("is_survivor", F.col("id") == F.col("survivor_id"))


def largest_groups(groups: DataFrame, n: int = 15) -> DataFrame:
    return groups.orderBy(F.col("size").desc(), "group_id").limit(n)
