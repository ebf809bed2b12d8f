"""Incremental entity resolution: buckets a micro-batch touched, components that grow with its edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.operators import neardup
from casebook.operators.components import connected_components
from casebook.session import cut
from casebook.streaming.ingest import KEY_BUCKETS


def touched_buckets(batch: DataFrame) -> DataFrame:
    """(day, city) buckets of the batch's dated and placed rows."""
    return (
        batch.where(F.col("event_date").isNotNull() & F.col("city").isNotNull())
        .select(F.to_date("event_date").alias("day"), "city")
        .distinct()
    )


def resolver(snapshot: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: regroup only the touched buckets of the snapshot."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(neardup.groups_in_buckets(snapshot(), touched_buckets(batch)), batch_id)

    return run


# --- components that grow with the stream -------------------------------------------------------
MEMBER = "id long, root long, key_bucket int, batch int"


class ComponentTable:
    """Components of all edges seen so far, kept as two growing tables in a shared folder.

    `members` holds each id once, with the root of its component when it first
    came; `roots` holds (id, root) for every root that was later joined to a
    smaller one.  A component's root is its smallest id, so the current root of an
    id is found by following `roots` downwards.  A batch reads only the hash
    buckets of its own ids and roots, finds the components of the roots its edges
    tie together, and appends what is new; nothing that earlier batches settled is
    computed or written again.  A batch that is run again rewrites its own rows.
    """

    def __init__(self, folder: str, buckets: int = KEY_BUCKETS) -> None:
        self.folder, self.buckets = folder, buckets

    def _read(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame:
        """Rows of the batches before this one; all batches if none is named."""
        try:
            rows = spark.read.schema(MEMBER).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], MEMBER)
        return rows if before is None else rows.where(F.col("batch") < before)

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _known(self, spark: SparkSession, name: str, ids: DataFrame, batch_id: int) -> DataFrame:
        """(id, root) of those of the ids that the table holds."""
        keyed = ids.withColumn("key_bucket", self._bucket("id"))
        touched = [r["key_bucket"] for r in keyed.select("key_bucket").distinct().collect()]  # at most `buckets` numbers
        stored = self._read(spark, name, batch_id).where(F.col("key_bucket").isin(touched)).select("id", "root", "key_bucket")
        return keyed.join(stored, ["id", "key_bucket"]).select("id", "root")

    def _current(self, spark: SparkSession, found: DataFrame, batch_id: int) -> DataFrame:
        """`found` (id, root) with each root followed to its end, a join a step."""
        while True:
            roots = found.select(F.col("root").alias("id")).distinct()
            moved = cut(self._known(spark, "roots", roots, batch_id).select(F.col("id").alias("root"), F.col("root").alias("next")))
            if moved.isEmpty():
                return found
            found = cut(found.join(moved, "root", "left").select("id", F.coalesce("next", "root").alias("root")))

    def fold(self, edges: DataFrame, batch_id: int) -> None:
        """Take in a batch of edges (id_a, id_b); to be given to foreachBatch."""
        spark = edges.sparkSession
        edges = cut(edges.select("id_a", "id_b").where("id_a IS NOT NULL AND id_b IS NOT NULL").distinct())
        ids = cut(edges.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct())
        known = self._current(spark, cut(self._known(spark, "members", ids, batch_id)), batch_id)
        at = cut(ids.join(known, "id", "left").select("id", F.col("root").isNull().alias("new"), F.coalesce("root", "id").alias("root")))
        ends = [at.select(F.col("id").alias(f"id_{t}"), F.col("root").alias(f"root_{t}")) for t in "ab"]
        between = edges.join(ends[0], "id_a").join(ends[1], "id_b").select(F.col("root_a").alias("id_a"), F.col("root_b").alias("id_b"))
        joined = cut(connected_components(between))
        top = at.where("new").join(joined.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("component", "root").alias("root"))
        # New ids are roots of nothing yet; only roots that older rows point at need an entry.
        older = joined.join(at.where("NOT new").select(F.col("root").alias("id")).distinct(), "id", "left_semi")
        moved = older.where("id <> component").select("id", F.col("component").alias("root"))
        for name, rows in (("members", top), ("roots", moved)):
            rows.withColumn("key_bucket", self._bucket("id")).write.mode("overwrite").partitionBy("key_bucket").parquet(
                f"{self.folder}/{name}/batch={batch_id}")

    def components(self, spark: SparkSession) -> DataFrame:
        """(id, component) of every id seen so far."""
        members = self._read(spark, "members").select("id", "root")
        ends = connected_components(self._read(spark, "roots").select(F.col("id").alias("id_a"), F.col("root").alias("id_b")))
        last = ends.select(F.col("id").alias("root"), "component")
        return members.join(last, "root", "left").select("id", F.coalesce("component", "root").alias("component"))
