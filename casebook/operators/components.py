"""Connected components over an edge table, by alternating star contractions.

Each round points every node at the smallest id it can see, first through all
neighbours, then through smaller ones.  Rounds grow with the logarithm of the
longest chain, not with its length, and each round only groups and joins edges:
the minimum per node combines map-side, and a node with very many edges is
split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.session import cut


def connected_components(edges: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, component): component is the smallest id of the connected group.

    Only nodes that occur in an edge are returned.
    """
    current = cut(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    )
    before = _signature(current)
    while before[0]:
        current = cut(_small_star(_large_star(current)))
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pointed = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return pointed.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def with_components(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    found = connected_components(edges).withColumnRenamed("id", id_col)
    return nodes.join(found, id_col, "left").withColumn("component", F.coalesce("component", id_col))
