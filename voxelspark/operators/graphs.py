"""Connected components by alternating stars: distributed union-find whose tables never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, materialize


#: Copies of a parent's least neighbour, among which its children are dealt.
SALTS = 32


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every neighbour above a node points to the least of its neighbourhood. Small star: the neighbours below do, and the node itself.

    A parent may have a third of all nodes as children, so in the large star its rows are salted by the child; other nodes have few.
    """
    near = edges.select("a", "b", F.lit(0).alias("salt"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.pmod(F.xxhash64("a"), F.lit(SALTS)) + 1).cast("int").alias("salt")))
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.max("salt").alias("salt")).withColumn("m", F.least("a", "m"))
    copies = least.select("a", "m", F.explode(F.when(F.col("salt") > 0, F.sequence(F.lit(0), F.lit(SALTS))).otherwise(F.array(F.lit(0)))).alias("salt")) if large else least.select("a", "m", F.lit(0).alias("salt"))
    joined = near.join(copies, ["a", "salt"])
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and to none that points further."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 OR child + parent > 1").isEmpty()


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b; ``rows`` at most, if that is known), root being the least node that it reaches. Links are of any orderable type; loops and links
    with a null end are ignored.

    Edges point from the greater to the less. Each round's table replaces the one before.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    while not _settled(edges):
        new = materialize(_star(_star(edges, large=True), large=False), 2 * edges.count())
        drop(edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
