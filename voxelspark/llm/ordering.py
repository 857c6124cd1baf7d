"""Places of rows in a global order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def numbered(rows: DataFrame, group: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """The stored table ``rows`` with ``at`` (places before it in its group, from 0, or the ``weight`` before it) and ``n`` (the group's places or weight); ``group`` holds no null.

    Rows are dealt out by ranges of (group, order), so a group spreads over many tasks; equal rows are dealt out by a salt, and their order among each other is open. One row for each
    task and group then gives the places that come before.
    """
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(*group, *order, "_salt").sortWithinPartitions(*group, *order, "_salt").drop("_salt")
    stored = C.materialize(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    own = F.lit(1) if weight is None else F.col(weight)
    starts = C.materialize(stored.groupBy(*group, "_part").agg(F.min("_id").alias("_first"), F.sum(own).cast("long").alias("_many")), 1)  # about one row a task
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*group, "_part", "_first", F.coalesce(F.sum("_many").over(before), F.lit(0)).alias("_before"), F.sum("_many").over(Window.partitionBy(*group)).alias("n"))
    out = stored.join(C.checked_broadcast(starts), [*group, "_part"])
    if weight is None:
        at = F.col("_id") - F.col("_first")
    else:  # of tables that are small beside the documents
        at = F.coalesce(F.sum(weight).over(Window.partitionBy(*group, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("at", (F.col("_before") + at).cast("long")).select(*rows.columns, "at", "n")
