"""Seeded sampling by the order of hashes, so that results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import PALETTE, QUOTA
from ..session import materialize


def seeded(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified(labels: DataFrame, quota: dict[int, int], seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per volume (``keys``) and label the ``quota`` cells that come first in hash order, all if there are fewer, none without a quota.

    A label of many cells would make one task rank them all. So cells are first kept by the head of their hash, under a share that the label's count sets: four times the quota and 64
    more are kept, which falls short of the quota in none of 10**20 draws; only these are ranked.
    """
    table = F.broadcast(labels.sparkSession.createDataFrame([(k, v) for k, v in quota.items() if v > 0], "label int, quota int"))
    labels = materialize(labels)  # it is read twice
    sizes = labels.groupBy(*keys, "label").agg(F.count("*").alias("_cells"))
    found = labels.join(table, "label").withColumn("_hash", seeded(seed, "x", "y", "z"))
    head = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    found = found.join(sizes, [*keys, "label"]).where(head * F.col("_cells") < F.col("quota") * 4 + 64)
    order = Window.partitionBy(*keys, "label").orderBy("_hash", "x", "y", "z")
    return found.withColumn("_n", F.row_number().over(order)).where("_n <= quota").select(*labels.columns)


def first_rows(df: DataFrame, k: int, seed: int, column: str) -> DataFrame:
    return df.orderBy(seeded(seed, column), column).limit(k)


def batches(df: DataFrame, order: str, n: int, parts: int = 64) -> DataFrame:
    """``df`` with batch_id: positions in ``order`` cut in batches of ``n``. Values of ``order`` should be distinct.

    Rows are dealt into ranges of ``order`` between values that a bounded draw gives; a row's position is its rank within its range and the rows of the ranges before, so no task holds all rows.
    """
    drawn = df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(16 * parts).collect()
    cuts = sorted({r[0] for r in drawn})[8::16]
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col(order) > F.lit(cut)).cast("int")
    dealt = df.withColumn("_part", F.coalesce(part, F.lit(-1)))  # rows without a value come first
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # at most ``parts`` + 1 rows
    before, total = [], 0
    for k in sorted(sizes):
        before += [F.lit(k), F.lit(total)]
        total += sizes[k]
    if not before:
        return df.withColumn("batch_id", F.lit(None).cast("long"))
    at = F.create_map(*before)[F.col("_part")] + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("batch_id", F.floor(at / n).cast("long")).drop("_part")


def paired(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Rows of two tables that have the same position in their orders, as two lists are zipped: the longer table's rest is left out. Column names must differ."""
    at = "_position"
    return batches(left, left_order, 1).withColumnRenamed("batch_id", at).join(batches(right, right_order, 1).withColumnRenamed("batch_id", at), at).drop(at)


def with_colors(points: DataFrame) -> DataFrame:
    colors = F.broadcast(points.sparkSession.createDataFrame(list(PALETTE), "label int, red int, green int, blue int, alpha int"))
    joined = points.join(colors, "label", "left")
    return joined.select(*points.columns, *[F.coalesce(c, F.lit(255 if c == "alpha" else 0)).alias(c) for c in ("red", "green", "blue", "alpha")])


def axis_plane(spark, y: int, width: int, height: int) -> DataFrame:
    """x, y, z of the plane z = y."""
    return spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), F.lit(y).alias("z"))


def axis_planes(volumes: DataFrame, z: int, width: int, height: int) -> DataFrame:
    """The columns of ``volumes`` and x, y, z of the plane at ``z`` of each."""
    cell = volumes.select("*", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("_cell"))
    return cell.select(*volumes.columns, (F.col("_cell") % width).cast("int").alias("x"), F.floor(F.col("_cell") / width).cast("int").alias("y"), F.lit(z).alias("z"))


def _drawn(draw: Column, seed: int, cells: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), draw.cast("string"))), 1, 12), 16, 10).cast("long") % cells


def axis_sample(plane: DataFrame, size: int, seed: int, width: int, height: int) -> DataFrame:
    """``size`` draws with replacement from a plane whose cells are numbered y * width + x."""
    drawn = plane.sparkSession.range(size).select(F.col("id").alias("draw"), _drawn(F.col("id"), seed, width * height).alias("cell"))
    return drawn.join(plane.withColumn("cell", (F.col("y") * width + F.col("x")).cast("long")), "cell").select("draw", "x", "y", "z")


def axis_draws(volumes: DataFrame, z: int, size: int, seed: int, width: int, height: int) -> DataFrame:
    """The columns of ``volumes`` and x, y, z: ``size`` draws from the whole plane at ``z`` for each row, the same for all; nothing is joined."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _drawn(i, seed, width * height))
    cell = volumes.select("*", F.explode(draws).alias("_cell"))
    return cell.select(*volumes.columns, (F.col("_cell") % width).cast("int").alias("x"), F.floor(F.col("_cell") / width).cast("int").alias("y"), F.lit(z).alias("z"))


DEFAULT_QUOTA = QUOTA
