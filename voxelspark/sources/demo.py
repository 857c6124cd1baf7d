"""A made-up volume for trying things out: one small block of cells per label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blocks(labels: DataFrame, per_label: int, seed: int) -> DataFrame:
    """label, x, y, z: draws of cells of a block for each row of ``labels`` (label). x and y lie in [40, 60), z within two cells below and one above 20 + 5 * label."""
    draw = lambda axis, low, span: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), F.col("label").cast("string"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % span + low).cast("int").alias(axis)
    rows = labels.select("label", F.explode(F.sequence(F.lit(0), F.lit(per_label - 1))).alias("id"))
    return rows.select("label", draw("x", F.lit(40), 20), draw("y", F.lit(40), 20), draw("z", F.col("label") * 5 + 18, 4))


def cloud(spark: SparkSession, labels: tuple[int, ...], per_label: int, seed: int) -> DataFrame:
    """``blocks`` of given labels."""
    return blocks(spark.createDataFrame([(x,) for x in labels], "label int"), per_label, seed)
