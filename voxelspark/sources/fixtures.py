"""Volumes and rasters made of the driver's tables, in exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = {"x": 32, "y": 32, "z": 16}
PLANE = {"r": 64, "c": 64}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """x, y, z, tot, tis, bod, hu: raw classes of three tasks and a density per cell. With the key volume_id, one volume for every 4096 order numbers, so their number grows with the table."""
    li = table(spark, sf_dir, "lineitem")
    named = [F.floor(F.col("l_orderkey") / 4096).cast("int").alias(k) for k in keys]
    cell = [*named, (F.col("l_partkey") % 32).cast("int").alias("x"), (F.col("l_orderkey") % 32).cast("int").alias("y"), (F.col("l_suppkey") % 16).cast("int").alias("z")]
    sums = li.select(*cell, "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")).groupBy(*keys, "x", "y", "z")
    sums = sums.agg(F.sum(F.col("l_linenumber") + F.col("l_partkey")).alias("a"), F.sum("l_linenumber").alias("b"), F.sum(F.col("q") * 20).alias("d"))
    inside = (F.pow(F.col("x") - 16, F.lit(2)) + F.pow(F.col("y") - 16, F.lit(2)) <= 144) & F.col("z").between(2, 13)
    return sums.select(*keys, "x", "y", "z", (F.col("a") % 118).cast("int").alias("tot"), (F.col("b") % 4).cast("int").alias("tis"), inside.cast("int").alias("bod"), (F.col("d") % 1000 - 500).cast("int").alias("hu"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plane, r, c, v: all vectors as 64 x 64 planes of 64 vectors each, the last one as far as they go."""
    e = table(spark, sf_dir, "embeddings")
    place = [F.floor(F.col("vec_id") / 64).cast("int").alias("plane"), F.pmod("vec_id", F.lit(64)).cast("int").alias("r")]
    return e.select(*place, F.posexplode("embedding").alias("c", "v")).select("plane", "r", "c", F.col("v").cast("double").alias("v"))
