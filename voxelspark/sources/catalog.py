"""File catalogs: name filter, first of each basename, derived paths, affine matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, pattern: str = "*.nii.gz") -> DataFrame:
    """path, modificationTime and length of the files of a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).drop("content")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def unprocessed(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").contains("_processed_"))


def first_of_each_name(files: DataFrame) -> DataFrame:
    """The first path, in path order, of each basename. An aggregate, so a name shared by many files is combined before the shuffle."""
    return files.groupBy(basename(F.col("path")).alias("name")).agg(F.min("path").alias("path"))


def derived_paths(files: DataFrame) -> DataFrame:
    swap = lambda suffix, folder: F.replace(F.replace(F.col("path"), F.lit(".nii.gz"), F.lit(suffix)), F.lit("/imgs/"), F.lit(folder))
    return files.select("path", swap("_label.nii.gz", "/labels/").alias("dest_label"), swap("_us", "/us/").alias("dest_us"))


def affine(direction: Column, spacing: Column, origin: Column) -> Column:
    """The 4 x 4 matrix: direction columns scaled by spacing, and the origin."""
    cell = lambda i, j: direction[i * 3 + j] * spacing[j]
    rows = [F.array(*[cell(i, j) for j in range(3)], origin[i]) for i in range(3)]
    return F.array(*rows, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))
