"""Label maps from raw segmentations: class remap, overlays, body shell and the assembly of all three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CLASS_TO_LABEL, DENSITY
from . import packed

AXES = ("x", "y", "z")


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASS_TO_LABEL, "cls int, label int")


def remap(cells: DataFrame, column: str = "tot") -> DataFrame:
    """``cells`` with the label of a raw class; unknown classes give 0. The table has 118 rows, so it is broadcast."""
    table = F.broadcast(class_table(cells.sparkSession).withColumnRenamed("cls", column))
    return cells.join(table, column, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def invert_map(table: DataFrame) -> DataFrame:
    return table.groupBy("label").agg(F.sort_array(F.collect_list("cls")).alias("classes"))


def is_fat(tissue: Column, fast: bool = False) -> Column:
    return tissue.isin(1, 2, 3) if fast else tissue.isin(1, 2)


def dense(hu: Column) -> Column:
    return (hu > DENSITY[0]) & (hu < DENSITY[1])


def shell(cells: DataFrame, shape: dict[str, int], dilation: int = 1, erosion: int = 3, box: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """Packed planes (``keys``, z, skin) of the body's shell: the dilated body without the eroded one, where density allows, dilated by a box of ``box`` cells a side."""
    body = F.coalesce(F.col("bod"), F.lit(0))
    planes = packed.pack(cells, {"body": body == 1, "whole": body != 0, "dense": dense(F.col("hu"))}, shape, keys)
    planes = packed.erode_ball(packed.dilate_ball(planes, "body", "body", dilation, shape, keys), "whole", "whole", erosion, shape, keys)
    planes = planes.select(*keys, "z", packed.both(packed.without(F.col("body"), F.col("whole")), F.col("dense")).alias("skin"))
    return packed.dilate_box(planes, "skin", "skin", -(box // 2), box - box // 2 - 1, shape, keys)


def skin(cells: DataFrame, shape: dict[str, int], dilation: int = 1, erosion: int = 3, box: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, x, y, z of the cells of ``shell``. ``keys`` name a volume."""
    return packed.unpack(shell(cells, shape, dilation, erosion, box, keys), "skin", shape, keys)


def assemble(cells: DataFrame, shape: dict[str, int], fast: bool = False, box: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, x, y, z and label; writes of skin, fat and classes in reverse order as one CASE, and background 9 for what is left. The skin is joined line by line, as bits."""
    shells = packed.lines(shell(cells, shape, box=box, keys=keys), "skin", shape, keys)
    found = remap(cells).join(shells, [*keys, "z", "y"], "left")
    skin = F.coalesce(packed.has("skin", F.col("x")), F.lit(False))
    value = F.when(skin, 12).when(is_fat(F.col("tis"), fast), 3).when(F.col("label") != 0, F.col("label")).otherwise(9)
    return found.select(*keys, *shape, value.cast("int").alias("label"))
