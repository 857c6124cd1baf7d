"""Resampling as projection of coordinates and gather joins; point transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rays


def resize_nearest(raster: DataFrame, shape: dict[str, int], size: int) -> DataFrame:
    """Each source cell yields the target cells that take it: ceil(i * size / n) up to the next one's first."""
    out = raster
    for a, n in shape.items():
        first = F.ceil(F.col(a) * size / F.lit(float(n))).cast("int")
        last = F.ceil((F.col(a) + 1) * size / F.lit(float(n))).cast("int") - 1
        out = out.withColumn(a, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return out


def crop_center(raster: DataFrame, size: int, crop: int, axes: tuple[str, ...] = ("r", "c")) -> DataFrame:
    low = (size - crop) // 2
    for a in axes:
        raster = raster.where((F.col(a) >= low) & (F.col(a) < low + crop)).withColumn(a, (F.col(a) - low).cast("int"))
    return raster


def rotate_warped(raster: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return raster.select(*keys, F.col("c").alias("r"), (F.lit(n - 1) - F.col("r")).cast("int").alias("c"), "v")


def polar_warp(raster: DataFrame, w: int, h: int, label_interp: str = "bilinear", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, i, j, v of the 360 x 220 sector picture of each raster (ray r, depth c, v); pixels outside the sector are 0.

    Bilinear: four taps at pixel indices, outside 0. ``nearest`` takes the rounded place, for labels.
    """
    shape = {"r": w, "c": h}
    found = rays.planes(rays.pack(raster.select(*keys, "r", "c", "v"), keys), "v", shape, keys)
    return rays.sectors(found, shape, keys, label_interp)


def _axis_taps(spark, axis: str, n: int, size: int, antialias: bool) -> DataFrame:
    """o, ``axis`` and w: the weights of the n places for each of ``size`` outputs; at most (2 n / size + 2) * size rows."""
    out = spark.range(size).select(F.col("id").cast("int").alias("o"))
    if antialias:  # a triangle whose foot is as wide as an output's share of the input, or one place if that is less
        wide = max(1.0, n / size)
        center = (F.col("o") + 0.5) * (n / size)
        low, high = F.greatest(F.floor(center - wide), F.lit(0)), F.least(F.ceil(center + wide), F.lit(n)) - 1
        places = F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda p: F.struct(p.alias("p"), F.greatest(F.lit(0.0), 1 - F.abs(p + 0.5 - center) / wide).alias("w")))
        total = F.aggregate("_taps", F.lit(0.0), lambda acc, t: acc + t["w"])
        return out.withColumn("_taps", places).withColumn("_total", total).select("o", "_total", F.explode("_taps").alias("t")).where("t.w > 0").select("o", F.col("t.p").alias(axis), (F.col("t.w") / F.col("_total")).alias("w"))
    place = F.greatest((F.col("o") + 0.5) * (n / size) - 0.5, F.lit(0.0))
    low = F.floor(place)
    taps = F.array(F.struct(low.alias("p"), (1 - (place - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("p"), (place - low).alias("w")))
    return out.select("o", F.explode(taps).alias("t")).select("o", F.col("t.p").cast("int").alias(axis), F.col("t.w").alias("w"))


def resize_bilinear(raster: DataFrame, shape: dict[str, int], size: int, keys: tuple[str, ...] = (), antialias: bool = False) -> DataFrame:
    """``keys``, the two axes of ``shape`` and v, resized to a square, bilinearly at half-pixel centres; rows, then columns. Both axes should be dense, absent cells count as 0. With ``antialias`` the filter's support grows with the scale."""
    for axis, n in shape.items():
        others = [*keys, *(a for a in shape if a != axis)]
        taps = F.broadcast(_axis_taps(raster.sparkSession, axis, n, size, antialias))
        raster = raster.join(taps, axis).groupBy(*others, "o").agg(F.sum(F.col("v") * F.col("w")).alias("v")).withColumnRenamed("o", axis)
    return raster.select(*keys, *shape, "v")


def sector_picture(raster: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = (), size: int = 256) -> DataFrame:
    """The ``size`` x ``size`` pictures of rasters (ray r, depth c, v): warped to the sector, turned and resized."""
    return rays.pictures(rays.planes(rays.pack(raster.select(*keys, "r", "c", "v"), keys), "v", shape, keys), shape, size, keys)


def jittered(points: DataFrame, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points moved by a draw in [0, 1) along each axis, as doubles; the draw depends on seed, axis, keys and place."""
    draw = lambda axis: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(axis), *[F.col(c).cast("string") for c in (*keys, "x", "y", "z")])), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))
    return points.select(*[(F.col(c) + draw(c)).alias(c) if c in ("x", "y", "z") else F.col(c) for c in points.columns])


def normalize_points(points: DataFrame, shape: dict[str, int]) -> DataFrame:
    keep = [c for c in points.columns if c not in shape]
    return points.select(*keep, *[(F.col(a) / F.lit(float(n)) - 0.5).alias(a) for a, n in shape.items()])


def rotate_points(points: DataFrame) -> DataFrame:
    """Half a turn about x after a quarter turn about -y."""
    keep = [c for c in points.columns if c not in ("x", "y", "z")]
    return points.select(*keep, (-F.col("z")).alias("x"), (-F.col("y")).alias("y"), (-F.col("x")).alias("z"))
