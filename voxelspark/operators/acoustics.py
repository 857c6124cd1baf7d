"""Acoustic maps of label slices (r: ray, c: depth; ``keys``: further columns that name a slice)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import SCATTER_SLOPE, TISSUES
from . import rays


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def tissue_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TISSUES), "label int, tissue string, imp double, alpha double, mu0 double, mu1 double, sigma0 double")


def lookup(cells: DataFrame, strict: tuple[str, ...] | None = None) -> DataFrame:
    """``cells`` (with label) and the acoustic values of their tissue, 0 for unmapped labels; with ``strict`` (a slice's columns) for all of a slice that has one."""
    names = ["imp", "alpha", "mu0", "mu1", "sigma0"]
    out = cells.join(F.broadcast(tissue_table(cells.sparkSession).drop("tissue")), "label", "left")
    if strict is not None:
        bad = F.max(F.col("imp").isNull().cast("int")).over(Window.partitionBy(*strict))
        return out.withColumn("_bad", bad).select(*cells.columns, *[F.when(F.col("_bad") == 1, 0.0).otherwise(F.col(n)).alias(n) for n in names])
    return out.select(*cells.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clamp_maps(maps: DataFrame) -> DataFrame:
    highest = {"imp": 10.0, "alpha": 10.0, "mu0": 1.0, "mu1": 1.0, "sigma0": 1.0}
    return maps.withColumns({name: clamp(F.col(name), 0.0, high) for name, high in highest.items()})


def interfaces(maps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``maps`` with d, boundary and refl of ``rays.interfaces``."""
    return rays.unpack(rays.interfaces(rays.pack(maps, keys)), keys)


def depth_maps(maps: DataFrame, depth: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``maps`` with d, boundary, refl, att, att_tgc and trans, by one shuffle."""
    return rays.unpack(rays.depth_maps(rays.interfaces(rays.pack(maps, keys)), depth), keys)


def gaussian_weights(size: int = 3, std: tuple[float, float] = (0.5, 1.5)) -> list[dict[int, float]]:
    """Weights along both axes by two normal densities, normalised."""
    one = [[math.exp(-0.5 * (i / s) ** 2) for i in range(-size, size + 1)] for s in std]
    return [{i - size: w / sum(x) for i, w in enumerate(x)} for x in one]


def gaussian_kernel(size: int = 3, std: tuple[float, float] = (0.5, 1.5)) -> dict[tuple[int, int], float]:
    """The (2 size + 1)-square outer product of ``gaussian_weights``."""
    a, b = gaussian_weights(size, std)
    return {(i, j): v * w for i, v in a.items() for j, w in b.items()}


def noise(seed: int, *place: Column) -> Column:
    """A repeatable draw from the normal distribution (mean 0, variance 1): two uniforms of 48 bits from an MD5 of seed and place, by the Box-Muller transform."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in place]))
    uniform = lambda at: (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(F.lit(2 * math.pi) * uniform(13))


def scatter(maps: DataFrame, seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``scat``, from two draws for every cell of every slice."""
    place = tuple(F.col(c) for c in (*keys, "r", "c"))
    return maps.withColumn("scat", sigmoid(F.lit(SCATTER_SLOPE) * (F.col("mu1") - noise(seed, *place))) * (noise(seed + 1, *place) * F.col("sigma0") + F.col("mu0")))


def lit(maps: DataFrame, shape: dict[str, int], seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rays with intensity of ``maps`` (imp, alpha, mu0, mu1, sigma0 of each cell): all of the simulation between the tissue's values and the picture, by one shuffle."""
    depth = [*shape.values()][1]
    packed = rays.depth_maps(rays.interfaces(rays.pack(scatter(maps, seed, keys), keys)), depth)
    return rays.intensity(packed, gaussian_weights(), depth, keys)


def intensity(maps: DataFrame, shape: dict[str, int], seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, r, c, intensity in [0, 1] of each slice."""
    return rays.unpack(lit(maps, shape, seed, keys), keys).select(*keys, "r", "c", "intensity")
