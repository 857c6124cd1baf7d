"""Rendering of labelled volumes: every ``step``-th plane z becomes an ultrasound picture and warped label masks, for any number of volumes (``keys``) at once.

A ray is a column x and depth runs along y. ``resize`` and ``crop`` bring planes to one size first: nearest to a square of ``resize``, then its middle ``crop`` x ``crop``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acoustics, components, geometry, rays

PICTURE = {"r": 256, "c": 256}
BACKGROUND = 9


@dataclass(frozen=True)
class Frame:
    """How planes are brought to one size: ``resize`` and ``crop``, or neither."""

    resize: int | None = None
    crop: int | None = None

    def planes(self, cells: DataFrame, shape: dict[str, int], step: int, keys: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
        """keys, z, r, c, label of every ``step``-th plane, and the planes' shape."""
        out = cells.where(F.col("z") % step == 0).select(*keys, "z", F.col("x").alias("r"), F.col("y").alias("c"), "label")
        size = {"r": shape["x"], "c": shape["y"]}
        if self.resize:
            out, size = geometry.resize_nearest(out, size, self.resize), {"r": self.resize, "c": self.resize}
            if self.crop:
                out, size = geometry.crop_center(out, self.resize, self.crop), {"r": self.crop, "c": self.crop}
        return out, size


#: The sizes of the original renderer.
STANDARD = Frame(380, 256)


def pictures(cells: DataFrame, shape: dict[str, int], step: int = 1, seed: int = 0, keys: tuple[str, ...] = (), frame: Frame = STANDARD) -> DataFrame:
    """keys, z, r, c, intensity in [0, 1]: a 256 x 256 picture of every ``step``-th plane."""
    planes, size = frame.planes(cells, shape, step, keys)
    names = (*keys, "z")
    lit = acoustics.lit(acoustics.clamp_maps(acoustics.lookup(planes)), size, seed, names)
    return rays.pictures(rays.planes(lit, "intensity", size, names), size, PICTURE["r"], names).withColumnRenamed("v", "intensity")


def warped_labels(cells: DataFrame, shape: dict[str, int], step: int = 1, keys: tuple[str, ...] = (), frame: Frame = STANDARD, label_interp: str = "nearest") -> DataFrame:
    """keys, z, r, c, label of the picture's pixels; 0 outside the sector. ``bilinear`` blends codes as the pictures' values, so only whole results are labels and borders are 0."""
    planes, size = frame.planes(cells, shape, step, keys)
    names = (*keys, "z")
    values = planes.select(*names, "r", "c", F.col("label").cast("double").alias("v"))
    if label_interp == "bilinear":
        out = geometry.sector_picture(values, size, names, PICTURE["r"])
        return out.select(*names, "r", "c", F.when(F.abs(F.col("v") - F.round("v")) < 1e-9, F.round("v")).otherwise(0).cast("int").alias("label"))
    warped = geometry.polar_warp(values, size["r"], size["c"], "nearest", names).select(*names, F.col("i").alias("r"), F.col("j").alias("c"), "v")
    turned = geometry.rotate_warped(warped, 360, names)
    return geometry.resize_nearest(turned, {"r": 220, "c": 360}, PICTURE["r"]).select(*names, "r", "c", F.col("v").cast("int").alias("label"))


def masks(warped: DataFrame, keys: tuple[str, ...] = (), clean: bool = True) -> DataFrame:
    """keys, z, label, r, c: the pixels of each label but background; ``clean`` closes, widens and fills each mask by itself."""
    found = warped.where(~F.col("label").isin(0, BACKGROUND)).select(*keys, "z", "label", "r", "c")
    if not clean:
        return found
    names = (*keys, "z", "label")
    one = found.select(F.struct(*names).alias("_mask"), "r", "c")
    return components.cleaned(one, PICTURE, "_mask").select("_mask.*", "r", "c")
