"""Binary morphology on sparse masks: a mask is the table of its foreground cells, an element the list of its offsets.

Offsets are exploded from a literal, so each operator is one shuffle on the cells. n rounds of the cross equal one pass with the L1 ball of radius n, which is what callers pass.
Cells outside ``shape`` count as background (``border='zero'``) or are ignored (``border='ignore'``).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Offsets = list[tuple[int, ...]]


def ball(n: int, dims: int = 3) -> Offsets:
    """The L1 ball; n = 0 is the identity."""
    return [o for o in itertools.product(range(-n, n + 1), repeat=dims) if sum(map(abs, o)) <= n]


def box(low: int, high: int, dims: int = 3) -> Offsets:
    return list(itertools.product(range(low, high + 1), repeat=dims))


def disc(r: int) -> Offsets:
    return [o for o in itertools.product(range(-r, r + 1), repeat=2) if o[0] ** 2 + o[1] ** 2 <= r * r]


def _spread(mask: DataFrame, axes: list[str], offsets: Offsets) -> DataFrame:
    moves = F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(axes, o, strict=True)]) for o in offsets])
    keys = [c for c in mask.columns if c not in axes]
    return mask.withColumn("_o", F.explode(moves)).select(*keys, *[(F.col(a) + F.col(f"_o.{a}")).cast("int").alias(a) for a in axes])


def _inside(cells: DataFrame, shape: dict[str, int]) -> DataFrame:
    for a, n in shape.items():
        cells = cells.where((F.col(a) >= 0) & (F.col(a) < n))
    return cells


def dilate(mask: DataFrame, offsets: Offsets, shape: dict[str, int]) -> DataFrame:
    return _inside(_spread(mask, [*shape], offsets), shape).distinct()


def grid(mask: DataFrame, shape: dict[str, int]) -> DataFrame:
    """All cells of ``shape``; every cell for each key of ``mask`` if it has other columns."""
    keys = [c for c in mask.columns if c not in shape]
    out = mask.select(*keys).distinct() if keys else mask.sparkSession.range(1).select()
    for a, n in shape.items():
        out = out.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out


def complement(mask: DataFrame, shape: dict[str, int]) -> DataFrame:
    return grid(mask, shape).join(mask, mask.columns, "left_anti")


def erode(mask: DataFrame, offsets: Offsets, shape: dict[str, int], border: str = "zero") -> DataFrame:
    if border == "ignore":
        return complement(dilate(complement(mask, shape), [tuple(-d for d in o) for o in offsets], shape), shape)
    back = [tuple(-d for d in o) for o in offsets]
    cells = _inside(_spread(mask.distinct(), [*shape], back), shape)
    return cells.groupBy(*mask.columns).count().where(F.col("count") == len(offsets)).drop("count")


def closing(mask: DataFrame, offsets: Offsets, shape: dict[str, int], border: str = "zero") -> DataFrame:
    return erode(dilate(mask, offsets, shape), offsets, shape, border)


def opening(mask: DataFrame, offsets: Offsets, shape: dict[str, int], border: str = "zero") -> DataFrame:
    return dilate(erode(mask, offsets, shape, border), offsets, shape)


def convolve(raster: DataFrame, weights: dict[tuple[int, int], float], shape: dict[str, int], value: str = "v") -> DataFrame:
    """Correlation of 2-D rasters (two axes, ``value`` and columns that name the raster) with a table of weights; outside is 0."""
    a, b = shape
    keys = [c for c in raster.columns if c not in (a, b, value)]
    taps = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in weights.items()])
    spread = raster.withColumn("_t", F.explode(taps)).select(*keys, (F.col(a) + F.col("_t.i")).alias(a), (F.col(b) + F.col("_t.j")).alias(b), (F.col(value) * F.col("_t.w")).alias("_p"))
    return _inside(spread, shape).groupBy(*keys, a, b).agg(F.sum("_p").alias(value))


def convolve_separable(raster: DataFrame, weights: list[dict[int, float]], shape: dict[str, int], values: tuple[str, ...] = ("v",), carried: tuple[str, ...] = ()) -> DataFrame:
    """``convolve`` by a product of weights along the two axes, for several values at once: 2 n rows a cell in place of n * n.

    With ``carried``, the other columns named there stay with their cells and places without a cell are left out, which spares joining them back.
    """
    keys = [c for c in raster.columns if c not in (*shape, *values, *carried, "_own")]
    raster = raster.withColumn("_own", F.lit(1)) if carried else raster
    kept = [*carried, "_own"] if carried else []
    for axis, line in zip(shape, weights, strict=True):
        taps = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(float(w)).alias("w")) for i, w in line.items()])
        others = [c for c in shape if c != axis]
        stays = [F.when(F.col("_t.i") == 0, F.col(c)).alias(c) for c in kept]
        spread = raster.withColumn("_t", F.explode(taps)).select(*keys, *others, (F.col(axis) + F.col("_t.i")).alias(axis), *[(F.col(v) * F.col("_t.w")).alias(v) for v in values], *stays)
        raster = _inside(spread, {axis: shape[axis]}).groupBy(*keys, *shape).agg(*[F.sum(v).alias(v) for v in values], *[F.max(c).alias(c) for c in kept])
    return raster.where("_own = 1").drop("_own") if carried else raster
