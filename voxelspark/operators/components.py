"""Connected components of foreground cells, by union-find per volume, plane or slab in Arrow groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship
from . import graphs, packed, runs

#: Cells along a side of the tiles in which ``fill_holes`` looks for components.
PICTURE = 256


def label(mask: DataFrame, shape: dict[str, int], key: str) -> DataFrame:
    """``mask`` with ``comp``: the least linear index of the cell's component (4- or 6-neighbours) within its ``key``. A group is one volume or plane."""
    axes, sizes = [*shape], [*shape.values()]

    def run(table):
        table = table.select([key, *axes])
        cells = np.stack([table.column(a).to_numpy().astype(np.int64) for a in axes], 1)
        stride = np.append(np.cumprod(sizes[::-1])[::-1][1:], 1)
        index = np.unique(cells @ stride)
        root = np.arange(len(index))
        pairs = []
        for axis, step in enumerate(stride):
            inner = (index // step) % sizes[axis] < sizes[axis] - 1
            at = np.searchsorted(index, index + step)
            hit = inner & (at < len(index))
            hit[hit] = index[at[hit]] == index[hit] + step
            pairs.append((np.flatnonzero(hit), at[hit]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:  # hooking to the least root, then pointer jumping
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        found = index[root[np.searchsorted(index, cells @ stride)]]
        return pa.table([*(table.column(c) for c in (key, *axes)), pa.array(found, pa.int64())], names=[key, *axes, "comp"])

    ship(mask.sparkSession)
    kind = dict(mask.dtypes)
    return mask.select(key, *axes).groupBy(key).applyInArrow(run, ", ".join(f"{c} {kind[c]}" for c in (key, *axes)) + ", comp long")


def label_slabs(mask: DataFrame, shape: dict[str, int], key: str, slab: int) -> DataFrame:
    """``label``, with a group for each ``slab`` cells along the first axis, so a task's size does not grow with a volume.

    Components of neighbouring slabs that touch are linked, and a distributed union-find over these links gives the least index of each.
    """
    first, *others = shape
    cells = mask.select(key, *shape).withColumn("_slab", F.concat_ws("/", F.col(key).cast("string"), F.floor(F.col(first) / slab).cast("string")))
    local = label(cells.select("_slab", *shape), shape, "_slab")
    local = materialize(local.join(cells.select("_slab", key).distinct(), "_slab").select(key, *shape, "comp"))
    upper = local.where(F.col(first) % slab == slab - 1).select(key, (F.col(first) + 1).alias(first), *others, F.col("comp").alias("above"))
    lower = local.where(F.col(first) % slab == 0)
    touching = lower.join(upper, [key, *shape]).select(F.struct(key, "comp").alias("a"), F.struct(key, F.col("above").alias("comp")).alias("b")).distinct()
    roots = materialize(graphs.components(touching).select(F.col(f"node.{key}").alias(key), F.col("node.comp").alias("comp"), F.col("root.comp").alias("_root")))
    return local.join(roots, [key, "comp"], "left").select(key, *shape, F.coalesce("_root", "comp").alias("comp"))


def sizes(labelled: DataFrame, key: str) -> DataFrame:
    return labelled.groupBy(key, "comp").agg(F.count("*").alias("n"))


def blob_filter(labelled: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Cells of the components with low < size <= high."""
    keep = sizes(labelled, key).where((F.col("n") > low) & (F.col("n") <= high)).select(key, "comp")
    return labelled.join(keep, [key, "comp"], "left_semi").select(*labelled.columns)


def fill_holes(mask: DataFrame, shape: dict[str, int], key: str) -> DataFrame:
    """``mask`` with the background components that do not touch the border; the background is taken as runs between those of the mask, in tiles of a picture's size."""
    return runs.to_cells(runs.fill_holes(runs.from_cells(mask, shape, (key,)), shape, (key,), PICTURE), shape, (key,))


def cleaned(mask: DataFrame, shape: dict[str, int], key: str) -> DataFrame:
    """``mask`` (``key``, r, c), closed by the L1 ball of radius 3, widened by that of radius 2 and filled, each plane by itself. Planes are bits and then runs until the result, so a cell is not a row for each offset."""
    # a mask is a volume of one plane: x is c, y is r
    flat = {"x": shape["c"], "y": shape["r"], "z": 1}
    planes = packed.pack(mask.select(key, F.col("c").alias("x"), F.col("r").alias("y"), F.lit(0).alias("z")), {"m": F.lit(True)}, flat, (key,))
    planes = packed.erode_flat(packed.dilate_flat(planes, "m", "m", 3, flat), "m", "m", 3, flat)
    wide = materialize(packed.runs(packed.dilate_flat(planes, "m", "m", 2, flat), "m", flat, (key,)).select(key, F.col("y").alias("r"), "first", "last"))
    return runs.to_cells(runs.fill_holes(wide, shape, (key,), PICTURE), shape, (key,))
