"""Connected components and hole filling on runs: a mask is the table of its maximal runs of cells along the last axis, so a full line is one row, and the background of a line is what lies between its runs.

Runs are cut into tiles along all axes (``block`` cells a side). A task joins the touching runs of a tile by a union-find; runs that touch across a tile's faces are joined as intervals of neighbouring lines, and a distributed
union-find over these links gives each tile's components their least cell. So no task holds a volume, a plane or a line of it, and only faces are linked across tasks.

A run has ``keys`` (columns that name a volume), the other axes of ``shape``, first and last (its cells along the last axis). A component is named by the least linear index of its cells.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop, materialize, ship
from . import graphs

Shape = dict[str, int]
BLOCK = 64


def _axes(shape: Shape) -> tuple[list[str], str]:
    *others, along = shape
    return others, along


def from_cells(cells: DataFrame, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """The maximal runs of a mask's cells. Cells of a line differ from their rank by the same number as long as they follow each other."""
    others, along = _axes(shape)
    line = [*keys, *others]
    order = Window.partitionBy(*line).orderBy(along)
    ranked = cells.select(*line, along).distinct().withColumn("_run", F.col(along) - F.row_number().over(order))
    return ranked.groupBy(*line, "_run").agg(F.min(along).cast("int").alias("first"), F.max(along).cast("int").alias("last")).drop("_run")


def to_cells(runs: DataFrame, shape: Shape, keys: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
    others, along = _axes(shape)
    found = runs.withColumn(along, F.explode(F.sequence("first", "last")))
    return found.select(*keys, *[F.col(a).cast("int").alias(a) for a in shape], *carried)


def complement(runs: DataFrame, shape: Shape, volumes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The runs of the background of ``volumes`` (distinct ``keys``; one row without columns if there are none): what lies before, between and after a line's runs, and the whole of a line that has none."""
    others, along = _axes(shape)
    line, n = [*keys, *others], shape[along]
    # two marks on every line stand just outside of it, so each gap lies between two rows
    lines = volumes
    for a in others:
        lines = lines.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(shape[a] - 1))))
    marks = lines.withColumn("_m", F.explode(F.array(F.lit(-1), F.lit(n)))).select(*line, F.col("_m").alias("first"), F.col("_m").alias("last"))
    order = Window.partitionBy(*line).orderBy("first")
    gaps = runs.select(*line, "first", "last").unionByName(marks).withColumn("_next", F.lead("first").over(order))
    return gaps.select(*line, (F.col("last") + 1).cast("int").alias("first"), (F.col("_next") - 1).cast("int").alias("last")).where("first <= last")


def _index(shape: Shape, place: dict[str, Column]) -> Column:
    out = F.lit(0).cast("long")
    for a, n in shape.items():
        out = out * n + place[a]
    return out


def _local(shape: Shape, names: list[str], kinds: dict[str, str]):
    """Names the runs of a tile by the least index of the tile's component."""
    others, _ = _axes(shape)

    def run(table: pa.Table) -> pa.Table:
        lines = np.stack([table.column(a).to_numpy().astype(np.int64) for a in others], 1) if others else np.zeros((table.num_rows, 0), np.int64)
        first, last, own = (table.column(c).to_numpy().astype(np.int64) for c in ("first", "last", "_own"))
        low, span = lines.min(0) - 1, lines.max(0) - lines.min(0) + 3  # a free line on each side, so a step never meets the end of a row of lines
        wide = int(last.max()) + 2
        stride = np.append(np.cumprod(span[::-1])[::-1][1:], 1)[: len(others)]
        key = ((lines - low) * stride).sum(1) if len(others) else np.zeros(len(first), np.int64)
        order = np.argsort(key * wide + first, kind="stable")
        key, first, last = key[order], first[order], last[order]
        begins, ends = key * wide + first, key * wide + last
        pairs = []
        for step in stride.tolist():
            # of a neighbouring line, the runs that overlap [first, last] are one after the other
            a = np.searchsorted(ends, (key + step) * wide + first)
            b = np.searchsorted(begins, (key + step) * wide + last, "right")
            many = np.maximum(b - a, 0)
            pairs.append((np.repeat(np.arange(len(key)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)))
        one, two = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        root = np.arange(len(key))
        while True:  # hooking to the least root, then pointer jumping
            low_root = np.minimum(root[one], root[two])
            before = root.copy()
            np.minimum.at(root, root[one], low_root)
            np.minimum.at(root, root[two], low_root)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        own = own[order]
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, root, own)
        table = table.take(pa.array(order))
        return pa.table([*(table.column(c) for c in names), pa.array(least[root])], names=[*names, "comp"])

    return run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", comp long"


def one_tile(shape: Shape, block: int) -> bool:
    return all(n <= block for n in shape.values())


def label(runs: DataFrame, shape: Shape, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Runs, cut at tiles, with ``comp``: the least linear index of their component (neighbours share a face). A stored table, unless a volume is a tile by itself."""
    others, along = _axes(shape)
    spark = runs.sparkSession
    ship(spark)
    tile = [F.floor(F.col(a) / block).cast("int").alias(f"_t_{a}") for a in others]
    parts = F.sequence(F.floor(F.col("first") / block).cast("int"), F.floor(F.col("last") / block).cast("int"))
    cut = runs.select(*keys, *others, "first", "last", *tile, F.explode(parts).alias("_t")).withColumn("first", F.greatest("first", F.col("_t") * block)).withColumn("last", F.least("last", F.col("_t") * block + block - 1))
    place = {a: F.col(a) for a in others} | {along: F.col("first")}
    cut = cut.withColumn("_own", _index(shape, place))
    names = [*keys, *others, "first", "last", "_own"]
    f, schema = _local(shape, names, dict(cut.dtypes))
    local = cut.groupBy(*keys, *[f"_t_{a}" for a in others], "_t").applyInArrow(f, schema)
    if one_tile(shape, block):
        return local.drop("_own")
    local = materialize(local)
    node = lambda c: F.struct(*keys, F.col(c).alias("comp")) if keys else F.struct(F.col(c).alias("comp"))
    links = []
    for a in others:
        lower = local.where(F.col(a) % block == block - 1).withColumn(a, F.col(a) + 1).select(*keys, *others, F.col("first").alias("_f"), F.col("last").alias("_l"), F.col("comp").alias("_c"))
        upper = local.where(F.col(a) % block == 0)
        met = upper.join(lower, [*keys, *others]).where("_f <= last AND first <= _l")
        links.append(met.select(node("_c").alias("a"), node("comp").alias("b")))
    before = local.where(F.col("last") % block == block - 1).select(*keys, *others, (F.col("last") + 1).alias("first"), F.col("comp").alias("_c"))
    links.append(local.join(before, [*keys, *others, "first"]).select(node("_c").alias("a"), node("comp").alias("b")))
    touching = materialize(reduce(DataFrame.unionByName, links).distinct())
    if touching.isEmpty():
        drop(touching)
        return local.drop("_own")
    found = graphs.components(touching)
    roots = materialize(found.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.comp").alias("comp"), F.col("root.comp").alias("_root")))
    out = materialize(local.drop("_own").join(roots, [*keys, "comp"], "left").withColumn("comp", F.coalesce("_root", "comp")).drop("_root"))
    drop(local, touching, roots)
    return out


def sizes(labelled: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, comp and the number n of its cells; no cell is written."""
    return labelled.groupBy(*keys, "comp").agg(F.sum(F.col("last") - F.col("first") + 1).cast("long").alias("n"))


def blob_filter(labelled: DataFrame, low: int, high: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs of the components with low < size <= high."""
    keep = sizes(labelled, keys).where((F.col("n") > low) & (F.col("n") <= high)).select(*keys, "comp")
    return labelled.join(keep, [*keys, "comp"], "left_semi")


def fill_holes(runs: DataFrame, shape: Shape, keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``runs`` and those of the background's components that do not touch the border, of all volumes that ``runs`` names."""
    others, along = _axes(shape)
    own = [*keys, *others, "first", "last"]
    runs = runs.select(*own) if one_tile(shape, block) else materialize(runs.select(*own))
    volumes = runs.select(*keys).distinct() if keys else runs.limit(1).select()
    back = label(complement(runs, shape, volumes, keys), shape, keys, block)
    edge = (F.col("first") == 0) | (F.col("last") == shape[along] - 1)
    for a in others:
        edge = edge | F.col(a).isin(0, shape[a] - 1)
    if one_tile(shape, block):  # a component is part of one group of ``label``
        open_ = F.max(edge).over(Window.partitionBy(*keys, "comp"))
        return runs.unionByName(back.withColumn("_open", open_).where(~F.col("_open")).select(*own))
    outside = back.where(edge).select(*keys, "comp").distinct()
    return runs.unionByName(back.join(outside, [*keys, "comp"], "left_anti").select(*own))
