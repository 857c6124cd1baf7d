"""Queries of the voxel operators over the driver's tables, each beside its DuckDB equivalent."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sql as sql_surface
from .functions.constants import BLOB_SIZE, CLASS_TO_LABEL, PALETTE, TISSUES
from .operators import acoustics, components, geometry, labels, packed, rays, runs, sampling, stencil
from .plans import exports, registry, rendering
from .session import shared_dir
from .sources import catalog, demo, nifti, nifti_source, pictures
from .sources.fixtures import PLANE, SHAPE, raster, table, volume
from .streaming import landing, volumes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def planes_query(name: str, sql: str):
    """A query of rasters (plane, r, c, v), over all planes."""
    return lambda f: query(name, sql)(lambda s, d: f(raster(s, d))) and f


# ---------------------------------------------------------------- oracle pieces

VOL_OF = """vol AS (
  SELECT {key}CAST(l_partkey % 32 AS INT) AS x, CAST(l_orderkey % 32 AS INT) AS y, CAST(l_suppkey % 16 AS INT) AS z,
         CAST(sum(l_linenumber + l_partkey) % 118 AS INT) AS tot, CAST(sum(l_linenumber) % 4 AS INT) AS tis,
         CAST(CASE WHEN power(l_partkey % 32 - 16, 2) + power(l_orderkey % 32 - 16, 2) <= 144 AND l_suppkey % 16 BETWEEN 2 AND 13 THEN 1 ELSE 0 END AS INT) AS bod,
         CAST(sum(CAST(l_quantity AS INT) * 20) % 1000 - 500 AS INT) AS hu
  FROM lineitem GROUP BY {group}l_partkey % 32, l_orderkey % 32, l_suppkey % 16)"""
VOL = VOL_OF.format(key="", group="")
#: As many volumes as the orders fill, each of the same shape.
VOLUMES = VOL_OF.format(key="CAST(l_orderkey // 4096 AS INT) AS volume_id, ", group="l_orderkey // 4096, ")
RUNS = "lmap(cls, label) AS (VALUES " + ", ".join(map(str, CLASS_TO_LABEL)) + ")"
RAS = "ras AS MATERIALIZED (SELECT CAST(vec_id // 64 AS INT) AS plane, CAST(vec_id % 64 AS INT) AS r, CAST(i - 1 AS INT) AS c, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) g(i))"
WHOLE = "whole AS MATERIALIZED (SELECT plane, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT DISTINCT plane FROM ras), range(64) a(r), range(64) b(c))"
TIS = "tissue(label, name, imp, alpha, mu0, mu1, sigma0) AS (VALUES " + ", ".join(f"({a}, '{b}', {', '.join(f'CAST({x!r} AS DOUBLE)' for x in rest)})" for a, b, *rest in TISSUES) + ")"


def near(name: str, source: str, element: list[tuple], key: str = "") -> str:
    """A dilation of the 3-D mask ``source``; ``key``: a column that names a volume, with a comma."""
    return f"{name}_o(i, j, k) AS (VALUES {', '.join(map(str, element))}), {name} AS (SELECT DISTINCT {key}CAST(x + i AS INT) AS x, CAST(y + j AS INT) AS y, CAST(z + k AS INT) AS z FROM {source}, {name}_o WHERE x + i BETWEEN 0 AND 31 AND y + j BETWEEN 0 AND 31 AND z + k BETWEEN 0 AND 15)"


def all_near(name: str, source: str, element: list[tuple], key: str = "") -> str:
    """An erosion with background outside: cells all of whose neighbours are foreground."""
    return f"{name}_o(i, j, k) AS (VALUES {', '.join(map(str, element))}), {name} AS (SELECT {key}CAST(x - i AS INT) AS x, CAST(y - j AS INT) AS y, CAST(z - k AS INT) AS z FROM {source}, {name}_o WHERE x - i BETWEEN 0 AND 31 AND y - j BETWEEN 0 AND 31 AND z - k BETWEEN 0 AND 15 GROUP BY ALL HAVING count(*) = {len(element)})"


GRID = "grid AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM range(32) a(x), range(32) b(y), range(16) c(z))"
MASK = "m AS (SELECT x, y, z FROM vol WHERE bod = 1)"
BALL1, BALL3, BOX2, CUBE = stencil.ball(1), stencil.ball(3), stencil.box(-1, 0), stencil.box(-1, 1)


def skin_sql(vol: str = VOL, key: str = "") -> str:
    inside = f"{key}x, y, z"
    return ", ".join([vol, f"m AS (SELECT {inside} FROM vol WHERE bod = 1)", near("big", "m", BALL1, key), f"m0 AS (SELECT {inside} FROM vol WHERE bod <> 0)", all_near("inner_", "m0", BALL3, key), f"shell AS (SELECT {inside} FROM (FROM big EXCEPT FROM inner_) JOIN vol USING ({inside}) WHERE hu > -200 AND hu < 250)", near("skin", "shell", BOX2, key)])


def assembled_sql(skin: str, key: str = "") -> str:
    named = "".join(f"vol.{k}, " for k in key.replace(" ", "").split(",") if k)
    return f"WITH {skin}, {RUNS}, lab AS (SELECT {named}vol.x, vol.y, vol.z, CAST(CASE WHEN skin.x IS NOT NULL THEN 12 WHEN tis IN (1, 2) THEN 3 WHEN coalesce(lmap.label, 0) <> 0 THEN lmap.label ELSE 9 END AS INT) AS label, hu FROM vol LEFT JOIN lmap ON tot = cls LEFT JOIN skin USING ({key}x, y, z))"


SKIN = skin_sql()
ASSEMBLED = assembled_sql(SKIN)
KEY = ("volume_id",)
MANY = assembled_sql(skin_sql(VOLUMES, "volume_id, "), "volume_id, ")


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.assemble(volume(spark, sf_dir), SHAPE)


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).where("bod = 1").select("x", "y", "z")


# ---------------------------------------------------------------- labels

query("label_remap", f"WITH {VOL}, {RUNS} SELECT x, y, z, coalesce(label, 0) AS label FROM vol LEFT JOIN lmap ON tot = cls")(lambda s, d: labels.remap(volume(s, d)).select("x", "y", "z", "label"))
query("label_map_invert", f"WITH {VOL}, {RUNS} SELECT label, CAST(list(cls ORDER BY cls) AS VARCHAR) AS classes FROM (SELECT DISTINCT tot AS cls, coalesce(label, 0) AS label FROM vol LEFT JOIN lmap ON tot = cls) GROUP BY label")(
    lambda s, d: labels.invert_map(labels.remap(volume(s, d)).select(F.col("tot").alias("cls"), "label").distinct()).select("label", F.concat(F.lit("["), F.array_join("classes", ", "), F.lit("]")).alias("classes"))
)
query("tissue_overlay", f"WITH {VOL}, {RUNS} SELECT x, y, z, CAST(CASE WHEN tis IN (1, 2) THEN 3 ELSE coalesce(label, 0) END AS INT) AS label FROM vol LEFT JOIN lmap ON tot = cls")(
    lambda s, d: labels.remap(volume(s, d)).select("x", "y", "z", F.when(labels.is_fat(F.col("tis")), 3).otherwise(F.col("label")).alias("label"))
)
query("tissue_overlay_fast", f"WITH {VOL}, {RUNS} SELECT x, y, z, CAST(CASE WHEN tis IN (1, 2, 3) THEN 3 ELSE coalesce(label, 0) END AS INT) AS label FROM vol LEFT JOIN lmap ON tot = cls")(
    lambda s, d: labels.remap(volume(s, d)).select("x", "y", "z", F.when(labels.is_fat(F.col("tis"), fast=True), 3).otherwise(F.col("label")).alias("label"))
)
query("body_skin", f"WITH {SKIN} SELECT x, y, z FROM skin")(lambda s, d: labels.skin(volume(s, d), SHAPE))
query("body_skin_volumes", f"WITH {skin_sql(VOLUMES, 'volume_id, ')} SELECT volume_id, x, y, z FROM skin")(lambda s, d: labels.skin(volume(s, d, KEY), SHAPE, keys=KEY))
query("label_assembly", f"{ASSEMBLED} SELECT x, y, z, label FROM lab")(assembled)
query("label_assembly_volumes", f"{MANY} SELECT volume_id, x, y, z, label FROM lab")(lambda s, d: labels.assemble(volume(s, d, KEY), SHAPE, keys=KEY))
query("label_counts_volumes", f"{MANY} SELECT volume_id, label, count(*) AS n FROM lab GROUP BY ALL")(lambda s, d: registry.run(volume(s, d, KEY), SHAPE, registry.Config(keys=KEY))["counts"])
query("stratified_sample_volumes", f"{MANY} SELECT volume_id, x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, label ORDER BY md5('11:' || x || ':' || y || ':' || z), x, y, z) AS n FROM lab) WHERE label <> 9 AND n <= 40")(
    lambda s, d: sampling.stratified(labels.assemble(volume(s, d, KEY), SHAPE, keys=KEY), dict.fromkeys(sampling.DEFAULT_QUOTA, 40), 11, KEY)
)
query("label_counts", f"{ASSEMBLED} SELECT label, count(*) AS n FROM lab GROUP BY label")(lambda s, d: assembled(s, d).groupBy("label").agg(F.count("*").alias("n")))
query("distinct_labels", f"{ASSEMBLED} SELECT DISTINCT label FROM lab")(lambda s, d: assembled(s, d).select("label").distinct())
query("quota_cap", f"{ASSEMBLED} SELECT label, least(count(*), 400) AS n FROM lab GROUP BY label")(lambda s, d: assembled(s, d).groupBy("label").agg(F.least(F.count("*"), F.lit(400)).alias("n")))
query("density_mask", f"WITH {VOL} SELECT x, y, z FROM vol WHERE hu > -200 AND hu < 250")(lambda s, d: volume(s, d).where(labels.dense(F.col("hu"))).select("x", "y", "z"))
query("prelabeled_bypass", f"WITH {VOL} SELECT x, y, z, CAST(tot % 14 AS INT) AS label FROM vol")(lambda s, d: volume(s, d).select("x", "y", "z", (F.col("tot") % 14).alias("label")))
query("tissue_masks", f"{ASSEMBLED}, {TIS} SELECT x, y, z, label, name AS tissue FROM lab JOIN tissue USING (label) WHERE label <> 9")(
    lambda s, d: assembled(s, d).join(F.broadcast(acoustics.tissue_table(s).select("label", "tissue")), "label").where("label <> 9").select("x", "y", "z", "label", "tissue")
)
query("cast_wrap", f"WITH {VOL} SELECT x, y, z, CAST((hu % 256 + 256) % 256 AS INT) AS v FROM vol")(lambda s, d: volume(s, d).select("x", "y", "z", F.pmod("hu", F.lit(256)).alias("v")))
query("slice_stride", f"WITH {VOL} SELECT * FROM vol WHERE z % 3 = 0")(lambda s, d: volume(s, d).where("z % 3 = 0"))
PALETTE_SQL = "pal(label, red, green, blue, alpha) AS (VALUES " + ", ".join(map(str, PALETTE)) + ")"
query("palette", f"{ASSEMBLED}, {PALETTE_SQL} SELECT x, y, z, label, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(alpha, 255) AS alpha FROM lab LEFT JOIN pal USING (label)")(lambda s, d: sampling.with_colors(assembled(s, d)))
query("preview_slices", f"{ASSEMBLED}, {PALETTE_SQL} SELECT z AS plane, y AS row, CAST(31 - x AS INT) AS col, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue FROM lab LEFT JOIN pal USING (label) WHERE z % 4 = 0")(
    lambda s, d: sampling.with_colors(assembled(s, d).where("z % 4 = 0")).select(F.col("z").alias("plane"), F.col("y").alias("row"), (31 - F.col("x")).alias("col"), "red", "green", "blue")
)

# ---------------------------------------------------------------- morphology

def masks(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The packed planes of the body."""
    return packed.pack(volume(spark, sf_dir, keys), {"body": F.col("bod") == 1}, SHAPE, keys)


def packed_query(name: str, sql: str, *steps):
    """A query of one volume, whose SQL has ``m`` for the mask and ends in ``o``, and ``<name>_volumes`` over the volumes of all orders. A step is (function, arguments)."""

    def run(spark: SparkSession, sf_dir: str, keys: tuple[str, ...] = ()) -> DataFrame:
        planes = masks(spark, sf_dir, keys)
        for f, *arguments in steps:
            planes = f(planes, "body", "body", *arguments[:-1], SHAPE, keys, arguments[-1]) if isinstance(arguments[-1], str) else f(planes, "body", "body", *arguments, SHAPE, keys)
        return packed.unpack(planes, "body", SHAPE, keys)

    query(name, f"WITH {VOL}, {MASK}, {GRID}, {sql('')} FROM o")(run)
    whole = f"vols AS (SELECT DISTINCT volume_id FROM vol), {GRID.replace('AS (SELECT ', 'AS (SELECT volume_id, ').replace('FROM range(32) a(x)', 'FROM vols, range(32) a(x)')}"
    query(f"{name}_volumes", f"WITH {VOLUMES}, {MASK.replace('SELECT ', 'SELECT volume_id, ')}, {whole}, {sql('volume_id, ')} FROM o")(lambda s, d: run(s, d, KEY))


def pool_erode(name: str, source: str, key: str) -> str:
    return f"{name}_n AS (FROM grid EXCEPT SELECT {key}x, y, z FROM {source}), {near(name + '_d', name + '_n', CUBE, key)}, {name} AS (FROM grid EXCEPT FROM {name}_d)"


GROW, SHRINK, GROW_BOX, SHRINK_BOX = packed.dilate_ball, packed.erode_ball, packed.dilate_box, packed.erode_box
packed_query("dilate", lambda k: near("o", "m", stencil.ball(2), k), (GROW, 2))
packed_query("erode", lambda k: all_near("o", "m", BALL3, k), (SHRINK, 3))
packed_query("closing", lambda k: f"{near('g', 'm', BALL3, k)}, {all_near('o', 'g', BALL3, k)}", (GROW, 3), (SHRINK, 3))
packed_query("dilate_box", lambda k: near("o", "m", BOX2, k), (GROW_BOX, -1, 0))
packed_query("pool_dilate", lambda k: near("o", "m", CUBE, k), (GROW_BOX, -1, 1))
packed_query("pool_erode", lambda k: pool_erode("o", "m", k), (SHRINK_BOX, -1, 1, "ignore"))
packed_query("pool_closing", lambda k: f"{near('g', 'm', CUBE, k)}, {pool_erode('o', 'g', k)}", (GROW_BOX, -1, 1), (SHRINK_BOX, -1, 1, "ignore"))
packed_query("pool_opening", lambda k: f"{pool_erode('g', 'm', k)}, {near('o', 'g', CUBE, k)}", (SHRINK_BOX, -1, 1, "ignore"), (GROW_BOX, -1, 1))


def plane_near(name: str, source: str, element: list[tuple]) -> str:
    return f"{name}_o(i, j) AS (VALUES {', '.join(map(str, element))}), {name} AS (SELECT DISTINCT plane, CAST(r + i AS INT) AS r, CAST(c + j AS INT) AS c FROM {source}, {name}_o WHERE r + i BETWEEN 0 AND 63 AND c + j BETWEEN 0 AND 63)"


def plane_all_near(name: str, source: str, element: list[tuple]) -> str:
    return f"{name}_o(i, j) AS (VALUES {', '.join(map(str, element))}), {name} AS (SELECT plane, CAST(r - i AS INT) AS r, CAST(c - j AS INT) AS c FROM {source}, {name}_o WHERE r - i BETWEEN 0 AND 63 AND c - j BETWEEN 0 AND 63 GROUP BY ALL HAVING count(*) = {len(element)})"


def plane_mask(ras: DataFrame, over: float = 0.06) -> DataFrame:
    return ras.where(F.col("v") > over).select("plane", "r", "c")


DISC = stencil.disc(2)
PM = f"WITH RECURSIVE {RAS}, m AS (SELECT plane, r, c FROM ras WHERE v > CAST(0.06 AS DOUBLE))"
planes_query("disc_dilate", f"{PM}, {plane_near('o', 'm', DISC)} FROM o")(lambda ras: stencil.dilate(plane_mask(ras), DISC, PLANE))
planes_query("disc_erode", f"{PM}, {plane_all_near('o', 'm', stencil.disc(1))} FROM o")(lambda ras: stencil.erode(plane_mask(ras), stencil.disc(1), PLANE))
planes_query("disc_closing", f"{PM}, {plane_near('g', 'm', DISC)}, {plane_all_near('o', 'g', DISC)} FROM o")(lambda ras: stencil.closing(plane_mask(ras), DISC, PLANE))
KERNEL = acoustics.gaussian_kernel()
KSQL = "k(i, j, w) AS (VALUES " + ", ".join(f"({i}, {j}, CAST({w!r} AS DOUBLE))" for (i, j), w in KERNEL.items()) + ")"
planes_query(
    "gauss_kernel",
    f"WITH {RAS}, g AS (SELECT i, j, exp(-0.5 * power(i / CAST(0.5 AS DOUBLE), 2)) * exp(-0.5 * power(j / CAST(1.5 AS DOUBLE), 2)) AS w FROM range(-3, 4) a(i), range(-3, 4) b(j)), n AS (SELECT i, j, w / sum(w) OVER () AS w FROM g) SELECT plane, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(w * m, 9) AS w FROM n, (SELECT plane, avg(v) AS m FROM ras GROUP BY plane)",
)(  # what each tap takes of a plane's mean
    lambda ras: ras.groupBy("plane").agg(F.avg("v").alias("m")).withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in KERNEL.items()]))).select("plane", "k.i", "k.j", F.round(F.col("k.w") * F.col("m"), 9).alias("w"))
)
planes_query("gauss_conv", f"WITH {RAS}, {KSQL} SELECT plane, CAST(r - i AS INT) AS r, CAST(c - j AS INT) AS c, round(sum(v * w), 6) AS v FROM ras, k WHERE r - i BETWEEN 0 AND 63 AND c - j BETWEEN 0 AND 63 GROUP BY ALL")(
    lambda ras: stencil.convolve(ras, KERNEL, PLANE).select("plane", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.round("v", 6).alias("v"))
)

# ---------------------------------------------------------------- components


def labelled(ras: DataFrame) -> DataFrame:
    return components.label(plane_mask(ras), PLANE, "plane")


def counted(ras: DataFrame) -> DataFrame:
    """A plane without foreground has 0 components."""
    found = labelled(ras).groupBy("plane").agg(F.countDistinct("comp").alias("n"))
    return ras.select("plane").distinct().join(found, "plane", "left").select("plane", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def closure(mask: str) -> str:
    return f"step(i, j) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)), walk AS (SELECT plane, r, c, r * 64 + c AS comp FROM {mask} UNION SELECT n.plane, n.r, n.c, comp FROM (SELECT plane, r + i AS r, c + j AS c, comp FROM walk, step) w JOIN {mask} n USING (plane, r, c)), comps AS (SELECT plane, r, c, CAST(min(comp) AS BIGINT) AS comp FROM walk GROUP BY plane, r, c)"


planes_query("components", f"{PM}, {closure('m')} SELECT plane, r, c, comp FROM comps")(lambda ras: labelled(ras).select("plane", "r", "c", "comp"))
planes_query("component_sizes", f"{PM}, {closure('m')} SELECT plane, comp, count(*) AS n FROM comps GROUP BY plane, comp")(lambda ras: components.sizes(labelled(ras), "plane").select("plane", "comp", "n"))
planes_query("component_count", f"{PM}, {closure('m')} SELECT plane, count(DISTINCT comp) AS n FROM (SELECT DISTINCT plane FROM ras) LEFT JOIN comps USING (plane) GROUP BY plane")(counted)
planes_query("blob_filter", f"{PM}, {closure('m')} SELECT plane, r, c, comp FROM (SELECT *, count(*) OVER (PARTITION BY plane, comp) AS n FROM comps) WHERE n > 10 AND n <= 30")(lambda ras: components.blob_filter(labelled(ras), "plane", *BLOB_SIZE).select("plane", "r", "c", "comp"))
OUTSIDE = "step(i, j) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)), outside AS (SELECT plane, r, c FROM b WHERE r IN (0, 63) OR c IN (0, 63) UNION SELECT n.plane, n.r, n.c FROM (SELECT plane, r + i AS r, c + j AS c FROM outside, step) w JOIN b n USING (plane, r, c))"
planes_query("fill_holes", f"WITH RECURSIVE {RAS}, {WHOLE}, m AS (SELECT plane, r, c FROM ras WHERE v > 0), b AS MATERIALIZED (FROM whole EXCEPT FROM m), {OUTSIDE} FROM whole EXCEPT FROM outside")(
    lambda ras: components.fill_holes(plane_mask(ras, 0.0), PLANE, "plane").select("plane", "r", "c")
)


def cleaned(ras: DataFrame) -> DataFrame:
    return components.cleaned(plane_mask(ras), PLANE, "plane")


planes_query("mask_cleanup", f"{PM}, {WHOLE}, {plane_near('g', 'm', stencil.ball(3, 2))}, {plane_all_near('q', 'g', stencil.ball(3, 2))}, {plane_near('o', 'q', stencil.ball(2, 2))}, b AS MATERIALIZED (FROM whole EXCEPT FROM o), {OUTSIDE} FROM whole EXCEPT FROM outside")(cleaned)

# the same in 3-D, over the volumes of all orders; tiles of 8 cells a side, so that volumes of this size are cut along all axes
TILE = 8
STEP_3D = "step(i, j, k) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
WALK_3D = f"WITH RECURSIVE {VOLUMES}, {STEP_3D}, m AS (SELECT volume_id, x, y, z FROM vol WHERE bod = 1), walk AS (SELECT volume_id, x, y, z, (x * 32 + y) * 16 + z AS comp FROM m UNION SELECT n.volume_id, n.x, n.y, n.z, comp FROM (SELECT volume_id, x + i AS x, y + j AS y, z + k AS z, comp FROM walk, step) w JOIN m n USING (volume_id, x, y, z)), comps AS (SELECT volume_id, x, y, z, CAST(min(comp) AS BIGINT) AS comp FROM walk GROUP BY volume_id, x, y, z)"


def labelled_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body_runs = runs.from_cells(volume(spark, sf_dir, KEY).where("bod = 1"), SHAPE, KEY)
    return runs.label(body_runs, SHAPE, KEY, TILE)


query("components_volumes", f"{WALK_3D} SELECT volume_id, x, y, z, comp FROM comps")(lambda s, d: runs.to_cells(labelled_volumes(s, d), SHAPE, KEY, ("comp",)))
query("component_sizes_volumes", f"{WALK_3D} SELECT volume_id, comp, count(*) AS n FROM comps GROUP BY volume_id, comp")(lambda s, d: runs.sizes(labelled_volumes(s, d), KEY))
query("blob_filter_volumes", f"{WALK_3D} SELECT volume_id, x, y, z, comp FROM (SELECT *, count(*) OVER (PARTITION BY volume_id, comp) AS n FROM comps) WHERE n > 2 AND n <= 30")(
    lambda s, d: runs.to_cells(runs.blob_filter(labelled_volumes(s, d), 2, 30, KEY), SHAPE, KEY, ("comp",))
)
query(
    "fill_holes_volumes",
    f"WITH RECURSIVE {VOLUMES}, {STEP_3D}, vols AS (SELECT DISTINCT volume_id FROM vol), {near('m', 'vol', BALL1, 'volume_id, ')}, grid AS (SELECT volume_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM vols, range(32) a(x), range(32) b(y), range(16) c(z)), b AS MATERIALIZED (FROM grid EXCEPT FROM m), outside AS (SELECT * FROM b WHERE x IN (0, 31) OR y IN (0, 31) OR z IN (0, 15) UNION SELECT n.volume_id, n.x, n.y, n.z FROM (SELECT volume_id, x + i AS x, y + j AS y, z + k AS z FROM outside, step) w JOIN b n USING (volume_id, x, y, z)) FROM grid EXCEPT FROM outside",
)(lambda s, d: runs.to_cells(runs.fill_holes(runs.from_cells(packed.unpack(packed.dilate_ball(packed.pack(volume(s, d, KEY), {"m": F.lit(True)}, SHAPE, KEY), "m", "m", 1, SHAPE, KEY), "m", SHAPE, KEY), SHAPE, KEY), SHAPE, KEY, TILE), SHAPE, KEY))


def reached(n: int) -> str:
    """Background that n steps from the border reach, round by round."""
    outer = ["o0 AS MATERIALIZED (SELECT * FROM b WHERE x IN (0, 31) OR y IN (0, 31) OR z IN (0, 15))"]
    outer += [f"o{k} AS MATERIALIZED (FROM o{k - 1} UNION SELECT n.volume_id, n.x, n.y, n.z FROM (SELECT volume_id, x + i AS x, y + j AS y, z + k AS z FROM o{k - 1}, step) w JOIN b n USING (volume_id, x, y, z))" for k in range(1, n + 1)]
    return ", ".join(outer)


query("bounded_fill_volumes", f"WITH {VOLUMES}, {STEP_3D}, vols AS (SELECT DISTINCT volume_id FROM vol), {near('m', 'vol', BALL1, 'volume_id, ')}, grid AS (SELECT volume_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM vols, range(32) a(x), range(32) b(y), range(16) c(z)), b AS MATERIALIZED (FROM grid EXCEPT FROM m), {reached(1)} FROM grid EXCEPT FROM o1")(
    lambda s, d: packed.unpack(packed.bounded_fill(packed.dilate_ball(packed.pack(volume(s, d, KEY), {"m": F.lit(True)}, SHAPE, KEY), "m", "m", 1, SHAPE, KEY), "m", "m", 1, SHAPE, KEY), "m", SHAPE, KEY)
)

# ---------------------------------------------------------------- acoustics

LABELLED_RASTER = f"{RAS}, {RUNS}, {TIS}, lr AS (SELECT plane, r, c, CAST(CASE WHEN label = 0 THEN 9 ELSE label END AS INT) AS label FROM ras JOIN lmap ON cls = ((plane * 64 + r) * 64 + c) % 118)"
MAPS = f"{LABELLED_RASTER}, maps AS (SELECT plane, r, c, label, imp, alpha, mu0, mu1, sigma0 FROM lr JOIN tissue USING (label))"
FACES = f"{MAPS}, f1 AS (SELECT *, coalesce(imp - lead(imp) OVER w, 0) AS d, imp + coalesce(lag(imp) OVER w, 0) AS s FROM maps WINDOW w AS (PARTITION BY plane, r ORDER BY c)), faces AS (SELECT *, 1 - exp(-d * d / CAST(0.1 AS DOUBLE)) AS boundary, 1 / (1 + exp(-power(d / CASE WHEN s = 0 THEN 1 ELSE s END, 2))) AS refl FROM f1)"
DEEP = f"{FACES}, d1 AS (SELECT *, product(exp(-alpha * (4.0::DOUBLE / 63))) OVER w AS att, product(1 - refl * boundary) OVER w AS trans FROM faces WINDOW w AS (PARTITION BY plane, r ORDER BY c ROWS UNBOUNDED PRECEDING)), deep AS (SELECT *, att * (1 + 7.0::DOUBLE * c / 63) AS att_tgc FROM d1)"


def slice_labels(ras: DataFrame) -> DataFrame:
    vector = F.col("plane").cast("long") * 64 + F.col("r")
    cells = ras.select("plane", "r", "c", ((vector * 64 + F.col("c")) % 118).cast("int").alias("tot"))
    return labels.remap(cells).select("plane", "r", "c", F.when(F.col("label") == 0, 9).otherwise(F.col("label")).cast("int").alias("label"))


def maps(ras: DataFrame) -> DataFrame:
    return acoustics.lookup(slice_labels(ras))


def faces(ras: DataFrame) -> DataFrame:
    return acoustics.interfaces(maps(ras), ("plane",))


def deep(ras: DataFrame) -> DataFrame:
    return acoustics.depth_maps(acoustics.clamp_maps(maps(ras)), 64, ("plane",))


def _rounded(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


planes_query("acoustic_maps", f"WITH {MAPS} FROM maps")(maps)
planes_query("clamp_maps", f"WITH {MAPS} SELECT plane, r, c, greatest(0, least(10, imp * 3 - 2)) AS imp, greatest(0, least(1, mu0 * 3 - 1)) AS mu0 FROM maps")(
    lambda ras: acoustics.clamp_maps(maps(ras).withColumn("imp", F.col("imp") * 3 - 2).withColumn("mu0", F.col("mu0") * 3 - 1)).select("plane", "r", "c", "imp", "mu0")
)
planes_query("impedance_diff", f"WITH {FACES} SELECT plane, r, c, round(d, 6) AS d FROM faces")(lambda ras: faces(ras).select("plane", "r", "c", *_rounded("d")))
planes_query("boundary_map", f"WITH {FACES} SELECT plane, r, c, round(boundary, 6) AS boundary FROM faces")(lambda ras: faces(ras).select("plane", "r", "c", *_rounded("boundary")))
planes_query("reflection_map", f"WITH {FACES} SELECT plane, r, c, round(refl, 6) AS refl FROM faces")(lambda ras: faces(ras).select("plane", "r", "c", *_rounded("refl")))
planes_query("attenuation", f"WITH {DEEP} SELECT plane, r, c, round(att, 6) AS att FROM deep")(lambda ras: deep(ras).select("plane", "r", "c", *_rounded("att")))
planes_query("attenuation_tgc", f"WITH {DEEP} SELECT plane, r, c, round(att_tgc, 6) AS att_tgc FROM deep")(lambda ras: deep(ras).select("plane", "r", "c", *_rounded("att_tgc")))
planes_query("transmission", f"WITH {DEEP} SELECT plane, r, c, round(trans, 6) AS trans, round(ln(trans + CAST(1.1920929e-7 AS DOUBLE)), 3) AS log_trans FROM deep")(
    lambda ras: deep(ras).select("plane", "r", "c", *_rounded("trans"), F.round(F.log(F.col("trans") + F.lit(1.1920929e-7)), 3).alias("log_trans"))
)
UNIFORM = lambda seed, at: f"((CAST(('0x' || substr(md5('{seed}:' || plane || ':' || r || ':' || c), {at}, 12)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({2**48} AS DOUBLE))"
NOISE = lambda seed: f"(sqrt(-2 * ln({UNIFORM(seed, 1)})) * cos(2 * pi() * {UNIFORM(seed, 13)}))"
SCAT = f"{DEEP}, scat AS MATERIALIZED (SELECT *, 1 / (1 + exp(-10 * (mu1 - {NOISE(5)}))) * ({NOISE(6)} * sigma0 + mu0) AS scat FROM deep)"
planes_query("scatter_det", f"WITH {SCAT} SELECT plane, r, c, round(scat, 6) AS scat FROM scat")(lambda ras: acoustics.scatter(maps(ras), 5, ("plane",)).select("plane", "r", "c", *_rounded("scat")))
BLUR = lambda n: f"{n}_g AS MATERIALIZED (SELECT plane, r - i AS r, c - j AS c, sum({n} * w) AS {n}_g FROM scat, k WHERE r - i BETWEEN 0 AND 63 AND c - j BETWEEN 0 AND 63 GROUP BY ALL)"
US = f"{SCAT}, {KSQL}, {BLUR('scat')}, {BLUR('boundary')}, us AS MATERIALIZED (SELECT plane, CAST(r AS INT) AS r, CAST(c AS INT) AS c, greatest(0, least(1, att_tgc * scat_g + att_tgc * trans * refl * boundary_g)) AS v FROM scat JOIN scat_g USING (plane, r, c) JOIN boundary_g USING (plane, r, c))"


def us_slice(ras: DataFrame) -> DataFrame:
    return acoustics.intensity(acoustics.clamp_maps(maps(ras)), PLANE, 5, ("plane",))


def us_picture(ras: DataFrame) -> DataFrame:
    found = rays.planes(acoustics.lit(acoustics.clamp_maps(maps(ras)), PLANE, 5, ("plane",)), "intensity", PLANE, ("plane",))
    return rays.pictures(found, PLANE, 256, ("plane",)).select("plane", "r", "c", F.round("v", 4).alias("v"))


planes_query("us_intensity", f"WITH {US} SELECT plane, r, c, round(v, 4) AS intensity FROM us")(lambda ras: us_slice(ras).select("plane", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.round("intensity", 4).alias("intensity")))

# ---------------------------------------------------------------- geometry


def warp_sql(source: str, w: int = 64, h: int = 64, keys: str = "plane") -> str:
    """``warped`` (``keys``, i, j, v): the sector pictures of the planes in ``source``, by integer places of taps."""
    return f"""pix AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, atan2(CAST(i - 180 AS DOUBLE), CAST(j + 120 AS DOUBLE)) AS angle, sqrt(CAST((i - 180) * (i - 180) + (j + 120) * (j + 120) AS DOUBLE)) AS radius FROM range(360) a(i), range(220) b(j)),
    uv AS (SELECT i, j, (angle + pi() / 6) / (pi() / 3) * {w} AS u, (radius - 140) / CAST(200 AS DOUBLE) * {h} AS v FROM pix WHERE abs(angle) < pi() / 6 AND radius > 140 AND radius < 340),
    taps AS MATERIALIZED (SELECT i, j, CAST(floor(u) AS INT) + CAST(a AS INT) AS r, CAST(floor(v) AS INT) + CAST(b AS INT) AS c, (CASE a WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE b WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM uv, range(2) p(a), range(2) q(b)),
    hit AS MATERIALIZED (SELECT {keys}, t.i, t.j, sum(s.v * t.w) AS v FROM taps t JOIN {source} s ON s.r = t.r AND s.c = t.c GROUP BY ALL), warped AS MATERIALIZED (SELECT {keys}, i, j, coalesce(hit.v, 0) AS v FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN pix LEFT JOIN hit USING ({keys}, i, j))"""


def picture_sql(keys: str = "plane") -> str:
    """``picture`` (``keys``, r, c, v): ``warped`` turned and resized to 256 x 256, bilinearly at half-pixel centres, row and column weights apart."""
    axis = lambda name, n: f"""{name} AS MATERIALIZED (SELECT CAST(o AS INT) AS o, CAST(least(floor(greatest((o + 0.5::DOUBLE) * ({n}::DOUBLE / 256) - 0.5::DOUBLE, 0)) + t, {n - 1}) AS INT) AS p,
      CASE t WHEN 1 THEN greatest((o + 0.5::DOUBLE) * ({n}::DOUBLE / 256) - 0.5::DOUBLE, 0) - floor(greatest((o + 0.5::DOUBLE) * ({n}::DOUBLE / 256) - 0.5::DOUBLE, 0)) ELSE 1 - (greatest((o + 0.5::DOUBLE) * ({n}::DOUBLE / 256) - 0.5::DOUBLE, 0) - floor(greatest((o + 0.5::DOUBLE) * ({n}::DOUBLE / 256) - 0.5::DOUBLE, 0))) END AS w FROM range(256) g(o), range(2) h(t))"""  # noqa: E731
    return f"""turned AS (SELECT {keys}, j AS r, CAST(359 - i AS INT) AS c, v FROM warped), {axis('rows_', 220)}, {axis('cols_', 360)},
    tall AS MATERIALIZED (SELECT {keys}, o AS r, c, sum(v * w) AS v FROM turned JOIN rows_ ON r = p GROUP BY ALL),
    picture AS (SELECT {keys}, r, o AS c, sum(v * w) AS v FROM tall JOIN cols_ ON c = p GROUP BY ALL)"""


planes_query("polar_warp", f"WITH {RAS}, {warp_sql('ras')} SELECT plane, i, j, round(v, 6) AS v FROM warped")(lambda ras: geometry.polar_warp(ras, 64, 64, keys=("plane",)).select("plane", "i", "j", *_rounded("v")))
planes_query("us_render", f"WITH {US}, {warp_sql('us')}, {picture_sql()} SELECT plane, r, c, round(v, 4) AS v FROM picture")(us_picture)
planes_query("warp_rotate", f"WITH {RAS} SELECT plane, c AS r, CAST(63 - r AS INT) AS c, v FROM ras")(lambda ras: geometry.rotate_warped(ras, 64, ("plane",)))
planes_query("resize_nearest", f"WITH {RAS} SELECT plane, CAST(i AS INT) AS r, CAST(j AS INT) AS c, v FROM range(380) a(i), range(380) b(j), ras WHERE ras.r = i * 64 // 380 AND ras.c = j * 64 // 380")(lambda ras: geometry.resize_nearest(ras, PLANE, 380))


def resized_sql(antialias: bool, size: int = 40) -> str:
    """64 x 64 planes resized; the plain form takes the two nearest places, the other a triangle as wide as the scale."""
    scale, wide = f"({64 / size!r}::DOUBLE)", f"({max(1.0, 64 / size) if antialias else 1.0!r}::DOUBLE)"
    at = f"(o + 0.5::DOUBLE) * {scale}" if antialias else f"greatest((o + 0.5::DOUBLE) * {scale} - 0.5::DOUBLE, 0) + 0.5::DOUBLE"
    taps = f"raw AS (SELECT CAST(o AS INT) AS o, CAST(p AS INT) AS p, greatest(0, 1 - abs(p + 0.5::DOUBLE - ({at})) / {wide}) AS w FROM range({size}) g(o), range(64) h(p)), taps AS MATERIALIZED (SELECT o, p, w / sum(w) OVER (PARTITION BY o) AS w FROM raw WHERE w > 0)"
    return f"WITH {RAS}, {taps}, tall AS MATERIALIZED (SELECT plane, o AS r, c, sum(v * w) AS v FROM ras JOIN taps ON r = p GROUP BY ALL) SELECT plane, r, o AS c, round(sum(v * w), 6) AS v FROM tall JOIN taps ON c = p GROUP BY ALL"


for _name, _soft in (("resize_bilinear", False), ("resize_antialiased", True)):
    planes_query(_name, resized_sql(_soft))(lambda ras, soft=_soft: geometry.resize_bilinear(ras, PLANE, 40, ("plane",), soft).select("plane", "r", "c", F.round("v", 6).alias("v")))
planes_query("center_crop", f"WITH {RAS} SELECT plane, CAST(i - 62 AS INT) AS r, CAST(j - 62 AS INT) AS c, v FROM range(62, 318) a(i), range(62, 318) b(j), ras WHERE ras.r = i * 64 // 380 AND ras.c = j * 64 // 380")(lambda ras: geometry.crop_center(geometry.resize_nearest(ras, PLANE, 380), 380, 256))
# a volume's planes as rasters: ray x, depth y
STEP = 4
VOLUME_RASTER = f"{ASSEMBLED[5:]}, {TIS}, lr AS (SELECT z AS plane, x AS r, y AS c, label FROM lab WHERE z % {STEP} = 0)"
VOLUME_US = US.replace(LABELLED_RASTER, VOLUME_RASTER).replace("0 AND 63", "0 AND 31").replace("/ 63)", "/ 31)")
query("us_render_volume", f"WITH {VOLUME_US}, {warp_sql('us', 32, 32)}, {picture_sql()} SELECT plane AS z, r, c, round(v, 4) AS intensity FROM picture")(
    lambda s, d: registry.run(volume(s, d), SHAPE, registry.Config(rendering="ultrasound_plain", step=STEP, seed=5))["maps"].select("z", "r", "c", F.round("intensity", 4).alias("intensity"))
)


# the original's sizes: planes brought to 380 x 380, of which the middle 256 x 256 is rendered
STANDARD_RASTER = f"{ASSEMBLED[5:]}, {TIS}, lr AS (SELECT z AS plane, CAST(i - 62 AS INT) AS r, CAST(j - 62 AS INT) AS c, label FROM range(62, 318) a(i), range(62, 318) b(j), lab WHERE z % {STEP} = 0 AND x = i * 32 // 380 AND y = j * 32 // 380)"
STANDARD_US = US.replace(LABELLED_RASTER, STANDARD_RASTER).replace("0 AND 63", "0 AND 255").replace("/ 63)", "/ 255)")
query("us_render_standard", f"WITH {STANDARD_US}, {warp_sql('us', 256, 256)}, {picture_sql()} SELECT plane AS z, r, c, round(v, 4) AS intensity FROM picture")(
    lambda s, d: registry.run(volume(s, d), SHAPE, registry.Config(rendering="ultrasound", step=STEP, seed=5))["maps"].select("z", "r", "c", F.round("intensity", 4).alias("intensity"))
)


def us_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume's pictures as PNG files, read back."""
    cells = registry.run(volume(spark, sf_dir), SHAPE, registry.Config(rendering="ultrasound_plain", step=STEP, seed=5))["maps"]
    return pictures.decoded(pictures.slice_pictures(cells.withColumn("intensity", F.round("intensity", 4)), rendering.PICTURE), "png")


query("us_pictures", f"WITH {VOLUME_US}, {warp_sql('us', 32, 32)}, {picture_sql()} SELECT 'slice__' || plane || '.png' AS name, r, c, CAST(round_even(round(v, 4) * 255, 0) AS INT) AS v FROM picture")(us_pictures)
WARPED = f"{VOLUME_RASTER}, {warp_sql('lr', 32, 32).replace('s.v', 's.label')}, near AS MATERIALIZED (SELECT plane, j AS y, CAST(359 - i AS INT) AS x, label FROM uv JOIN lr ON r = CAST(round(u) AS INT) AND c = CAST(round(v) AS INT)), target AS MATERIALIZED (SELECT plane, CAST(a AS INT) AS r, CAST(b AS INT) AS c, CAST(a * 220 // 256 AS INT) AS y, CAST(b * 360 // 256 AS INT) AS x FROM (SELECT DISTINCT plane FROM lr), range(256) p(a), range(256) q(b))"
query("warped_labels", f"WITH {WARPED} SELECT plane AS z, r, c, coalesce(label, 0) AS label FROM target LEFT JOIN near USING (plane, x, y)")(
    lambda s, d: rendering.warped_labels(assembled(s, d), SHAPE, STEP, frame=rendering.Frame())
)


def mask_near(name: str, source: str, element: list[tuple], every: bool = False) -> str:
    """A dilation of the masks (z, label) of pictures, or the erosion."""
    sign, rest = ("-", f"GROUP BY ALL HAVING count(*) = {len(element)}") if every else ("+", "")
    return f"{name}_o(i, j) AS (VALUES {', '.join(map(str, element))}), {name} AS MATERIALIZED (SELECT {'' if every else 'DISTINCT '}z, label, CAST(r {sign} i AS INT) AS r, CAST(c {sign} j AS INT) AS c FROM {source}, {name}_o WHERE r {sign} i BETWEEN 0 AND 255 AND c {sign} j BETWEEN 0 AND 255 {rest})"


FLAT3, FLAT2 = stencil.ball(3, 2), stencil.ball(2, 2)
query(
    "warped_masks",
    f"WITH RECURSIVE {WARPED}, found AS MATERIALIZED (SELECT plane AS z, label, r, c FROM target JOIN near USING (plane, x, y) WHERE label NOT IN (0, 9)), {mask_near('grown', 'found', FLAT3)}, {mask_near('closed', 'grown', FLAT3, True)}, {mask_near('wide', 'closed', FLAT2)}, back AS MATERIALIZED (SELECT z, label, CAST(r AS INT) AS r, CAST(c AS INT) AS c FROM (SELECT DISTINCT z, label FROM wide), range(256) a(r), range(256) b(c) EXCEPT FROM wide), step(i, j) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)), outer_ AS (SELECT z, label, r, c FROM back WHERE r IN (0, 255) OR c IN (0, 255) UNION SELECT n.z, n.label, n.r, n.c FROM (SELECT z, label, r + i AS r, c + j AS c FROM outer_, step) w JOIN back n USING (z, label, r, c)) FROM wide UNION ALL (FROM back EXCEPT FROM outer_)",
)(lambda s, d: rendering.masks(rendering.warped_labels(assembled(s, d), SHAPE, STEP, frame=rendering.Frame())))
query("intermediates", f"WITH {VOL} SELECT unnest(['tot', 'tis', 'bod']) AS task, x, y, z, unnest([tot, tis, bod]) AS cls FROM vol")(lambda s, d: exports.intermediates(volume(s, d)))
query("label_assembly_predictor", f"{ASSEMBLED.replace(near('skin', 'shell', BOX2), near('skin', 'shell', CUBE))} SELECT x, y, z, label FROM lab")(lambda s, d: registry.run(volume(s, d), SHAPE, registry.Config(segmentation="predictor"))["labels"])
SAMPLE = f"{ASSEMBLED}, q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('11:' || x || ':' || y || ':' || z), x, y, z) AS n FROM lab), pts AS (SELECT x, y, z, label FROM q WHERE label <> 9 AND n <= 300)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(assembled(spark, sf_dir), dict.fromkeys(sampling.DEFAULT_QUOTA, 300), 11)


query("stratified_sample", f"{SAMPLE} FROM pts")(points)
query("pcd_normalize", f"{SAMPLE} SELECT label, x / CAST(32 AS DOUBLE) - 0.5 AS x, y / CAST(32 AS DOUBLE) - 0.5 AS y, z / CAST(16 AS DOUBLE) - 0.5 AS z FROM pts")(lambda s, d: geometry.normalize_points(points(s, d), SHAPE))
query("pcd_rotate", f"{SAMPLE} SELECT label, -(z / CAST(16 AS DOUBLE) - 0.5) AS x, -(y / CAST(32 AS DOUBLE) - 0.5) AS y, -(x / CAST(32 AS DOUBLE) - 0.5) AS z FROM pts")(lambda s, d: geometry.rotate_points(geometry.normalize_points(points(s, d), SHAPE)))
VOLS = "vols AS (SELECT DISTINCT CAST(l_orderkey // 4096 AS INT) AS volume_id FROM lineitem)"


def volume_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 4096).cast("int").alias("volume_id")).distinct()


query("axis_plane", f"WITH {VOLS} SELECT volume_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, 5 AS z FROM vols, range(32) a(x), range(32) b(y)")(lambda s, d: sampling.axis_planes(volume_ids(s, d), 5, 32, 32))
AXIS = "axis AS (SELECT i AS draw, CAST(('0x' || substr(md5('3:' || i), 1, 12)) AS BIGINT) % 1024 AS cell FROM range(2000) g(i))"
query("axis_sample", f"WITH {VOLS}, {AXIS} SELECT volume_id, CAST(cell % 32 AS INT) AS x, CAST(cell // 32 AS INT) AS y, 5 AS z FROM vols, axis")(lambda s, d: sampling.axis_draws(volume_ids(s, d), 5, 2000, 3, 32, 32))
query("pcd_with_axis", f"{SAMPLE}, {AXIS} SELECT label, x, y, z FROM pts UNION ALL SELECT -1, CAST(cell % 32 AS INT), CAST(cell // 32 AS INT), 5 FROM axis")(
    lambda s, d: points(s, d).select("label", "x", "y", "z").unionByName(sampling.axis_sample(sampling.axis_plane(s, 5, 32, 32), 2000, 3, 32, 32).select(F.lit(-1).alias("label"), "x", "y", "z"))
)

JITTER = lambda a: f"CAST(('0x' || substr(md5('11:{a}:' || x || ':' || y || ':' || z), 1, 12)) AS BIGINT) / CAST({2**48} AS DOUBLE)"
AXIS_11 = "axis AS (SELECT i AS draw, CAST(('0x' || substr(md5('11:' || i), 1, 12)) AS BIGINT) % 1024 AS cell FROM range(2000) g(i))"
query("placed_cloud", f"{SAMPLE}, {PALETTE_SQL}, {AXIS_11}, every AS (SELECT label, x, y, z FROM pts UNION ALL SELECT -1, CAST(cell % 32 AS INT), CAST(cell // 32 AS INT), 8 FROM axis) SELECT label, round(-((z + {JITTER('z')}) / 16 - 0.5), 9) AS x, round(-((y + {JITTER('y')}) / 32 - 0.5), 9) AS y, round(-((x + {JITTER('x')}) / 32 - 0.5), 9) AS z, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(alpha, 255) AS alpha FROM every LEFT JOIN pal USING (label)")(
    lambda s, d: registry.run(volume(s, d), SHAPE, registry.Config(pointcloud="placed", seed=11, quota=dict.fromkeys(sampling.DEFAULT_QUOTA, 300)))["points"].select("label", *[F.round(c, 9).alias(c) for c in "xyz"], "red", "green", "blue", "alpha")
)

# ---------------------------------------------------------------- files


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))


NAMES = "f AS (SELECT page_id, url AS path FROM pages)"
query("file_catalog", f"WITH {NAMES} FROM f WHERE path NOT LIKE '%\\_processed\\_%' ESCAPE '\\'")(lambda s, d: catalog.unprocessed(files(s, d)))
query("dedup_basename", f"WITH {NAMES} SELECT list_last(string_split(path, '/')) AS name, min(path) AS path FROM f GROUP BY 1")(lambda s, d: catalog.first_of_each_name(files(s, d)))
PATHS = "replace(replace(url, '/en/', '/imgs/'), '.html', '.nii.gz')"
query("path_derivation", f"WITH p AS (SELECT {PATHS} AS path FROM pages) SELECT path, replace(replace(path, '.nii.gz', '_label.nii.gz'), '/imgs/', '/labels/') AS dest_label, replace(replace(path, '.nii.gz', '_us'), '/imgs/', '/us/') AS dest_us FROM p")(
    lambda s, d: catalog.derived_paths(files(s, d).select(F.replace(F.replace("path", F.lit("/en/"), F.lit("/imgs/")), F.lit(".html"), F.lit(".nii.gz")).alias("path")))
)
query("sample_files", f"WITH {NAMES} FROM f ORDER BY md5('2:' || path), path LIMIT 5")(lambda s, d: sampling.first_rows(files(s, d), 5, 2, "path"))
query("batch_collate", f"WITH {NAMES} SELECT batch_id, string_agg(path, ' ' ORDER BY page_id) AS paths FROM (SELECT *, CAST((row_number() OVER (ORDER BY page_id) - 1) // 8 AS BIGINT) AS batch_id FROM f) GROUP BY batch_id")(
    lambda s, d: sampling.batches(files(s, d), "page_id", 8).groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "path"))), lambda x: x["path"]), " ").alias("paths"))
)
query("paired_files", f"WITH {NAMES}, a AS (SELECT *, row_number() OVER (ORDER BY page_id) AS n FROM f), b AS (SELECT page_id AS other_id, path AS other, row_number() OVER (ORDER BY page_id DESC) AS n FROM f WHERE page_id % 3 <> 0) SELECT page_id, path, other_id, other FROM a JOIN b USING (n)")(
    lambda s, d: sampling.paired(files(s, d), files(s, d).where("page_id % 3 <> 0").select(F.col("page_id").alias("other_id"), F.col("path").alias("other"), (-F.col("page_id")).alias("back")), "page_id", "back").drop("back")
)
query("point_lookup", f"WITH {NAMES} FROM f WHERE page_id = 7")(lambda s, d: files(s, d).where("page_id = 7"))
AFFINE = [[i * 3 + j for j in range(3)] for i in range(3)]
query("affine_matrix", "WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings) SELECT vec_id, " + ", ".join(f"round({f'e[{i * 3 + j + 1}] * e[{10 + j}]' if i < 3 and j < 3 else f'e[{13 + i}]' if i < 3 else str(float(j == 3)) + '::DOUBLE'}, 9) AS a{i}{j}" for i, j in itertools.product(range(4), range(4))) + " FROM e")(
    lambda s, d: table(s, d, "embeddings")
    .select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    .select("vec_id", catalog.affine(F.slice("e", 1, 9), F.slice("e", 10, 3), F.slice("e", 13, 3)).alias("a"))
    .select("vec_id", *[F.round(F.col("a")[i][j], 9).alias(f"a{i}{j}") for i, j in itertools.product(range(4), range(4))])
)

# ---------------------------------------------------------------- formats, methods, streams


def nifti_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities written as a file of signed samples and read back; cells that the volume lacks are 0."""
    folder = f"{shared_dir(spark)}/nifti-{uuid.uuid4().hex}"
    nifti.write(volume(spark, sf_dir).withColumn("volume_id", F.lit("one")), SHAPE, folder, "hu", code=4)
    return nifti.voxels(nifti.planes(spark, folder)).select("x", "y", "z", F.col("v").cast("int").alias("hu"))


def nifti_source_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Densities of the volumes of all orders, written and read by the data source."""
    folder = f"{shared_dir(spark)}/nifti-{uuid.uuid4().hex}"
    nifti_source.write(nifti_source.planes_of(volume(spark, sf_dir, KEY), SHAPE, "hu"), folder, SHAPE["z"], 4)
    found = nifti.voxels(spark.read.format("nifti").load(nifti_source.local(folder)))
    return found.select(F.regexp_extract("path", r"(\d+)\.nii\.gz$", 1).cast("int").alias("volume_id"), "x", "y", "z", F.col("v").cast("int").alias("hu"))


def picture_round_trip(ras: DataFrame) -> DataFrame:
    """Pictures are named by their planes."""
    cells = ras.select(F.col("plane").alias("z"), "r", "c", F.pmod(F.col("r") * 31 + F.col("c") * 7, F.lit(256)).alias("g")).withColumn("intensity", F.col("g") / 255)
    return pictures.decoded(pictures.slice_pictures(cells, PLANE), "png")


def cloud_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    colored = sampling.with_colors(points(spark, sf_dir)).withColumn("volume", F.lit("one"))
    return pictures.decoded(pictures.clouds(colored, "volume"), "glb")


query("nifti_round_trip", f"WITH {VOL}, {GRID} SELECT x, y, z, coalesce(hu, 0) AS hu FROM grid LEFT JOIN vol USING (x, y, z)")(nifti_round_trip)
query("nifti_source_volumes", f"WITH {VOLUMES}, whole AS (SELECT volume_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (SELECT DISTINCT volume_id FROM vol), range(32) a(x), range(32) b(y), range(16) c(z)) SELECT volume_id, x, y, z, coalesce(hu, 0) AS hu FROM whole LEFT JOIN vol USING (volume_id, x, y, z)")(nifti_source_volumes)
planes_query("picture_round_trip", f"WITH {RAS}, {WHOLE} SELECT 'slice__' || plane || '.png' AS name, r, c, CAST(CASE WHEN ras.v IS NULL THEN 0 ELSE (r * 31 + c * 7) % 256 END AS INT) AS v FROM whole LEFT JOIN ras USING (plane, r, c)")(picture_round_trip)
query("cloud_round_trip", f"{SAMPLE}, {PALETTE_SQL} SELECT 'one.glb' AS name, x, y, z, coalesce(red, 0) AS red, coalesce(green, 0) AS green, coalesce(blue, 0) AS blue, coalesce(alpha, 255) AS alpha FROM pts LEFT JOIN pal USING (label)")(cloud_round_trip)
DEMO = lambda axis: f"CAST(('0x' || substr(md5('1:{axis}:' || label || ':' || id), 1, 12)) AS BIGINT)"
query("demo_cloud", f"{ASSEMBLED} SELECT label, CAST({DEMO('x')} % 20 + 40 AS INT) AS x, CAST({DEMO('y')} % 20 + 40 AS INT) AS y, CAST({DEMO('z')} % 4 + label * 5 + 18 AS INT) AS z FROM range(200) g(id), (SELECT DISTINCT label FROM lab WHERE label <> 9) t")(
    lambda s, d: demo.blocks(assembled(s, d).where("label <> 9").select("label").distinct(), 200, 1)
)
query("registry_counts", f"{ASSEMBLED} SELECT label, count(*) AS n FROM lab GROUP BY label")(lambda s, d: registry.run(volume(s, d), SHAPE)["counts"])
query("stream_counts", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")(
    lambda s, d: landing.drain(landing.windowed_counts(landing.arrivals(s, f"{d}/events.parquet*", table(s, d, "events").schema), "ts", "event_type", "1 hour", "1 day"))
)


def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken once, counted by hour; only hours that no later event can reach are told."""
    rows = volumes.once(landing.arrivals(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema), "ts", "1 day", "event_id")
    found, _ = volumes.drain(volumes.closed_counts(rows, "ts", "event_type", "1 hour"))
    return found.select(F.col("start").cast(table(spark, sf_dir, "events").schema["ts"].dataType).alias("start"), "event_type", "n")


query("stream_closed_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM events) WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 1 DAY GROUP BY ALL")(closed_windows)

# ---------------------------------------------------------------- SQL text


def sql_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_surface.register(spark)
    cells = volume(spark, sf_dir)
    return spark.sql(
        """SELECT label, count(*) AS n FROM (
             SELECT voxel_label(s.x IS NOT NULL, c.tis, m.label) AS label
             FROM {cells} c LEFT JOIN class_map m ON c.tot = m.cls LEFT JOIN {skin} s ON c.x = s.x AND c.y = s.y AND c.z = s.z)
           GROUP BY label""",
        cells=cells,
        skin=labels.skin(cells, SHAPE),
    )


def sql_acoustic_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_surface.register(spark)
    return spark.sql(
        """SELECT plane, r, c, t.label, clamp(t.imp * 3 - 2, 0, 10) AS imp, alpha, clamp(t.mu0 * 3 - 1, 0, 1) AS mu0, mu1, sigma0
           FROM (SELECT plane, r, c, CASE WHEN coalesce(m.label, 0) = 0 THEN 9 ELSE m.label END AS label
                 FROM {cells} LEFT JOIN class_map m ON CAST(((CAST(plane AS BIGINT) * 64 + r) * 64 + c) % 118 AS INT) = m.cls) l
           JOIN tissues t ON l.label = t.label""",
        cells=raster(spark, sf_dir),
    )


query("sql_label_counts", f"{ASSEMBLED} SELECT label, count(*) AS n FROM lab GROUP BY label")(sql_label_counts)
query("sql_acoustic_maps", f"WITH {MAPS} SELECT plane, r, c, label, greatest(0, least(10, imp * 3 - 2)) AS imp, alpha, greatest(0, least(1, mu0 * 3 - 1)) AS mu0, mu1, sigma0 FROM maps")(sql_acoustic_maps)
