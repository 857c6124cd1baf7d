"""Hand-checked cases and properties of the voxel operators, and a few queries against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from voxelspark import queries
from voxelspark.functions.constants import CLASS_TO_LABEL
from voxelspark.operators import components, geometry, sampling, stencil

SF = "/root/testdata/sf0.001"
CUBE = {"x": 5, "y": 5, "z": 5}


def cells(df):
    return {tuple(r) for r in df.collect()}


def test_ball_sizes_and_class_table():
    assert (len(stencil.ball(0)), len(stencil.ball(1)), len(stencil.ball(3))) == (1, 7, 63)
    assert len(CLASS_TO_LABEL) == 118


def test_dilation_and_erosion_of_one_cell(spark):
    one = spark.createDataFrame([(0, 2, 2)], "x int, y int, z int")
    assert cells(stencil.dilate(one, stencil.ball(1), CUBE)) == {(0, 2, 2), (1, 2, 2), (0, 1, 2), (0, 3, 2), (0, 2, 1), (0, 2, 3)}
    assert stencil.erode(one, stencil.ball(1), CUBE).count() == 0
    assert cells(stencil.dilate(one, stencil.box(-1, 0), CUBE)) == {(0, y, z) for y in (1, 2) for z in (1, 2)}


def test_border_rules_differ(spark):
    full = spark.range(125).select((F.col("id") % 5).cast("int").alias("x"), (F.floor(F.col("id") / 5) % 5).cast("int").alias("y"), F.floor(F.col("id") / 25).cast("int").alias("z"))
    assert stencil.erode(full, stencil.ball(1), CUBE).count() == 27
    assert stencil.erode(full, stencil.box(-1, 1), CUBE, "ignore").count() == 125


def test_components_and_holes(spark):
    ring = [(0, r, c) for r in range(1, 4) for c in range(1, 4) if (r, c) != (2, 2)] + [(0, 5, 5), (1, 5, 5)]
    mask = spark.createDataFrame(ring, "plane int, r int, c int")
    shape = {"r": 7, "c": 7}
    found = components.label(mask, shape, "plane")
    assert sorted((r.plane, r.comp, r.n) for r in components.sizes(found, "plane").collect()) == [(0, 8, 8), (0, 40, 1), (1, 40, 1)]
    filled = components.fill_holes(mask, shape, "plane")
    assert cells(filled) == {*ring, (0, 2, 2)}
    assert cells(components.fill_holes(filled, shape, "plane")) == cells(filled)


def test_empty_mask(spark):
    empty = spark.createDataFrame([], "plane int, r int, c int")
    assert components.label(empty, {"r": 4, "c": 4}, "plane").count() == 0
    assert stencil.closing(empty.drop("plane"), stencil.disc(1), {"r": 4, "c": 4}).count() == 0


def test_sample_sizes(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.when(F.col("id") < 10, 2).otherwise(13).alias("label"))
    assert dict(sampling.stratified(df, {2: 50, 13: 20}, 1).groupBy("label").count().collect()) == {2: 10, 13: 20}


def test_resize_takes_floor(spark):
    row = spark.createDataFrame([(0, c, float(c)) for c in range(3)], "r int, c int, v double")
    out = geometry.resize_nearest(row, {"r": 1, "c": 3}, 7)
    assert {(r.r, r.c, r.v) for r in out.collect()} == {(i, j, float(j * 3 // 7)) for i in range(7) for j in range(7)}


@pytest.mark.parametrize("name", ["label_assembly", "erode", "components", "transmission", "stratified_sample", "batch_collate"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SF)
    theirs = con.execute(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)


RASTERS = ["disc_dilate", "disc_closing", "gauss_conv", "component_count", "blob_filter", "fill_holes", "mask_cleanup", "scatter_det", "us_intensity", "polar_warp", "us_render", "center_crop", "picture_round_trip"]


@pytest.mark.parametrize("name", RASTERS)
def test_rasters_match_duckdb(spark, name):
    """Every plane of all vectors."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    ours = queries.QUERIES[name](spark, SF)
    planes = con.execute("SELECT count(DISTINCT vec_id // 64) FROM embeddings").fetchone()[0]
    assert ours.select(ours.columns[0]).distinct().count() == planes == 8
    theirs = sorted(con.execute(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLES[name]})").fetchall())
    got = sorted(map(tuple, ours.collect()))
    assert len(got) == len(theirs) > 0
    for a, b in zip(got, theirs, strict=True):
        assert a == b or all(x == y or isinstance(x, float) and abs(x - y) < 1.1e-3 for x, y in zip(a, b, strict=True))


def test_slabs_give_the_same_components(spark):
    """Random cells and a snake that crosses all slabs, in two volumes."""
    import random

    r = random.Random(1)
    shape = {"z": 13, "r": 8, "c": 7}
    cells = {(k, z, i, j) for k in (1, 2) for z in range(13) for i in range(8) for j in range(7) if r.random() < 0.35 + 0.1 * k}
    cells |= {(1, z, 0, 0) for z in range(13)} | {(1, z, 7, 6) for z in range(13)} | {(1, 12, i, 0) for i in range(8)} | {(1, 12, 7, j) for j in range(7)}
    mask = spark.createDataFrame(sorted(cells), "volume int, z int, r int, c int")
    want = sorted(map(tuple, components.label(mask, shape, "volume").collect()))
    for slab in (1, 4, 20):
        assert sorted(map(tuple, components.label_slabs(mask, shape, "volume", slab).collect())) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}


def test_antialiasing_widens_with_the_scale(spark):
    rows = spark.createDataFrame([(r, c, float(c % 2)) for r in range(8) for c in range(8)], "r int, c int, v double")
    shape = {"r": 8, "c": 8}
    plain, soft = ({(x.r, x.c): round(x.v, 9) for x in geometry.resize_bilinear(rows, shape, 2, antialias=a).collect()} for a in (False, True))
    assert set(plain.values()) == {0.5} and all(abs(v - 0.5) < 0.1 for v in soft.values())
    one = spark.createDataFrame([(r, c, 3.0) for r in range(8) for c in range(8)], "r int, c int, v double")
    for size in (2, 3, 8, 13):
        assert {round(x.v, 9) for x in geometry.resize_bilinear(one, shape, size, antialias=True).collect()} == {3.0}
    up = [{(x.r, x.c): round(x.v, 9) for x in geometry.resize_bilinear(rows, shape, 16, antialias=a).collect()} for a in (False, True)]
    assert up[0] == up[1]  # enlarged, both are the same
