"""Bit-packed morphology against the sparse operators, on shapes whose lines are shorter, equal and longer than a word."""

import random

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import packed, runs, stencil


def cells(df):
    return sorted(tuple(r) for r in df.collect())


def made(spark, shape, share, seed=1):
    r = random.Random(seed)
    rows = [(v, x, y, z) for v in (0, 1) for x in range(shape["x"]) for y in range(shape["y"]) for z in range(shape["z"]) if r.random() < share and not (v == 1 and z in (0, 2, 3))]
    return spark.createDataFrame(rows, "vol int, x int, y int, z int")


SHAPES = [{"x": 7, "y": 5, "z": 6}, {"x": 64, "y": 3, "z": 4}, {"x": 130, "y": 3, "z": 5}]


@pytest.mark.parametrize("shape", SHAPES)
def test_round_trip(spark, shape):
    mask = made(spark, shape, 0.3)
    planes = packed.pack(mask, {"m": F.lit(True), "odd": F.col("x") % 2 == 1}, shape, ("vol",))
    assert planes.count() == 2 * shape["z"]
    assert cells(packed.unpack(planes, "m", shape, ("vol",))) == cells(mask)
    assert cells(packed.unpack(planes, "odd", shape, ("vol",))) == cells(mask.where("x % 2 = 1"))


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("n", [1, 3])
def test_balls(spark, shape, n):
    key = ("vol",)
    thin, thick = made(spark, shape, 0.03), made(spark, shape, 0.97)
    grown = packed.dilate_ball(packed.pack(thin, {"m": F.lit(True)}, shape, key), "m", "o", n, shape, key)
    assert cells(packed.unpack(grown, "o", shape, key)) == cells(stencil.dilate(thin, stencil.ball(n), shape))
    for border in ("zero", "ignore"):
        eroded = packed.erode_ball(packed.pack(thick, {"m": F.lit(True)}, shape, key), "m", "m", n, shape, key, border)
        assert cells(packed.unpack(eroded, "m", shape, key)) == cells(stencil.erode(thick, stencil.ball(n), shape, border))


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("low,high", [(-1, 0), (-1, 1), (0, 2)])
def test_boxes(spark, shape, low, high):
    key = ("vol",)
    thin, thick = made(spark, shape, 0.05), made(spark, shape, 0.98)
    grown = packed.dilate_box(packed.pack(thin, {"m": F.lit(True)}, shape, key), "m", "o", low, high, shape, key)
    assert cells(packed.unpack(grown, "o", shape, key)) == cells(stencil.dilate(thin, stencil.box(low, high), shape))
    for border in ("zero", "ignore"):
        eroded = packed.erode_box(packed.pack(thick, {"m": F.lit(True)}, shape, key), "m", "o", low, high, shape, key, border)
        assert cells(packed.unpack(eroded, "o", shape, key)) == cells(stencil.erode(thick, stencil.box(low, high), shape, border))


def test_one_shuffle_of_lines_and_one_of_volumes(spark):
    shape = SHAPES[0]
    planes = packed.pack(made(spark, shape, 0.3), {"m": F.lit(True)}, shape, ("vol",))
    out = packed.erode_ball(packed.dilate_ball(planes, "m", "m", 3, shape, ("vol",)), "m", "m", 3, shape, ("vol",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_nothing(spark):
    shape = SHAPES[0]
    none = made(spark, shape, 0.3).where("false")
    planes = packed.dilate_ball(packed.pack(none, {"m": F.lit(True)}, shape), "m", "o", 2, shape)
    assert packed.unpack(planes, "o", shape).count() == 0


@pytest.mark.parametrize("shape", [{"x": 9, "y": 8, "z": 7}, {"x": 66, "y": 5, "z": 5}])
def test_bounded_fill(spark, shape):
    """After n rounds, what a walk of n steps from the border does not reach is filled; with many rounds, the holes."""
    given = {c[1:] for c in map(tuple, made(spark, shape, 0.75, 4).where("vol = 0").collect())}
    every = {(x, y, z) for x in range(shape["x"]) for y in range(shape["y"]) for z in range(shape["z"])}
    mask = spark.createDataFrame(sorted(given), "x int, y int, z int")
    planes = packed.pack(mask, {"m": F.lit(True)}, shape)
    for rounds in (0, 1, 2, 30):
        out = {c for c in every - given if any(v in (0, n - 1) for v, n in zip(c, shape.values(), strict=True))}
        for _ in range(rounds):
            out |= {c for c in every - given - out if any((*c[:i], c[i] + d, *c[i + 1 :]) in out for i in range(3) for d in (-1, 1))}
        got = {tuple(r) for r in packed.unpack(packed.bounded_fill(planes, "m", "o", rounds, shape), "o", shape).collect()}
        assert got == every - out
    holes = {tuple(r) for r in runs.to_cells(runs.fill_holes(runs.from_cells(mask, shape), shape), shape).collect()}
    assert got == holes


def test_runs_of_packed_lines_and_cleaned_planes(spark):
    """Runs of lines of 1 to 130 cells against plain ones; planes of two keys, closed, widened and filled, as by cells, and by no row for a cell and an offset."""
    import random

    from voxelspark.operators import components, packed, stencil

    r = random.Random(8)
    for width in (1, 63, 64, 130):
        shape = {"x": width, "y": 3, "z": 2}
        cells = {(x, y, z) for x in range(width) for y in range(3) for z in range(2) if r.random() < 0.6} | {(0, 0, 0), (width - 1, 0, 0)}
        frame = spark.createDataFrame(sorted(cells), "x int, y int, z int")
        got = {tuple(x) for x in packed.runs(packed.pack(frame, {"m": F.lit(True)}, shape), "m", shape).select("z", "y", "first", "last").collect()}
        want = set()
        for x, y, z in cells:
            if (x - 1, y, z) not in cells:
                end = x
                while (end + 1, y, z) in cells:
                    end += 1
                want.add((z, y, x, end))
        assert got == want
    plane = {"r": 21, "c": 30}
    mask = spark.createDataFrame([(k, i, j) for k in (3, 5) for i in range(21) for j in range(30) if r.random() < 0.04 * k or i in (2, 9) and j > 25], "k int, r int, c int")
    closed = stencil.closing(mask, stencil.ball(3, 2), plane)
    want = {tuple(x) for x in components.fill_holes(stencil.dilate(closed, stencil.ball(2, 2), plane), plane, "k").collect()}
    ours = components.cleaned(mask, plane, "k")
    assert {tuple(x) for x in ours.collect()} == want and ours.count() == len(want)
    from voxelspark import queries

    cleanup = queries.QUERIES["mask_cleanup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " _o#" not in cleanup and "explode([[" not in cleanup  # a mask's cells with offsets
