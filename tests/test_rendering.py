"""Rendering of volumes, masks, clouds and exports against plain versions."""

import collections

import pytest
from pyspark.sql import functions as F

from voxelspark.operators import geometry, labels, sampling, stencil
from voxelspark.plans import exports, registry, rendering
from voxelspark.sources import demo, pictures

SHAPE = {"x": 12, "y": 10, "z": 4}


def two_volumes(spark):
    """A block of label 11 with a hole, in background; the second volume is the first one mirrored along x."""
    cells = [(v, x if v == "a" else 11 - x, y, z, 11 if 2 <= x < 9 and 2 <= y < 8 and not (x, y) == (5, 5) else 9) for v in "ab" for x in range(12) for y in range(10) for z in range(4)]
    return spark.createDataFrame(cells, "volume_id string, x int, y int, z int, label int")


def test_pictures_of_volumes_equal_those_of_each(spark):
    cells, keys = two_volumes(spark), ("volume_id",)
    both = rendering.pictures(cells, SHAPE, 2, 7, keys, rendering.Frame(24, 16))
    got = {(r.volume_id, r.z): r.n for r in both.groupBy("volume_id", "z").agg(F.count("*").alias("n")).collect()}
    assert got == {(v, z): 256 * 256 for v in "ab" for z in (0, 2)}
    warped = rendering.warped_labels(cells, SHAPE, 2, keys, rendering.Frame(24, 16))
    one = rendering.warped_labels(cells.where("volume_id = 'b'").drop("volume_id"), SHAPE, 2, (), rendering.Frame(24, 16))
    assert warped.where("volume_id = 'b'").drop("volume_id").exceptAll(one).isEmpty() and one.where("label = 11").count() > 1000
    lit = both.agg(F.min("intensity").alias("low"), F.max("intensity").alias("high")).first()
    assert lit.low == 0 and 0 < lit.high <= 1


def plain_clean(mask, n):
    ball = lambda k: [(i, j) for i in range(-k, k + 1) for j in range(-k, k + 1) if abs(i) + abs(j) <= k]
    grow = lambda m, k: {(r + i, c + j) for r, c in m for i, j in ball(k) if 0 <= r + i < n and 0 <= c + j < n}
    wide = grow(mask, 3)
    wide = grow({(r, c) for r, c in wide if all((r + i, c + j) in wide for i, j in ball(3))}, 2)
    free = {(r, c) for r in range(n) for c in range(n)} - wide
    todo = collections.deque(p for p in free if 0 in p or n - 1 in p)
    outside = set(todo)
    while todo:
        r, c = todo.popleft()
        for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
            if p in free and p not in outside:
                outside.add(p)
                todo.append(p)
    return {(r, c) for r in range(n) for c in range(n)} - outside


def test_masks_are_cleaned_one_by_one(spark):
    ring = [(0, 11, r, c) for r in range(40, 71) for c in range(40, 71) if r in (40, 70) or c in (40, 70)]
    spots = [(0, 13, 100 + 3 * k, 90) for k in range(5)] + [(1, 11, 0, 0), (1, 11, 255, 255), (0, 9, 5, 5), (0, 0, 6, 6)]
    warped = spark.createDataFrame(ring + spots, "z int, label int, r int, c int")
    got = collections.defaultdict(set)
    for r in rendering.masks(warped).collect():
        got[r.z, r.label].add((r.r, r.c))
    want = collections.defaultdict(set)
    for z, label, r, c in ring + spots:
        want[z, label].add((r, c))
    want = {k: plain_clean(v, 256) for k, v in want.items() if k[1] not in (0, 9)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert {(r.z, r.label) for r in rendering.masks(warped, clean=False).collect()} == {(0, 11), (0, 13), (1, 11)}


def test_shell_against_separate_steps(spark):
    """The one-pass shell equals the steps done one by one, for several volumes, sparse cells and parameters."""
    cells = [(v, x, y, z, 1 if (x - 6) ** 2 + (y - 5) ** 2 < 20 + 5 * (v == "b") else 7 * (x == y), (x * y * 31 + z) % 700 - 300, x % 5, y % 4) for v in "ab" for x in range(12) for y in range(10) for z in range(4) if (x + 2 * y + 3 * z) % 11]
    cells = spark.createDataFrame(cells, "volume_id string, x int, y int, z int, bod int, hu int, tot int, tis int")
    for dilation, erosion, box in ((1, 3, 2), (2, 1, 3), (0, 0, 1)):
        axes = ["volume_id", *SHAPE]
        body = stencil.dilate(cells.where("bod = 1").select(*axes), stencil.ball(dilation), SHAPE)
        inner = stencil.erode(cells.where("bod <> 0").select(*axes), stencil.ball(erosion), SHAPE)
        shell = body.join(inner, axes, "left_anti").join(cells.where(labels.dense(F.col("hu"))).select(*axes), axes, "left_semi")
        want = stencil.dilate(shell, stencil.box(-(box // 2), -(box // 2) + box - 1), SHAPE)
        got = labels.skin(cells, SHAPE, dilation, erosion, box, ("volume_id",))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_separable_equals_the_product(spark):
    raster = spark.createDataFrame([(p, r, c, float(r * c % 7 + p), r + c) for p in (0, 1) for r in range(6) for c in range(5) if (r + c + p) % 4], "p int, r int, c int, v double, own int")
    a, b = {-1: 0.25, 0: 0.5, 1: 0.25}, {-2: 0.1, 0: 0.7, 1: 0.2}
    shape = {"r": 6, "c": 5}
    want = stencil.convolve(raster.drop("own"), {(i, j): x * y for i, x in a.items() for j, y in b.items()}, shape)
    key = lambda d: {(r.p, r.r, r.c): round(r.v, 9) for r in d.collect()}
    assert key(stencil.convolve_separable(raster.drop("own"), [a, b], shape)) == key(want)
    kept = stencil.convolve_separable(raster, [a, b], shape, ("v",), ("own",)).collect()
    assert {(r.p, r.r, r.c): r.own for r in kept} == {(r.p, r.r, r.c): r.own for r in raster.collect()}
    assert all(key(want)[r.p, r.r, r.c] == round(r.v, 9) for r in kept)


def test_bilinear_resize_by_hand(spark):
    row = spark.createDataFrame([(0, c, float(c * c)) for c in range(4)], "r int, c int, v double")
    got = {r.c: r.v for r in geometry.resize_bilinear(row, {"r": 1, "c": 4}, 2).where("r = 0").collect()}
    assert got == {0: 0.5, 1: 6.5}


def test_registry_variants_and_errors(spark):
    names = registry.REGISTRY.names("segmentation")
    assert names == ["precomputed", "precomputed_fast", "predictor", "prelabeled"] and exports.other_methods(names, "predictor") == ["precomputed", "precomputed_fast", "prelabeled"]
    bare = spark.createDataFrame([(0, 0, 0, 1, 1, 5)], "x int, y int, z int, tot int, tis int, hu int")
    with pytest.raises(registry.SegmentationError):
        registry.run(bare, SHAPE)
    with pytest.raises(registry.SegmentationError):
        registry.validated(bare, ("heart",))
    cells = two_volumes(spark)
    out = registry.run(cells, SHAPE, registry.Config(segmentation="prelabeled", rendering="ultrasound_plain", pointcloud="placed", step=3, keys=("volume_id",), quota={11: 5}))
    assert {(r.volume_id, r.label): r.n for r in out["counts"].collect()} == {(v, k): n for v in "ab" for k, n in ((11, 164), (9, 316))}
    found = {(r.volume_id, r.label): r.n for r in out["points"].groupBy("volume_id", "label").agg(F.count("*").alias("n")).collect()}
    assert found == {(v, k): n for v in "ab" for k, n in ((11, 5), (-1, 2000))}
    assert out["maps"].select("volume_id", "z").distinct().count() == 4


def test_clouds_lie_in_the_unit_cube_and_in_files(spark):
    cells = two_volumes(spark)
    points = exports.cloud(cells, SHAPE, {11: 50, 9: 10}, 3, 0.5, ("volume_id",))
    rows = points.collect()
    assert len(rows) == 2 * (60 + 2000) and all(-0.5 <= v <= 0.5 for r in rows for v in (r.x, r.y, r.z))
    files = exports.cloud_files(points, "volume_id").collect()
    assert sorted(f.name for f in files) == ["a.glb", "b.glb"] and all(len(pictures.read_glb(bytes(f.content))[0]) == 2060 for f in files)


def test_stratified_takes_the_first_by_hash(spark):
    """A label of many cells, thinned before it is ranked, and one of few."""
    cells = spark.range(60_000).select((F.col("id") % 100).cast("int").alias("x"), F.floor(F.col("id") / 100).cast("int").alias("y"), F.lit(0).alias("z"), F.when(F.col("id") < 59_990, 12).otherwise(3).alias("label"))
    got = sampling.stratified(cells, {12: 100, 3: 50, 4: 9}, 5)
    want = [r for k, n in ((12, 100), (3, 50)) for r in cells.where(F.col("label") == k).orderBy(sampling.seeded(5, "x", "y", "z"), "x", "y", "z").limit(n).collect()]
    assert sorted(got.collect()) == sorted(want) and len(want) == 110


def test_batches_of_many_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("_at"))
    got = sorted((r.k, r.batch_id) for r in sampling.batches(rows, "k", 30).collect())
    assert got == [(k, k // 30) for k in range(1000)]
    assert sampling.batches(rows.limit(0), "k", 3).count() == 0
    names = spark.createDataFrame([("b",), ("a",), (None,)], "k string")
    assert sorted((r.k or "", r.batch_id) for r in sampling.batches(names, "k", 2).collect()) == [("", 0), ("a", 0), ("b", 1)]


def test_exports(spark, tmp_path):
    files = spark.createDataFrame([("x/sample/a.nii.gz", "labels"), ("x/sample/prelabeled_b.nii.gz", "images"), ("x/own.nii.gz", "intermediates")], "path string, kind string")
    paths = lambda d: [r.path for r in d.orderBy("path").collect()]
    assert paths(exports.default_inputs(files)) == ["x/sample/a.nii.gz"] and paths(exports.default_inputs(files, bypass=True)) == ["x/sample/prelabeled_b.nii.gz"]
    assert paths(exports.default_inputs(files, ["x/own.nii.gz"])) == ["x/own.nii.gz"]
    assert paths(exports.chosen(files, ["labels", "images"])) == ["x/sample/a.nii.gz", "x/sample/prelabeled_b.nii.gz"] and exports.chosen(files, []).isEmpty()
    with pytest.raises(ValueError):
        exports.chosen(files, ["models"])
    store = exports.LabelStore(spark, str(tmp_path / "store"))
    cells = two_volumes(spark)
    store.add(cells.where("volume_id = 'a'"), 0)
    store.add(cells.where("volume_id = 'b'").withColumn("label", F.col("label") + 256), 1)
    store.add(cells.where("volume_id = 'b'").withColumn("label", F.col("label") + 256), 1)
    assert store.read().count() == cells.count() and {r.label for r in store.read("b").select("label").distinct().collect()} == {9, 11}
    made = demo.cloud(spark, (2, 3), 5, 1)
    assert made.count() == 10
    raw = spark.createDataFrame([(0, 0, 0, 5, 1, 1)], "x int, y int, z int, tot int, tis int, bod int")
    exports.write_intermediates(raw, str(tmp_path / "parts"))
    exports.write_intermediates(raw, str(tmp_path / "parts"))
    assert {(r.task, r.cls) for r in spark.read.parquet(str(tmp_path / "parts")).collect()} == {("tot", 5), ("tis", 1), ("bod", 1)}
    exports.reset(spark, str(tmp_path / "parts"), str(tmp_path / "none"))
    assert not (tmp_path / "parts").exists()
    timings = exports.Timings()
    for batch in (0, 1):
        with timings.stage("render", batch):
            pass
    assert [b for b, *_ in timings.rows] == [0, 1] and timings.last()["render"] == timings.rows[1][2] and timings.total()["render"] == sum(t for *_, t in timings.rows)


def test_pictures_are_gathers_of_planes(spark):
    """Planes with absent cells and a struct for a key: the sector pictures turned and resized by joins give the same, and no pixel is an element of an interpreted function."""
    import random

    from voxelspark.operators import geometry, rays

    r = random.Random(4)
    cells = [((k, str(k)), i, j, r.random()) for k in (1, 7) for i in range(9) for j in range(6) if r.random() < 0.8]
    frame = spark.createDataFrame(cells, "k struct<a: int, b: string>, r int, c int, v double")
    shape = {"r": 9, "c": 6}
    ours = geometry.sector_picture(frame, shape, ("k",), 32)
    turned = geometry.polar_warp(frame, 9, 6, keys=("k",)).select("k", F.col("j").alias("r"), (359 - F.col("i")).alias("c"), "v")
    want = {(x.k.a, x.r, x.c): x.v for x in geometry.resize_bilinear(turned, {"r": 220, "c": 360}, 32, ("k",)).collect()}
    got = {(x.k.a, x.r, x.c): x.v for x in ours.collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 32 * 32 and max(got.values()) > 0.1
    assert max(abs(got[k] - want[k]) for k in got) < 1e-9
    planes = rays.planes(rays.pack(frame, ("k",)), "v", shape, ("k",))
    plan = rays.pictures(planes, shape, 32, ("k",))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sequence(0, 1023" not in plan
