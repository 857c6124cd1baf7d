"""Volumes that arrive late and twice, observed figures of batches, and the SQL surface."""

import datetime as dt
import os
import shutil
import uuid

import pytest
from pyspark.sql import functions as F

from voxelspark.functions import sql
from voxelspark.plans import exports, registry
from voxelspark.streaming import landing, volumes

SCHEMA = "volume_id string, z int, made timestamp"


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def arrive(spark, folder, name, rows):
    spark.createDataFrame([(v, z, at(h)) for v, z, h in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_late_and_repeated_volumes(spark, tmp_path):
    landing_, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def handle(batch):
        seen.append(batch.count())
        return batch.groupBy("volume_id").agg(F.count("*").alias("planes"))

    def drain():
        rows = landing.arrivals(spark, f"{landing_}/*", spark.createDataFrame([], SCHEMA).schema, 1)
        found, progress = volumes.drain(volumes.once(rows, "made", "2 hours", "volume_id", "z"), handle, out)
        return {r.volume_id: r.planes for r in found.groupBy("volume_id").agg(F.sum("planes").alias("planes")).collect()}, progress

    arrive(spark, landing_, "1", [("a", z, 1) for z in range(4)] + [("a", 0, 1)])
    assert drain()[0] == {"a": 4}
    arrive(spark, landing_, "2", [("a", z, 1) for z in range(4)] + [("b", z, 2) for z in range(3)])  # a again, in time
    assert drain()[0] == {"a": 4, "b": 3}
    arrive(spark, landing_, "3", [("c", 0, 40)])
    assert drain()[0] == {"a": 4, "b": 3, "c": 1}
    arrive(spark, landing_, "4", [("d", z, 3) for z in range(5)])  # later than the watermark allows
    arrive(spark, landing_, "5", [("e", 0, 80)])
    found, progress = drain()
    assert found == {"a": 4, "b": 3, "c": 1, "e": 1}
    assert volumes.state_rows(progress) <= 2  # of 13 rows: what the watermark had not passed when the last batch began
    assert drain()[0] == found  # nothing new


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    landing_, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, landing_, "1", [("a", z, 1) for z in range(4)])
    rows = lambda: volumes.once(landing.arrivals(spark, f"{landing_}/*", spark.createDataFrame([], SCHEMA).schema), "made", "2 hours", "volume_id", "z")
    assert volumes.drain(rows(), None, out)[0].count() == 4
    shutil.rmtree(f"{out}/state")  # as if the batch had been stored and its commit lost
    assert volumes.drain(rows(), None, out)[0].count() == 4


def test_closed_windows(spark, tmp_path):
    landing_ = str(tmp_path / "in")
    arrive(spark, landing_, "1", [("a", 0, 0.5), ("a", 1, 1.5), ("a", 1, 1.5), ("b", 0, 9.5)])
    rows = volumes.once(landing.arrivals(spark, f"{landing_}/*", spark.createDataFrame([], SCHEMA).schema), "made", "2 hours", "volume_id", "z")
    found, _ = volumes.drain(volumes.closed_counts(rows, "made", "volume_id", "1 hour"))
    assert sorted((r.start, r.volume_id, r.n) for r in found.collect()) == [(at(0), "a", 1), (at(1), "a", 1)]


SHAPE = {"x": 4, "y": 4, "z": 3}


def test_figures_of_two_batches(spark):
    timings = exports.Timings(spark)
    kept = {}
    for batch, n in ((0, 2), (1, 3)):
        cells = spark.range(48 * n).select(F.floor(F.col("id") / 48).cast("string").alias("volume_id"), (F.col("id") % 4).cast("int").alias("x"), (F.floor(F.col("id") / 4) % 4).cast("int").alias("y"), (F.floor(F.col("id") / 16) % 3).cast("int").alias("z"), F.lit(11).alias("label"))
        config = registry.Config(segmentation="prelabeled", keys=("volume_id",), quota={11: 5})
        registry.run_batch(cells, SHAPE, {"labels": lambda df: kept.update(labels=df.count()), "points": lambda df: df.write.format("noop").mode("overwrite").save()}, timings, batch, config)
    rows = {(f["batch"], f["stage"]): f["rows"] for f in timings.figures}
    assert rows == {(0, "labels"): 96, (0, "points"): 10, (1, "labels"): 144, (1, "points"): 15}
    assert timings.total_rows() == {"labels": 240, "points": 25}
    assert timings.last()["points"] == timings.rows[-1][2] and timings.total()["points"] >= timings.last()["points"] > 0
    assert all(f["task_seconds"] > 0 for f in timings.figures)
    with pytest.raises(RuntimeError), timings.stage("points", 2):
        raise RuntimeError
    assert timings.figures[-1]["batch"] == 2  # a stage that failed is told too


def test_sql_functions(spark):
    sql.register(spark)
    sql.register(spark)
    row = spark.sql("SELECT clamp(5, 0, 2) AS a, is_fat(2) AS b, is_fat(3) AS c, is_fat_fast(3) AS d, is_dense(0) AS e, is_dense(250) AS f, is_fat(NULL) AS g, wrapped(-1) AS h, at_index(array(1D, 2D), 5, 7) AS i, affine_point(array(array(2D, 0D, 0D, 1D), array(0D, 2D, 0D, 0D), array(0D, 0D, 2D, 0D), array(0D, 0D, 0D, 1D)), 1, 2, 3) AS j, voxel_label(true, 1, 5) AS k, voxel_label(false, 0, NULL) AS l").first()
    assert tuple(row) == (2.0, True, False, True, True, False, False, 255, 7.0, [3.0, 4.0, 6.0], 12, 9)
    assert spark.table("class_map").count() == 118 and spark.table("tissues").count() > 5


def test_a_model_runs_on_planes(spark, tmp_path):
    """Several inputs a call, one model for each worker, and failures that name the volume."""
    cells = spark.range(2 * 48).select(F.when(F.col("id") < 48, "a").otherwise("b").alias("volume_id"), (F.col("id") % 4).cast("int").alias("x"), (F.floor(F.col("id") / 4) % 4).cast("int").alias("y"), (F.floor(F.col("id") / 16) % 3).cast("int").alias("z"), F.col("id").cast("int").alias("hu"), F.lit(2).alias("tot")).where("x <> 1 OR y <> 2")
    log = str(tmp_path)

    def load():
        open(f"{log}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return 10

    methods = registry.Registry()
    methods.register("segmentation", "ten", registry.model_method(load, lambda model, p: p["hu"] // model + p["tot"], ("hu", "tot"), "ten"))
    for kind in ("rendering", "pointcloud"):
        methods.register(kind, "none", lambda cells, *rest, keys=(): cells)
    config = registry.Config(segmentation="ten", rendering="none", pointcloud="none", keys=("volume_id",))
    got = {tuple(r) for r in registry.run(cells, SHAPE, config, methods)["labels"].collect()}
    assert got == {(r.volume_id, r.x, r.y, r.z, r.hu // 10 + 2) for r in cells.collect()}
    pids = [n.split("-")[0] for n in os.listdir(log)]
    assert len(pids) == len(set(pids)) > 0
    methods.register("segmentation", "ten", registry.model_method(lambda: 0, lambda model, p: 1 // model, ("hu",), "bad"))
    with pytest.raises(Exception, match="SegmentationError: volume_id [ab], z [012]: integer division"):
        registry.run(cells, SHAPE, config, methods)["labels"].collect()
