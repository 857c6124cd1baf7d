"""Runs over many volumes and what they leave behind: label files, intermediates, pictures, clouds, archives, a label store, timings."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, sampling
from ..session import materialize
from ..sources import pictures

KINDS = ("labels", "images", "intermediates")
TASKS = ("tot", "tis", "bod")


def default_inputs(files: DataFrame, picked: list[str] | None = None, bypass: bool = False, path: str = "path") -> DataFrame:
    """The picked files; without any, all of the demo folder, or its pre-labelled ones on bypass."""
    if picked:
        return files.where(F.col(path).isin(picked))
    name = F.element_at(F.split(path, "/"), -1)
    ready = name.startswith("prelabeled_")
    return files.where(F.col(path).contains("sample/") & name.endswith(".nii.gz") & (ready if bypass else ~ready))


def chosen(files: DataFrame, kinds: tuple[str, ...] | list[str], column: str = "kind") -> DataFrame:
    """The files of the kinds chosen for export; an unknown kind is an error."""
    if unknown := {*kinds} - {*KINDS}:
        raise ValueError(f"unknown kinds: {', '.join(sorted(unknown))}")
    return files.where(F.col(column).isin(list(kinds)))


def other_methods(names: list[str], current: str) -> list[str]:
    """Method names but the current one, in order."""
    return [n for n in names if n != current]


def intermediates(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, task, x, y, z, cls: the raw classes of the three tasks, one row per cell and task; the form that is written by task."""
    tasks = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("cls")) for t in TASKS])
    return cells.select(*keys, "x", "y", "z", F.explode(tasks).alias("t")).select(*keys, "t.task", "x", "y", "z", "t.cls")


def write_intermediates(cells: DataFrame, folder: str, keys: tuple[str, ...] = ()) -> None:
    """Parquet by task under ``folder``; what was there before is replaced."""
    intermediates(cells, keys).write.mode("overwrite").partitionBy(*keys, "task").parquet(folder)


def cloud(labels: DataFrame, shape: dict[str, int], quota: dict[int, int], seed: int, plane: float | None = None, keys: tuple[str, ...] = (), axis_points: int = 2000) -> DataFrame:
    """keys, label, x, y, z, red, green, blue, alpha of each volume's sampled points: jittered, with the plane at ``plane`` (a share of the depth) as label -1, scaled and turned.

    Points are bounded by the quotas and ``axis_points`` for each volume.
    """
    points = materialize(sampling.stratified(labels.select(*keys, "x", "y", "z", "label"), quota, seed, keys))
    if plane is not None:
        at = min(int(plane * shape["z"]), shape["z"] - 1)
        volumes = points.select(*keys).distinct() if keys else labels.sparkSession.range(1).select()
        drawn = sampling.axis_draws(volumes, at, axis_points, seed, shape["x"], shape["y"]).withColumn("label", F.lit(-1))
        points = points.unionByName(drawn.select(*points.columns))
    placed = geometry.rotate_points(geometry.normalize_points(geometry.jittered(points, seed, keys), shape))
    return sampling.with_colors(placed)


def cloud_files(points: DataFrame, volume: str) -> DataFrame:
    """One binary glTF file for each volume."""
    return pictures.clouds(points, volume)


def counts(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, label, n in order of the keys and labels."""
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("n")).orderBy(*keys, "label")


class LabelStore:
    """Labels of several batches under one name, to be read by volume: each ``add`` appends, an empty store holds no cell."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, labels: DataFrame, batch: int) -> None:
        """``labels`` (volume_id, x, y, z, label); a batch added again replaces itself, so a retry does not double it."""
        kept = labels.select("volume_id", "x", "y", "z", F.pmod(F.col("label").cast("int"), F.lit(256)).cast("short").alias("label"))
        kept.write.mode("overwrite").partitionBy("volume_id").parquet(f"{self.folder}/batch={batch}")

    def read(self, volume_id: str | None = None) -> DataFrame:
        found = self.spark.read.option("basePath", self.folder).option("recursiveFileLookup", "false").schema("x int, y int, z int, label short, batch int, volume_id string").parquet(self.folder)
        return found if volume_id is None else found.where(F.col("volume_id") == volume_id)


class Timings:
    """Figures of named stages by batch: seconds, rows of the result, and seconds of its tasks on the executors. Those of all batches are kept; ``last`` gives a stage's last seconds, as the original shows.

    Rows are observed by the plan that makes them, so nothing is counted again; tasks are those of the Spark jobs that ran while a stage was open.
    """

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark
        self.rows: list[tuple[int, str, float]] = []
        self.figures: list[dict] = []

    @contextmanager
    def stage(self, name: str, batch: int = 0):
        began, group = time.monotonic(), f"{name}-{batch}-{uuid.uuid4().hex}"
        figures = {"batch": batch, "stage": name}
        if self.spark is not None:
            self.spark.sparkContext.setJobGroup(group, name)
        try:
            yield figures
        finally:
            figures["seconds"] = time.monotonic() - began
            self.rows.append((batch, name, figures["seconds"]))
            if self.spark is not None:
                figures["task_seconds"] = self._tasks(group)
                self.spark.sparkContext.setJobGroup("", "")
            self.figures.append(figures)

    def _tasks(self, group: str) -> float:
        """Seconds that the tasks of a group of jobs ran."""
        sc = self.spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store, jobs = sc._jsc.sc().statusStore(), sc.statusTracker()
        stages = {k for j in jobs.getJobIdsForGroup(group) if (info := jobs.getJobInfo(j)) for k in info.stageIds}
        return sum(store.lastStageAttempt(k).executorRunTime() for k in stages if jobs.getStageInfo(k)) / 1000

    def write(self, name: str, batch: int, result: DataFrame, sink: Callable[[DataFrame], None]) -> None:
        """Runs ``sink`` on ``result`` as a stage, and takes down how many rows went by."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        with self.stage(name, batch) as figures:
            sink(result.observe(seen, F.count(F.lit(1)).alias("rows")))
            figures["rows"] = seen.get["rows"]

    def last(self) -> dict[str, float]:
        return {name: seconds for _, name, seconds in self.rows}

    def total(self) -> dict[str, float]:
        out: dict[str, float] = {}
        for _, name, seconds in self.rows:
            out[name] = out.get(name, 0.0) + seconds
        return out

    def total_rows(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for f in self.figures:
            out[f["stage"]] = out.get(f["stage"], 0) + f.get("rows", 0)
        return out


def reset(spark: SparkSession, *folders: str) -> None:
    """Deletes the outputs of former runs; folders that are not there are passed over."""
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
