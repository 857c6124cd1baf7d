"""Named methods of each kind, and the pipeline that a configuration of them makes."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import acoustics, labels, sampling
from ..session import ship
from . import exports, rendering

KINDS = ("segmentation", "rendering", "pointcloud")


class SegmentationError(RuntimeError):
    """A segmentation method failed."""


class InputValidationError(ValueError):
    """An input lacks what a method needs."""


class Registry:
    def __init__(self) -> None:
        self._methods: dict[str, dict[str, Callable]] = {kind: {} for kind in KINDS}

    def register(self, kind: str, name: str, method: Callable) -> None:
        """Keeps ``method`` under ``name``; a later one of that name replaces it."""
        if not callable(method):
            raise TypeError("a method is a callable")
        self._kind(kind)[name] = method

    def names(self, kind: str) -> list[str]:
        return sorted(self._kind(kind))

    def get(self, kind: str, name: str) -> Callable:
        methods = self._kind(kind)
        if name not in methods:
            raise ValueError(f"unknown {kind} method {name!r}; known: {', '.join(sorted(methods))}")
        return methods[name]

    def _kind(self, kind: str) -> dict[str, Callable]:
        if kind not in self._methods:
            raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
        return self._methods[kind]


def _need(df: DataFrame, *columns: str) -> DataFrame:
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise InputValidationError(f"columns are missing: {', '.join(lacking)}")
    return df


#: What each segmentation task is called in the cells of a volume.
TASKS = {"total": "tot", "tissue_types": "tis", "body": "bod"}


def validated(cells: DataFrame, tasks: tuple[str, ...] = tuple(TASKS)) -> DataFrame:
    """``cells`` if they have the classes of all ``tasks`` and a density; an unknown task or a missing one is an error before any work."""
    if unknown := [t for t in tasks if t not in TASKS]:
        raise SegmentationError(f"unknown tasks: {', '.join(unknown)}")
    _need(cells, "x", "y", "z", "hu")
    if lacking := [t for t in tasks if TASKS[t] not in cells.columns]:
        raise SegmentationError(f"no results of the tasks: {', '.join(lacking)}")
    return cells


def precomputed(cells: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels assembled from raw classes of three tasks (tot, tis, bod) and density (hu)."""
    return labels.assemble(validated(_need(cells, *keys)), shape, keys=keys)


def precomputed_fast(cells: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """As ``precomputed``, by the fast tasks, which have a third tissue class that counts as fat."""
    return labels.assemble(validated(_need(cells, *keys)), shape, fast=True, keys=keys)


def predictor(cells: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """As ``precomputed``, with the shell widened by a cube of 3 cells a side, centred."""
    return labels.assemble(validated(_need(cells, *keys)), shape, box=3, keys=keys)


_MODELS: dict = {}


def model_method(load: Callable[[], object], apply: Callable[[object, dict[str, np.ndarray]], np.ndarray], inputs: tuple[str, ...] = ("hu",), name: str = "model") -> Callable[..., DataFrame]:
    """A segmentation method that runs a model on planes: ``load`` makes the model, once in each worker, and ``apply`` (model, the plane's ``inputs`` as y, x arrays) gives the labels of a plane as an array of that shape.

    Planes are made from cells by one shuffle and go to workers as Arrow batches, each with all inputs; absent cells are 0 and get no label. A failure of ``apply`` is a SegmentationError that names the volume and plane.
    """

    def method(cells: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
        w, h = shape["x"], shape["y"]
        _need(cells, *keys, "x", "y", "z", *inputs)
        rows = cells.groupBy(*keys, "z").agg(F.collect_list((F.col("y") * w + F.col("x")).cast("int")).alias("_at"), *[F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in inputs])
        kinds = dict(cells.dtypes)
        out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "z int, _at array<int>, _label array<int>"])

        def run(batches):
            if name not in _MODELS:
                _MODELS[name] = load()
            for b in batches:
                for i in range(b.num_rows):
                    at = b.column("_at")[i].values.to_numpy()
                    planes = {}
                    for c in inputs:
                        planes[c] = np.zeros(w * h)
                        planes[c][at] = b.column(c)[i].values.to_numpy()
                        planes[c] = planes[c].reshape(h, w)
                    where = ", ".join(f"{k} {b.column(k)[i].as_py()}" for k in (*keys, "z"))
                    try:
                        found = np.asarray(apply(_MODELS[name], planes))
                    except Exception as error:
                        raise SegmentationError(f"{where}: {error}") from error
                    if found.shape != (h, w):
                        raise SegmentationError(f"{where}: labels of shape {found.shape}, not {(h, w)}")
                    label = pa.array([found.ravel()[at].astype(np.int32)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in (*keys, "z", "_at")), label], [*keys, "z", "_at", "_label"])

        ship(cells.sparkSession)
        found = rows.mapInArrow(run, out).select(*keys, "z", F.explode(F.arrays_zip("_at", "_label")).alias("_c"))
        return found.select(*keys, (F.col("_c._at") % w).alias("x"), F.floor(F.col("_c._at") / w).cast("int").alias("y"), "z", F.col("_c._label").alias("label"))

    return method


def prelabeled(cells: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels as given, without background filling."""
    return _need(cells, *keys, "x", "y", "z", "label").select(*keys, "x", "y", "z", F.pmod(F.col("label").cast("int"), F.lit(256)).alias("label"))


def acoustic_maps(cells: DataFrame, shape: dict[str, int], step: int, keys: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """Maps along the rays (r = x, depth c = y) of every ``step``-th plane z."""
    rays = cells.where(F.col("z") % step == 0).select(*keys, "z", F.col("x").alias("r"), F.col("y").alias("c"), "label")
    return acoustics.depth_maps(acoustics.clamp_maps(acoustics.lookup(rays)), shape["y"], (*keys, "z"))


def ultrasound(cells: DataFrame, shape: dict[str, int], step: int, keys: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """Pictures of every ``step``-th plane, in the original renderer's sizes."""
    return rendering.pictures(cells, shape, step, seed, keys)


def ultrasound_plain(cells: DataFrame, shape: dict[str, int], step: int, keys: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """Pictures of planes as they are, neither resized nor cropped before rendering."""
    return rendering.pictures(cells, shape, step, seed, keys, rendering.Frame())


def quotas(cells: DataFrame, shape: dict[str, int], quota: dict[int, int], seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    return sampling.stratified(cells, quota, seed, keys)


def placed_cloud(cells: DataFrame, shape: dict[str, int], quota: dict[int, int], seed: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Coloured points as they go into a cloud file, with the plane at half the depth."""
    return exports.cloud(cells, shape, quota, seed, 0.5, keys)


REGISTRY = Registry()
REGISTRY.register("segmentation", "precomputed", precomputed)
REGISTRY.register("segmentation", "prelabeled", prelabeled)
REGISTRY.register("segmentation", "precomputed_fast", precomputed_fast)
REGISTRY.register("segmentation", "predictor", predictor)
REGISTRY.register("rendering", "acoustic_maps", acoustic_maps)
REGISTRY.register("rendering", "ultrasound", ultrasound)
REGISTRY.register("rendering", "ultrasound_plain", ultrasound_plain)
REGISTRY.register("pointcloud", "default", quotas)
REGISTRY.register("pointcloud", "placed", placed_cloud)


@dataclass(frozen=True)
class Config:
    segmentation: str = "precomputed"
    rendering: str = "acoustic_maps"
    pointcloud: str = "default"
    step: int = 1
    seed: int = 0
    quota: dict[int, int] = field(default_factory=lambda: dict(sampling.DEFAULT_QUOTA))
    keys: tuple[str, ...] = ()  # columns that name a volume

    def __post_init__(self) -> None:
        if self.step < 1:
            raise ValueError("step is at least 1")


def _call(method: Callable, *given, **more) -> DataFrame:
    """``method`` with those of ``more`` that it takes; one that takes no keys cannot run many volumes."""
    takes = inspect.signature(method).parameters
    if more.get("keys") and "keys" not in takes:
        raise InputValidationError("this method takes one volume at a time")
    return method(*given, **{k: v for k, v in more.items() if k in takes})


def run(cells: DataFrame, shape: dict[str, int], config: Config | None = None, registry: Registry = REGISTRY) -> dict[str, DataFrame]:
    """The lazy results labels, maps, points and counts of one configuration; an unknown method name fails before any work."""
    config = config or Config()
    segment, render, sample = (registry.get(kind, getattr(config, kind)) for kind in KINDS)
    found = _call(segment, cells, shape, keys=config.keys)
    return {
        "labels": found,
        "maps": _call(render, found, shape, config.step, keys=config.keys, seed=config.seed),
        "points": _call(sample, found, shape, config.quota, config.seed, keys=config.keys),
        "counts": found.groupBy(*config.keys, "label").agg(F.count("*").alias("n")),
    }


def run_batch(cells: DataFrame, shape: dict[str, int], sinks: dict[str, Callable[[DataFrame], None]], timings: exports.Timings, batch: int = 0, config: Config | None = None, registry: Registry = REGISTRY) -> None:
    """``run`` for one batch of volumes; each result that ``sinks`` names is handed to its sink, and ``timings`` takes down seconds and rows."""
    results = run(cells, shape, config, registry)
    for name, sink in sinks.items():
        timings.write(name, batch, results[name], sink)
