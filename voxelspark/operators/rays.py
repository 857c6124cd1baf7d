"""Rays packed as arrays: a ray is one row of structs in order of depth, a plane's rays are in one task, and what runs along depth or across rays is done by higher-order functions; warps and resizes, whose places are the same for all planes, by gathers of Arrow batches.

One shuffle (by plane) brings the cells of a plane together; differences, running products, blurs, warps and resizes then follow in the same stage. A table of rays has ``keys`` (columns that name a plane), r and
``ray`` (structs with c and values, sorted by c). Cells may be absent: neighbours along depth are the present ones, and blurs and warps take absent places as 0. A table of planes has ``keys`` and ``matrix``, an array of dense rays.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BOUNDARY_SCALE, TGC
from ..session import dealt, ship

Keys = tuple[str, ...]


def let(value: Column, body) -> Column:
    """body(x) with ``value`` evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack(cells: DataFrame, keys: Keys = ()) -> DataFrame:
    """Rays of cells (``keys``, r, c and values), by one shuffle."""
    values = [c for c in cells.columns if c not in (*keys, "r", "c")]
    return dealt(cells, keys).groupBy(*keys, "r").agg(F.sort_array(F.collect_list(F.struct("c", *values))).alias("ray"))


def unpack(rays: DataFrame, keys: Keys = ()) -> DataFrame:
    return rays.select(*keys, "r", F.explode("ray").alias("_cell")).select(*keys, "r", "_cell.*")


def extended(rays: DataFrame, new, **more: Column) -> DataFrame:
    """``rays`` with the fields that ``new`` (ray, cell, place in the ray, further values) gives by name; fields of these names are replaced. ``more``: values of a ray, evaluated once."""

    def ray(s):
        def one(x, i):
            for n, v in new(s["ray"], x, i, s).items():
                x = x.withField(n, v)
            return x

        return F.transform(s["ray"], one)

    return rays.withColumn("ray", let(F.struct(F.col("ray").alias("ray"), *[v.alias(n) for n, v in more.items()]), ray))


def interfaces(rays: DataFrame) -> DataFrame:
    """d: impedance minus the next one in depth (0 at the end); boundary and refl from it and from the sum with the one before."""

    def new(ray, x, i, _):
        d = F.coalesce(x["imp"] - F.get(ray, i + 1)["imp"], F.lit(0.0))
        s = x["imp"] + F.coalesce(F.when(i > 0, F.get(ray, i - 1)["imp"]), F.lit(0.0))
        share = d / F.when(s == 0, 1.0).otherwise(s)
        return {"d": d, "boundary": 1 - F.exp(-d * d / F.lit(BOUNDARY_SCALE)), "refl": 1 / (1 + F.exp(-share * share))}

    return extended(rays, new)


def _running(values: Column, start: float, step) -> Column:
    """step(so far, value) for each prefix of an array of doubles."""
    none = F.array().cast("array<double>")
    both = lambda acc, x: let(step(acc["now"], x), lambda y: F.struct(y.alias("now"), F.array_append(acc["all"], y).alias("all")))
    return F.aggregate(values, F.struct(F.lit(start).alias("now"), none.alias("all")), both, lambda acc: acc["all"])


def depth_maps(rays: DataFrame, depth: int) -> DataFrame:
    """att, att_tgc and trans: running products along the ray, the first as a sum of exponents."""
    alpha = F.transform("ray", lambda x: x["alpha"])
    passed = F.transform("ray", lambda x: 1 - x["refl"] * x["boundary"])
    step = 4.0 / (depth - 1)

    def new(ray, x, i, s):
        att = F.exp(-F.lit(step) * F.get(s["alphas"], i))
        return {"att": att, "att_tgc": att * (1 + F.lit(TGC - 1) * x["c"] / F.lit(float(depth - 1))), "trans": F.get(s["passed"], i)}

    return extended(rays, new, alphas=_running(alpha, 0.0, lambda a, x: a + x), passed=_running(passed, 1.0, lambda a, x: a * x))


def dense(ray: Column, n: int, value) -> Column:
    """value(cell) at each depth below ``n``, 0 where there is no cell."""

    def at(ray):
        def one(c):
            here = F.get(ray, c)
            found = F.when(here["c"] == c, here).otherwise(F.get(F.filter(ray, lambda x: x["c"] == c), F.lit(0)))
            return F.coalesce(value(found), F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)

    return let(ray, at)


def blurred(values: Column, weights: dict[int, float], n: int) -> Column:
    """A dense array, correlated with weights; outside is 0."""

    def body(v):
        tap = lambda i, k: F.coalesce(F.when(i + k >= 0, F.get(v, i + k)), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: reduce(lambda a, b: a + b, [F.lit(float(w)) * tap(i, k) for k, w in weights.items()]))

    return let(values, body)


def blur(rays: DataFrame, names: dict[str, str], weights: list[dict[int, float]], depth: int, keys: Keys = ()) -> DataFrame:
    """Fields ``names`` of the cells (new name: old name) blurred by the product of weights across rays and along depth. Absent cells count as 0 and get no value."""
    across, along = weights
    wide = rays
    for new, old in names.items():
        wide = wide.withColumn(f"_{new}", blurred(dense(F.col("ray"), depth, _field(old)), along, depth))
    low, high = min(across), max(across)
    near = Window.partitionBy(*keys).orderBy("r").rangeBetween(low, high)
    wide = wide.withColumn("_near", F.collect_list(F.struct("r", *[f"_{n}" for n in names])).over(near))
    weight = F.array(*[F.lit(float(across[k])) for k in range(low, high + 1)])

    def new(ray, x, i, s):
        total = lambda n: F.aggregate(s["near"], F.lit(0.0), lambda acc, y: acc + F.get(weight, (y["r"] - s["r"] - low).cast("int")) * F.get(y[f"_{n}"], x["c"].cast("int")))
        return {n: total(n) for n in names}

    return extended(wide, new, near=F.col("_near"), r=F.col("r")).drop("_near", *[f"_{n}" for n in names])


def _field(name: str):
    return lambda x: x[name]


def intensity(rays: DataFrame, weights: list[dict[int, float]], depth: int, keys: Keys = ()) -> DataFrame:
    """``rays`` with intensity in [0, 1]: backscatter and specular echo, both blurred."""
    lit = blur(rays, {"scat_g": "scat", "boundary_g": "boundary"}, weights, depth, keys)

    def new(ray, x, i, _):
        echo = x["att_tgc"] * x["scat_g"] + x["att_tgc"] * x["trans"] * x["refl"] * x["boundary_g"]
        return {"intensity": F.greatest(F.lit(0.0), F.least(F.lit(1.0), echo))}

    return extended(lit, new)


# ---------------------------------------------------------------- planes


def planes(rays: DataFrame, value: str, shape: dict[str, int], keys: Keys = ()) -> DataFrame:
    """``keys`` and matrix: dense rays of one value. Rays are in place already, so nothing is shuffled."""
    w, h = shape.values()
    rows = rays.select(*keys, F.struct("r", dense(F.col("ray"), h, _field(value)).alias("v")).alias("_ray"))
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_ray")).alias("_rays"))
    none = F.array_repeat(F.lit(0.0), h)

    def all_rays(rows):
        def line(r):
            here = F.get(rows, r)
            other = F.get(F.filter(rows, lambda x: x["r"] == r), F.lit(0))["v"]
            return F.coalesce(F.when(here["r"] == r, here["v"]), other, none)

        return F.transform(F.sequence(F.lit(0), F.lit(w - 1)), line)

    return found.select(*keys, let(F.col("_rays"), all_rays).alias("matrix"))


PIXELS = {"i": 360, "j": 220}


def sector_taps(w: int, h: int, label_interp: str = "bilinear") -> list[tuple[np.ndarray, np.ndarray]]:
    """Four (or one, ``nearest``) places r * h + c and weights for each pixel i * 220 + j of the sector picture; places outside the plane are w * h, weights outside the sector 0."""
    i, j = (x.ravel() for x in np.divmod(np.arange(PIXELS["i"] * PIXELS["j"]), PIXELS["j"]))
    x, y = (i - 180).astype(np.float64), (j + 120).astype(np.float64)
    angle, radius = np.arctan2(x, y), np.sqrt(x * x + y * y)
    inside = (np.abs(angle) < math.pi / 6) & (radius > 140) & (radius < 340)
    u, v = (angle + math.pi / 6) / (math.pi / 3) * w, (radius - 140) / 200.0 * h

    def tap(r: np.ndarray, c: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = inside & (r >= 0) & (r < w) & (c >= 0) & (c < h)
        return np.where(found, r * h + c, w * h).astype(np.int64), np.where(found, weight, 0.0)

    if label_interp == "nearest":
        return [tap(np.floor(u + 0.5), np.floor(v + 0.5), np.ones(len(u)))]
    fu, fv = u - np.floor(u), v - np.floor(v)
    return [tap(np.floor(u) + a, np.floor(v) + b, (fu if a else 1 - fu) * (fv if b else 1 - fv)) for a in (0, 1) for b in (0, 1)]


def picture_taps(size: int) -> tuple[np.ndarray, ...]:
    """The four places in a sector picture, turned a quarter, and the two shares for each pixel r * size + c of its ``size`` x ``size`` picture, bilinear at half-pixel centres."""
    wide, high = PIXELS["i"], PIXELS["j"]

    def place(o: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.maximum((o + 0.5) * (n / size) - 0.5, 0.0)
        low = np.floor(at).astype(np.int64)
        return low, np.minimum(low + 1, n - 1), at - low

    r, c = np.divmod(np.arange(size * size), size)
    (r0, r1, pr), (c0, c1, pc) = place(r, high), place(c, wide)
    see = lambda r, c: (wide - 1 - c) * high + r  # noqa: E731  the turned picture's r, c
    return see(r0, c0), see(r0, c1), see(r1, c0), see(r1, c1), pr, pc


def _projected(found: DataFrame, shape: dict[str, int], keys: Keys, names: tuple[str, str], lines: int, label_interp: str, finish) -> DataFrame:
    """``keys``, two places and v: a batch of rows for each plane, ``lines`` to a first place, of what ``finish`` makes of its sector. What comes from where is the same for all planes, so a plane is a few gathers; Spark deals the planes out."""
    w, h = shape.values()
    kinds = dict(found.dtypes)

    def run(batches):
        taps = sector_taps(w, h, label_interp)
        turn, places = finish(), None
        for b in batches:
            values = b.column(b.num_columns - 1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, w * h)
            for i, plane in enumerate(values):
                plane = np.append(plane, 0.0)
                sector = np.zeros(len(taps[0][0]))
                for at, weight in taps:
                    sector += plane[at] * weight
                out = turn(sector)
                if places is None:
                    places = [pa.array(x.astype(np.int32)) for x in np.divmod(np.arange(len(out)), lines)]
                own = [pa.repeat(b.column(k)[i], len(out)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, *places, pa.array(out)], [*keys, *names, "v"])

    ship(found.sparkSession)
    return found.select(*keys, "matrix").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} int" for n in names), "v double"]))


def sectors(found: DataFrame, shape: dict[str, int], keys: Keys = (), label_interp: str = "bilinear") -> DataFrame:
    """``keys``, i, j, v: the values of all pixels of the sector picture of each plane."""
    return _projected(found, shape, keys, ("i", "j"), PIXELS["j"], label_interp, lambda: lambda sector: sector)


def pictures(found: DataFrame, shape: dict[str, int], size: int, keys: Keys = ()) -> DataFrame:
    """``keys``, r, c, v of the ``size`` x ``size`` pictures: the sector pictures turned a quarter and resized bilinearly at half-pixel centres."""

    def finish():
        a, b, c, d, pr, pc = picture_taps(size)

        def turn(sector):
            upper = sector[a] * (1 - pc) + sector[b] * pc
            lower = sector[c] * (1 - pc) + sector[d] * pc
            return upper * (1 - pr) + lower * pr

        return turn

    return _projected(found, shape, keys, ("r", "c"), size, "bilinear", finish)
