"""Binary morphology on bit-packed planes: a mask's plane is an array of longs, 64 cells along x in each, and a step is shifts, ORs and ANDs of whole words.

A table of planes has ``keys`` (columns that name a volume), z and one or more masks as array columns; line y of a plane takes words y * ``words`` to (y + 1) * ``words`` - 1, and bits beyond the width are 0. Packing
sends one row for each line (volume, z, y), then the lines of a volume to one task, as bits: 32 MB for 512 x 512 x 1024 cells. All steps after that look at neighbouring planes through
a window over z that is partitioned alike, so dilations, erosions and their combinations run one after the other in the same stage, without another shuffle and without a row for each offset.

The L1 ball of radius n is taken in n crosses: with L(k) the planes at distance k joined, X = L(0), then X = cross(X) joined with L(k) for k = 1 .. n. Outside the volume counts as background (``zero``) or is ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt, materialize

Shape = dict[str, int]


def words(shape: Shape) -> int:
    """Longs of a line."""
    return -(-shape["x"] // 64)


def pack(cells: DataFrame, masks: dict[str, Column], shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """The planes of all volumes that have a cell, dense in z: ``keys``, z and an array for each of ``masks``, which holds the cells where its condition does. Cells outside ``shape`` are left out."""
    wide, h, d = words(shape), shape["y"], shape["z"]
    inside = reduce(lambda a, b: a & b, [F.col(a).between(0, n - 1) for a, n in shape.items()])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("x") % 64).cast("int"))
    word = lambda m, k: F.coalesce(F.bit_or(F.when(m & (F.floor(F.col("x") / 64) == k), bit)), F.lit(0).cast("long"))
    lines = cells.where(inside).groupBy(*keys, "z", "y").agg(*[F.array(*[word(m, k) for k in range(wide)]).alias(n) for n, m in masks.items()])
    planes = dealt(lines, keys).groupBy(*keys, "z").agg(F.collect_list("y").alias("_y"), *[F.collect_list(n).alias(n) for n in masks])
    empty = F.array_repeat(F.lit(0).cast("long"), wide)
    place = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.array_position("_y", y.cast("int")))
    planes = planes.withColumn("_at", place)
    taken = lambda name: lambda p: F.when(p > 0, F.get(name, (p - 1).cast("int"))).otherwise(empty)
    planes = planes.select(*keys, "z", *[F.flatten(F.transform("_at", taken(n))).alias(n) for n in masks])
    over = Window.partitionBy(*keys).orderBy("z")
    first = F.when(F.lag("z").over(over).isNull(), F.lit(0)).otherwise(F.col("z"))
    filled = planes.withColumn("_first", first).withColumn("_next", F.coalesce(F.lead("z").over(over), F.lit(d)))
    filled = filled.withColumn("_to", F.explode(F.sequence(F.col("_first"), F.col("_next") - 1)))
    none = F.array_repeat(F.lit(0).cast("long"), wide * h)
    return filled.select(*keys, F.col("_to").cast("int").alias("z"), *[F.when(F.col("_to") == F.col("z"), F.col(n)).otherwise(none).alias(n) for n in masks])


def _let(value: Column, body) -> Column:
    """body(x) with ``value`` evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def without(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y)))


class _Plane:
    """Words of a plane as seen from a word: of its own line, moved along x, or of other lines; what lies outside is ``out`` (0 or -1)."""

    def __init__(self, plane: Column, i: Column, shape: Shape, out: int):
        self.plane, self.i, self.wide, self.width, self.out = plane, i, words(shape), shape["x"], F.lit(out).cast("long")

    def line(self, dy: int) -> Column:
        return F.get(self.plane, self.i) if dy == 0 else F.coalesce(F.get(self.plane, self.i + dy * self.wide), self.out)

    def full(self, word: Column) -> Column:
        """``word`` of this place, with ``out`` beyond the width."""
        rest = self.width % 64
        if not rest:
            return word
        beyond = self.out.bitwiseAND(F.lit(-1 << rest).cast("long"))
        return F.when(self.i % self.wide == self.wide - 1, word.bitwiseOR(beyond)).otherwise(word) if self.wide > 1 else word.bitwiseOR(beyond)

    def along(self, dx: int) -> Column:
        """The word whose cells are those at x + dx of this line, |dx| < 64."""
        word = self.full(self.line(0))
        if dx == 0:
            return word
        n, step = abs(dx), 1 if dx > 0 else -1
        edge = self.i % self.wide == (self.wide - 1 if dx > 0 else 0)
        near = F.when(edge, self.out).otherwise(F.get(self.plane, self.i + step)) if self.wide > 1 else self.out
        if self.wide > 1 and dx > 0 and self.width % 64:
            beyond = self.out.bitwiseAND(F.lit(-1 << self.width % 64).cast("long"))
            near = F.when(self.i % self.wide == self.wide - 2, near.bitwiseOR(beyond)).otherwise(near)
        return F.shiftrightunsigned(word, n).bitwiseOR(F.shiftleft(near, 64 - n)) if dx > 0 else F.shiftleft(word, n).bitwiseOR(F.shiftrightunsigned(near, 64 - n))

    def inside(self, word: Column) -> Column:
        """``word`` without bits beyond the width."""
        rest = self.width % 64
        mask = F.lit((1 << rest) - 1).cast("long")
        if not rest:
            return word
        return F.when(self.i % self.wide == self.wide - 1, word.bitwiseAND(mask)).otherwise(word) if self.wide > 1 else word.bitwiseAND(mask)


def _joined(parts: list[Column], grow: bool) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b) if grow else a.bitwiseAND(b), parts)


def cross(plane: Column, shape: Shape, grow: bool = True, out: int = 0) -> Column:
    """A plane dilated (or eroded) by a cell and its four neighbours."""

    def body(p):
        def word(_, i):
            see = _Plane(p, i, shape, out)
            return see.inside(_joined([see.along(0), see.along(1), see.along(-1), see.line(1), see.line(-1)], grow))

        return F.transform(p, word)

    return _let(plane, body)


def _moves(plane: Column, shape: Shape, axis: str, steps: list[int], grow: bool, out: int) -> Column:
    """A plane joined with itself moved by ``steps`` along x or y."""

    def body(p):
        def word(_, i):
            see = _Plane(p, i, shape, out)
            return see.inside(_joined([see.along(s) if axis == "x" else see.line(s) for s in steps], grow))

        return F.transform(p, word)

    return _let(plane, body)


def _beside(planes: DataFrame, column: str, k: int, shape: Shape, keys: tuple[str, ...], out: int) -> Column:
    """The plane at z + k, or one of ``out`` words."""
    over = Window.partitionBy(*keys).orderBy("z")
    missing = F.array_repeat(F.lit(out).cast("long"), words(shape) * shape["y"])
    found = F.col(column) if k == 0 else F.lead(column, k).over(over) if k > 0 else F.lag(column, -k).over(over)
    return found if k == 0 else F.coalesce(found, missing)


def _ball(planes: DataFrame, column: str, into: str, n: int, shape: Shape, keys: tuple[str, ...], grow: bool, border: str) -> DataFrame:
    out = -1 if border == "ignore" and not grow else 0
    join = either if grow else both
    near = {f"_k{k}": _beside(planes, column, k, shape, keys, out) for k in range(-n, n + 1) if k}
    found = planes.select("*", *[c.alias(a) for a, c in near.items()])
    x = F.col(column)
    for k in range(1, n + 1):
        x = join(cross(x, shape, grow, out), join(F.col(f"_k{k}"), F.col(f"_k-{k}")))
    return found.withColumn("_new", x).select(*[c for c in planes.columns if c != into], F.col("_new").alias(into))


def _box(planes: DataFrame, column: str, into: str, low: int, high: int, shape: Shape, keys: tuple[str, ...], grow: bool, border: str) -> DataFrame:
    """Offsets ``low`` .. ``high`` along each axis, one axis after the other."""
    out = -1 if border == "ignore" and not grow else 0
    # a dilation moves cells by an offset, so a place sees what lies at minus that; an erosion looks at the offset itself
    steps = [-s if grow else s for s in range(low, high + 1)]
    flat = _moves(_moves(F.col(column), shape, "x", steps, grow, out), shape, "y", steps, grow, out)
    found = planes.withColumn("_flat", flat)
    near = found.select("*", *[_beside(found, "_flat", s, shape, keys, out).alias(f"_s{s}") for s in steps])
    x = reduce(either if grow else both, [F.col(f"_s{s}") for s in steps])
    return near.withColumn("_new", x).select(*[c for c in planes.columns if c != into], F.col("_new").alias(into))


def dilate_ball(planes: DataFrame, column: str, into: str, n: int, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """``planes`` with the mask ``column``, dilated by the L1 ball of radius ``n``, as ``into``."""
    return _ball(planes, column, into, n, shape, keys, True, "zero")


def erode_ball(planes: DataFrame, column: str, into: str, n: int, shape: Shape, keys: tuple[str, ...] = (), border: str = "zero") -> DataFrame:
    return _ball(planes, column, into, n, shape, keys, False, border)


def dilate_box(planes: DataFrame, column: str, into: str, low: int, high: int, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every cell moved by each of ``low`` .. ``high`` along all axes."""
    return _box(planes, column, into, low, high, shape, keys, True, "zero")


def erode_box(planes: DataFrame, column: str, into: str, low: int, high: int, shape: Shape, keys: tuple[str, ...] = (), border: str = "zero") -> DataFrame:
    """Cells all of whose places at ``low`` .. ``high`` along all axes are foreground."""
    return _box(planes, column, into, low, high, shape, keys, False, border)


def dilate_flat(planes: DataFrame, column: str, into: str, n: int, shape: Shape) -> DataFrame:
    """``planes``, each by itself, dilated by the L1 ball of radius ``n`` in the plane."""
    return planes.withColumn(into, reduce(lambda x, _: cross(x, shape), range(n), F.col(column)))


def erode_flat(planes: DataFrame, column: str, into: str, n: int, shape: Shape) -> DataFrame:
    return planes.withColumn(into, reduce(lambda x, _: cross(x, shape, False), range(n), F.col(column)))


def border(shape: Shape) -> Column:
    """The cells of plane z that touch the volume's border."""
    wide, h, last = words(shape), shape["y"], (shape["x"] - 1) % 64
    ones = lambda n: F.lit((1 << n) - 1 if n < 64 else -1).cast("long")
    high = 1 << last if last < 63 else -(1 << 63)
    first = [ones(min(64, shape["x"] - 64 * k)) for k in range(wide)]
    ends = [F.lit(((1 if k == 0 else 0) | (high if k == wide - 1 else 0))).cast("long") for k in range(wide)]
    edge = F.col("z").isin(0, shape["z"] - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.when(edge | (y == 0) | (y == h - 1), F.array(*first)).otherwise(F.array(*ends))))


def bounded_fill(planes: DataFrame, column: str, into: str, rounds: int, shape: Shape, keys: tuple[str, ...] = (), stored: int = 4) -> DataFrame:
    """``planes`` with the mask ``column`` and the background that is not reached from the border in ``rounds`` steps; with enough of them these are its holes.

    Each round widens what is reached by one cross; planes are stored every ``stored`` rounds, so a plan stays short however many there are. It ends early when a stored round reaches nothing new.
    """
    kept = [c for c in planes.columns if c not in (into, "_out")]
    found = planes.withColumn("_out", without(border(shape), F.col(column)))
    count = lambda df: df.agg(F.sum(F.aggregate(F.transform("_out", lambda w: F.bit_count(w)), F.lit(0), lambda a, b: a + b))).first()[0]
    reached = None
    for k in range(rounds):
        grown = dilate_ball(found, "_out", "_grown", 1, shape, keys)
        found = grown.withColumn("_out", without(F.col("_grown"), F.col(column))).drop("_grown")
        if k % stored == stored - 1:
            found, old = materialize(found), reached
            reached = count(found)
            if reached == old:
                break
    full = F.transform(F.col("_out"), lambda w, i: _Plane(F.col("_out"), i, shape, 0).inside(F.bitwise_not(w)))
    return found.withColumn("_new", full).select(*[c for c in kept if c != into], F.col("_new").alias(into))


def lines(planes: DataFrame, column: str, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, z, y and ``column``: the words of each line that is not empty."""
    wide = words(shape)
    cut = _let(F.col(column), lambda bits: F.transform(F.sequence(F.lit(0), F.lit(shape["y"] - 1)), lambda y: F.struct(y.cast("int").alias("y"), F.slice(bits, y * wide + 1, F.lit(wide)).alias(column))))
    return planes.select(*keys, "z", F.explode(F.filter(cut, lambda line: F.exists(line[column], lambda w: w != 0))).alias("_l")).select(*keys, "z", "_l.*")


def has(line: str, x: Column) -> Column:
    """Whether a line's words have the bit of cell x."""
    return F.getbit(F.get(line, F.floor(x / 64).cast("int")), (x % 64).cast("int")) == 1


def unpack(planes: DataFrame, column: str, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, x, y, z of the cells of a mask."""
    found = lines(planes, column, shape, keys).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(shape["x"] - 1))))
    return found.where(has(column, F.col("x"))).select(*keys, "x", "y", "z")


def runs(planes: DataFrame, column: str, shape: Shape, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, z, y, first and last of the maximal runs along x of a mask; no cell is written."""
    at, end = F.sequence(F.lit(0), F.lit(shape["x"] - 1)), shape["x"] - 1
    first = F.filter(at, lambda x: has(column, x) & ((x == 0) | ~has(column, F.greatest(x - 1, F.lit(0)))))
    last = F.filter(at, lambda x: has(column, x) & ((x == end) | ~has(column, F.least(x + 1, F.lit(end)))))
    found = lines(planes, column, shape, keys).select(*keys, "z", "y", F.explode(F.arrays_zip(first.alias("first"), last.alias("last"))).alias("_r"))
    return found.select(*keys, "z", "y", "_r.first", "_r.last")
