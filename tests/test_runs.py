"""Components and hole filling on runs against a flood fill in plain Python."""

import itertools
import math
import random

import pytest

from voxelspark.operators import components, runs


def flood(cells, shape):
    """The least linear index of each cell's component."""
    out = {}
    sizes = [*shape.values()]
    index = lambda c: sum(x * n for x, n in zip(c, [math.prod(sizes[i + 1 :]) for i in range(len(sizes))], strict=True))
    for c in sorted(cells, key=index):
        if c in out:
            continue
        todo = [c]
        out[c] = index(c)
        while todo:
            x = todo.pop()
            for i, d in itertools.product(range(len(x)), (-1, 1)):
                y = (*x[:i], x[i] + d, *x[i + 1 :])
                if y in cells and y not in out:
                    out[y] = out[c]
                    todo.append(y)
    return out


def masks(shape, share, seed):
    r = random.Random(seed)
    return {v: {c for c in itertools.product(*map(range, shape.values())) if r.random() < share} for v in (0, 1)}


@pytest.mark.parametrize("shape,block", [({"x": 7, "y": 6, "z": 9}, 3), ({"x": 6, "y": 5, "z": 8}, 64), ({"r": 12, "c": 15}, 4)])
@pytest.mark.parametrize("share", [0.3, 0.55])
def test_components(spark, shape, block, share):
    found = masks(shape, share, 3)
    rows = [(v, *c) for v, cells in found.items() for c in cells]
    given = spark.createDataFrame(rows, "vol int, " + ", ".join(f"{a} int" for a in shape))
    own = runs.from_cells(given, shape, ("vol",))
    labelled = runs.label(own, shape, ("vol",), block)
    want = {(v, *c): n for v, cells in found.items() for c, n in flood(cells, shape).items()}
    assert {tuple(r)[:-1]: r.comp for r in runs.to_cells(labelled, shape, ("vol",), ("comp",)).collect()} == want
    many = {}
    for (v, *_), n in want.items():
        many[v, n] = many.get((v, n), 0) + 1
    assert {(r.vol, r.comp): r.n for r in runs.sizes(labelled, ("vol",)).collect()} == many
    kept = {tuple(r) for r in runs.to_cells(runs.blob_filter(labelled, 1, 4, ("vol",)), shape, ("vol",)).collect()}
    assert kept == {c for c, n in want.items() if 1 < many[c[0], n] <= 4}


@pytest.mark.parametrize("shape,block", [({"x": 6, "y": 7, "z": 8}, 3), ({"r": 14, "c": 11}, 4)])
def test_holes(spark, shape, block):
    found = masks(shape, 0.75, 5)
    given = spark.createDataFrame([(v, *c) for v, cells in found.items() for c in cells], "vol int, " + ", ".join(f"{a} int" for a in shape))
    filled = {tuple(r) for r in runs.to_cells(runs.fill_holes(runs.from_cells(given, shape, ("vol",)), shape, ("vol",), block), shape, ("vol",)).collect()}
    want = set()
    for v, cells in found.items():
        back = {c for c in itertools.product(*map(range, shape.values())) if c not in cells}
        comp = flood(back, shape)
        outside = {comp[c] for c in back if any(x in (0, n - 1) for x, n in zip(c, shape.values(), strict=True))}
        want |= {(v, *c) for c in cells} | {(v, *c) for c in back if comp[c] not in outside}
    assert filled == want and len(want) > sum(map(len, found.values()))


def test_without_keys_and_nothing(spark):
    shape = {"r": 4, "c": 70}
    line = spark.createDataFrame([(1, c) for c in range(70)] + [(3, 0), (3, 2)], "r int, c int")
    own = runs.from_cells(line, shape)
    assert sorted(map(tuple, own.collect())) == [(1, 0, 69), (3, 0, 0), (3, 2, 2)]
    assert sorted(map(tuple, runs.sizes(runs.label(own, shape)).collect())) == [(70, 70), (210, 1), (212, 1)]
    assert runs.label(own.where("false"), shape).count() == 0
    assert runs.fill_holes(own.where("false"), shape).count() == 0
    assert sorted(map(tuple, runs.fill_holes(own, shape).collect())) == [(1, 0, 69), (3, 0, 0), (3, 2, 2)]


def test_same_as_the_operator_on_cells(spark):
    shape = {"r": 9, "c": 9}
    given = spark.createDataFrame([(v, *c) for v, cells in masks(shape, 0.5, 8).items() for c in cells], "plane int, r int, c int")
    a = components.label(given, shape, "plane").select("plane", "r", "c", "comp")
    b = runs.to_cells(runs.label(runs.from_cells(given, shape, ("plane",)), shape, ("plane",), 4), shape, ("plane",), ("comp",))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
