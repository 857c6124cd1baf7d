"""Near duplicates against brute force: families around the bound, hubs, blocks, equal ids and odd rows."""

import random
import re

import numpy as np
import pytest

from voxelspark.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def grouped(rows):
    """(id, text) -> least id reachable, by comparing all pairs."""
    sets, root = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(x)): find(i) for i, x in sets}


def families(seed):
    """Texts of a few sources with one to many words changed, so that similarities lie on both sides of 0.75, some linked through others only."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for _ in range(6):
        source = [word() for _ in range(r.choice([30, 80, 200]))]
        for _ in range(25):
            made = list(source)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12])):
                made[r.randrange(len(made))] = word()
            texts.append(" ".join(made))
        for _ in range(8):  # a chain
            source[r.randrange(len(source))] = word()
            texts.append(" ".join(source))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_families_against_brute_force(spark, monkeypatch, small):
    if small:  # many hubs, blocks and pieces
        for name, value in (("STAR", 2), ("BLOCK", 4), ("BLOCK_BYTES", 4000), ("PIECE", 50)):
            monkeypatch.setattr(near_dup, name, value)
    rows = list(enumerate(families(11 if small else 12)))
    want = grouped(rows)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dup.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(rows) - 50


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text, "k", 1, "r"), (3, text, "k", 1, "r"), (None, text, "k", 1, "r"), (9, text.upper(), None, None, None), (4, None, "", 0, ""), (5, " \n", "", 0, ""), (6, "a b", "", 0, ""), (7, "A  b", "", 0, ""), (8, text + " x", "", 0, ""), (8, "another text of some words", "", 0, ""), (2, "another text of some words", "", 0, "")]
    got = near_dup.group_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key string, size int, root string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted([(3, 46, 3, True)] * 2 + [(-1, 46, None, True), (9, 46, 3, False), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 47, 3, False), (8, 1, 2, False), (2, 1, 2, True)])


def test_share_of_candidates_at_the_bound():
    """Pairs of similarity 0.75 share a band: of 400 pairs of sets, all."""
    r = np.random.default_rng(6)
    met = 0
    for _ in range(400):
        x = r.integers(0, 2**63, 350, dtype=np.uint64)
        bands = near_dup.band_hashes(near_dup.super_min_hash(np.concatenate([x[:300], x[50:]]), np.array([0, 300, 600])))
        met += bool((bands[0] == bands[1]).any())
    assert met == 400  # similarity 250 / 350 = 0.714, so a little below the bound


def test_forest_asks_for_some_sets_only():
    sets = [np.arange(100), np.arange(1, 101), np.arange(500, 600), np.arange(501, 601), np.arange(2, 102)]
    assert near_dup.forest(sets, 75, np.ones(5, bool)) == [(1, 0), (3, 2), (4, 0)]
    assert near_dup.forest(sets, 75, np.array([False, False, False, False, True])) == [(1, 0), (4, 0)]
