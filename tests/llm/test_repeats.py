"""Repeated spans against brute force: branching passages, equal ids, nulls, pieces of long texts, and the graph's degrees."""

import hashlib
import random
import re

import numpy as np
import pytest

from voxelspark.llm import debruijn_dedup, repeats, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(units, size=50):
    """In order of rows: which units a window covers that also starts in a row with a smaller id."""
    first, out = {}, []
    for i, u in units:
        if i is not None:
            for q in range(len(u) - size + 1):
                first[tuple(u[q : q + size])] = min(i, first.get(tuple(u[q : q + size]), i))
    for i, u in units:
        gone = [False] * len(u)
        for q in range(len(u) - size + 1):
            if i is not None and first[tuple(u[q : q + size])] < i:
                gone[q : q + size] = [True] * size
        out.append(gone)
    return out


def branching(seed, docs=70, n=30):
    """Texts put together from few parts, so that passages fork, join, overlap, start and end in each other."""
    r = random.Random(seed)
    parts = [[f"w{r.randrange(500)}" for _ in range(r.choice([8, 20, 45, 60, 90]))] for _ in range(n)]
    texts = []
    for _ in range(docs):
        w = [x for _ in range(r.randint(1, 7)) for x in r.choice(parts)]
        texts.append(r.choice([" ", "  ", "\n"]).join(w[r.randrange(min(9, len(w))) :]))
    return texts


def rows_of(seed):
    texts = branching(seed)
    rows = list(enumerate(texts, 5))
    r = random.Random(seed)
    r.shuffle(rows)
    # equal rows, rows that share an id with other texts, rows without an id, empty and null ones
    return rows + [rows[3], rows[3], (rows[4][0], texts[9][::-1] + " " + texts[2]), (rows[5][0], texts[1]), (None, texts[7]), (None, None), (1, None), (2, ""), (3, " \n ")]


def words_result(text, gone):
    return len(gone), sum(gone), hashlib.sha256(" ".join(w for w, g in zip(WORD.findall(text or ""), gone, strict=True) if not g).encode()).hexdigest()


def test_words_against_brute_force(spark):
    rows = rows_of(21)
    gone = removed([(i, WORD.findall(t or "")) for i, t in rows])
    want = sorted(((i is not None, i), *words_result(t, g)) for (i, t), g in zip(rows, gone, strict=True) if i is not None)
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, t int, c int, marks string")
    got = debruijn_dedup.remove_repeated_words(frame).collect()
    assert sorted(((True, r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert sum(map(sum, gone)) > 1000


def test_bytes_against_brute_force(spark):
    rows = rows_of(22)
    units = [(i, (t or "").encode()) for i, t in rows]
    want = sorted((i, len(u), sum(g), len(re.findall(b"\x01+", bytes(g))), hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()) for (i, u), g in zip(units, removed(units), strict=True) if i is not None)
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == want and len(got) == len(rows)


@pytest.mark.parametrize("units", [debruijn_dedup.word_units, suffix_dedup.byte_units])
def test_pieces_hold_the_same_windows(monkeypatch, units):
    """Blocks of a text read in pieces: the same windows in order, none twice, the same anchor for each."""
    data = np.frombuffer("\n".join(branching(3)).encode(), np.uint8)
    offsets = np.array([0, 0, 700, 705, len(data) - 900, len(data)])
    codes, o = units(data, offsets)

    def windows():
        row, begin, many, h, _ = repeats.blocks(codes, o, 9, 50)
        return [(r, b + i, x) for r, b, m, x in zip(row.tolist(), begin.tolist(), many.tolist(), h.tolist(), strict=True) for i in range(m)]

    whole = windows()
    assert [w[:2] for w in whole] == [(r, q) for r in range(5) for q in range(o[r], o[r + 1] - 49)]
    monkeypatch.setattr(repeats, "PIECE", 257)
    assert windows() == whole


def test_branches_by_degree(spark):
    """Nodes of passages abcde, xbcd and bcdf by plain counting: passages start or end in, and fork at, some of their inner nodes."""
    made = [(1, 1, 1, 9, "", [12, 23, 34, 45], [1, 2, 3, 4, 5]), (2, 2, 2, 9, "", [62, 23, 34], [6, 2, 3, 4]), (3, 3, 3, 9, "", [23, 34, 47], [2, 3, 4, 7])]
    cut = spark.createDataFrame(made, "h long, c long, lo long, hi long, words string, edges array<long>, nodes array<long>")
    assert {r.node for r in debruijn_dedup.branches(cut).collect()} == {2, 4}
    assert {(r.c, r.at, r.length) for r in debruijn_dedup.paths(cut).collect()} == {(1, 0, 1), (1, 1, 2), (1, 3, 1), (2, 0, 1), (2, 1, 2), (3, 0, 2), (3, 2, 1)}


def test_suffix_order_to_a_depth():
    """Suffixes sorted by at least their first bytes, over all bytes but the separator's neighbours; byte 0 and runs of one byte too."""
    r = random.Random(9)
    for _ in range(40):
        text = np.array([r.choice([0, 0, 1, 97, 97, 254, 255]) for _ in range(r.randint(1, 90))], np.uint8)
        raw, depth = text.tobytes(), r.choice([1, 3, 8])
        got = suffix_dedup.suffix_order(text, depth).tolist()
        assert sorted(got) == list(range(len(raw)))
        keys = [raw[i : i + depth].ljust(depth, b"\0") for i in got]
        assert keys == sorted(keys)


@pytest.mark.parametrize("most", [1, 3, 64])
def test_blocks_cross_the_network_once_and_packed(spark, monkeypatch, most):
    """Small segments and chunks, with anchors too frequent for a segment: the same results, and a row for each segment of a chunk, not for each block."""
    rows = rows_of(23)
    units = [(i, (t or "").encode()) for i, t in rows]
    want = sorted((i, len(u), sum(g), hashlib.sha256(bytes(b for b, x in zip(u, g, strict=True) if not x)).hexdigest()) for (i, u), g in zip(units, removed(units), strict=True) if i is not None)
    monkeypatch.setattr(repeats, "HOT", most)
    monkeypatch.setattr(repeats, "CHUNK", 500)
    monkeypatch.setattr(repeats, "SEGMENT_BYTES", 9000)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeated_bytes(frame).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None) == want
    known = frame.where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr("doc_id", "text", "0L AS t").coalesce(1)
    monkeypatch.setattr(repeats, "CHUNK", 1 << 19)
    sent = repeats._packed(known, suffix_dedup.byte_units, suffix_dedup.K, suffix_dedup.WINDOW, 4).collect()
    texts = [t.encode() for i, t in rows if i is not None and t is not None]
    at = np.cumsum([0, *map(len, texts)])
    assert {r.seg for r in sent if r.seg >= 0} == {0, 1, 2, 3} and len(sent) <= 9 and any(r.seg < 0 for r in sent) == (most < 64)
    assert sum(r.many for r in sent if r.seg < 0) + sum((np.frombuffer(r.n, np.int16) > 0).sum() for r in sent if r.seg >= 0) == len(repeats.blocks(np.frombuffer(b"".join(texts), np.uint8), at, suffix_dedup.K, suffix_dedup.WINDOW)[0])
