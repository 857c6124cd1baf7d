"""Long repeated spans: which windows of units (bytes or words) also start in a document with a smaller id.

Comparing every window with every other is out of reach, so windows meet through anchors: of the k-mers of a window the one with the least hash (leftmost of equals). Equal windows
have equal anchors. Consecutive windows with one anchor form a block; a block's anchor and content hash (128 bits together) stand for all its windows. So one block, not every window, is shuffled:

1. blocks are sent once, packed as arrays, to segments of anchors; a segment's task drops the anchors that no two documents share;
2. where an anchor has one content, that content's windows have its least document, and its blocks in other documents are marked there;
3. where an anchor has blocks of different content (the ends of repeated passages), or everywhere if the caller wants it (``whole``), one copy of each content is resolved window by window, by the
   caller's method, and its blocks are joined with the result;
4. windows whose least document is smaller than their own are marked, and covered units removed.

Of an anchor that is frequent in a task's texts, a segment gets the ends of each content only; the blocks are joined with the result, a skewed join that Spark splits. So no task holds all of it. Long texts are read in pieces.

Rows are told apart by id, and by text too where some share an id. Rows that share an id are never compared with each other. Rows without an id, null, empty and short texts are passed on whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLICE = 1 << 19
#: Bits of a packed value that hold a place; a piece has fewer units.
PLACE = np.uint64((1 << 20) - 1)
PIECE = 1 << 19
NAMES = ["h", "c", "doc", "t", "pos", "n"]
TYPES = [np.uint64, np.int64, np.int64, np.int64, np.int32, np.int16]
#: Blocks of a task that are sent together; bytes of text whose blocks make a segment; blocks of one anchor in a chunk that are sent one by one.
CHUNK, SEGMENT_BYTES, HOT = 1 << 19, 8 << 20, 64
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]  # bytes, offsets -> codes (or bytes), offsets among codes


def blocks(codes: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, anchor hash and content hash of every block, in order. Codes may be bytes."""
    parts = []
    for base in range(0, len(codes), PIECE):
        end = base + PIECE + window - 1
        o = np.clip(offsets - base, 0, min(end, len(codes)) - base)
        row, begin, *rest = _blocks(codes[base:end], o, k, window)
        parts.append((row, begin + base, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else _blocks(codes, offsets, k, window)


def _blocks(codes: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    n, wide = len(codes), window - k + 1
    valid = np.zeros(max(0, n - window + 1), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[a : max(a, b - window + 1)] = True
    if not valid.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    prefix = C.prefix_codes(C.BYTE_CODES[codes] if codes.dtype == np.uint8 else codes)
    at = np.arange(n - k + 1)
    kmer = C.range_hash(prefix, at, at + k)
    # a k-mer's hash with its place in the low bits: the least of a window names the leftmost of equals too
    low, size = (kmer & ~PLACE) | at.astype(np.uint64), 1
    while size < wide:  # least of doubling ranges
        step = min(size, wide - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    new = np.ones(len(valid) + 1, bool)
    new[1:-1] = low[1 : len(valid)] != low[: len(valid) - 1]
    edge = np.zeros(len(valid) + 1, bool)
    edge[:-1] |= valid
    edge[1:] ^= valid
    new |= edge
    starts = np.flatnonzero(new)
    begin, end = starts[:-1], starts[1:]
    inside = valid[begin]
    begin, end = begin[inside], end[inside]
    row = np.searchsorted(offsets, begin, "right") - 1
    return row, begin, end - begin, kmer[(low[begin] & PLACE).astype(np.int64)], C.range_hash(prefix, begin, end - 1 + window)


def _sent(held: list[tuple[np.ndarray, ...]], segments: int, most: int) -> list[pa.RecordBatch]:
    """Blocks (h, c, doc, t, pos, n) as a row for each segment of h. Of an anchor with more than ``most`` of them, a segment gets the first and the last of each content, marked by a negative n, and the
    blocks themselves go into a row of a negative segment; so a segment has few of an anchor's equal blocks, however many there are."""
    h, c, doc, t, pos, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h, c, doc, t, pos, n = (x[order] for x in (h, c, doc, t, pos, n))
    count = np.diff(np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h)))
    hot = np.repeat(count > most, count)
    parts = [(_segment(h[~hot], segments), *(x[~hot] for x in (h, c, doc, t, pos, n)))]
    if hot.any():
        h, c, doc, t, pos, n = (x[hot] for x in (h, c, doc, t, pos, n))
        order = np.lexsort((pos, t, doc, c, h))
        h, c, doc, t, pos, n = (x[order] for x in (h, c, doc, t, pos, n))
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        ends = new | np.append(new[1:], True)
        parts.append((_segment(h[ends], segments), *(x[ends] for x in (h, c, doc, t, pos)), -n[ends]))
        parts.append((np.full(len(h), -1 - int(doc[0]) % segments), h, c, doc, t, pos, n))
    rows = []
    for seg, *columns in parts:
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
        at = np.append(first, len(seg))
        if not columns[3].any():
            columns[3] = columns[3][:0]
        packed = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.minimum(at, len(x)) * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in columns]
        many = pa.array(np.diff(at).astype(np.int32))
        rows.append(pa.RecordBatch.from_arrays([pa.array(seg[first].astype(np.int32)), many, *packed], ["seg", "many", *NAMES]))
    return pa.Table.from_batches(rows).combine_chunks().to_batches()


def _segment(h: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of h."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def _packed(docs: DataFrame, units: Units, k: int, window: int, segments: int) -> DataFrame:
    """All blocks, packed: seg, many and a binary column of each of ``NAMES``."""

    def run(batches):
        held, many = [], 0
        for b in batches:
            ids, texts = (b.column(x).to_numpy(zero_copy_only=False) for x in (0, 2))
            for i, _, data, offsets in C.slices(b.column(1), SLICE):
                codes, o = units(data, offsets)
                row, begin, n, h, c = blocks(codes, o, k, window)
                h = h << np.uint64(32) | h >> np.uint64(32)  # least hashes are small; their low bits are even
                if len(h):
                    held.append((h, c.view(np.int64), ids[i + row], texts[i + row], (begin - o[row]).astype(np.int32), n.astype(np.int16)))
                    many += len(h)
                if many >= CHUNK:
                    yield from _sent(held, segments, HOT)
                    held, many = [], 0
        if many:
            yield from _sent(held, segments, HOT)

    return C.map_arrow(docs.select("doc_id", "text", "t"), run, "seg int, many int, " + ", ".join(f"{x} binary" for x in NAMES))


#: Rows of ``_met``.
MARK, HIT, CUT, PLAIN = range(4)
MET = "kind byte, h long, c long, doc long, t long, pos int, n short, hi long"


def _unpacked(table: pa.Table) -> list[np.ndarray]:
    out = [C.utf8(table.column(x))[0].view(kind) for x, kind in zip(NAMES, TYPES, strict=True)]
    if len(out[3]) < len(out[0]):  # rows without t have zeros
        many = table.column("many").to_numpy()
        t = np.zeros(len(out[0]), np.int64)
        t[np.repeat(np.diff(C.utf8(table.column("t"))[1]) > 0, many)] = out[3]
        out[3] = t
    return out


def _met(packed: DataFrame, whole: bool) -> DataFrame:
    """What the blocks of a segment say together (``MET``):

    MARK: a block (doc, t, pos, n windows) whose content is its anchor's only one and starts in a smaller document; HIT: a block whose content is to be resolved, or that was too frequent to be sent there;
    CUT: the least place of a content to be resolved, and ``hi``; PLAIN: the least document of a content as in MARK that has hits.
    """

    def rows(kind: int, pick: np.ndarray, **columns: np.ndarray) -> pa.Table:
        made = {"kind": np.full(len(pick), kind, np.int8)} | {name: x[pick] for name, x in columns.items()}
        return pa.table([pa.array(made[f.name]) if f.name in made else pa.nulls(len(pick), f.type) for f in schema], schema=schema)

    schema = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("t", pa.int64()), ("pos", pa.int32()), ("n", pa.int16()), ("hi", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        h, c, doc, t, pos, n = _unpacked(table)
        if table.column("seg")[0].as_py() < 0:
            return rows(HIT, np.arange(len(h)), h=h.view(np.int64), c=c, doc=doc, t=t, pos=pos)
        order = np.argsort(h, kind="stable")
        key, who, what = h[order], doc[order], c[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.minimum.reduceat(who, first) < np.maximum.reduceat(who, first)
        mixed = np.ones(len(first), bool) if whole else np.minimum.reduceat(what, first) != np.maximum.reduceat(what, first)
        size = np.diff(np.append(first, len(key)))
        kept, mixed = order[np.repeat(shared, size)], np.repeat(mixed, size)[np.repeat(shared, size)]
        if not len(kept):
            return rows(HIT, kept)
        group = np.repeat(np.arange(int(shared.sum())), size[shared])
        order = np.lexsort((pos[kept], t[kept], doc[kept], c[kept], group))
        kept, mixed = kept[order], mixed[order]
        h, c, doc, t, pos, n = h[kept].view(np.int64), c[kept], doc[kept], t[kept], pos[kept], n[kept]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        content = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        low, hi = doc[first], doc[np.append(first[1:], len(h)) - 1]
        sent, n = n > 0, np.abs(n)
        lesser = low[content] < doc
        plain = ~mixed[first] & (low < hi) & ~np.logical_and.reduceat(sent, first)
        cut = np.flatnonzero(mixed[first])
        return pa.concat_tables([
            rows(MARK, np.flatnonzero(~mixed & sent & lesser), doc=doc, t=t, pos=pos, n=n),
            rows(HIT, np.flatnonzero(mixed & sent), h=h, c=c, doc=doc, t=t, pos=pos),
            rows(CUT, cut, h=h[first], c=c[first], doc=low, t=t[first], pos=pos[first], n=n[first], hi=hi),
            rows(PLAIN, np.flatnonzero(plain), h=h[first], c=c[first], doc=low, n=n[first]),
        ])

    return packed.groupBy("seg").applyInArrow(run, MET)


def marked(docs: DataFrame, units: Units, k: int, window: int, resolve: Callable[[DataFrame], DataFrame], whole: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with ``marks``: the runs of windows (begin, many) that also start in smaller documents.

    ``resolve`` gets documents with the blocks to cut from them (doc_id, text, cuts of pos, n, h, c, hi) and returns a stored table ``RUNS``: for each content the runs of its windows with one
    least document, if that is less than ``hi``, the greatest document with the content.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    tag = F.xxhash64("text")
    several = known.groupBy("doc_id").agg(F.min(tag).alias("low"), F.max(tag).alias("high")).where("low <> high")
    tag = F.lit(0).cast("long") if several.isEmpty() else tag
    docs, known = docs.withColumn("t", tag), known.withColumn("t", tag)
    size, many = known.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    met = C.materialize(_met(_packed(known, units, k, window, max(1, -(-(size or 0) // SEGMENT_BYTES))), whole))
    wanted = met.where(F.col("kind") == CUT).select(F.col("doc").alias("doc_id"), "t", F.struct("pos", "n", "h", "c", "hi").alias("cut"))
    wanted = wanted.groupBy("doc_id", "t").agg(F.collect_list("cut").alias("cuts"))
    runs = resolve(C.few(known.join(wanted, ["doc_id", "t"]).select("doc_id", "text", "cuts"), many, C.TASK_TEXTS))
    plain = F.array(F.struct(F.lit(0).alias("at"), F.col("n").cast("int").alias("length"), F.col("doc").alias("least")))
    least = met.where(F.col("kind") == PLAIN).select("h", "c", plain.alias("runs")).unionByName(runs)
    found = met.where(F.col("kind") == HIT).select("h", "c", "doc", "t", "pos").join(least.hint("shuffle_hash"), ["h", "c"]).select("doc", "t", "pos", F.explode("runs").alias("run")).where("run.least < doc")
    found = found.select("doc", "t", F.struct((F.col("pos") + F.col("run.at")).cast("int").alias("begin"), F.col("run.length").cast("int").alias("many")).alias("mark"))
    found = found.unionByName(met.where(F.col("kind") == MARK).select("doc", "t", F.struct(F.col("pos").alias("begin"), F.col("n").cast("int").alias("many")).alias("mark")))
    marks = C.materialize(found.groupBy("doc", "t").agg(F.collect_list("mark").alias("marks")).withColumnRenamed("doc", "doc_id"), met.count())
    C.drop(met, runs)
    return C.few(docs.join(marks, ["doc_id", "t"], "left").select("doc_id", "text", "marks"), many, C.TASK_TEXTS)


RUNS = "h long, c long, runs array<struct<at: int, length: int, least: long>>"


def covered(batch: pa.RecordBatch, row: int, size: int, window: int) -> np.ndarray:
    """Which of the ``size`` units of a row of ``marked`` a marked window covers."""
    marks = batch.column(2)[row].values
    if marks is None or not len(marks):
        return np.zeros(size, bool)
    begin, many = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in marks.flatten())
    turn = np.bincount(np.minimum(begin, size), minlength=size + 1) - np.bincount(np.minimum(begin + many - 1 + window, size), minlength=size + 1)
    return np.cumsum(turn[:size]) > 0


def rows(batch: pa.RecordBatch):
    """(row, id, bytes of the text) of a batch of ``marked``."""
    data, at = C.utf8(batch.column(1))
    for i, doc in enumerate(batch.column(0).to_pylist()):
        yield i, doc, data[at[i] : at[i + 1]]
