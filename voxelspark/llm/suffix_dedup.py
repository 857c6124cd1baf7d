"""Removal of repeated byte strings, resolved with suffix arrays by two-stage sorting.

``repeats`` brings together one copy of every differing passage around a shared anchor. A task joins the passages of its anchors, sorts their suffixes in two stages
(suffixes smaller than their successors are sorted directly, the rest is induced by scanning the buckets of first bytes), and takes adjacent common prefixes:
suffixes next to each other that share ``window`` bytes hold the same string, whose least document is that of the run.
An anchor whose passages are too many for a task is split: its windows are grouped by their bytes, so no task holds all of its passages.

Defined results: as in ``repeats``; a null text is empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import repeats

WINDOW, K = 50, 18
#: Bytes of passages that meet in one task, about; an anchor that has more is split.
BUCKET_BYTES = 2 << 20
SEPARATOR = 0xFF  # no byte of UTF-8


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by at least their first ``depth`` bytes.

    Stage one sorts the suffixes that are smaller than their successors. Stage two fills bucket after bucket (by first byte): the others of a bucket are the predecessors of suffixes
    in lower buckets, in their order, followed by their own predecessors within a run of the same byte; then come the directly sorted ones.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # smaller than the successor: the next different byte is larger; the end counts as smallest
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    run = np.searchsorted(change, np.arange(n))
    after = np.append(text.astype(np.int16), -1)[change + 1]
    small = after[run] > text
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(small)
    key = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(key).view(f"S{depth}").ravel(), kind="stable")]
    split = np.searchsorted(text[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[text[-1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for b in range(256):
        part = np.concatenate([*pending[b], np.zeros(0, np.int64)])
        grown = [part]
        while len(part):
            part = part[part > 0] - 1
            part = part[text[part] == b]
            grown.append(part)
        bucket = np.concatenate([*grown, direct[split[b] : split[b + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        before, byte = before[byte > b], byte[byte > b]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        for x in np.unique(byte):
            pending[x].append(before[np.searchsorted(byte, x) : np.searchsorted(byte, x, "right")])
    return np.concatenate(out)


def common_runs(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Run numbers along ``order``: neighbours with a common prefix of ``depth`` or more share one. All suffixes must have ``depth`` bytes."""
    view = np.lib.stride_tricks.sliding_window_view(text, depth)
    new = np.ones(len(order), bool)
    for i in range(1, len(order), 100_000):
        new[i : i + 100_000] = (view[order[i : i + 100_000]] != view[order[i - 1 : i - 1 + len(new[i : i + 100_000])]]).any(1)
    return np.cumsum(new) - 1


def least_documents(segments: list[np.ndarray], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of every segment, in order: the least document of any segment that has the same window, its segment and its place there."""
    size = np.array([len(x) for x in segments])
    gap = np.array([SEPARATOR], np.uint8)
    text = np.concatenate([y for x in segments for y in (x, gap)])
    begin = C.from_offsets(size + 1)[:-1]
    owner = np.repeat(np.arange(len(segments)), size + 1)
    order = suffix_order(text, window)
    order = order[order + window <= (begin + size)[owner[order]]]
    run = common_runs(text, order, window)
    best = np.minimum.reduceat(docs[owner[order]], np.flatnonzero(np.append(True, run[1:] != run[:-1])))
    out = np.zeros(len(text), np.int64)
    out[order] = best[run]
    window_at = np.flatnonzero(np.arange(len(text)) + window <= (begin + size)[owner])
    return out[window_at], owner[window_at], window_at - begin[owner[window_at]]


def hot_anchors(pieces: DataFrame) -> DataFrame:
    """h of the anchors whose passages are more than ``BUCKET_BYTES``."""
    return C.materialize(pieces.groupBy("h").agg(F.sum(F.octet_length("seg")).alias("size")).where(F.col("size") > BUCKET_BYTES).select("h"))


def by_windows(pieces: DataFrame) -> DataFrame:
    """The runs of ``_resolve`` by grouping windows on their bytes; a window is in the passages of one anchor only."""

    def cut(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                columns = [b.column(k).slice(i, 1000).to_pylist() for k in range(5)]
                rows = [(*x, at, text[at : at + WINDOW]) for *x, text in zip(*columns, strict=True) for at in range(len(text) - WINDOW + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["h", "c", "lo", "hi", "at", "piece"])

    rows = C.map_arrow(pieces.select("h", "c", "lo", "hi", "seg"), cut, "h long, c long, lo long, hi long, at int, piece binary")
    least = rows.groupBy("piece").agg(F.min("lo").alias("least"), F.count("*").alias("copies"))
    # only windows of several passages can have another least document than their own
    joined = rows.join(least.where("copies > 1").drop("copies"), "piece", "left").select("h", "c", "at", "hi", F.coalesce("least", "lo").alias("least"))
    order = Window.partitionBy("h", "c").orderBy("at")
    starts = joined.withColumn("new", F.when(F.col("least") == F.lag("least").over(order), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = starts.groupBy("h", "c", "run").agg(F.min("at").alias("at"), F.count("*").cast("int").alias("length"), F.first("least").alias("least"), F.first("hi").alias("hi")).where("least < hi")
    return runs.groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("at", "length", "least"))).alias("runs"))


def _resolve(segments: DataFrame) -> DataFrame:
    def cut(batches):
        for b in batches:
            data, at = C.utf8(b.column(1))
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
            cuts = {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(b.column(2).type.value_type, b.column(2).flatten().flatten(), strict=True)}
            docs, size = b.column(0).to_numpy()[row], cuts["n"].astype(np.int64) - 1 + WINDOW
            begin = at[row] + cuts["pos"]
            for i in range(0, len(row), 10_000):
                j = slice(i, i + 10_000)
                to = C.from_offsets(size[j])
                seg = data[np.arange(to[-1]) + np.repeat(begin[j] - to[:-1], size[j])]
                seg = pa.BinaryArray.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(seg)])
                yield pa.RecordBatch.from_arrays([pa.array(cuts["h"][j]), pa.array(cuts["c"][j]), pa.array(docs[j]), pa.array(cuts["hi"][j]), seg], ["h", "c", "lo", "hi", "seg"])

    pieces = C.materialize(C.map_arrow(segments, cut, "h long, c long, lo long, hi long, seg binary"))
    stored, hot = pieces, hot_anchors(pieces)
    split = None
    if not hot.isEmpty():  # at most one for every BUCKET_BYTES
        split = by_windows(pieces.join(C.checked_broadcast(hot), "h", "left_semi"))
        pieces = pieces.join(C.checked_broadcast(hot), "h", "left_anti")
    total = pieces.agg(F.sum(F.octet_length("seg"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    def solve(table):
        seg = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("seg")]
        least, owner, at = least_documents(seg, table.column("lo").to_numpy(), WINDOW)
        first = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])))
        length = np.diff(np.append(first, len(least)))
        wanted = least[first] < table.column("hi").to_numpy()[owner[first]]  # runs that mark a document
        first, length = first[wanted], length[wanted]
        runs = pa.StructArray.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(least[first])], ["at", "length", "least"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(len(seg) + 1)).astype(np.int32)), runs)
        return pa.table({"h": table.column("h"), "c": table.column("c"), "runs": lists}).take(np.unique(owner[first]))

    C.ship(pieces.sparkSession)
    runs = pieces.groupBy(F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("bucket")).applyInArrow(solve, repeats.RUNS)
    runs = C.few(runs, buckets, 2)  # a row is little, but a bucket is work
    out = C.materialize(runs if split is None else runs.unionByName(split))
    C.drop(stored)
    return out


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for i, doc, data in repeats.rows(b):
                gone = repeats.covered(b, i, len(data), WINDOW)
                rows.append((doc, len(data), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(gone) else 0, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if rows:
                yield C.batches(schema, [list(x) for x in zip(*rows, strict=True)])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return C.map_arrow(repeats.marked(docs, byte_units, K, WINDOW, _resolve), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
