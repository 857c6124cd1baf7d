"""Removal of repeated word passages through a de Bruijn graph of token k-mers.

The graph's edges are windows of ``WINDOW`` words and its nodes the ``WINDOW`` - 1 words that two consecutive windows share. As an edge can repeat across documents only with its anchor,
``repeats`` deals the graph out by anchors (as super-k-mers, one row for the consecutive edges with one anchor) and leaves those of shared anchors, one copy of each different passage. Then

1. every node of a passage gives a row with the edge before and the edge after it (or the passage's start or end); one aggregate tells nodes with several of either: these branch;
2. a join with the branching nodes cuts the passages there, which compacts their edges to paths that no passage enters or leaves on the way;
3. the words of each path are read at its source's coordinates, and equal paths are those with equal words; the least document of a path holds for all its edges.

Defined results: as in ``repeats``; a null text has no words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import repeats

WINDOW, K = 50, 9


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, rows = C.words(data, offsets)
    return C.word_hashes(data, s, e), rows


#: Stand for the start and the end of a passage among the edges of a node.
START, END = 1, 2


def passages(segments: DataFrame) -> DataFrame:
    """h, c, lo, hi, words (joined by blanks), edges and nodes (one more) of the passages to cut from documents."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("words", pa.binary()), ("edges", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64()))])

    def cut(batches):
        for b in batches:
            for i, j, data, offsets in C.slices(b.column(1), repeats.SLICE):
                s, e, rows = C.words(data, offsets)
                prefix = C.prefix_codes(C.word_hashes(data, s, e))
                out, raw = [], data.tobytes()
                for r in range(i, j):
                    doc = b.column(0)[r].as_py()
                    for x in b.column(2)[r].as_py():
                        at = rows[r - i] + x["pos"] + np.arange(x["n"] + 1)
                        last = at[-1] + WINDOW - 1
                        words = b" ".join(raw[p:q] for p, q in zip(s[at[0] : last].tolist(), e[at[0] : last].tolist(), strict=True))
                        out.append((x["h"], x["c"], doc, x["hi"], words, C.range_hash(prefix, at[:-1], at[:-1] + WINDOW).view(np.int64), C.range_hash(prefix, at, at + WINDOW - 1).view(np.int64)))
                        if len(out) == 5000:
                            yield C.batches(schema, [list(x) for x in zip(*out, strict=True)])
                            out = []
                if out:
                    yield C.batches(schema, [list(x) for x in zip(*out, strict=True)])

    found = C.map_arrow(segments, cut, "h long, c long, lo long, hi long, words binary, edges array<long>, nodes array<long>")
    return found.select("h", "c", "lo", "hi", F.col("words").cast("string").alias("words"), "edges", "nodes")


def branches(cut: DataFrame) -> DataFrame:
    """The nodes (node) with more than one edge before or after them, starts and ends of passages counted as edges."""
    before = F.concat(F.array(F.lit(START).cast("long")), "edges")
    after = F.concat("edges", F.array(F.lit(END).cast("long")))
    sides = cut.select(F.explode(F.arrays_zip(F.col("nodes").alias("node"), before.alias("before"), after.alias("after"))).alias("x")).select("x.*")
    degree = sides.groupBy("node").agg(*[f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("low", F.min), ("high", F.max))])
    return degree.where("before_low <> before_high OR after_low <> after_high").select("node")


def paths(cut: DataFrame) -> DataFrame:
    """h, c, lo, hi, at, length and words of the paths that passages consist of, cut at branching nodes."""
    inner = cut.select("h", "c", F.posexplode(F.slice("nodes", F.lit(2), F.size("edges") - 1)).alias("i", "node"))
    cuts = inner.join(branches(cut), "node", "left_semi").groupBy("h", "c").agg(F.array_sort(F.collect_set(F.col("i") + 1)).alias("cuts"))  # a passage has at most WINDOW - K + 1 edges
    starts = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")))
    ends = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("edges")))
    cut = cut.select("h", "c", "lo", "hi", "words", "edges").join(cuts, ["h", "c"], "left")
    out = cut.select("h", "c", "lo", "hi", F.split("words", " ").alias("words"), F.explode(F.arrays_zip(starts.alias("at"), ends.alias("end"))).alias("x"))
    length = F.col("x.end") - F.col("x.at")
    return out.select("h", "c", "lo", "hi", F.col("x.at").alias("at"), length.alias("length"), F.array_join(F.slice("words", F.col("x.at") + 1, length + (WINDOW - 1)), " ").alias("words"))


def _resolve(segments: DataFrame) -> DataFrame:
    """Least documents of the windows of each segment, by compacted paths."""
    cut = C.materialize(passages(segments))
    found = C.materialize(paths(cut))
    C.drop(cut)
    least = found.groupBy("words").agg(F.min("lo").alias("least"), F.count("*").alias("copies"))
    # only paths of several passages can have another least document than their own
    joined = found.join(least.where("copies > 1").drop("copies"), "words", "left").withColumn("least", F.coalesce("least", "lo")).where("least < hi")
    runs = C.materialize(joined.groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("at", "length", "least"))).alias("runs")), found.count())
    C.drop(found)
    return runs


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for i, doc, units in repeats.rows(b):
                s, e, _ = C.words(units, np.array([0, len(units)]))
                data = units.tobytes()
                gone = repeats.covered(b, i, len(s), WINDOW)
                kept = b" ".join(data[x:y] for x, y in zip(s[~gone].tolist(), e[~gone].tolist(), strict=True))
                rows.append((doc, len(s), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield C.batches(schema, [list(x) for x in zip(*rows, strict=True)])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return C.map_arrow(repeats.marked(docs, word_units, K, WINDOW, _resolve, whole=True), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
