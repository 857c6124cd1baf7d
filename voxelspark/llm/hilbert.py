"""Sharding in Hilbert-curve order: metadata dimensions are quantised, rows sorted by their cell's index on the curve, and the order cut into runs.

Rows near each other in all dimensions lie near each other on the curve, so a shard covers a small box of the metadata, and a reader that filters by any of the dimensions skips most shards by their least and greatest values.

1. Each dimension is quantised to ``2**BITS`` cells of about equally many rows: values (of numbers: about 1 % wide bins of their logarithm) are counted, their counts summed up in order, and a value's cell is that
   of its middle row. Only one row for each value is sorted, so a value that a third of all rows have is one row here.
2. A cell's index on the curve comes from Skilling's transformation, in numpy over Arrow batches.
3. Rows are ordered by index, then by a hash of the text (equal texts of equal cells are neighbours), then by id, and numbered over ranges; shard s holds the places from s * n / shards on, so counts are at most one apart.

Defined results: null values have a cell of their own, before all others; null texts have no bytes; repeated rows are rows of their own; rows that are equal in all of this may change places with each other; an
empty table gives no rows; other columns, whatever their names, go along in ``shard_documents`` and ``write_shards``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .ordering import numbered

DIMENSIONS, BITS, SHARDS = ("lang", "source", "n_chars"), 6, 24


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the rows of ``cells`` (rows, dimensions), whose numbers have ``bits`` bits; dimensions * bits is at most 63."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the rotations and reflections of each sub-cube, from the coarsest on
        low = (1 << b) - 1
        for i in range(dims):
            upper = (x[i] >> b) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[i] ^= swap
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b) & 1
    return out


def _bin(kind: str, value: Column) -> Column:
    """An orderable key of a value: strings stand for themselves, numbers for a bin of their logarithm; null is the least."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit("="), value), F.lit(""))
    number = value.cast("double")
    return F.coalesce((F.signum(number) * F.floor(64 * F.log2(1 + F.abs(number)))).cast("int"), F.lit(-(1 << 30)))


def quantised(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """``rows`` with ``cell_<column>``, from the counts of all its values; ``rows`` has them as ``bin_<column>``."""
    key = f"bin_{column}"
    counts = C.materialize(rows.groupBy(key).agg(F.count("*").alias("many")))
    placed = numbered(counts, [], [key], "many")
    middle = (F.col("at") + F.col("many") / 2) / F.col("n")
    cell = F.least(F.floor(middle * (1 << bits)), F.lit((1 << bits) - 1)).cast("int")
    return rows.join(C.checked_broadcast(C.materialize(placed.select(key, cell.alias(f"cell_{column}")))), key)


def ordered(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``docs`` with the cells of ``dimensions`` and curve: a stored table."""
    kinds = dict(docs.dtypes)
    rows = docs.select("*", *[_bin(kinds[d], F.col(d)).alias(f"bin_{d}") for d in dimensions])
    for d in dimensions:
        rows = quantised(rows, d, bits)
    cells = [f"cell_{d}" for d in dimensions]
    rows = rows.drop(*[f"bin_{d}" for d in dimensions]).withColumn("curve", F.lit(0).cast("long"))

    def run(batches):
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in cells], 1) if b.num_rows else np.zeros((0, len(cells)), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(curve_index(at, bits))], schema=b.schema)

    return C.materialize(C.map_arrow(rows, run, rows.schema))


def _placed(rows: DataFrame, shards: int, dimensions: tuple[str, ...], bits: int) -> DataFrame:
    """shard, slot, curve and the fields of ``row`` of ``rows`` (row, dimensions, text_hash, doc_id)."""
    out = numbered(ordered(rows, dimensions, bits), [], ["curve", "text_hash", "doc_id"]).withColumn("shard", F.expr(f"CAST((at * {shards}) DIV n AS INT)"))
    first = F.expr(f"(shard * n + {shards - 1}) DIV {shards}")
    return out.select("row.*", "shard", (F.col("at") - first).alias("slot"), "curve")


def shard_documents(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``docs`` (with doc_id, text and the columns of ``dimensions``) with shard, slot (gapless from 0 in its shard) and curve, in place of columns of these names."""
    kept = [c for c in docs.columns if c not in ("shard", "slot", "curve")]
    return _placed(docs.select(F.struct(*kept).alias("row"), *dimensions, F.xxhash64("text").alias("text_hash"), "doc_id"), shards, dimensions, bits)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> None:
    """Writes whole documents as Parquet, a folder for each shard, sorted by slot; a shard's files are runs of the curve too, so many tasks write one shard."""
    placed = shard_documents(docs, shards, dimensions, bits).drop("curve")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def statistics(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """A row for each shard: its rows, and of each dimension the least and greatest value and the number of nulls."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("least", F.min), ("greatest", F.max), ("nulls", lambda x: F.count_if(F.isnull(x))))])


def relevant(stats: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """The shards that can hold rows with every dimension of ``ranges`` within its (low, high)."""
    keep = F.lit(True)
    for c, (low, high) in ranges.items():
        keep = keep & (F.col(f"least_{c}") <= F.lit(high)) & (F.col(f"greatest_{c}") >= F.lit(low))
    return stats.where(keep).select("shard")


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and curve of every row (doc_id, text, lang, source, n_chars). Only these digests are sorted, not the texts."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    row = F.struct("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = _placed(docs.select(row.alias("row"), *DIMENSIONS, F.xxhash64("text").alias("text_hash"), "doc_id"), shards, DIMENSIONS, BITS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
