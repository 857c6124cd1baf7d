"""Shared helpers: durable intermediate tables and byte-level text kernels for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import FILE_ROWS, drop, few, materialize, ship  # noqa: F401

#: Texts are processed in slices of about this many bytes, which bounds a worker's memory; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 19


#: Texts of a task of a small table.
TASK_TEXTS = 10_000
#: Bytes of text whose blocks or anchors make a file.
FILE_BYTES = 32 << 20


def compact(docs: DataFrame) -> DataFrame:
    """A stored table of texts in few partitions, if it is small; its rows are counted from the files' footers."""
    return few(docs, docs.count(), TASK_TEXTS)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` on workers that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound(value: Column, body) -> Column:
    """body(x) with ``value`` evaluated once per row, however often ``body`` uses x."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A join side of at most so many rows and bytes is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def checked_broadcast(small: DataFrame) -> DataFrame:
    """``small``, marked for broadcast if its rows and the bytes of its values are counted and within bounds. The count runs where the rows lie."""
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) if "<" in t else F.lit(8) for c, t in small.dtypes]
    rows, size = small.agg(F.count("*"), F.sum(sum(wide, F.lit(16)).cast("long"))).first()
    return F.broadcast(small) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else small


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


# ---------------------------------------------------------------- Arrow text slices


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string or binary column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive row ranges of about ``most`` bytes."""
    data, offsets = utf8(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


# ---------------------------------------------------------------- hashing

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
MIX = tuple(_RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
_POW: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, SLICE_BYTES + 4096), np.uint64)
        size = 1
        while size < len(out):
            step = min(size, len(out) - size)
            out[size : size + step] = out[:step] * U64(pow(base, size, 2**64))
            size += step
        have = out
        if len(out) == SLICE_BYTES + 4096:  # those of a longer text are not kept
            _POW[base] = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_codes(codes: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of codes[i] * base**i, so that any range's polynomial hash takes two reads."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(base, len(codes)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = BASE_INV) -> np.ndarray:
    """Mixed hash of the codes in [start, end), independent of position; the length counts."""
    inv = powers(inverse, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * MIX[63])


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``[^\\x20\\x09-\\x0D]+`` and the offset of each row's first word (n + 1)."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = word[first]
    end = word.copy()
    end[:-1] &= ~word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    end[last] = word[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return range_hash(prefix_codes(BYTE_CODES[data]), s, e)


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their row numbers; a shorter, non-empty row has its whole sequence as one."""
    n = len(hashes)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    full = max(0, n - size + 1)
    sh = np.zeros(full, np.uint64)
    for i in range(size):
        sh += hashes[i : i + full] * MIX[i]
    inside = row[:full] == row[size - 1 :] if full else np.zeros(0, bool)
    out, at = [mix(sh[inside])], [row[:full][inside]]
    count = np.diff(rows)
    for r in np.flatnonzero((count > 0) & (count < size)):
        h = U64(count[r])
        with np.errstate(over="ignore"):
            for i, x in enumerate(hashes[rows[r] : rows[r + 1]]):
                h += x * MIX[16 + i]
        out.append(mix(np.array([h], np.uint64)))
        at.append(np.array([r]))
    sh, row = np.concatenate(out), np.concatenate(at)
    if len(at) > 1:
        order = np.argsort(row, kind="stable")
        sh, row = sh[order], row[order]
    return sh, row


def from_offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def batches(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
