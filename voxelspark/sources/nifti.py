"""NIfTI-1 volumes, read plane by plane and written as one gzip member per plane.

Reading holds a compressed file and one plane at a time; a file is limited to 2 GB, as it is one value of Spark's ``binaryFile`` reader. Writing compresses planes in
parallel and appends them in order, so no task holds a volume. Every value of a cell is carried as float; absent cells are written as 0.
"""

from __future__ import annotations

import gzip
import io
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .files import put_parts

HEADER = 348
# The format's codes of sample types.
SAMPLES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
PLANE_SCHEMA = "path string, z int, w int, h int, spacing array<double>, direction array<double>, origin array<double>, vals array<float>"


ARROW = pa.schema([("path", pa.string()), ("z", pa.int32()), ("w", pa.int32()), ("h", pa.int32())] + [(n, pa.list_(pa.float64())) for n in ("spacing", "direction", "origin")] + [("vals", pa.list_(pa.float32()))])


def scaled(samples: np.ndarray, about: dict) -> np.ndarray:
    vals = samples.astype(np.float32)
    if about["slope"] not in (0, 1) or about["inter"]:
        vals = vals * np.float32(about["slope"] or 1) + np.float32(about["inter"])
    return vals


def _matrix(head: bytes, e: str) -> np.ndarray:
    """The 3 x 4 matrix from cells to space: rows if given, else the quaternion, else the cell sizes alone."""
    pixdim = struct.unpack_from(e + "8f", head, 76)
    qform, sform = struct.unpack_from(e + "2h", head, 252)
    if sform > 0:
        return np.array(struct.unpack_from(e + "12f", head, 280), float).reshape(3, 4)
    if qform <= 0:
        return np.hstack([np.diag(pixdim[1:4]).astype(float), np.zeros((3, 1))])
    b, c, d, *offset = struct.unpack_from(e + "6f", head, 256)
    a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    turn = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])
    v = np.array([b, c, d])
    rotation = 2 * np.outer(v, v) + (a * a - v @ v) * np.eye(3) + 2 * a * turn
    scale = np.array(pixdim[1:4]) * [1, 1, -1 if pixdim[0] < 0 else 1]
    return np.hstack([rotation * scale, np.array(offset)[:, None]])


def header(head: bytes) -> dict:
    """Byte order, sample type, shape, scaling and properties (direction and origin in left-posterior-superior axes); ValueError for what is not NIfTI-1."""
    if len(head) < HEADER or head[344:348] not in (b"n+1\0", b"ni1\0"):
        raise ValueError("not a NIfTI-1 file")
    e = "<" if struct.unpack_from("<i", head)[0] == HEADER else ">"
    dim = struct.unpack_from(e + "8h", head, 40)
    code = struct.unpack_from(e + "h", head, 70)[0]
    if code not in SAMPLES:
        raise ValueError(f"unknown sample type {code}")
    offset, slope, inter = struct.unpack_from(e + "3f", head, 108)
    m = _matrix(head, e) * np.array([[-1.0], [-1.0], [1.0]])
    spacing = np.linalg.norm(m[:, :3], axis=0)
    direction = m[:, :3] / np.where(spacing > 0, spacing, 1)
    shape = tuple(max(1, d) if i < dim[0] else 1 for i, d in enumerate(dim[1:4]))
    return {"type": np.dtype(e + SAMPLES[code]), "shape": shape, "offset": int(offset), "slope": slope, "inter": inter, "spacing": spacing.tolist(), "direction": direction.ravel().tolist(), "origin": m[:, 3].tolist()}


def planes(spark: SparkSession, folder: str, pattern: str = "*.nii*") -> DataFrame:
    """One row per plane of every matching file: path, z, w, h, properties and samples with x running fastest."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = io.BytesIO(content.as_buffer())
                file = gzip.GzipFile(fileobj=raw) if raw.getbuffer()[:2] == b"\x1f\x8b" else raw
                head = file.read(HEADER)
                about = header(head)
                file.read(max(0, about["offset"] - HEADER))
                w, h, d = about["shape"]
                for z in range(d):
                    data = file.read(w * h * about["type"].itemsize)
                    vals = scaled(np.frombuffer(data, about["type"], w * h), about)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([path, z, w, h, about["spacing"], about["direction"], about["origin"], vals], ARROW, strict=True)], schema=ARROW)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    return files.mapInArrow(run, PLANE_SCHEMA)


def voxels(rows: DataFrame, name: str = "v") -> DataFrame:
    """path, x, y, z and the value of each cell of ``planes``."""
    cell = rows.select("path", "z", "w", F.posexplode("vals").alias("at", name))
    return cell.select("path", (F.col("at") % F.col("w")).alias("x"), F.floor(F.col("at") / F.col("w")).cast("int").alias("y"), "z", name)


def encode_header(shape: tuple[int, int, int], code: int, spacing=(1.0, 1.0, 1.0), direction=(1, 0, 0, 0, 1, 0, 0, 0, 1), origin=(0, 0, 0)) -> bytes:
    out = bytearray(HEADER + 4)
    struct.pack_into("<i", out, 0, HEADER)
    struct.pack_into("<8h", out, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", out, 70, code, np.dtype(SAMPLES[code]).itemsize * 8)
    struct.pack_into("<8f", out, 76, 1, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", out, 108, HEADER + 4, 1, 0)
    struct.pack_into("<h", out, 254, 1)
    m = np.hstack([np.reshape(direction, (3, 3)) * np.array(spacing), np.reshape(origin, (3, 1))]) * np.array([[-1.0], [-1.0], [1.0]])
    struct.pack_into("<12f", out, 280, *m.ravel())
    out[344:348] = b"n+1\0"
    return bytes(out)


def write(cells: DataFrame, shape: dict[str, int], folder: str, value: str = "label", volume: str = "volume_id", code: int = 2, **properties) -> None:
    """One ``<volume>.nii.gz`` per volume in ``folder``, which driver and executors share. Cells outside ``shape`` are errors, as are values the sample type cannot hold."""
    w, h, d = (shape[a] for a in "xyz")
    kind = np.dtype("<" + SAMPLES[code])
    schema = pa.schema([("name", pa.string()), ("part", pa.int32()), ("content", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        if len(x) and (x.min() < 0 or x.max() >= w or y.min() < 0 or y.max() >= h):
            raise ValueError("cell outside the volume")
        if kind.kind in "iu" and not ((v >= np.iinfo(kind).min) & (v <= np.iinfo(kind).max)).all():
            raise ValueError(f"value outside {kind}")
        plane = np.zeros((h, w), kind)
        plane[y, x] = v
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip([[table.column("name")[0].as_py()], [table.column("z")[0].as_py()], [gzip.compress(plane.tobytes(), mtime=0)]], schema, strict=True)], schema=schema)

    ship(cells.sparkSession)
    known = cells.select(F.concat(F.col(volume).cast("string"), F.lit(".nii.gz")).alias("name"), "x", "y", "z", F.col(value).cast("double").alias("v"))
    first = gzip.compress(encode_header((w, h, d), code, **properties), mtime=0)
    put_parts(known.groupBy("name", "z").applyInArrow(pack, "name string, part int, content binary"), folder, first, d, gzip.compress(np.zeros((h, w), kind).tobytes(), mtime=0))
