"""NIfTI volumes as a Spark data source: ``spark.read.format("nifti").load(folder)`` and ``planes.write.format("nifti").option("depth", n).save(folder)``, after ``register``.

A row is a plane (``nifti.PLANE_SCHEMA``). Reading asks for the headers only when it is planned; an uncompressed file is then read by byte ranges of planes, and so is a compressed one whose planes are
gzip members that tell their own size, as those written here do. Any other compressed file is one partition and read as a stream. No file or plane range is ever held whole, so files may be larger than 2 GB.
``planes`` ("3-8", ends included) restricts reading to a range of z. Folders must be in a file system that driver and executors mount; ``nifti.planes`` reads from any store, file by file.

A task writes the volumes whose planes it has, in order (``write`` deals them out so), each to a file of its own in a hidden folder. When all tasks are done the driver moves these files to their names, which is a rename each;
if the job fails it deletes the hidden folder, so neither a lost task nor a failed job leaves a file. Planes that a volume lacks are zero. A plane outside the depth, two planes of one place, values that the sample type
cannot hold and planes that are out of order are errors.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import shutil
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..session import ship
from . import nifti
from .files import local

#: Bytes that a partition reads, and the mark of a gzip member that tells its size.
RANGE_BYTES, MARK = 32 << 20, b"VX"


def member(data: bytes) -> bytes:
    """A gzip member with its own size in the extra field."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = MARK + struct.pack("<HI", 4, 20 + len(body) + 8)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def members(path: str) -> list[tuple[int, int]] | None:
    """Offset and size of all gzip members, from their marks alone; None if one has none."""
    out, at, end = [], 0, os.path.getsize(path)
    with open(path, "rb") as f:
        while at < end:
            f.seek(at)
            head = f.read(20)
            if len(head) < 20 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != MARK:
                return None
            size = struct.unpack("<I", head[16:20])[0]
            out.append((at, size))
            at += size
    return out


@dataclass
class Range(InputPartition):
    path: str
    about: dict
    first: int
    last: int  # planes first .. last - 1
    where: list[tuple[int, int]] | None  # members of the planes, if the file has marks
    packed: bool


class NiftiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Range]:
        folder = local(self.options["path"])
        found = [folder] if os.path.isfile(folder) else sorted(glob.glob(os.path.join(glob.escape(folder), self.options.get("pathglobfilter", "*.nii*"))))
        low, high = (int(x) for x in self.options.get("planes", f"0-{1 << 30}").split("-"))
        out = []
        for path in found:
            with open(path, "rb") as f:
                packed = f.read(2) == b"\x1f\x8b"
            with gzip.open(path) if packed else open(path, "rb") as f:
                about = nifti.header(f.read(nifti.HEADER))
            w, h, d = about["shape"]
            size = w * h * about["type"].itemsize
            where = members(path) if packed else None
            where = where[1:] if where is not None and len(where) == d + 1 else None
            first, last = max(0, low), min(d, high + 1)
            many = max(1, RANGE_BYTES // max(1, size)) if where is not None or not packed else d
            for z in range(first, last, many) if not packed or where is not None else ([first] if first < last else []):
                end = min(last, z + many)
                out.append(Range(path, about, z, end, where[z:end] if where is not None else None, packed))
        return out or [Range("", {}, 0, 0, None, False)]

    def read(self, part: Range):
        if part.first >= part.last:
            return
        about = part.about
        w, h, _ = about["shape"]
        kind = about["type"]
        size = w * h * kind.itemsize
        with open(part.path, "rb") as raw:
            if part.packed and part.where is None:
                stream = gzip.GzipFile(fileobj=raw)
                stream.read(about["offset"])
                for _ in range(part.first):  # planes before the range are passed over one by one
                    stream.read(size)
            for i, z in enumerate(range(part.first, part.last)):
                if part.where is not None:
                    raw.seek(part.where[i][0])
                    data = gzip.decompress(raw.read(part.where[i][1]))
                elif part.packed:
                    data = stream.read(size)
                else:
                    raw.seek(about["offset"] + z * size)
                    data = raw.read(size)
                vals = nifti.scaled(np.frombuffer(data, kind, w * h), about)
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip([part.path, z, w, h, about["spacing"], about["direction"], about["origin"], vals], nifti.ARROW, strict=True)], schema=nifti.ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NiftiWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = local(options["path"]), overwrite
        self.depth, self.code = int(options["depth"]), int(options.get("code", 16))
        self.hidden = os.path.join(self.folder, f"._writing-{uuid.uuid4().hex}")

    def write(self, batches) -> Written:
        own = os.path.join(self.hidden, uuid.uuid4().hex)  # an attempt's own folder, so attempts never meet
        os.makedirs(own)
        kind = np.dtype("<" + nifti.SAMPLES[self.code])
        done: list[str] = []
        out, name, at, empty = None, None, 0, b""
        for b in batches:
            for row in b.to_pylist():
                title = os.path.basename(row["path"])
                if not title.endswith(".nii.gz"):
                    raise ValueError(f"not a compressed volume's name: {title!r}")
                if title != name:
                    if out:
                        self._finish(out, at, empty)
                    if title in done:
                        raise ValueError(f"planes of {title} are not together")
                    out, name, at = open(os.path.join(own, title), "wb"), title, 0  # noqa: SIM115
                    done.append(title)
                    about = {c: row[c] for c in ("spacing", "direction", "origin") if row[c] is not None}
                    out.write(member(nifti.encode_header((row["w"], row["h"], self.depth), self.code, **about)))
                    empty = member(bytes(row["w"] * row["h"] * kind.itemsize))
                if not at <= row["z"] < self.depth:
                    raise ValueError(f"plane {row['z']} of {title} is out of order or outside the depth")
                v = np.array(row["vals"], np.float64)
                if len(v) != row["w"] * row["h"]:
                    raise ValueError(f"plane {row['z']} of {title} is not {row['w']} x {row['h']}")
                if kind.kind in "iu" and not ((v >= np.iinfo(kind).min) & (v <= np.iinfo(kind).max)).all():
                    raise ValueError(f"value outside {kind}")
                out.write(empty * (row["z"] - at) + member(v.astype(kind).tobytes()))
                at = row["z"] + 1
        if out:
            self._finish(out, at, empty)
        return Written([os.path.join(own, x) for x in done])

    def _finish(self, out: io.BufferedWriter, at: int, empty: bytes) -> None:
        out.write(empty * (self.depth - at))
        out.close()

    def commit(self, messages: list[Written | None]) -> None:
        files = [x for m in messages if m is not None for x in m.files]
        names = [os.path.basename(x) for x in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks wrote one volume; deal planes out by path")
        old = [] if not self.overwrite else [x for x in glob.glob(os.path.join(glob.escape(self.folder), "*.nii.gz")) if os.path.basename(x) not in names]
        for x in files:
            os.replace(x, os.path.join(self.folder, os.path.basename(x)))
        for x in old:
            os.remove(x)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class NiftiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return nifti.PLANE_SCHEMA

    def reader(self, schema) -> NiftiReader:
        return NiftiReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> NiftiWriter:
        return NiftiWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(NiftiSource)


def planes_of(cells: DataFrame, shape: dict[str, int], value: str, volume: str = "volume_id") -> DataFrame:
    """The planes of cells (``volume``, x, y, z, ``value``), absent cells as 0; a group is one plane."""
    w, h = shape["x"], shape["y"]

    def dense(table: pa.Table) -> pa.Table:
        x, y, v = (table.column(c).to_numpy() for c in ("x", "y", "v"))
        if x.min() < 0 or x.max() >= w or y.min() < 0 or y.max() >= h:
            raise ValueError("cell outside the volume")
        vals = np.zeros((h, w), np.float32)
        vals[y, x] = v
        return pa.Table.from_arrays([pa.array([c], t.type) for c, t in zip([table.column("path")[0].as_py(), table.column("z")[0].as_py(), w, h, None, None, None, vals.ravel()], nifti.ARROW, strict=True)], schema=nifti.ARROW)

    ship(cells.sparkSession)
    known = cells.select(F.concat(F.col(volume).cast("string"), F.lit(".nii.gz")).alias("path"), "x", "y", "z", F.col(value).cast("float").alias("v"))
    return known.groupBy("path", "z").applyInArrow(dense, nifti.PLANE_SCHEMA)


def write(planes: DataFrame, folder: str, depth: int, code: int = 16, mode: str = "append") -> None:
    """Writes planes as ``<path's last part>`` in ``folder``; a task has whole volumes."""
    register(planes.sparkSession)
    os.makedirs(local(folder), exist_ok=True)
    planes.repartition("path").sortWithinPartitions("path", "z").write.format("nifti").option("depth", depth).option("code", code).mode(mode).save(local(folder))
