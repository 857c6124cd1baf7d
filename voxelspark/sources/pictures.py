"""PNG pictures of planes and binary glTF point clouds, encoded by executors."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

PARTS = pa.schema([("name", pa.string()), ("part", pa.int32()), ("content", pa.binary())])
PARTS_DDL = "name string, part int, content binary"


def png(image: np.ndarray) -> bytes:
    """8-bit grey (h, w) or colour (h, w, 3) samples as a PNG."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + image[0].size), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">2I5B", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(content: bytes) -> np.ndarray:
    """Samples of a picture that ``png`` made."""
    at, data, head = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + n]
        head, data = (struct.unpack_from(">2I5B", body) if kind == b"IHDR" else head), data + (body if kind == b"IDAT" else b"")
        at += 12 + n
    w, h, deep = head[0], head[1], 3 if head[3] == 2 else 1
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * deep)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].reshape((h, w, 3) if deep == 3 else (h, w))


def slice_pictures(cells: DataFrame, shape: dict[str, int], keys: tuple[str, ...] = ()) -> DataFrame:
    """name (``slice__<z>.png``, after the keys), part 0 and content for each plane of z, r, c, intensity in [0, 1]; absent pixels are black."""
    h, w = shape["r"], shape["c"]

    def run(table: pa.Table) -> pa.Table:
        image = np.zeros((h, w), np.uint8)
        image[table.column("r").to_numpy(), table.column("c").to_numpy()] = np.rint(np.clip(table.column("v").to_numpy(), 0, 1) * 255)
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip([[table.column("name")[0].as_py()], [0], [png(image)]], PARTS, strict=True)], schema=PARTS)

    ship(cells.sparkSession)
    name = F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.concat(F.lit("slice__"), F.col("z").cast("string"), F.lit(".png")))
    return cells.select(name.alias("name"), "r", "c", F.coalesce(F.col("intensity").cast("double"), F.lit(0.0)).alias("v")).groupBy("name").applyInArrow(run, PARTS_DDL)


def glb(points: np.ndarray, colors: np.ndarray) -> bytes:
    """A binary glTF of points (n, 3) with RGBA bytes (n, 4)."""
    points, colors = np.ascontiguousarray(points, "<f4"), np.ascontiguousarray(colors, np.uint8)
    n, place = len(points), points.nbytes
    scene = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0] if n else []}]}
    if n:
        scene |= {
            "nodes": [{"mesh": 0}],
            "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "mode": 0}]}],
            "buffers": [{"byteLength": place + colors.nbytes}],
            "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": place}, {"buffer": 0, "byteOffset": place, "byteLength": colors.nbytes}],
            "accessors": [
                {"bufferView": 0, "componentType": 5126, "count": n, "type": "VEC3", "min": points.min(0).tolist(), "max": points.max(0).tolist()},
                {"bufferView": 1, "componentType": 5121, "normalized": True, "count": n, "type": "VEC4"},
            ],
        }
    text = json.dumps(scene, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    chunks = struct.pack("<I4s", len(text), b"JSON") + text
    if n:
        chunks += struct.pack("<I4s", place + colors.nbytes, b"BIN\0") + points.tobytes() + colors.tobytes()
    return struct.pack("<4s2I", b"glTF", 2, 12 + len(chunks)) + chunks


def read_glb(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Points and colours of a file that ``glb`` made."""
    size = struct.unpack_from("<I", content, 12)[0]
    scene = json.loads(content[20 : 20 + size])
    if "accessors" not in scene:
        return np.zeros((0, 3), np.float32), np.zeros((0, 4), np.uint8)
    n, at = scene["accessors"][0]["count"], 28 + size
    return np.frombuffer(content, "<f4", 3 * n, at).reshape(n, 3), np.frombuffer(content, np.uint8, 4 * n, at + 12 * n).reshape(n, 4)


def clouds(points: DataFrame, volume: str) -> DataFrame:
    """name (``<volume>.glb``), part 0 and content for each volume of sampled points (x, y, z, red, green, blue, alpha). A volume's sample is bounded by its quotas."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda names: np.stack([table.column(c).to_numpy() for c in names], 1)
        content = glb(column(["x", "y", "z"]), column(["red", "green", "blue", "alpha"]))
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip([[table.column("name")[0].as_py()], [0], [content]], PARTS, strict=True)], schema=PARTS)

    ship(points.sparkSession)
    named = points.select(F.concat(F.col(volume).cast("string"), F.lit(".glb")).alias("name"), *[F.col(c).cast("double").alias(c) for c in "xyz"], *[F.col(c).cast("int").alias(c) for c in ("red", "green", "blue", "alpha")])
    return named.groupBy("name").applyInArrow(run, PARTS_DDL)


def decoded(files: DataFrame, kind: str) -> DataFrame:
    """name and rows of pictures (r, c, v) or clouds (x, y, z, red, green, blue, alpha) from name and content."""
    names, ddl = (["r", "c", "v"], "name string, r int, c int, v int") if kind == "png" else (["x", "y", "z", "red", "green", "blue", "alpha"], "name string, x int, y int, z int, red int, green int, blue int, alpha int")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if kind == "png":
                    image = read_png(content)
                    r, c = np.indices(image.shape)
                    columns = [r.ravel(), c.ravel(), image.ravel()]
                else:
                    columns = [x for part in read_glb(content) for x in part.T]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(columns[0]), pa.string()), *[pa.array(x.astype(np.int32)) for x in columns]], ["name", *names])

    ship(files.sparkSession)
    return files.select("name", "content").mapInArrow(run, ddl)
