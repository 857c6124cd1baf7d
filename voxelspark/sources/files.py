"""Files written by executors into a folder that all of them share; each appears whole, under its name, or not at all."""

from __future__ import annotations

import itertools
import os
import shutil
import uuid

from pyspark.sql import DataFrame

from ..session import ship


def local(folder: str) -> str:
    return folder.removeprefix("file://")


def put_parts(parts: DataFrame, folder: str, first: bytes = b"", count: int = 0, missing: bytes = b"") -> None:
    """Writes name, part, content: each name's parts in order after ``first``; parts absent from 0 .. count - 1 are ``missing``. Retried tasks replace files by equal ones."""
    folder = local(folder)

    def run(rows):
        os.makedirs(folder, exist_ok=True)
        for name, group in itertools.groupby(rows, key=lambda r: r["name"]):
            if os.path.basename(name) != name or not name:
                raise ValueError(f"not a file name: {name!r}")
            path = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(path, "wb") as out:
                out.write(first)
                at = 0
                for row in group:
                    if count and not 0 <= row["part"] < count:
                        raise ValueError("part outside the file")
                    out.write(missing * (row["part"] - at) if count else b"")
                    out.write(row["content"])
                    at = row["part"] + 1
                out.write(missing * (count - at) if count else b"")
            os.replace(path, os.path.join(folder, name))

    ship(parts.sparkSession)
    parts.repartition("name").sortWithinPartitions("name", "part").foreachPartition(run)


def archive(folder: str, target: str) -> str:
    """A zip of a folder, made by the driver; an earlier one of that name is replaced."""
    fresh = shutil.make_archive(f"{local(target)}.{uuid.uuid4().hex}", "zip", local(folder))
    os.replace(fresh, f"{local(target)}.zip")
    return f"{local(target)}.zip"
