"""The NIfTI data source: round trips, ranges of planes, large files, and failed jobs that leave nothing."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.sources import nifti, nifti_source

SHAPE = {"x": 5, "y": 4, "z": 7}


@pytest.fixture(scope="module")
def planes(spark):
    nifti_source.register(spark)
    rows = [(v, x, y, z, (x + 5 * y + 20 * z + 7 * v) % 200 - 100) for v in (1, 2, 3) for x in range(5) for y in range(4) for z in range(7) if z != 3]
    cells = spark.createDataFrame(rows, "volume_id int, x int, y int, z int, hu int")
    return nifti_source.planes_of(cells, SHAPE, "hu")


def values(df):
    return {(os.path.basename(r.path), r.z): r.vals for r in df.collect()}


def test_round_trip_and_ranges(spark, planes, tmp_path, monkeypatch):
    nifti_source.write(planes, f"{tmp_path}/a", 7, 4)
    assert sorted(os.listdir(tmp_path / "a")) == ["1.nii.gz", "2.nii.gz", "3.nii.gz"]
    back = spark.read.format("nifti").load(f"{tmp_path}/a")
    want = values(planes) | {(f"{v}.nii.gz", 3): [0.0] * 20 for v in (1, 2, 3)}
    assert values(back) == want
    assert values(nifti.planes(spark, f"{tmp_path}/a")) == want  # the plain reader takes the same files
    some = spark.read.format("nifti").option("planes", "2-4").load(f"{tmp_path}/a")
    assert values(some) == {k: v for k, v in want.items() if 2 <= k[1] <= 4}
    reader = nifti_source.NiftiReader({"path": f"{tmp_path}/a"})
    assert len(reader.partitions()) == 3
    monkeypatch.setattr(nifti_source, "RANGE_BYTES", 80)
    parts = reader.partitions()
    assert len(parts) == 3 * 4 and all(p.where for p in parts)
    assert {(os.path.basename(r.path), r.z): r.vals for p in parts for b in reader.read(p) for r in map(lambda x: type("R", (), x), b.to_pylist())} == want
    nifti_source.write(back, f"{tmp_path}/b", 7, 16)  # what was read can be written
    assert values(spark.read.format("nifti").load(f"{tmp_path}/b")) == want


def test_files_of_others(spark, planes, tmp_path):
    """One gzip member, and none."""
    nifti_source.write(planes.where("path = '1.nii.gz'"), f"{tmp_path}/a", 7, 4)
    want = values(spark.read.format("nifti").load(f"{tmp_path}/a"))
    raw = gzip.decompress((tmp_path / "a" / "1.nii.gz").read_bytes())
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.nii.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "b" / "2.nii").write_bytes(raw)
    got = values(spark.read.format("nifti").load(f"{tmp_path}/b"))
    assert got == {(n, z): v for (_, z), v in want.items() for n in ("1.nii.gz", "2.nii")}
    tail = values(spark.read.format("nifti").option("planes", "5-9").load(f"{tmp_path}/b"))
    assert tail == {k: v for k, v in got.items() if k[1] >= 5}


def test_large_file(spark, planes, tmp_path):
    """3 GB, most of it a hole in the file; only the asked planes are read."""
    w, h, d = 1024, 1024, 3000
    with open(tmp_path / "big.nii", "wb") as f:
        f.write(nifti.encode_header((w, h, d), 2))
        f.seek(nifti.HEADER + 4 + (d - 1) * w * h)
        f.write(bytes([7]) * (w * h))
    assert len(nifti_source.NiftiReader({"path": f"{tmp_path}/big.nii"}).partitions()) == -(-d // 32)
    last = spark.read.format("nifti").option("planes", f"{d - 2}-{d}").load(f"{tmp_path}/big.nii")
    assert sorted((r.z, r.low, r.high) for r in last.select("z", F.array_min("vals").alias("low"), F.array_max("vals").alias("high")).collect()) == [(d - 2, 0.0, 0.0), (d - 1, 7.0, 7.0)]


def test_failed_jobs_leave_nothing(spark, planes, tmp_path):
    nifti_source.write(planes.where("path = '1.nii.gz'"), f"{tmp_path}/a", 7, 4)
    before = (tmp_path / "a" / "1.nii.gz").read_bytes()
    for bad, code in ((planes.withColumn("vals", F.transform("vals", lambda v: v * 1000)), 4), (planes.withColumn("z", F.col("z") + 1), 4), (planes.unionByName(planes), 4), (planes.withColumn("path", F.lit("x.txt")), 4)):
        with pytest.raises(Exception, match="value outside|out of order|name"):
            nifti_source.write(bad, f"{tmp_path}/a", 7, code)
        assert os.listdir(tmp_path / "a") == ["1.nii.gz"] and (tmp_path / "a" / "1.nii.gz").read_bytes() == before


def test_overwrite_and_commit(spark, planes, tmp_path):
    nifti_source.write(planes, f"{tmp_path}/a", 7, 4)
    nifti_source.write(planes.where("path = '2.nii.gz'"), f"{tmp_path}/a", 7, 4, "overwrite")
    assert os.listdir(tmp_path / "a") == ["2.nii.gz"]
    writer = nifti_source.NiftiWriter({"path": f"{tmp_path}/a", "depth": "7", "code": "4"}, False)
    batch = nifti.ARROW.empty_table()
    one = planes.where("path = '1.nii.gz'").orderBy("z").toArrow()
    lost, kept = writer.write(iter(one.to_batches())), writer.write(iter(one.to_batches()))
    assert lost.files != kept.files and os.listdir(tmp_path / "a").count("1.nii.gz") == 0
    writer.commit([kept, writer.write(iter(batch.to_batches()))])  # the attempt that was lost is not committed, and goes
    assert sorted(os.listdir(tmp_path / "a")) == ["1.nii.gz", "2.nii.gz"]


def test_members_tell_their_size(tmp_path):
    data = [np.random.default_rng(i).bytes(1000 * i) for i in range(5)]
    (tmp_path / "x").write_bytes(b"".join(map(nifti_source.member, data)))
    found = nifti_source.members(f"{tmp_path}/x")
    raw = (tmp_path / "x").read_bytes()
    assert [gzip.decompress(raw[a : a + n]) for a, n in found] == data and gzip.decompress(raw) == b"".join(data)
    (tmp_path / "y").write_bytes(gzip.compress(b"x" * 100))
    assert nifti_source.members(f"{tmp_path}/y") is None
