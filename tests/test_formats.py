"""Round trips of file formats, method registry and stream; new queries against DuckDB."""

import gzip
import struct
import zipfile

import duckdb
import numpy as np
import pytest

from voxelspark import queries
from voxelspark.plans import registry
from voxelspark.sources import demo, files, nifti, pictures

SF = "/root/testdata/sf0.001"


def test_nifti_keeps_values_properties_and_gaps(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0, 0, 0, 1), ("a", 2, 1, 3, 13), ("b", 1, 1, 1, 9)], "volume_id string, x int, y int, z int, label int")
    turned = (0, 1, 0, -1, 0, 0, 0, 0, 1)
    nifti.write(cells, {"x": 3, "y": 2, "z": 4}, str(tmp_path), spacing=(0.5, 2.0, 3.0), direction=turned, origin=(1, -2, 3))
    rows = nifti.planes(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and {(r.w, r.h) for r in rows} == {(3, 2)}
    assert all((r.spacing, r.direction, r.origin) == ([0.5, 2.0, 3.0], list(turned), [1, -2, 3]) for r in rows)
    got = {(r.path[-8], r.x, r.y, r.z, int(r.v)) for r in nifti.voxels(nifti.planes(spark, str(tmp_path))).where("v <> 0").collect()}
    assert got == {tuple(r) for r in cells.collect()}


def test_nifti_header_variants():
    head = bytearray(nifti.encode_header((2, 2, 1), 4))
    struct.pack_into("<h", head, 254, 0)
    about = nifti.header(bytes(head))
    assert about["spacing"] == [1, 1, 1] and about["shape"] == (2, 2, 1)
    struct.pack_into("<h", head, 252, 1)  # half a turn about z
    struct.pack_into("<6f", head, 256, 0, 0, 1, 5, 6, 7)
    about = nifti.header(bytes(head))
    assert about["direction"] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and about["origin"] == [-5, -6, 7]
    with pytest.raises(ValueError):
        nifti.header(b"\0" * 348)
    with pytest.raises(ValueError):
        nifti.header(b"")


def test_nifti_scaling_and_plain_file(spark, tmp_path):
    head = bytearray(nifti.encode_header((2, 1, 1), 4))
    struct.pack_into("<2f", head, 112, 2, -1)
    (tmp_path / "v.nii").write_bytes(bytes(head) + np.array([3, 4], "<i2").tobytes())
    assert nifti.planes(spark, str(tmp_path)).first().vals == [5.0, 7.0]


def test_nifti_refuses_values_and_places_that_do_not_fit(spark, tmp_path):
    for row in [("a", 0, 0, 0, 256), ("a", 3, 0, 0, 1), ("a", 0, 0, 9, 1)]:
        with pytest.raises(Exception, match="outside"):
            nifti.write(spark.createDataFrame([row], "volume_id string, x int, y int, z int, label int"), {"x": 3, "y": 2, "z": 4}, str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith(".")]


def test_pictures_and_clouds_round_trip(spark, tmp_path):
    color = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (pictures.read_png(pictures.png(color)) == color).all()
    empty = pictures.read_glb(pictures.glb(np.zeros((0, 3)), np.zeros((0, 4))))
    assert len(empty[0]) == 0
    parts = pictures.slice_pictures(spark.createDataFrame([(0, 0, 0, 1.0), (2, 1, 1, None)], "z int, r int, c int, intensity double"), {"r": 2, "c": 2})
    files.put_parts(parts, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"slice__0.png", "slice__2.png"}
    assert pictures.read_png((tmp_path / "out/slice__0.png").read_bytes()).tolist() == [[255, 0], [0, 0]]
    for _ in range(2):
        name = files.archive(str(tmp_path / "out"), str(tmp_path / "results"))
    assert len(zipfile.ZipFile(name).namelist()) >= 2
    assert gzip.decompress(gzip.compress(b"x")) == b"x"


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.REGISTRY.get("segmentation", "unknown")
    with pytest.raises(ValueError):
        registry.REGISTRY.names("unknown")
    with pytest.raises(registry.InputValidationError):
        registry.run(spark.range(1), {"x": 1, "y": 1, "z": 1})
    mine = registry.Registry()
    for kind in registry.KINDS:
        for name in registry.REGISTRY.names(kind):
            mine.register(kind, name, registry.REGISTRY.get(kind, name))
    mine.register("segmentation", "all bone", lambda cells, shape: cells.selectExpr("x", "y", "z", "13 AS label"))
    out = registry.run(spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "x int, y int, z int"), {"x": 1, "y": 2, "z": 1}, registry.Config(segmentation="all bone", quota={13: 1}), mine)
    assert out["points"].count() == 1 and out["maps"].count() == 2 and out["counts"].first().n == 2


def test_demo_cloud_is_repeatable_and_in_its_blocks(spark):
    one, two = (sorted(demo.cloud(spark, (2, 13), 50, 7).collect()) for _ in range(2))
    assert one == two and len(one) == 100
    assert all(40 <= r.x < 60 and 40 <= r.y < 60 and -2 <= r.z - 20 - 5 * r.label < 2 for r in one)


@pytest.mark.parametrize("name", ["nifti_round_trip", "picture_round_trip", "cloud_round_trip", "registry_counts", "stream_counts"])
def test_query_equals_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "embeddings", "events"):
        db.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want, got = db.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found: sorted(tuple(map(str, r)) for r in found)
    assert rows(got.select(*columns).collect()) == rows(want.select(*columns).fetchall())


def test_scan_lists_files_without_reading_them(spark, tmp_path):
    from voxelspark.sources import catalog

    for name in ("a.nii.gz", "b_processed_.nii.gz", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    found = catalog.scan(spark, str(tmp_path))
    assert "content" not in found.columns
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in found.collect()) == [("a.nii.gz", 5), ("b_processed_.nii.gz", 5)]
    assert catalog.unprocessed(found).count() == 1
