"""Round trips of the file formats, and their refusals."""

import numpy as np
import pytest

from splatframe.functions import quaternion
from splatframe.plans import views
from splatframe.plans.governance import SplatError
from splatframe.sources import glb, ply, sinks, spz

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    kept = views.cloud_canonical(spark, SF).filter("x is not null and opacity > 0.01 and opacity < 0.99").limit(50)
    return kept.persist()


def random_columns(n, degree):
    rng = np.random.default_rng(7)
    q = rng.normal(size=(n, 4))
    return {
        "position": rng.uniform(-100, 100, (n, 3)), "scale": np.exp(rng.uniform(-7, 1, (n, 3))),
        "rotation": q / np.linalg.norm(q, axis=1, keepdims=True), "opacity": rng.uniform(0.01, 0.99, n),
        "sh": rng.uniform(-0.9, 0.9, (n, (degree + 1) ** 2 * 3)),
    }


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
@pytest.mark.parametrize("n", [1, 17, 100])
def test_spz_round_trip(n, degree):
    c = random_columns(n, degree)
    back = spz.unpack(spz.pack(c, degree))
    assert np.abs(back["position"] - c["position"]).max() < 1 / 2048
    assert np.abs(np.log(back["scale"] / c["scale"])).max() < 0.05
    assert np.abs(back["opacity"] - c["opacity"]).max() < 0.01
    turn = 2 * np.arccos(np.clip(np.abs((back["rotation"] * c["rotation"]).sum(axis=1)), 0, 1))
    assert turn.max() < 0.02


def test_splat_rows_round_trip():
    c = random_columns(20, 0)
    back = spz.unpack_splat(spz.pack_splat(c))
    assert np.allclose(back["position"], c["position"], atol=1e-4)
    with pytest.raises(Exception):
        spz.unpack_splat(b"x" * 33)


def values(df):
    """Rows by id, as flat lists of numbers."""
    return {r["splat_id"]: [*(r[n] for n in ("x", "y", "z", "sx", "sy", "sz", "qx", "qy", "qz", "qw", "opacity")), *r["sh"]] for r in df.collect()}


@pytest.mark.parametrize("kind", ["ply", "ply_ascii"])
def test_ply_round_trip(spark, cloud, tmp_path, kind):
    path = str(tmp_path / "a.ply")
    assert sinks.validate_then_write(cloud, path, kind) == []
    back = values(spark.read.format("ply").option("path", path).option("rows", "7").load())
    before = list(values(cloud.orderBy("splat_id")).values())
    assert sorted(back) == list(range(len(before)))
    for row in before:  # parts are joined in the order of partitions
        assert min(np.abs(np.array(row) - other).max() for other in back.values()) < 1e-5
    with pytest.raises(Exception):
        sinks.validate_then_write(cloud, path, kind)


def test_ply_encodings_hold_the_same(spark, cloud, tmp_path):
    batch = cloud.select(*ply.CANONICAL.names).toArrow().combine_chunks().to_batches()[0]
    rows, _ = ply.encode(batch, 0)
    spark.dataSource.register(ply.PlyDataSource)
    found = {}
    for encoding, body in {"ascii": ply.ascii_rows(rows), "binary_little_endian": rows.tobytes(), "binary_big_endian": rows.astype([(n, ">f4") for n in rows.dtype.names]).tobytes()}.items():
        path = tmp_path / f"{encoding}.ply"
        path.write_bytes(ply.header_bytes(len(rows), 0, encoding) + body)
        found[encoding] = values(spark.read.format("ply").option("path", str(path)).load())
    assert found["ascii"] == found["binary_little_endian"] == found["binary_big_endian"] and len(found["ascii"]) == len(rows)


@pytest.mark.parametrize("body", [b"1 2 3_0\n", b"1 2\n", b"1 2 3 4\n", b"1 2 x\n", b"1 0x2 3\n", b"", b"1 2 3e\n"])
def test_ascii_rows_are_whole(body):
    header = ply.parse_header(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n")
    with pytest.raises(SplatError):
        ply.parse_ascii(body, header)
    assert ply.parse_ascii(b"\n1 -2.5e1 .5\n9 9 9 9\n", header).tolist() == [(1.0, -25.0, 0.5)]


def test_nothing_is_written_of_an_invalid_cloud(spark, cloud, tmp_path):
    from pyspark.sql import functions as F

    bad = cloud.withColumn("opacity", F.when(F.col("splat_id") == cloud.first()["splat_id"], F.lit(2.0)).otherwise(F.col("opacity")))
    for kind in ("ply", "ply_ascii", "spz", "splat", "glb"):
        for df in (bad, cloud.limit(0)):
            with pytest.raises(ValueError):
                sinks.validate_then_write(df, str(tmp_path / f"x.{kind}"), kind)
    assert list(tmp_path.iterdir()) == []


def test_files_are_read_back(spark, cloud, tmp_path):
    before = [r for _, r in sorted(values(cloud).items())]
    for kind, tolerance in (("spz", 0.06), ("glb", 1e-6)):
        path = str(tmp_path / f"a.{kind}")
        sinks.validate_then_write(cloud, path, kind)
        back = values((spz.read if kind == "spz" else glb.read_splats)(spark, path))
        assert sorted(back) == list(range(len(before)))
        for k, row in enumerate(before):
            a, b = np.array(row), np.array(back[k])
            if a[6:10] @ b[6:10] < 0:
                b[6:10] = -b[6:10]
            assert np.abs(a[:3] - b[:3]).max() < 1e-3 and np.abs(np.log(a[3:6] / b[3:6])).max() < tolerance and np.abs(a[6:11] - b[6:11]).max() < max(tolerance / 3, 1e-5)
    path = str(tmp_path / "a.splat")
    sinks.validate_then_write(cloud, path, "splat")
    assert len(spz.unpack_splat(open(path, "rb").read())["position"]) == len(before)
    sinks.validate_then_write(cloud, path, "splat", overwrite=True)


def test_spz_of_version_1_and_values_that_are_not_finite():
    import gzip
    import struct

    p = np.array([[1.5, -2.0, 0.25], [100.0, 0.0, -7.0]])
    body = struct.pack("<IIIBBBB", spz.MAGIC, 1, 2, 0, 12, 0, 0) + p.astype("<f2").tobytes() + bytes([128, 255]) + bytes([128] * 6) + bytes([160] * 6) + bytes([128, 128, 128] * 2)
    assert np.allclose(spz.unpack(gzip.compress(body))["position"], p)
    for name in ("position", "scale", "opacity", "sh", "rotation"):
        c = random_columns(3, 0)
        c[name] = c[name].copy()
        c[name].flat[0] = np.nan
        with pytest.raises(SplatError):
            spz.pack(c, 0)


def mesh_document(uri=None):
    """Two triangles under a turned and stretched node; colours on the second primitive alone."""
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]], "<f4")
    n = np.array([[0, 0, 1], [0, 1, 0], [1, 0, 0]], "<f4")
    c = np.array([[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255]], "u1")
    data = p.tobytes() + n.tobytes() + c.tobytes()
    views = [{"buffer": 0, "byteOffset": a, "byteLength": b} for a, b in ((0, 36), (36, 36), (72, 12))]
    kinds = [(5126, "VEC3", False), (5126, "VEC3", False), (5121, "VEC4", True)]
    document = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}],
        "nodes": [{"children": [1], "translation": [10, 0, 0]}, {"mesh": 0, "scale": [2, 1, 1], "rotation": [0, 0, np.sqrt(0.5), np.sqrt(0.5)]}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "NORMAL": 1}}, {"attributes": {"POSITION": 0, "COLOR_0": 2}}]}],
        "accessors": [{"bufferView": k, "componentType": t, "type": w, "count": 3, "normalized": z} for k, (t, w, z) in enumerate(kinds)],
        "bufferViews": views, "buffers": [{"byteLength": len(data)} | ({"uri": uri} if uri else {})],
    }
    return document, data


@pytest.mark.parametrize("kind", ["glb", "gltf", "embedded"])
def test_mesh_vertices(spark, tmp_path, kind):
    import base64
    import json

    from splatframe.operators import mesh

    document, data = mesh_document({"glb": None, "gltf": "some%20data.bin", "embedded": "data:application/octet-stream;base64," + base64.b64encode(mesh_document()[1]).decode()}[kind])
    path = tmp_path / f"m.{'glb' if kind == 'glb' else 'gltf'}"
    path.write_bytes(glb.build_glb(document, data) if kind == "glb" else json.dumps(document).encode())
    if kind == "gltf":
        (tmp_path / "some data.bin").write_bytes(data)
    rows = glb.read_mesh(spark, str(path)).orderBy("splat_id").collect()
    at = [(10, 0, 0), (10, 2, 0), (9, 0, 0)]  # stretched along x, then turned by a quarter about z
    assert np.allclose([[r[n] for n in "xyz"] for r in rows], at * 2)
    assert np.allclose([[r[n] for n in ("nx", "ny", "nz")] for r in rows[:3]], [(0, 0, 1), (-1, 0, 0), (0, 1, 0)])
    assert all(r["nx"] is None for r in rows[3:]) and all(r["r"] is None for r in rows[:3])
    assert [[r[n] for n in "rgb"] for r in rows[3:]] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    assert mesh.basic(glb.read_mesh(spark, str(path))).count() == 6
    with pytest.raises(SplatError):
        glb.read_splats(spark, str(path))


@pytest.mark.parametrize("uri", ["../secret.bin", "/etc/passwd", "file:///etc/passwd", "http://x/y", "a/../../b", "..%2Fsecret.bin", "C:\\x", "link.bin"])
def test_buffers_outside_the_folder_are_refused(spark, tmp_path, uri):
    import json

    inside = tmp_path / "in"
    inside.mkdir()
    document, data = mesh_document(uri)
    (tmp_path / "secret.bin").write_bytes(data)
    (inside / "link.bin").symlink_to(tmp_path / "secret.bin")
    (inside / "m.gltf").write_text(json.dumps(document))
    with pytest.raises(SplatError):
        glb.read_mesh(spark, str(inside / "m.gltf"))


def test_one_file_is_replaced_in_one_step(spark, tmp_path):
    from splatframe.sources.files import read_bytes, write_bytes

    path = str(tmp_path / "f.bin")
    write_bytes(spark, path, b"one")
    with pytest.raises(SplatError):
        write_bytes(spark, path, b"two")
    write_bytes(spark, path, b"two", overwrite=True)
    assert read_bytes(spark, path) == b"two" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["f.bin"]


def test_limits():
    from splatframe.plans.governance import limits

    assert limits("web", splats=5)["splats"] == 5
    for bad in ({"splats": 0}, {"splats": 1 << 60}, {"unknown": 3}, {"splats": None}, {"decoded_bytes": 1}, {"depth": 1 << 20}):
        with pytest.raises(SplatError):
            limits("server", **bad)


@pytest.mark.parametrize("head", [b"", b"plx\n", b"ply\nformat strange 1.0\nend_header\n", b"ply\nformat ascii 1.0\nelement vertex -1\nend_header\n"])
def test_ply_refuses(head):
    with pytest.raises(Exception):
        ply.parse_header(head)


def test_glb_round_trip():
    document, binary = glb.parse_glb(glb.build_glb({"asset": {"version": "2.0"}}, b"\x01\x02\x03\x04"))
    assert document["asset"]["version"] == "2.0" and bytes(binary[:4]) == b"\x01\x02\x03\x04"
    with pytest.raises(Exception):
        glb.parse_glb(b"glTX" + b"\0" * 20)


def test_null_normal_has_null_quaternion(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*quaternion.from_normal(F.lit(0.0), F.lit(0.0), F.lit(None).cast("double"))).first()
    assert row[3] is None
