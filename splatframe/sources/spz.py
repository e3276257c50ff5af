"""SPZ: one gzip stream a file, so a file is one task. Layout by the public description of the format."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from splatframe.functions.sh import coefficients
from splatframe.plans.governance import Budget, SplatError, limits
from splatframe.schema import CANONICAL

MAGIC, MAX_POINTS, FRACTION = 0x5053474E, 10_000_000, 12
COLOR_SCALE = 0.15
C0 = 0.28209479177387814


def unpack(data: bytes, budget: Budget | None = None) -> dict[str, np.ndarray]:
    """Canonical columns of versions 1 (half-precision positions), 2 and 3."""
    budget = budget or Budget({k: v or 0 for k, v in limits().items()})
    try:
        stream = zlib.decompressobj(31)
        head = stream.decompress(data, 16)
        while len(head) < 16 and stream.unconsumed_tail:
            head += stream.decompress(stream.unconsumed_tail, 16 - len(head))
    except zlib.error:
        raise SplatError("MK1301", "not gzip") from None
    if len(head) < 16:
        raise SplatError("MK1301", "too short")
    magic, version, n, degree, fraction, _, _ = struct.unpack("<IIIBBBB", head)
    if magic != MAGIC or version not in (1, 2, 3):
        raise SplatError("MK1302", f"version {version}", "unsupported")
    if n > MAX_POINTS or degree > 3 or fraction > 23:
        raise SplatError("MK1303", "header")
    rest = 3 * (coefficients(degree) - 1)
    widths = {"position": 6 if version == 1 else 9, "alpha": 1, "color": 3, "scale": 3, "rotation": 4 if version == 3 else 3, "sh": rest}
    need = n * sum(widths.values())
    budget.check_ratio(len(data), need + 16, "spz")
    try:
        body = gzip.decompress(data)[16:]
    except (zlib.error, EOFError, OSError):
        raise SplatError("MK1301", "gzip stream") from None
    if len(body) < need:
        raise SplatError("MK1304", "payload is short")
    parts, at = {}, 0
    for name, width in widths.items():
        parts[name] = np.frombuffer(body, np.uint8, n * width, at).reshape(n, width)
        at += n * width
    if version == 1:
        position = np.ascontiguousarray(parts["position"]).view("<f2").astype(np.float64)
        if not np.isfinite(position).all():
            raise SplatError("MK1305", "position is not finite")
    else:
        p = parts["position"].reshape(n, 3, 3).astype(np.int32)
        fixed = p[:, :, 0] | p[:, :, 1] << 8 | p[:, :, 2] << 16
        position = (fixed - ((fixed & 0x800000) << 1)) / float(1 << fraction)
    dc = (parts["color"] / 255.0 - 0.5) / COLOR_SCALE
    sh = np.concatenate([dc[:, None, :], (parts["sh"].reshape(n, -1, 3) - 128.0) / 128.0], axis=1)
    rotation = _rotation_smallest3(parts["rotation"]) if version == 3 else _rotation_first3(parts["rotation"])
    return {"position": position, "scale": np.exp(parts["scale"] / 16.0 - 10.0), "rotation": rotation, "opacity": parts["alpha"][:, 0] / 255.0, "sh": sh, "degree": np.array(degree)}  # fmt: skip # noqa: E501


def _rotation_first3(raw: np.ndarray) -> np.ndarray:
    v = raw / 127.5 - 1.0
    w = np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1)))
    return np.concatenate([v, w[:, None]], axis=1)


def _rotation_smallest3(raw: np.ndarray) -> np.ndarray:
    """Ten bits (sign and nine) for each of the three smaller parts, from the last; two bits name the largest."""
    word = raw.astype(np.uint32)
    word = word[:, 0] | word[:, 1] << 8 | word[:, 2] << 16 | word[:, 3] << 24
    largest = (word >> 30).astype(np.int64)
    q = np.zeros((len(raw), 4))
    rest = word.copy()
    for k in (3, 2, 1, 0):
        here = largest != k
        size = (rest & 511) / 511.0 * np.sqrt(0.5)
        value = np.where(rest >> 9 & 1, -size, size)
        q[here, k] = value[here]
        rest = np.where(here, rest >> 10, rest)
    q[np.arange(len(raw)), largest] = np.sqrt(np.maximum(0.0, 1 - (q * q).sum(axis=1)))
    return q


def pack(columns: dict[str, np.ndarray], degree: int) -> bytes:
    """A version 3 file of canonical columns."""
    check(columns, degree)
    n = len(columns["position"])
    fixed = np.round(columns["position"] * (1 << FRACTION)).astype(np.int64) & 0xFFFFFF
    position = np.stack([fixed & 255, fixed >> 8 & 255, fixed >> 16 & 255], axis=2).astype(np.uint8)
    byte = lambda v: np.clip(np.round(v), 0, 255).astype(np.uint8)
    sh = columns["sh"].reshape(n, -1, 3)
    q = columns["rotation"] / np.linalg.norm(columns["rotation"], axis=1, keepdims=True)
    largest = np.abs(q).argmax(axis=1)
    q = q * np.where(q[np.arange(n), largest] < 0, -1, 1)[:, None]
    word = largest.astype(np.uint64)
    for k in range(4):
        bits = np.minimum(511, np.floor(511 * np.abs(q[:, k]) / np.sqrt(0.5) + 0.5)).astype(np.uint64) | np.where(q[:, k] < 0, 512, 0).astype(np.uint64)
        word = np.where(largest != k, word << np.uint64(10) | bits, word)
    rotation = np.stack([word >> np.uint64(8 * k) & np.uint64(255) for k in range(4)], axis=1).astype(np.uint8)
    blocks = [
        position, byte(columns["opacity"] * 255), byte((sh[:, 0] * COLOR_SCALE + 0.5) * 255), byte((np.log(columns["scale"]) + 10) * 16), rotation,
        byte(sh[:, 1 : coefficients(degree)] * 128 + 128),
    ]
    head = struct.pack("<IIIBBBB", MAGIC, 3, n, degree, FRACTION, 0, 0)
    return gzip.compress(head + b"".join(np.ascontiguousarray(b).tobytes() for b in blocks), mtime=0)


def check(columns: dict[str, np.ndarray], degree: int) -> None:
    if len(columns["position"]) > MAX_POINTS:
        raise SplatError("MK1310", "too many points", "resource")
    if degree > 3:
        raise SplatError("MK1311", "degree", "unsupported")
    for name in ("position", "scale", "rotation", "opacity", "sh"):
        if not np.isfinite(columns[name]).all():
            raise SplatError("MK1313", f"{name} is not finite")
    if not (columns["scale"] > 0).all() or not (np.abs(columns["rotation"]).max(axis=1, initial=0) > 0).all():
        raise SplatError("MK1314", "scale or rotation")
    if not (np.abs(columns["position"]) < (1 << 23) / (1 << FRACTION)).all():
        raise SplatError("MK1312", "position range")


_FILES = T.StructType([T.StructField("path", T.StringType()), *CANONICAL.fields])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Canonical rows with path, of the files that a path names; each is unpacked in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                c = unpack(data)
                n, flat = len(c["position"]), c["sh"].reshape(len(c["sh"]), -1).astype(np.float32)
                arrays = [pa.array([name] * n, pa.string()), pa.array(np.arange(n))]
                arrays += [pa.array(v.astype(np.float32)) for v in (*c["position"].T, *c["scale"].T, *c["rotation"].T, c["opacity"])]
                arrays.append(pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel()))
                arrays.append(pa.array(np.full(n, int(c["degree"]), np.int32)))
                yield pa.RecordBatch.from_arrays(arrays, _FILES.names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _FILES)


def columns_of(df: DataFrame) -> tuple[dict[str, np.ndarray], int]:
    """A canonical cloud as columns, in order of splat_id; a file is one stream, so rows come to the driver."""
    t = df.orderBy("splat_id").limit(MAX_POINTS + 1).toArrow()
    get = lambda *names: np.stack([t[n].to_numpy() for n in names], axis=1).astype(np.float64)
    degree = int(t["sh_degree"][0].as_py()) if t.num_rows else 0
    return {"position": get("x", "y", "z"), "scale": get("sx", "sy", "sz"), "rotation": get("qx", "qy", "qz", "qw"), "opacity": t["opacity"].to_numpy().astype(np.float64), "sh": np.array(t["sh"].to_pylist(), dtype=np.float64).reshape(t.num_rows, -1)}, degree  # fmt: skip # noqa: E501


SPLAT_ROW = np.dtype([("position", "<f4", 3), ("scale", "<f4", 3), ("color", "u1", 4), ("rotation", "u1", 4)])


def pack_splat(columns: dict[str, np.ndarray]) -> bytes:
    """Rows of 32 bytes: position, scale, RGBA and wxyz in bytes."""
    out = np.zeros(len(columns["position"]), SPLAT_ROW)
    byte = lambda v: np.clip(np.round(v), 0, 255).astype(np.uint8)
    out["position"], out["scale"] = columns["position"], columns["scale"]
    out["color"][:, :3] = byte((columns["sh"].reshape(len(out), -1, 3)[:, 0] * C0 + 0.5) * 255)
    out["color"][:, 3] = byte(columns["opacity"] * 255)
    out["rotation"] = byte(columns["rotation"][:, [3, 0, 1, 2]] * 128 + 128)
    return out.tobytes()


def unpack_splat(data: bytes) -> dict[str, np.ndarray]:
    if len(data) % 32:
        raise SplatError("MK1401", "rows of 32 bytes")
    rows = np.frombuffer(data, SPLAT_ROW)
    q = (rows["rotation"].astype(np.float64) - 128) / 128
    q = q[:, [1, 2, 3, 0]]
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    sh = (rows["color"][:, :3] / 255.0 - 0.5) / C0
    return {"position": rows["position"].astype(np.float64), "scale": rows["scale"].astype(np.float64), "rotation": q, "opacity": rows["color"][:, 3] / 255.0, "sh": sh, "degree": np.array(0)}  # fmt: skip # noqa: E501
