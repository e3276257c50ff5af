"""PLY files as a Spark data source, for reading and writing.

Reading: the header is parsed on the driver and checked before any row; binary files have a fixed stride, so vertex
ranges are partitions. Text files are one partition. Writing: partitions write their rows' bytes beside the target and
the driver joins them after the header, whose count the commits tell.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from splatframe.functions.color import C0, DIVISORS
from splatframe.functions.sh import coefficients, degree_of_rest
from splatframe.plans.governance import SplatError
from splatframe.schema import CANONICAL, DEFAULT_OPACITY, DEFAULT_SCALE, OPACITY_EDGE

# Spellings of scalar types.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}  # fmt: skip # noqa: E501
ORDER = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
ROWS = 200_000
_KEEP = ("x", "y", "z")


@dataclass(frozen=True)
class Header:
    encoding: str
    count: int
    properties: tuple[tuple[str, str], ...]
    size: int

    @property
    def dtype(self) -> np.dtype:
        order = ORDER[self.encoding] or "<"
        return np.dtype([(n, order + TYPES[t]) for n, t in self.properties])

    @property
    def degree(self) -> int:
        names = {n for n, _ in self.properties}
        rest = sorted(int(n[7:]) for n in names if n.startswith("f_rest_") and n[7:].isdigit())
        if rest != list(range(len(rest))):
            raise SplatError("MK1208", "f_rest is not contiguous")
        degree = degree_of_rest(len(rest))
        if degree is None:
            raise SplatError("MK1209", f"{len(rest)} f_rest values")
        return degree


def parse_header(head: bytes) -> Header:
    """The header of a PLY file; anything that isn't plainly right is refused."""
    end = head.find(b"end_header")
    if not head.startswith(b"ply") or end < 0:
        raise SplatError("MK1201", "no PLY header")
    stop = head.find(b"\n", end)
    if stop < 0:
        raise SplatError("MK1201", "header not ended")
    lines = [x.strip() for x in head[:end].decode("ascii", "strict").split("\n")]
    if lines[0] != "ply":
        raise SplatError("MK1201", "magic")
    encoding, count, element = None, None, None
    properties: list[tuple[str, str]] = []
    for line in lines[1:]:
        words = line.split()
        if not words or words[0] in ("comment", "obj_info"):
            continue
        if words[0] == "format":
            if encoding or len(words) != 3 or words[1] not in ORDER or words[2] != "1.0":
                raise SplatError("MK1202", line)
            encoding = words[1]
        elif words[0] == "element":
            if len(words) != 3 or not words[2].isdigit():
                raise SplatError("MK1203", line)
            if element is None and words[1] != "vertex" or words[1] == "vertex" and count is not None:
                raise SplatError("MK1204", line)
            element = words[1]
            if element == "vertex":
                count = int(words[2])
        elif words[0] == "property":
            if element is None:
                raise SplatError("MK1204", line)
            if element == "vertex":
                if len(words) != 3 or words[1] not in TYPES or words[2] in {n for n, _ in properties}:
                    raise SplatError("MK1205", line)
                properties.append((words[2], words[1]))
        else:
            raise SplatError("MK1206", line)
    if encoding is None or count is None or not {"x", "y", "z"} <= {n for n, _ in properties}:
        raise SplatError("MK1207", "format, vertex or position missing")
    return Header(encoding, count, tuple(properties), stop + 1)


def _column(rows: np.ndarray, name: str) -> np.ndarray:
    return rows[name].astype(np.float64)


def decode(rows: np.ndarray, header: Header, first: int) -> pa.RecordBatch:
    """Training rows as canonical columns."""
    kinds, n = dict(header.properties), len(rows)
    with np.errstate(over="ignore"):
        if "f_dc_0" in kinds:
            dc = np.stack([_column(rows, f"f_dc_{c}") for c in range(3)], axis=1)
        elif {"red", "green", "blue"} <= kinds.keys():
            dc = (np.stack([_column(rows, c) / DIVISORS[kinds[c]] for c in ("red", "green", "blue")], axis=1) - 0.5) / C0
        else:
            dc = np.zeros((n, 3))
        degree = header.degree if "f_dc_0" in kinds else 0
        k = coefficients(degree)
        blocks = np.zeros((n, k, 3))
        blocks[:, 0] = dc
        for i in range(3 * (k - 1)):
            blocks[:, i % (k - 1) + 1, i // (k - 1)] = _column(rows, f"f_rest_{i}")
        opacity = 1 / (1 + np.exp(-_column(rows, "opacity"))) if "opacity" in kinds else np.full(n, DEFAULT_OPACITY)
        scales = [np.exp(_column(rows, f"scale_{c}")) if f"scale_{c}" in kinds else np.full(n, DEFAULT_SCALE) for c in range(3)]
        if all(f"rot_{c}" in kinds for c in range(4)):
            q = np.stack([_column(rows, f"rot_{c}") for c in (1, 2, 3, 0)], axis=1)
            size = np.linalg.norm(q, axis=1, keepdims=True)
            if not (np.abs(size - 1) <= 1e-3).all():
                raise SplatError("MK1212", "rotation is not unit")
            q = q / size
        else:
            q = np.tile([0.0, 0, 0, 1], (n, 1))
    position = [_column(rows, a) for a in "xyz"]
    if not np.isfinite(np.stack(position)).all():
        raise SplatError("MK1504", "position is not finite")
    flat = blocks.reshape(n, -1).astype(np.float32)
    columns = [pa.array(np.arange(first, first + n))]
    columns += [pa.array(v.astype(np.float32)) for v in (*position, *scales, *q.T, opacity)]
    columns.append(pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel()))
    columns.append(pa.array(np.full(n, degree, dtype=np.int32)))
    return pa.RecordBatch.from_arrays(columns, CANONICAL.names)


_WHOLE = re.compile(rb"[+-]?[0-9]+")
_REAL = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|inf|nan)", re.I)


def parse_ascii(body: bytes, header: Header) -> np.ndarray:
    """Whole tokens only, as many to a line as there are properties, in range of their declared types."""
    lines = [x for x in (line.split() for line in body.split(b"\n")) if x][: header.count]
    width = len(header.properties)
    if len(lines) < header.count:
        raise SplatError("MK1210", "rows missing")
    if any(len(x) != width for x in lines):
        raise SplatError("MK1211", "values of a row")
    words = [w for x in lines for w in x]
    out = np.zeros(header.count, dtype=header.dtype)
    table = [words[k :: width][: header.count] for k in range(width)]
    for (name, kind), column in zip(header.properties, table):
        code = TYPES[kind]
        token = _REAL if code[0] == "f" else _WHOLE
        if not all(map(token.fullmatch, column)):
            raise SplatError("MK1211", name)
        values = [float(x) for x in column] if code[0] == "f" else [int(x) for x in column]
        if code[0] != "f":
            info = np.iinfo(code)
            if any(not info.min <= v <= info.max for v in values):
                raise SplatError("MK1211", name)
        out[name] = values
    return out


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    count: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, rows: int = ROWS):
        self.path, self.rows = path, rows
        with open(path, "rb") as f:
            self.header = parse_header(f.read(1 << 20))
            size = os.fstat(f.fileno()).st_size
        if self.header.encoding != "ascii" and size < self.header.size + self.header.count * self.header.dtype.itemsize:
            raise SplatError("MK1210", "file is shorter than its header says")
        self.header.degree  # noqa: B018  refused here, not in a task

    def partitions(self) -> list[InputPartition]:
        step = self.header.count if self.header.encoding == "ascii" else self.rows
        n = self.header.count
        return [_Range(self.path, k, min(step, n - k)) for k in range(0, n, max(step, 1))] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h = self.header
        if not partition.count:
            return
        with open(partition.path, "rb") as f:
            if h.encoding == "ascii":
                f.seek(h.size)
                rows = parse_ascii(f.read(), h)
            else:
                f.seek(h.size + partition.first * h.dtype.itemsize)
                rows = np.frombuffer(f.read(partition.count * h.dtype.itemsize), dtype=h.dtype)
        for k in range(0, len(rows), 20_000):
            yield decode(rows[k : k + 20_000], h, partition.first + k)


def written_dtype(degree: int) -> np.dtype:
    """Rows as they are written: little-endian floats, dummy normals after the position."""
    rest = [f"f_rest_{k}" for k in range(3 * (coefficients(degree) - 1))]
    names = ["x", "y", "z", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *rest, "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]  # fmt: skip # noqa: E501
    return np.dtype([(n, "<f4") for n in names])


def encode(batch: pa.RecordBatch, degree: int) -> tuple[np.ndarray, int]:
    """Canonical columns as rows to write, and how many opacities were clamped."""
    get = lambda n: batch[n].to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros(batch.num_rows, dtype=written_dtype(degree))
    for a in "xyz":
        out[a] = get(a)
    out["nz"] = 1
    k = coefficients(degree)
    flat = np.array(batch["sh"].to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1, 3)[:, :k]
    for c in range(3):
        out[f"f_dc_{c}"] = flat[:, 0, c]
        for i in range(1, k):
            out[f"f_rest_{c * (k - 1) + i - 1}"] = flat[:, i, c]
    p = get("opacity")
    clamped = int(((p <= 0) | (p >= 1)).sum())
    p = np.clip(p, OPACITY_EDGE, 1 - OPACITY_EDGE)
    out["opacity"] = np.log(p / (1 - p))
    for c, n in enumerate(("sx", "sy", "sz")):
        out[f"scale_{c}"] = np.log(get(n))
    for c, n in enumerate(("qw", "qx", "qy", "qz")):
        out[f"rot_{c}"] = get(n)
    return out, clamped


def header_bytes(count: int, degree: int, encoding: str = "binary_little_endian") -> bytes:
    lines = ["ply", f"format {encoding} 1.0", f"element vertex {count}"]
    return "\n".join([*lines, *(f"property float {n}" for n in written_dtype(degree).names), "end_header", ""]).encode()


def ascii_rows(rows: np.ndarray) -> bytes:
    """A line for each row, with nine significant digits: what single precision needs."""
    wide = np.stack([rows[n] for n in rows.dtype.names], axis=1)
    return "".join(" ".join(format(float(v), ".9g") for v in row) + "\n" for row in wide).encode()


@dataclass
class _Written(WriterCommitMessage):
    path: str
    count: int
    clamped: int
    place: int


class PlyWriter(DataSourceArrowWriter):
    """Parts are written beside the target, in a folder that driver and executors share, and joined in order."""

    def __init__(self, path: str, degree: int, overwrite: bool, encoding: str = "binary_little_endian"):
        if encoding not in ("ascii", "binary_little_endian"):
            raise SplatError("MK1202", encoding)
        self.encoding = encoding
        if degree > 3:
            raise SplatError("MK1213", "PLY has harmonics up to degree 3")
        self.path, self.degree, self.overwrite = path, degree, overwrite
        self.held = f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        at = TaskContext.get()
        own, count, clamped = f"{self.held}.{at.partitionId()}.{at.taskAttemptId()}", 0, 0
        with open(own, "wb") as f:
            for batch in iterator:
                rows, n = encode(batch, self.degree)
                f.write(rows.tobytes() if self.encoding != "ascii" else ascii_rows(rows))
                count, clamped = count + len(rows), clamped + n
        return _Written(own, count, clamped, at.partitionId())

    def commit(self, messages: list[_Written | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.place)
        if os.path.exists(self.path) and not self.overwrite:
            self.abort(messages)
            raise SplatError("MK0501", os.path.basename(self.path), "io")
        with open(self.held, "wb") as out:
            out.write(header_bytes(sum(m.count for m in parts), self.degree, self.encoding))
            for m in parts:
                with open(m.path, "rb") as f:
                    while block := f.read(1 << 20):
                        out.write(block)
                os.unlink(m.path)
        os.replace(self.held, self.path)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.unlink(m.path)


class PlyDataSource(DataSource):
    """format("ply"): option path; rows for the vertices of a partition; degree for writing."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        return CANONICAL

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self.options["path"], int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], int(self.options.get("degree", 0)), overwrite, self.options.get("encoding", "binary_little_endian"))
