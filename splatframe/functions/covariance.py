"""Covariances: expressions for what is unique, numpy over Arrow batches for decompositions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.functions import quaternion
from splatframe.functions.activation import is_finite

NAMES = ("xx", "xy", "xz", "yy", "yz", "zz")
_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _sigma(m: list[Column], s: tuple[Column, Column, Column]) -> list[Column]:
    v = [x * x for x in s]
    return [m[3 * i] * m[3 * j] * v[0] + m[3 * i + 1] * m[3 * j + 1] * v[1] + m[3 * i + 2] * m[3 * j + 2] * v[2] for i, j in _PAIRS]  # fmt: skip # noqa: E501


def covariance(q: quaternion.Quat, scale: tuple[Column, Column, Column]) -> list[Column]:
    """Upper triangle of R diag(s^2) R'; null for a rotation that is not unit or a scale that is not positive."""
    ok = quaternion.is_unit(*q)
    for s in scale:
        ok = ok & is_finite(s) & (s > 0)
    return [F.when(ok, v) for v in _sigma(quaternion.to_matrix(*q), scale)]


def covariance_compat(q: quaternion.Quat, log_scale: tuple[Column, Column, Column]) -> list[Column]:
    """From log scales, without normalising the rotation."""
    return _sigma(quaternion.to_matrix(*q), tuple(F.exp(v) for v in log_scale))


def c_matrix(q: quaternion.Quat, scale: tuple[Column, Column, Column]) -> list[Column]:
    """R diag(s), row-major."""
    m = quaternion.to_matrix(*q)
    return [m[3 * i + j] * scale[j] for i in range(3) for j in range(3)]


def affine(sigma: list[Column], a: list[float]) -> list[Column]:
    """A S A' of an upper triangle and a literal row-major matrix."""
    full = [sigma[0], sigma[1], sigma[2], sigma[1], sigma[3], sigma[4], sigma[2], sigma[4], sigma[5]]
    left = [sum((F.lit(a[3 * i + k]) * full[3 * k + j] for k in range(1, 3)), F.lit(a[3 * i]) * full[j]) for i in range(3) for j in range(3)]  # fmt: skip # noqa: E501
    return [sum((left[3 * i + k] * a[3 * j + k] for k in range(1, 3)), left[3 * i] * a[3 * j]) for i, j in _PAIRS]


def is_singular(a: list[float]) -> bool:
    m = np.array(a, dtype=np.float64).reshape(3, 3)
    return not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-12 * (np.sum(m * m) / 3) ** 1.5


def with_eigenvalues(df: DataFrame) -> DataFrame:
    """Adds v0 <= v1 <= v2 of the columns xx..zz. In steps: one nested expression would repeat its parts many times."""
    mean = (F.col("xx") + F.col("yy") + F.col("zz")) / 3
    df = df.withColumns({"_m": mean, "_off": F.col("xy") * F.col("xy") + F.col("xz") * F.col("xz") + F.col("yz") * F.col("yz")})
    a, d, f = (F.col(n) - F.col("_m") for n in ("xx", "yy", "zz"))
    df = df.withColumn("_p", F.sqrt((a * a + d * d + f * f + 2 * F.col("_off")) / 6))
    by = F.when(F.col("_p") < 1e-300, F.lit(1.0)).otherwise(F.col("_p"))
    df = df.withColumns({f"_{n}": v / by for n, v in (("a", a), ("d", d), ("f", f), ("b", F.col("xy")), ("c", F.col("xz")), ("e", F.col("yz")))})
    a, b, c, d, e, f = (F.col(f"_{n}") for n in "abcdef")
    half = (a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c)) / 2
    df = df.withColumn("_t", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3)
    df = df.withColumns({"v2": F.col("_m") + 2 * F.col("_p") * F.cos("_t"), "v0": F.col("_m") + 2 * F.col("_p") * F.cos(F.col("_t") + 2 * np.pi / 3)})
    return df.withColumn("v1", 3 * F.col("_m") - F.col("v0") - F.col("v2")).drop("_m", "_off", "_p", "_t", *(f"_{n}" for n in "abcdef"))


def with_smallest_axis(df: DataFrame) -> DataFrame:
    """Adds ux, uy, uz: the unit eigenvector of the smallest eigenvalue of xx..zz, by Arrow batches."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("ux", "uy", "uz"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [batch[n].to_numpy(zero_copy_only=False) for n in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")]
            _, vectors = np.linalg.eigh(np.stack(v, axis=1).reshape(-1, 3, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(vectors[:, k, 0]) for k in range(3))], schema.names)

    return df.mapInArrow(run, schema)


def eigen(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descending eigenvalues and their vectors as columns, of a stack of symmetric matrices."""
    values, vectors = np.linalg.eigh(matrices)
    return values[..., ::-1], vectors[..., ::-1]


def rotations_and_scales(matrices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(quaternions xyzw, scales, whether valid): scales are roots of eigenvalues, rotations are proper."""
    values, vectors = eigen(matrices)
    ok = np.isfinite(values).all(axis=-1) & (values[..., 2] >= -1e-12 * np.abs(values[..., 0]))
    scales = np.sqrt(np.maximum(values, 1e-24))
    vectors[np.linalg.det(vectors) < 0, :, 2] *= -1
    return _quaternions(vectors), scales, ok


def _quaternions(m: np.ndarray) -> np.ndarray:
    """xyzw with w not negative, of a stack of rotations."""
    t = m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2]
    q = np.empty((len(m), 4))
    squares = np.stack([1 + 2 * m[:, 0, 0] - t, 1 + 2 * m[:, 1, 1] - t, 1 + 2 * m[:, 2, 2] - t, 1 + t], axis=1)
    sym = lambda i, j: m[:, i, j] + m[:, j, i]
    dif = lambda i, j: m[:, i, j] - m[:, j, i]
    table = np.stack(
        [
            np.stack([squares[:, 0], sym(0, 1), sym(0, 2), dif(2, 1)], axis=1),
            np.stack([sym(0, 1), squares[:, 1], sym(1, 2), dif(0, 2)], axis=1),
            np.stack([sym(0, 2), sym(1, 2), squares[:, 2], dif(1, 0)], axis=1),
            np.stack([dif(2, 1), dif(0, 2), dif(1, 0), squares[:, 3]], axis=1),
        ],
        axis=1,
    )
    best = squares.argmax(axis=1)
    q = table[np.arange(len(m)), best]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    q[q[:, 3] < 0] *= -1
    return q


def decompose(df: DataFrame, prefix: str = "") -> DataFrame:
    """Adds sx..sz, qx..qw and valid, from the columns xx..zz, by Arrow batches."""
    names = ["sx", "sy", "sz", "qx", "qy", "qz", "qw"]
    schema = T.StructType([*df.schema.fields, *(T.StructField(prefix + n, T.DoubleType()) for n in names), T.StructField(prefix + "valid", T.BooleanType())])  # fmt: skip # noqa: E501

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {n: batch[n].to_numpy(zero_copy_only=False) for n in NAMES}
            full = np.stack([v["xx"], v["xy"], v["xz"], v["xy"], v["yy"], v["yz"], v["xz"], v["yz"], v["zz"]], axis=1)
            full = full.reshape(-1, 3, 3).astype(np.float64)
            known = np.isfinite(full).all(axis=(1, 2))
            q, s, ok = rotations_and_scales(np.where(known[:, None, None], full, np.eye(3)))
            out = np.concatenate([s, q], axis=1)
            arrays = [pa.array(out[:, k], mask=~(known & ok)) for k in range(7)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays, pa.array(known & ok)], schema.names)

    return df.mapInArrow(run, schema)


def polar_rotation(a: list[float]) -> list[float] | None:
    """The rotation nearest to a literal matrix; None for reflections and near-singular ones."""
    m = np.array(a, dtype=np.float64).reshape(3, 3)
    values, vectors = np.linalg.eigh(m.T @ m)
    if np.linalg.det(m) <= 0 or values[0] <= 1e-24 * values[2]:
        return None
    return (m @ vectors @ np.diag(values**-0.5) @ vectors.T).ravel().tolist()


def is_proper_rotation(a: list[float], tolerance: float = 1e-6) -> bool:
    m = np.array(a, dtype=np.float64).reshape(3, 3)
    return bool(np.abs(m @ m.T - np.eye(3)).max() <= tolerance and abs(np.linalg.det(m) - 1) <= tolerance)
