"""Real spherical harmonics up to degree 3 (blocks up to 4), splat-major: sh[k * 3 + channel]."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Constants of the basis.
C0 = 0.28209479177387814
C1 = 0.4886025119029199
C2 = [1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396]
C3 = [-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435]  # fmt: skip # noqa: E501


def coefficients(degree: int) -> int:
    return (degree + 1) ** 2


def _polynomials(x, y, z) -> list:
    """The basis over anything with arithmetic: columns or arrays."""
    xx, yy, zz = x * x, y * y, z * z
    return [
        C0 + 0 * x,
        -C1 * y, C1 * z, -C1 * x,
        C2[0] * (x * y), C2[1] * (y * z), C2[2] * (2 * zz - xx - yy), C2[3] * (x * z), C2[4] * (xx - yy),
        C3[0] * (y * (3 * xx - yy)), C3[1] * (x * y * z), C3[2] * (y * (4 * zz - xx - yy)),
        C3[3] * (z * (2 * zz - 3 * xx - 3 * yy)), C3[4] * (x * (4 * zz - xx - yy)), C3[5] * (z * (xx - yy)),
        C3[6] * (x * (xx - 3 * yy)),
    ]


def basis(x: Column, y: Column, z: Column) -> list[Column]:
    return _polynomials(x, y, z)


def evaluate(sh: Column, degree: int, direction: tuple[Column, Column, Column]) -> list[Column]:
    """The three channels seen from a unit direction, unclamped and without the 0.5."""
    b = basis(*direction)
    out = []
    for c in range(3):
        terms = [b[k] * sh[3 * k + c].cast("double") for k in range(coefficients(degree))]
        out.append(sum(terms[1:], terms[0]))
    return out


def flat_of(l: Column, n: Column) -> Column:  # noqa: E741
    return l * l + n


def address_of(flat: Column) -> tuple[Column, Column]:
    """(l, n) with flat = l^2 + n."""
    l = F.floor(F.sqrt(flat.cast("double"))).cast("int")  # noqa: E741
    return l, (flat - l * l).cast("int")


def attribute(l: Column, n: Column, prefix: str = "KHR_gaussian_splatting") -> Column:  # noqa: E741
    return F.format_string(prefix + ":SH_DEGREE_%d_COEF_%d", l, n)


def parse_attribute(name: Column, prefix: str = "KHR_gaussian_splatting") -> tuple[Column, Column]:
    """(l, n), null for other names, leading zeros and n above 2l."""
    pattern = "^" + prefix + ":SH_DEGREE_(0|[1-9][0-9]?)_COEF_(0|[1-9][0-9]?)$"
    l, n = (F.regexp_extract(name, pattern, k) for k in (1, 2))  # noqa: E741
    l, n = (F.when(v != "", v).cast("int") for v in (l, n))  # noqa: E741
    ok = (l <= 4) & (n <= 2 * l)
    return F.when(ok, l), F.when(ok, n)


def to_channel_major(sh: Column, degree: int) -> Column:
    """The coefficients above DC, all of one channel together."""
    k = coefficients(degree)
    return F.array(*(sh[3 * i + c] for c in range(3) for i in range(1, k)))


def from_channel_major(dc: Column, rest: Column, degree: int) -> Column:
    k = coefficients(degree)
    return F.array(*(dc[c] if i == 0 else rest[c * (k - 1) + i - 1] for i in range(k) for c in range(3)))


def pad(sh: Column, degree: int) -> Column:
    """Zeros up to the degree's length."""
    need = F.greatest(F.lit(0), F.lit(3 * coefficients(degree)) - F.size(sh))
    return F.concat(sh, F.array_repeat(F.lit(0.0).cast("float"), need.cast("int")))


def truncate(sh: Column, degree: int) -> Column:
    return F.slice(sh, 1, 3 * coefficients(degree))


def degree_of_rest(n: int) -> int | None:
    """The degree that has n coefficients above DC in three channels; None if no degree has."""
    return {0: 0, 9: 1, 24: 2, 45: 3}.get(n)


def directions(n: int = 64) -> np.ndarray:
    """Points of a Fibonacci lattice on the unit sphere."""
    k = np.arange(n) + 0.5
    z = 1 - 2 * k / n
    angle = np.pi * (3 - np.sqrt(5)) * np.arange(n)
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(angle), r * np.sin(angle), z], axis=1)


def band_matrices(rotation: list[float], degree: int) -> list[np.ndarray]:
    """For each degree's band the matrix that turns its coefficients, by least squares over directions."""
    if degree > 3:
        raise ValueError("rotation is defined up to degree 3")
    r = np.array(rotation, dtype=np.float64).reshape(3, 3)
    d = directions()
    here = np.stack([np.broadcast_to(v, len(d)) for v in _polynomials(*d.T)], axis=1)
    back = np.stack([np.broadcast_to(v, len(d)) for v in _polynomials(*(d @ r).T)], axis=1)  # rows of R^-1 d
    out = []
    for l in range(degree + 1):  # noqa: E741
        band = slice(l * l, (l + 1) ** 2)
        out.append(np.linalg.lstsq(here[:, band], back[:, band], rcond=None)[0])
    return out


def rotate(sh: Column, rotation: list[float], degree: int) -> Column:
    """Turned coefficients: the band matrices are literals, made once on the driver."""
    parts = []
    for l, m in enumerate(band_matrices(rotation, degree)):  # noqa: E741
        for i in range(2 * l + 1):
            for c in range(3):
                terms = [F.lit(float(m[i, j])) * sh[3 * (l * l + j) + c].cast("double") for j in range(2 * l + 1)]
                parts.append(sum(terms[1:], terms[0]))
    return F.array(*parts)
