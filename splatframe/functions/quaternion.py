"""Quaternions in xyzw order, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from splatframe.functions.activation import is_finite

TINY, UNIT_TOLERANCE, FRAME_TOLERANCE = 1e-12, 1e-3, 1e-3
Quat = tuple[Column, Column, Column, Column]


def norm(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z + w * w)


def normalize(x: Column, y: Column, z: Column, w: Column) -> Quat:
    """Strict: null below the least norm; the sign stays."""
    n = norm(x, y, z, w)
    ok = is_finite(n) & (n >= TINY)
    return tuple(F.when(ok, v / n) for v in (x, y, z, w))


def normalize_compat(x: Column, y: Column, z: Column, w: Column) -> Quat:
    """Scales by the largest part first, so huge parts don't overflow; zero and NaN give identity; w is not negative."""
    most = F.greatest(F.abs(x), F.abs(y), F.abs(z), F.abs(w))
    bad = F.isnan(x) | F.isnan(y) | F.isnan(z) | F.isnan(w) | ~is_finite(most) | (most <= 0)
    by = F.when(bad, F.lit(1.0)).otherwise(most)
    part = [v / by for v in (x, y, z, w)]
    n = F.when(bad, F.lit(1.0)).otherwise(norm(*part))
    sign = F.when(part[3] < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return tuple(F.when(bad, F.lit(e)).otherwise(sign * v / n) for v, e in zip(part, (0.0, 0.0, 0.0, 1.0)))


def is_unit(x: Column, y: Column, z: Column, w: Column) -> Column:
    n = norm(x, y, z, w)
    return is_finite(n) & (F.abs(n - 1) <= UNIT_TOLERANCE)


def to_matrix(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Row-major 3x3."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def from_matrix(m: list[Column]) -> Quat:
    """By the largest of the four squares; w is not negative. m is a row-major rotation."""
    trace = m[0] + m[4] + m[8]
    squares = [1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8], 1 + trace]
    # Four times the products of parts i and j, of which the largest square's row gives all parts.
    table = [
        [squares[0], m[1] + m[3], m[2] + m[6], m[7] - m[5]],
        [m[1] + m[3], squares[1], m[5] + m[7], m[2] - m[6]],
        [m[2] + m[6], m[5] + m[7], squares[2], m[3] - m[1]],
        [m[7] - m[5], m[2] - m[6], m[3] - m[1], squares[3]],
    ]
    best = F.greatest(*squares)

    def part(k: int) -> Column:
        root = 2 * F.sqrt(best)
        rows = [table[i][k] / root for i in (3, 0, 1, 2)]
        out = rows[3]
        for i, row in ((1, rows[2]), (0, rows[1]), (3, rows[0])):
            out = F.when(squares[i] >= best, row).otherwise(out)
        return out

    x, y, z, w = (part(k) for k in range(4))
    sign = F.when(w < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * x, sign * y, sign * z, sign * w


def determinant(m: list[Column]) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def is_frame(m: list[Column], tolerance: float = FRAME_TOLERANCE) -> Column:
    """Columns of m are orthonormal and right-handed."""
    ok = determinant(m) > 0
    for i in range(3):
        for j in range(i, 3):
            dot = sum((m[3 * k + i] * m[3 * k + j] for k in range(1, 3)), m[i] * m[j])
            ok = ok & (F.abs(dot - (1.0 if i == j else 0.0)) <= tolerance)
    return ok


def from_frame(m: list[Column]) -> Quat:
    ok = is_frame(m)
    return tuple(F.when(ok, v) for v in from_matrix(m))


def dot(a: Quat, b: Quat) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]


def angular_distance(a: Quat, b: Quat) -> Column:
    return 2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def multiply(a: Quat, b: Quat) -> Quat:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def from_normal(nx: Column, ny: Column, nz: Column) -> Quat:
    """Turns +Z to the normal; identity near +Z, half a turn about x near -Z; null parts stay null."""
    s = F.sqrt(2 * F.when(nz.isNotNull(), F.greatest(1 + nz, F.lit(1e-12))))
    up, down = nz > 0.9999, nz < -0.9999
    pick = lambda a, b, c: F.when(up, F.lit(a)).when(down, F.lit(b)).otherwise(c)
    return pick(0.0, 1.0, -ny / s), pick(0.0, 0.0, nx / s), pick(0.0, 0.0, F.lit(0.0)), pick(1.0, 0.0, s / 2)


def major_axis(q: Quat, scales: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """The rotation's column of the largest scale; ties take the lower index."""
    m = to_matrix(*q)
    s0, s1, s2 = scales
    first, second = (s0 >= s1) & (s0 >= s2), s1 >= s2
    return tuple(F.when(first, m[3 * k]).when(second, m[3 * k + 1]).otherwise(m[3 * k + 2]) for k in range(3))


def surface_frame(nx: Column, ny: Column, nz: Column) -> tuple[list[Column], list[Column]]:
    """A tangent and a bitangent of a unit normal: the tangent is normal to the axis that is least along it."""
    use_x = F.abs(nx) < 0.9
    ax, ay = F.when(use_x, F.lit(1.0)).otherwise(F.lit(0.0)), F.when(use_x, F.lit(0.0)).otherwise(F.lit(1.0))
    t = [-nz * ay, nz * ax, nx * ay - ny * ax]
    n = F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])
    t = [v / n for v in t]
    b = [ny * t[2] - nz * t[1], nz * t[0] - nx * t[2], nx * t[1] - ny * t[0]]
    return t, b


def frame_quaternion(nx: Column, ny: Column, nz: Column) -> Quat:
    t, b = surface_frame(nx, ny, nz)
    return from_matrix([t[0], b[0], nx, t[1], b[1], ny, t[2], b[2], nz])
