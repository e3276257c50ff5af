"""Projection, compositing, image loss and the optimiser step, as joins and aggregates.

A pixel meets the splats whose square of 3 sigma holds it: each splat lists its pixels and an equi-join follows, never
all pairs. A pixel's splats are taken in an explicit order; storage order means nothing in a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatframe.functions import covariance, quaternion
from splatframe.functions.activation import sigmoid
from splatframe.functions.sh import C0

BLUR, MARGIN, MOST_ALPHA, LEAST_ALPHA, LEAST_LIGHT = 0.3, 1.3, 0.99, 1 / 255, 1e-4


@dataclass(frozen=True)
class Camera:
    """view and view_proj are column-major 4x4 matrices."""

    view: tuple[float, ...]
    view_proj: tuple[float, ...]
    focal: tuple[float, float]
    fov: tuple[float, float]
    width: int
    height: int


def perspective(fov: float, width: int, height: int, near: float, far: float, back: float) -> Camera:
    """A camera that looks along +z from distance back."""
    f = 1 / math.tan(fov / 2)
    view = (1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, back, 1.0)
    a, b = far / (far - near), -far * near / (far - near)
    vp = (f, 0, 0, 0, 0, f, 0, 0, 0, 0, a, 1.0, 0, 0, a * back + b, back)
    return Camera(view, vp, (f * width / 2, f * height / 2), (fov, fov), width, height)


def _times(m: tuple[float, ...], p: list[Column], rows: int) -> list[Column]:
    return [m[i] * p[0] + m[4 + i] * p[1] + m[8 + i] * p[2] + m[12 + i] for i in range(rows)]


def in_frustum(p: list[Column], camera: Camera) -> Column:
    x, y, z, w = _times(camera.view_proj, p, 4)
    return (w > 0) & (F.abs(x) <= w * MARGIN) & (F.abs(y) <= w * MARGIN) & (z >= 0) & (z <= w)


def project(df: DataFrame, camera: Camera) -> DataFrame:
    """Visible splats of training rows: splat_id, px, py, depth, conic_xx, conic_xy, conic_yy, radius, r, g, b, alpha."""
    p = [F.col(a).cast("double") for a in "xyz"]
    seen = df.filter(in_frustum(p, camera))
    clip, t = _times(camera.view_proj, p, 4), _times(camera.view, p, 3)
    q = quaternion.normalize(*(F.col(c).cast("double") for c in ("rot_1", "rot_2", "rot_3", "rot_0")))
    s3 = covariance.covariance_compat(q, tuple(F.col(f"scale_{k}").cast("double") for k in range(3)))
    first = seen.select(
        "splat_id", ((clip[0] / clip[3] * 0.5 + 0.5) * camera.width).alias("px"), ((clip[1] / clip[3] * 0.5 + 0.5) * camera.height).alias("py"),
        *(v.alias(f"t{k}") for k, v in enumerate(t)), *(v.alias(n) for v, n in zip(s3, covariance.NAMES)), "opacity", "sh",
    )
    limit = [MARGIN * math.tan(f / 2) for f in camera.fov]
    z = F.col("t2")
    tx, ty = (F.least(F.lit(lim), F.greatest(F.lit(-lim), F.col(f"t{k}") / z)) * z for k, lim in enumerate(limit))
    fx, fy = camera.focal
    # Rows of the Jacobian times the view's rotation.
    jac = [(fx / z, F.lit(0.0), -(fx * tx) / (z * z)), (F.lit(0.0), fy / z, -(fy * ty) / (z * z))]
    view = [[camera.view[4 * c + r] for c in range(3)] for r in range(3)]
    m = [[row[0] * view[0][c] + row[1] * view[1][c] + row[2] * view[2][c] for c in range(3)] for row in jac]
    full = [[F.col(n) for n in row] for row in (("xx", "xy", "xz"), ("xy", "yy", "yz"), ("xz", "yz", "zz"))]
    form = lambda a, b: sum((a[i] * b[j] * full[i][j] for i in range(3) for j in range(3) if i + j), a[0] * b[0] * full[0][0])  # noqa: E731, E501
    flat = first.withColumns({"cxx": form(m[0], m[0]) + BLUR, "cxy": form(m[0], m[1]), "cyy": form(m[1], m[1]) + BLUR})
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    mid = 0.5 * (F.col("cxx") + F.col("cyy"))
    top = mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))
    shade = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sh")[k].cast("double") * C0 + 0.5))
    # One generator both filters and binds: a filter would be pushed below and repeat the whole form at each use.
    row = F.struct(
        F.col("px"), F.col("py"), F.col("t2").alias("depth"), (F.col("cyy") / det).alias("conic_xx"), (-F.col("cxy") / det).alias("conic_xy"),
        (F.col("cxx") / det).alias("conic_yy"), F.ceil(3 * F.sqrt(top)).cast("int").alias("radius"),
        shade(0).alias("r"), shade(1).alias("g"), shade(2).alias("b"), sigmoid(F.col("opacity")).alias("alpha"),
    )
    return flat.select("splat_id", F.inline(F.when(det > 0, F.array(row)))).filter("radius > 0")


def splat_pixels(projected: DataFrame, width: int, height: int) -> DataFrame:
    """(u, v, splat_id, ..., weight, a): each pixel that a splat's square reaches with enough alpha."""
    def span(c: str, most: int) -> Column:
        low = F.greatest(F.lit(0), F.ceil(F.col(c) - F.col("radius") - 0.5)).cast("int")
        high = F.least(F.lit(most - 1), F.floor(F.col(c) + F.col("radius") - 0.5)).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    cells = projected.withColumn("u", F.explode(span("px", width))).withColumn("v", F.explode(span("py", height)))
    dx, dy = F.col("u") + 0.5 - F.col("px"), F.col("v") + 0.5 - F.col("py")
    power = -0.5 * (F.col("conic_xx") * dx * dx + 2 * F.col("conic_xy") * dx * dy + F.col("conic_yy") * dy * dy)
    met = cells.withColumn("power", power).filter("power <= 0").withColumn("weight", F.exp("power"))
    return met.withColumn("a", F.least(F.lit(MOST_ALPHA), F.col("alpha") * F.col("weight"))).filter(F.col("a") >= LEAST_ALPHA)


def composite(pixels: DataFrame, background: tuple[float, float, float] = (0.0, 0.0, 0.0), order: tuple[str, ...] = ("depth", "splat_id")) -> DataFrame:  # fmt: skip # noqa: E501
    """(u, v, r, g, b, opacity) front to back, until the light that is left falls below its least."""
    before = Window.partitionBy("u", "v").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    light = F.exp(F.coalesce(F.sum(F.ln(1 - F.col("a"))).over(before), F.lit(0.0)))
    lit = pixels.withColumn("light", light).filter(F.col("light") >= LEAST_LIGHT)
    out = lit.groupBy("u", "v").agg(*(F.sum(F.col("light") * F.col("a") * F.col(c)).alias(c) for c in "rgb"), F.exp(F.sum(F.ln(1 - F.col("a")))).alias("left"))  # fmt: skip # noqa: E501
    return out.select("u", "v", *((F.col(c) + F.col("left") * k).alias(c) for c, k in zip("rgb", background)), (1 - F.col("left")).alias("opacity"))


def l1_loss(rendered: DataFrame, target: DataFrame) -> DataFrame:
    """(u, v, loss, gr, gg, gb): mean absolute difference of a pixel and its gradient."""
    j = rendered.alias("r").join(target.alias("t"), ["u", "v"])
    d = [F.col(f"r.{c}") - F.col(f"t.{c}") for c in "rgb"]
    return j.select("u", "v", ((F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])) / 3).alias("loss"), *((F.signum(v) / 3).alias(f"g{c}") for v, c in zip(d, "rgb")))


def backward(pixels: DataFrame, gradient: DataFrame) -> DataFrame:
    """(splat_id, d_r, d_g, d_b, d_logit): the simplified gradients; those of scale and rotation are zero."""
    j = pixels.join(gradient.select("u", "v", "gr", "gg", "gb"), ["u", "v"])
    dot = F.col("gr") * F.col("r") + F.col("gg") * F.col("g") + F.col("gb") * F.col("b")
    return j.groupBy("splat_id").agg(
        *(F.sum(F.col(f"g{c}") * F.col("a")).alias(f"d_{c}") for c in "rgb"),
        F.sum(dot * F.col("weight") * F.col("alpha") * (1 - F.col("alpha"))).alias("d_logit"),
    )


def adam(df: DataFrame, step: int, rate: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, epsilon: float = 1e-8) -> DataFrame:
    """(…, param, m, v) after a step of rows with param, grad, m, v."""
    m = beta1 * F.col("m") + (1 - beta1) * F.col("grad")
    v = beta2 * F.col("v") + (1 - beta2) * F.col("grad") * F.col("grad")
    move = rate * (m / (1 - beta1**step)) / (F.sqrt(v / (1 - beta2**step)) + epsilon)
    return df.withColumns({"param": F.col("param") - move, "m": m, "v": v})
