"""Depth maps as clouds. Views are rows of (view, u, v, depth, conf, sky, r, g, b).

Values of a view are sent to all tasks, as a join that shuffles by view has no more tasks than there are views.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatframe.functions import color
from splatframe.functions.activation import is_finite
from splatframe.operators import ranks


def subsample(df: DataFrame, n: int) -> DataFrame:
    return df.filter((F.col("u") % n == 0) & (F.col("v") % n == 0))


def view_percentile(df: DataFrame, column: str, percent: float, name: str) -> DataFrame:
    """The linearly interpolated percentile of each view's finite values."""
    return ranks.percentile(df.filter(is_finite(F.col(column).cast("double"))), ["view"], column, percent / 100, name)


def depth_mask(df: DataFrame, low: float = 0.1, high: float = 100.0, percent: float = 40.0) -> DataFrame:
    """Pixels within depth limits, not sky, and as sure as their view's percentile."""
    least = view_percentile(df, "conf", percent, "least_conf")
    d = F.col("depth").cast("double")
    good = is_finite(d) & (d >= low) & (d <= high) & (F.col("sky") < 0.5)
    return df.join(F.broadcast(least), "view").filter(good & (F.col("conf") >= F.col("least_conf"))).drop("least_conf")


def border_trim(df: DataFrame, width: int, height: int, quantile: float = 90.0) -> DataFrame:
    """Without 8/256 of the image at each side and the view's farthest depths; the quantile is of all finite depths."""
    far = view_percentile(df, "depth", quantile, "far")
    bu, bv = int(8 / 256 * width), int(8 / 256 * height)
    inside = F.col("u").between(bu, width - bu - 1) & F.col("v").between(bv, height - bv - 1)
    return df.join(F.broadcast(far), "view").filter(inside & (F.col("depth") <= F.col("far"))).drop("far")


def rays_by_fov(u: Column, v: Column, width: int, height: int, fov: float = 60.0) -> list[Column]:
    """Unit rays of a pinhole camera."""
    f = width / 2 / math.tan(math.radians(fov) / 2)
    x, y = (u - width / 2) / f, (v - height / 2) / f
    n = F.sqrt(x * x + y * y + 1)
    return [x / n, y / n, 1 / n]


def intensity_depth(r: Column, g: Column, b: Column) -> Column:
    """A stand-in depth by brightness; only on demand."""
    return 5 * (1 - (0.299 * r + 0.587 * g + 0.114 * b)) + 0.5


def unproject(df: DataFrame, cameras: DataFrame) -> DataFrame:
    """Adds x, y, z: the camera's place plus depth along K^-1 (u, v, 1), turned to the world and not normalised.

    cameras: (view, fx, fy, cx, cy, rotation (row-major camera to world), origin); one row for each view.
    """
    j = df.join(F.broadcast(cameras), "view")
    x, y = (F.col("u") - F.col("cx")) / F.col("fx"), (F.col("v") - F.col("cy")) / F.col("fy")
    r = F.col("rotation")
    at = [F.col("origin")[i] + F.col("depth") * (r[3 * i] * x + r[3 * i + 1] * y + r[3 * i + 2]) for i in range(3)]
    return j.withColumns(dict(zip("xyz", at))).select(*df.columns, "x", "y", "z")


def depth_scales(df: DataFrame, factor: float = 0.01) -> DataFrame:
    """Adds scale: factor times depth over the view's median, within a tenth and ten thousand factors."""
    middle = ranks.percentile(df, ["view"], "depth", 0.5, "middle")
    value = factor * F.col("depth") / F.col("middle")
    return df.join(F.broadcast(middle), "view").withColumn("scale", F.greatest(F.lit(0.1 * factor), F.least(F.lit(10000 * factor), value))).drop("middle")


def depth_to_splats(df: DataFrame, cameras: DataFrame, step: int = 1, factor: float = 0.01, low: float = 0.1, high: float = 100.0, percent: float = 40.0) -> DataFrame:  # fmt: skip # noqa: E501
    """Training rows of the pixels that pass: subsample, mask, unproject, scale."""
    kept = depth_scales(unproject(depth_mask(subsample(df, step), low, high, percent), cameras), factor)
    log = F.ln("scale")
    return kept.select(
        F.struct("view", "v", "u").alias("key"), "x", "y", "z", log.alias("scale_0"), log.alias("scale_1"), log.alias("scale_2"),
        F.lit(1.0).alias("rot_0"), *(F.lit(0.0).alias(f"rot_{k}") for k in (1, 2, 3)), F.ln(F.lit(0.9 / (1 - 0.9))).alias("opacity"),
        F.array(*(color.rgb_to_sh_dc(F.col(c)) for c in "rgb")).alias("sh"), F.lit(0).alias("sh_degree"),
    )


def from_prediction(df: DataFrame, width: int, height: int, step: int = 1) -> DataFrame:
    """Rows of a model's own splats (view, u, v, depth and splat columns): trimmed, then subsampled."""
    return subsample(border_trim(df, width, height), step)


def preview(df: DataFrame, order: list[str], n: int = 1000) -> tuple[DataFrame, bool]:
    """The first n rows and whether there are more."""
    return df.orderBy(*order).limit(n), df.limit(n + 1).count() > n
