"""Mesh vertices as splats, and the fused cloud pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatframe.functions import activation, color, quaternion
from splatframe.operators import scene, spatial


def reject_positions(vertices: DataFrame) -> tuple[DataFrame, int]:
    """Finite vertices and the number of others; a loader fails if there are any."""
    good = spatial.finite(vertices)
    return good, vertices.count() - good.count()


def basic(vertices: DataFrame, scale: float = 0.01, opacity: float = 1.0, grey: float = 0.5, convert: bool = True, factor: float = 1.0) -> DataFrame:  # fmt: skip # noqa: E501
    """Canonical degree-0 rows of vertices (splat_id, x, y, z, nx, ny, nz, r, g, b; normals and colours may be null)."""
    p = [F.col(a).cast("double") for a in "xyz"]
    n = [F.col(f"n{a}").cast("double") for a in "xyz"]
    if convert:
        p, n = scene.y_up_to_z_up(p), scene.y_up_to_z_up(n)
    has = n[0].isNotNull() & n[1].isNotNull() & n[2].isNotNull()
    q = [F.when(has, v).otherwise(F.lit(e)) for v, e in zip(quaternion.from_normal(*n), (0.0, 0.0, 0.0, 1.0))]
    rgb = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(grey)))) for c in "rgb"]
    return vertices.select(
        "splat_id", *((v * factor).alias(a) for v, a in zip(p, "xyz")), *(F.lit(scale).alias(s) for s in ("sx", "sy", "sz")),
        *(v.alias(a) for v, a in zip(q, ("qx", "qy", "qz", "qw"))), F.lit(opacity).alias("opacity"),
        F.array(*(color.rgb_to_sh_dc(v) for v in rgb)).alias("sh"), F.lit(0).alias("sh_degree"),
    )


def enhanced(vertices: DataFrame, k: int = 8, scale_factor: float = 0.5, low: float = 0.001, high: float = 0.1, opacity: float = 0.95, flat: float = 0.3, aligned: bool = True) -> DataFrame:  # fmt: skip # noqa: E501
    """Training rows with scales by spacing and discs along the surface; missing normals come from neighbours."""
    scales = spatial.adaptive_scales(vertices, k, scale_factor, low, high)
    guessed = spatial.pca_normals(vertices, k).select("splat_id", *(F.col(f"n{a}").alias(f"g{a}") for a in "xyz"))
    rows = vertices.join(scales, "splat_id").join(guessed, "splat_id", "left")
    n = [F.coalesce(F.col(f"n{a}").cast("double"), F.col(f"g{a}"), F.lit(e)) for a, e in zip("xyz", (0.0, 0.0, 1.0))]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = [F.when(size > 0, v / F.when(size > 0, size).otherwise(F.lit(1.0))).otherwise(F.lit(e)) for v, e in zip(n, (0.0, 0.0, 1.0))]
    q = quaternion.from_normal(*unit)
    log = F.ln("scale")
    rgb = [F.coalesce(F.col(c).cast("double"), F.lit(0.5)) for c in "rgb"]
    return rows.select(
        "splat_id", *(F.col(a).cast("double").alias(a) for a in "xyz"), log.alias("scale_0"), log.alias("scale_1"),
        (F.ln(F.col("scale") * flat) if aligned else log).alias("scale_2"),
        q[3].alias("rot_0"), q[0].alias("rot_1"), q[1].alias("rot_2"), q[2].alias("rot_3"),
        activation.logit_clamped(F.lit(opacity)).alias("opacity"),
        F.array(*(color.rgb_to_sh_dc(v) for v in rgb)).alias("sh"), F.lit(0).alias("sh_degree"),
    )


def process_cloud(df: DataFrame, normalize: bool = True, to_sh: bool = True, to_logit: bool = True, scale: float = 1.0, to_z_up: bool = True) -> DataFrame:  # fmt: skip # noqa: E501
    """The fixed order of steps: quaternions, colours, opacity, positions' scale, axes. Catalyst makes one project of
    it. Rows have rot_0..rot_3 (wxyz), r, g, b, opacity, x, y, z."""
    if normalize:
        q = quaternion.normalize_compat(*(F.col(c).cast("double") for c in ("rot_1", "rot_2", "rot_3", "rot_0")))
        df = df.withColumns(dict(zip(("rot_1", "rot_2", "rot_3", "rot_0"), q)))
    if to_sh:
        df = df.withColumns({c: color.rgb_to_sh_dc(F.col(c)) for c in "rgb"})
    if to_logit:
        df = df.withColumn("opacity", activation.logit_clamped(F.col("opacity")))
    df = df.withColumns({a: F.col(a).cast("double") * scale for a in "xyz"})
    if to_z_up:
        df = df.withColumns(dict(zip("xyz", scene.y_up_to_z_up([F.col(a) for a in "xyz"]))))
    return df


def pack(df: DataFrame) -> DataFrame:
    """Rows of four groups of four values; higher harmonics are not kept."""
    return df.select(
        "splat_id", F.array("x", "y", "z", "opacity").alias("position"), F.array("scale_0", "scale_1", "scale_2", F.lit(0.0)).alias("scale"),
        F.array("rot_0", "rot_1", "rot_2", "rot_3").alias("rotation"), F.array(F.col("sh")[0], F.col("sh")[1], F.col("sh")[2], F.lit(0.0)).alias("color"),
    )


def unpack(df: DataFrame) -> DataFrame:
    get = lambda c, k, n: F.col(c)[k].alias(n)
    return df.select(
        "splat_id", *(get("position", k, n) for k, n in enumerate(("x", "y", "z", "opacity"))), *(get("scale", k, f"scale_{k}") for k in range(3)),
        *(get("rotation", k, f"rot_{k}") for k in range(4)), F.slice("color", 1, 3).alias("sh"), F.lit(0).alias("sh_degree"),
    )
