"""Row schemas of splat clouds, and the conversions between value domains.

Canonical rows have linear scales and opacity and unit quaternions in xyzw order; training rows have log scales, logit
opacity and wxyz quaternions. Storage is float, arithmetic is double: functions cast first and narrow last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splatframe.functions import activation, quaternion, sh

POSITION, SCALE, ROTATION = ("x", "y", "z"), ("sx", "sy", "sz"), ("qx", "qy", "qz", "qw")
LOG_SCALE, ROTATION_WXYZ = ("scale_0", "scale_1", "scale_2"), ("rot_0", "rot_1", "rot_2", "rot_3")

CANONICAL = T.StructType(
    [
        T.StructField("splat_id", T.LongType()),
        *(T.StructField(n, T.FloatType()) for n in (*POSITION, *SCALE, *ROTATION, "opacity")),
        T.StructField("sh", T.ArrayType(T.FloatType())),
        T.StructField("sh_degree", T.IntegerType()),
    ]
)

#: Defaults of fields that a source lacks.
DEFAULT_OPACITY, DEFAULT_SCALE, OPACITY_EDGE = 0.9, 0.01, 1e-6

#: What each profile stores.
PROFILES = {
    "canonical": {"scale": "linear", "opacity": "linear", "quaternion": "xyzw", "max_degree": 4},
    "ply-training": {"scale": "log", "opacity": "logit", "quaternion": "wxyz", "max_degree": 3},
    "ply-points": {"scale": None, "opacity": None, "quaternion": None, "max_degree": 0},
    "gltf-splats": {"scale": "linear", "opacity": "linear", "quaternion": "xyzw", "max_degree": 3},
    "spz": {"scale": "linear", "opacity": "linear", "quaternion": "xyzw", "max_degree": 3},
    "splat-demo": {"scale": "linear", "opacity": "byte", "quaternion": "wxyz-byte", "max_degree": 0},
}


def to_canonical(df: DataFrame, narrow: bool = True) -> DataFrame:
    """Training rows (scale_i logs, opacity logit, rot_i wxyz, sh splat-major) as canonical rows."""
    kind = "float" if narrow else "double"
    q = quaternion.normalize(*(F.col(c).cast("double") for c in ("rot_1", "rot_2", "rot_3", "rot_0")))
    return df.select(
        "splat_id", *(F.col(c).cast(kind) for c in POSITION),
        *(activation.linear_scale_from_log(F.col(a)).cast(kind).alias(b) for a, b in zip(LOG_SCALE, SCALE)),
        *(x.cast(kind).alias(n) for x, n in zip(q, ROTATION)),
        activation.sigmoid(F.col("opacity")).cast(kind).alias("opacity"), "sh", "sh_degree",
    )


def to_training(df: DataFrame) -> DataFrame:
    """Canonical rows as training rows; opacity is clamped from its ends, where the logit is infinite."""
    q = dict(zip(ROTATION_WXYZ, ("qw", "qx", "qy", "qz")))
    return df.select(
        "splat_id", *POSITION,
        *(activation.log_scale_from_linear(F.col(a)).cast("float").alias(b) for a, b in zip(SCALE, LOG_SCALE)),
        *(F.col(v).alias(k) for k, v in q.items()),
        activation.logit_clamped(F.col("opacity")).cast("float").alias("opacity"), "sh", "sh_degree",
    )


def with_ply_rest(df: DataFrame, degree: int) -> DataFrame:
    """Adds f_dc (3 values) and f_rest (channel-major) made of splat-major sh."""
    return df.withColumns({"f_dc": F.slice("sh", 1, 3), "f_rest": sh.to_channel_major(F.col("sh"), degree)})
