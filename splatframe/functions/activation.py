"""Activations between training and linear domains. Outside its domain a strict function gives null; see code()."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE, MOST_LOG_SCALE, LEAST_GPU_SCALE = 1e-6, 80.0, 1e-7


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def sigmoid(logit: Column) -> Column:
    v = logit.cast("double")
    small = F.exp(-F.abs(v))  # never overflows
    return F.when(is_finite(v), F.when(v >= 0, 1 / (1 + small)).otherwise(small / (1 + small)))


def logit(p: Column) -> Column:
    v = p.cast("double")
    return F.when(is_finite(v) & (v > 0) & (v < 1), F.ln(v / (1 - v)))


def logit_clamped(p: Column, edge: float = EDGE) -> Column:
    v = F.greatest(F.least(p.cast("double"), F.lit(1 - edge)), F.lit(edge))
    return F.ln(v / (1 - v))


def linear_scale_from_log(v: Column) -> Column:
    v = v.cast("double")
    return F.when(is_finite(v) & (F.abs(v) <= MOST_LOG_SCALE), F.exp(v))


def log_scale_from_linear(v: Column) -> Column:
    v = v.cast("double")
    return F.when(is_finite(v) & (v > 0), F.ln(v))


def scale_to_log_floor(v: Column) -> Column:
    """The variant that floors instead of failing."""
    return F.ln(F.greatest(v.cast("double"), F.lit(LEAST_GPU_SCALE)))


def code(kind: str, v: Column) -> Column:
    """Why a strict function has no value: its stable code, else null. Fixed values."""
    v = v.cast("double")
    codes = {
        "sigmoid": [(~is_finite(v), "MK1101")],
        "logit": [(~is_finite(v), "MK1102"), ((v <= 0) | (v >= 1), "MK1103")],
        "exp": [(~is_finite(v), "MK1104"), (F.abs(v) > MOST_LOG_SCALE, "MK1105")],
        "log": [(~is_finite(v), "MK1106"), (v <= 0, "MK1107")],
    }[kind]
    out = F.lit(None).cast("string")
    for bad, name in reversed(codes):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out
