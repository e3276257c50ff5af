"""Colour: harmonic DC terms, sRGB transfer, and channel values by declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C0 = 0.28209479177387814
#: What a channel of a declared type is divided by.
DIVISORS = {"uchar": 255.0, "uint8": 255.0, "char": 255.0, "int8": 255.0, "ushort": 65535.0, "uint16": 65535.0, "short": 65535.0, "int16": 65535.0, "uint": 4294967295.0, "uint32": 4294967295.0, "int": 4294967295.0, "int32": 4294967295.0, "float": 1.0, "float32": 1.0, "double": 1.0, "float64": 1.0}  # fmt: skip # noqa: E501


def rgb_to_sh_dc(v: Column) -> Column:
    return (v.cast("double") - 0.5) / C0


def sh_dc_to_rgb(v: Column) -> Column:
    return v.cast("double") * C0 + 0.5


def srgb_to_linear(v: Column) -> Column:
    v = v.cast("double")
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    v = v.cast("double")
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def channel(v: Column, declared: Column) -> Column:
    """A channel in [0, 1] by the declared type, not by the values seen."""
    by = F.create_map(*(F.lit(x) for pair in DIVISORS.items() for x in pair))
    return v.cast("double") / by[declared]


def color_space(name: Column) -> tuple[Column, Column]:
    """(known space, whether it had to be assumed)."""
    known = name.isin("lin_rec709_display", "srgb_rec709_display")
    known = F.coalesce(known, F.lit(False))
    return F.when(known, name).otherwise(F.lit("srgb_rec709_display")), ~known
