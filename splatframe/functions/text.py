"""String functions: escapes, formats, suffixes, redaction and identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Controls with short escapes.
_SHORT = {9: "\\t", 10: "\\n", 13: "\\r"}


def display_escape(v: Column) -> Column:
    """Control characters (C0, DEL, C1) as escapes, so a terminal shows them."""
    out = v
    for k in [*range(32), *range(127, 160)]:
        out = F.replace(out, F.lit(chr(k)), F.lit(_SHORT.get(k, f"\\x{k:02x}" if k < 128 else f"\\u{k:04x}")))
    return out


def json_string(v: Column) -> Column:
    """A JSON string literal."""
    whole = F.to_json(F.struct(v.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def float_text(v: Column) -> Column:
    """Nine significant digits without trailing zeros; both zeros are 0. Built-in formats keep the zeros."""

    @F.pandas_udf("string")
    def shown(x: pd.Series) -> pd.Series:
        return x.map(lambda y: None if pd.isna(y) else "0" if y == 0 else format(y, ".9g"))

    return shown(v)


def extension(path: Column) -> Column:
    """The lower-cased suffix with its dot, of the last path part; empty for none."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1))


def strict_int(v: Column) -> Column:
    return F.when(v.rlike(r"^[+-]?[0-9]+$"), v).try_cast("bigint")


def strict_float(v: Column) -> Column:
    found = F.when(v.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), v).try_cast("double")
    return F.when(F.abs(found) < F.lit(float("inf")), found)


def redact_path(path: Column, policy: str, root: str = "") -> Column:
    """basename, relative (to root, at a part's boundary; else the basename) or full."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    if policy == "full":
        return path
    if policy == "basename" or not root:
        return base
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return F.when(inside, F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(base)


def is_sha256(v: Column) -> Column:
    return v.rlike("^[0-9a-f]{64}$")


def is_absolute(v: Column) -> Column:
    return v.rlike(r"^([/\\]|[A-Za-z]:[/\\])")


def is_utf8(v: Column) -> Column:
    """Whether bytes are well-formed: no overlong forms, surrogates or values above U+10FFFF."""
    return F.is_valid_utf8(v.cast("string"))


def field_label(declared: Column, converted: Column) -> Column:
    """How a field came about: explicit, converted_rgb or defaulted."""
    return F.when(declared, F.lit("explicit")).when(converted, F.lit("converted_rgb")).otherwise(F.lit("defaulted"))
