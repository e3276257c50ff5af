"""Row invariants, cloud inspection, loss policy and metadata rules. Codes are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatframe.functions import quaternion
from splatframe.functions.activation import is_finite

FLOAT_LEAST_NORMAL = 1.1754943508222875e-38
SEVERITIES = ("info", "warning", "severe", "fatal")


def _all(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def splat_code(degree: Column | None = None) -> Column:
    """The code of the first invariant that a canonical row breaks; null for a valid row."""
    degree = F.col("sh_degree") if degree is None else degree
    count = (degree + 1) * (degree + 1) * 3
    scales = [F.col(n) for n in ("sx", "sy", "sz")]
    q = [F.col(n).cast("double") for n in ("qx", "qy", "qz", "qw")]
    sane = lambda ok: ~F.coalesce(ok, F.lit(False))
    return (
        F.when(sane(degree.between(0, 4)), "MK0106")
        .when(sane(F.size("sh") == count), "MK1501")
        .when(sane(F.forall("sh", is_finite)), "MK1502")
        .when(sane(_all([is_finite(F.col(n)) for n in "xyz"])), "MK1504")
        .when(sane(_all([is_finite(s) & (s > 0) for s in scales])), "MK1505")
        .when(sane(is_finite(F.col("opacity")) & F.col("opacity").between(0, 1)), "MK1506")
        .when(sane(quaternion.is_unit(*q)), "MK1507")
    )


def validate(df: DataFrame) -> DataFrame:
    """Adds code: null for valid rows. A bad row never ends a job by itself."""
    return df.withColumn("code", splat_code())


def first_offenders(df: DataFrame) -> DataFrame:
    """(code, n, first_index) of a validated cloud."""
    return df.filter("code is not null").groupBy("code").agg(F.count("*").alias("n"), F.min("splat_id").alias("first_index"))


def require_valid(df: DataFrame) -> DataFrame:
    """df, or an error with the first offender; one aggregate."""
    found = validate(df).agg(F.count("*").alias("n"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col("splat_id"))).alias("code")).first()  # fmt: skip # noqa: E501
    if not found["n"]:
        raise ValueError("empty_cloud")
    if found["code"]:
        raise ValueError(found["code"])
    return df


def scale_class(scale: Column) -> Column:
    """overflow, underflow or subnormal of the scale's square in single precision; null where it is normal."""
    s = scale.cast("float")
    square = s * s
    return (
        F.when(F.abs(square) == F.lit(float("inf")), "overflow")
        .when(square == F.lit(0.0).cast("float"), "underflow")
        .when(square.cast("double") < FLOAT_LEAST_NORMAL, "subnormal")
    )


def _has(kind: str) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(scale_class(F.col(n)) == kind, F.lit(False)) for n in ("sx", "sy", "sz")))


def inspect_cloud(df: DataFrame) -> DataFrame:
    """One row: splats, degree, bounds, and count and first index of each issue. One pass, partial aggregates."""
    bad = splat_code().isNotNull()
    checks = {"invalid": bad, **{k: ~bad & _has(k) for k in ("overflow", "underflow", "subnormal")}}
    columns = [F.count("*").alias("splats"), F.coalesce(F.max("sh_degree"), F.lit(0)).alias("sh_degree")]
    for axis in "xyz":
        columns += [F.min(axis).cast("double").alias(f"min_{axis}"), F.max(axis).cast("double").alias(f"max_{axis}")]
    for name, test in checks.items():
        columns += [F.count_if(test).alias(f"n_{name}"), F.min(F.when(test, F.col("splat_id"))).alias(f"first_{name}")]
    return df.agg(*columns)


def issues(inspection: DataFrame) -> DataFrame:
    """(code, severity, n, first_index) of an inspection, in the order of emission."""
    rows = [
        ("empty_cloud", "error", F.when(F.col("splats") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.lit(None).cast("long")),
        ("canonical_invariant_violation", "error", F.col("n_invalid"), F.col("first_invalid")),
        ("scale_covariance_overflow", "error", F.col("n_overflow"), F.col("first_overflow")),
        ("scale_covariance_underflow", "error", F.col("n_underflow"), F.col("first_underflow")),
        ("scale_covariance_subnormal", "warning", F.col("n_subnormal"), F.col("first_subnormal")),
    ]
    made = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("code"), F.lit(s).alias("severity"), n.alias("n"), i.alias("first_index")) for k, (c, s, n, i) in enumerate(rows)]  # fmt: skip # noqa: E501
    return inspection.select(F.inline(F.array(*made))).filter("n > 0")


def issue_counts(found: DataFrame) -> DataFrame:
    """errors and warnings weighted by their counts; valid without errors."""
    weigh = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).cast("long")
    return found.agg(weigh("error").alias("errors"), weigh("warning").alias("warnings")).withColumn("valid", F.col("errors") == 0)


def inspect_json(inspection: DataFrame) -> DataFrame:
    """The inspection as one JSON document with a fixed order of fields."""
    fields = [F.col(c) for c in inspection.columns]
    return inspection.select(F.to_json(F.struct(F.lit("splat.inspect.v1").alias("schema"), F.struct(*fields).alias("cloud")), {"ignoreNullFields": "false"}).alias("document"))  # fmt: skip # noqa: E501


def inspect_text(inspection: DataFrame) -> DataFrame:
    return inspection.select(
        F.format_string("splats: %d\nsh degree: %d\ninvalid rows: %d", F.col("splats"), F.col("sh_degree"), F.col("n_invalid")).alias("report")
    )


def ply_field_issues(color: str, opacity: bool, scale: bool, rotation: bool) -> list[str]:
    """Warning codes of fields that a point file lacks; color is explicit, rgb or none."""
    codes = {"rgb": ["rgb_color_converted"], "none": ["defaulted_color"]}.get(color, [])
    return codes + [f"defaulted_{n}" for n, has in (("opacity", opacity), ("scale", scale), ("rotation", rotation)) if not has]


# Losses: (place, code, severity, affected_splats).


def loss_policy(losses: DataFrame, approved: list[str]) -> DataFrame:
    """The first loss that blocks: any fatal one (MK1601), or a severe one that isn't approved (MK1602)."""
    code = F.when(F.col("severity") == "fatal", "MK1601").when((F.col("severity") == "severe") & ~F.col("code").isin(approved or [""]), "MK1602")  # fmt: skip # noqa: E501
    blocked = losses.withColumn("error", code).filter("error is not null")
    return blocked.orderBy("place").limit(1).select("error", "code", "place")


def loss_summary(losses: DataFrame) -> DataFrame:
    blocking = F.col("severity").isin("severe", "fatal")
    return losses.agg(
        F.coalesce(F.bool_or(blocking), F.lit(False)).alias("has_blocking"),
        F.coalesce(F.sum("affected_splats"), F.lit(0)).cast("long").alias("affected_splats"), F.count("*").alias("n"),
    )


def extension_gate(used: DataFrame, required: DataFrame, supported: DataFrame) -> DataFrame:
    """(name, verdict): required ones that aren't supported block; others that aren't are ignored. Sorted by name."""
    missing = required.select("name").exceptAll(supported.select("name")).distinct().withColumn("verdict", F.lit("blocking"))
    extra = used.select("name").distinct().join(required, "name", "left_anti").join(supported, "name", "left_anti")
    return missing.unionByName(extra.withColumn("verdict", F.lit("ignored"))).orderBy("name")


def provenance_code(p: str = "provenance") -> Column:
    """The first rule that a provenance struct breaks (schema_version, model_schema, source_format, source_sha256,
    source_path, operations: array of name, tool_version, parameters)."""
    c = lambda n: F.col(f"{p}.{n}")
    empty = lambda v: F.coalesce(F.length(v) == 0, F.lit(True))
    absolute = lambda v: F.coalesce(v.rlike(r"^([/\\]|[A-Za-z]:[/\\])"), F.lit(False))
    return (
        F.when(empty(c("schema_version")), "MK1520")
        .when(empty(c("model_schema")), "MK1521")
        .when(empty(c("source_format")), "MK1522")
        .when(c("source_sha256").isNotNull() & ~c("source_sha256").rlike("^[0-9a-f]{64}$"), "MK1523")
        .when(F.exists(c("operations"), lambda o: empty(o["name"])), "MK1525")
        .when(F.exists(c("operations"), lambda o: empty(o["tool_version"])), "MK1526")
        .when(F.exists(c("operations"), lambda o: F.exists(F.map_values(o["parameters"]), absolute)), "MK1527")
    )


def provenance_json(df: DataFrame, column: str = "provenance", reproducible: bool = True) -> DataFrame:
    """JSON of a provenance struct; reproducible documents have a null timestamp."""
    value = F.col(column)
    if reproducible:
        value = value.withField("operations", F.transform(value["operations"], lambda o: o.withField("timestamp", F.lit(None).cast("string"))))
    return df.select(F.to_json(value, {"ignoreNullFields": "false"}).alias("document"))


def primitive_code(metadata: str = "metadata") -> Column:
    """Metadata against the data: degree, domains, frame and reflection."""
    m = lambda n: F.col(f"{metadata}.{n}")
    return (
        F.when(m("sh_degree") != F.col("sh_degree"), "MK1524")
        .when(~m("scale_domain").isin("linear"), "MK1528")
        .when(~m("opacity_domain").isin("linear"), "MK1529")
        .when(m("reflected") | (m("frame") != "gltf-luf"), "MK1530")
    )


def roundtrip_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fidelity of b against a by splat_id: the five declared measures."""
    j = a.alias("a").join(b.alias("b"), "splat_id")
    d = lambda n: F.col(f"a.{n}").cast("double") - F.col(f"b.{n}").cast("double")
    square = lambda names: sum((d(n) * d(n) for n in names[1:]), d(names[0]) * d(names[0]))
    logs = [F.ln(F.col(f"a.{n}").cast("double")) - F.ln(F.col(f"b.{n}").cast("double")) for n in ("sx", "sy", "sz")]
    q = lambda t: tuple(F.col(f"{t}.{n}").cast("double") for n in ("qx", "qy", "qz", "qw"))
    sh_error = F.aggregate(F.zip_with("a.sh", "b.sh", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    return j.agg(
        F.sqrt(F.avg(square(("x", "y", "z")))).alias("position_rmse"),
        F.sqrt(F.avg(sum((v * v for v in logs[1:]), logs[0] * logs[0]) / 3)).alias("log_scale_rmse"),
        F.max(quaternion.angular_distance(q("a"), q("b"))).alias("max_quat_angle"),
        F.max(F.abs(d("opacity"))).alias("max_opacity_error"),
        F.sqrt(F.sum(sh_error) / F.sum(F.size("a.sh"))).alias("sh_rmse"),
    )
