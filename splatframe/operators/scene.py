"""Scene graphs as tables: reference checks, flattening, transforms and merging.

A graph's node tables are small next to splats, yet nothing here asks for that but flatten(), whose rounds are as many
as the graph is deep. Transforms are column expressions; a literal matrix picks its plan on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splatframe.functions import covariance, sh
from splatframe.operators.cut import cut
from splatframe.plans.governance import SplatError
from splatframe.schema import ROTATION, SCALE

IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
MAX_DEPTH = 256


# Nodes: linear (row-major array of 9 doubles) and translation (array of 3).


def local_transform(translation: Column, rotation: Column, scale: Column, matrix: Column | None = None) -> Column:
    """struct(linear, translation) of T R S arrays, or of a column-major 4x4 matrix where one is given."""
    q = [rotation[k].cast("double") for k in range(4)]
    from splatframe.functions import quaternion

    r = quaternion.to_matrix(*q)
    linear = F.array(*(r[3 * i + j] * scale[j].cast("double") for i in range(3) for j in range(3)))
    moved = F.array(*(translation[k].cast("double") for k in range(3)))
    if matrix is not None:
        own = F.array(*(matrix[4 * j + i].cast("double") for i in range(3) for j in range(3)))
        linear = F.when(matrix.isNotNull(), own).otherwise(linear)
        moved = F.when(matrix.isNotNull(), F.array(*(matrix[12 + k].cast("double") for k in range(3)))).otherwise(moved)
    return F.struct(linear.alias("linear"), moved.alias("translation"))


def compose(parent: Column, child: Column) -> Column:
    """parent after child."""
    a, b = parent["linear"], child["linear"]
    linear = F.array(*(a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)))
    point = apply_point(parent, [child["translation"][k] for k in range(3)])
    return F.struct(linear.alias("linear"), F.array(*point).alias("translation"))


def apply_point(t: Column, p: list[Column]) -> list[Column]:
    a, v = t["linear"], t["translation"]
    return [a[3 * i] * p[0] + a[3 * i + 1] * p[1] + a[3 * i + 2] * p[2] + v[i] for i in range(3)]


def flatten(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(node, transform, depth): world transforms of the nodes that roots reach; a node counts once, at its least depth.

    nodes (node, transform), edges (parent, child), roots (node). Each level is cut, so plans don't grow with depth.
    """
    level = cut(roots.select("node").distinct().join(nodes, "node").withColumn("depth", F.lit(0)))
    out = level
    for depth in range(1, max_depth + 1):
        step = (
            level.alias("p").join(edges.alias("e"), F.col("p.node") == F.col("e.parent"))
            .join(nodes.alias("c"), F.col("e.child") == F.col("c.node"))
            .select(F.col("c.node").alias("node"), F.col("p.node").alias("from_node"), compose(F.col("p.transform"), F.col("c.transform")).alias("transform"))
        )
        step = step.join(out.select("node"), "node", "left_anti")
        first = step.groupBy("node").agg(F.min_by("transform", "from_node").alias("transform"))
        level = cut(first.withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError("the graph is deeper than allowed")


def graph_problems(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(problem, node): children with several parents, references to nothing, roots that are children, and nodes on a
    cycle or behind one."""
    edges = edges.select("parent", "child").distinct()
    many = edges.groupBy("child").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("several_parents").alias("problem"), F.col("child").alias("node"))
    lost = edges.select(F.explode(F.array("parent", "child")).alias("node")).unionByName(roots.select("node")).distinct()
    lost = lost.join(nodes, "node", "left_anti").select(F.lit("missing_node").alias("problem"), "node")
    root = roots.select("node").join(edges.select(F.col("child").alias("node")), "node", "left_semi").distinct().select(F.lit("root_has_parent").alias("problem"), "node")  # fmt: skip # noqa: E501
    return many.unionByName(lost).unionByName(root).unionByName(cycle_nodes(edges).select(F.lit("cycle").alias("problem"), "node"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node): what is left when nodes without a parent are taken off again and again. Each round is cut."""
    left = cut(edges.select("parent", "child").distinct())
    n = left.count()
    while n:
        inner = cut(left.join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi").select("parent", "child"))
        before, n = n, inner.count()
        left = inner
        if n == before:
            break
    return left.select(F.col("child").alias("node")).distinct()


def require_tree(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> None:
    """Refuses a graph with any problem, by the first one's name."""
    found = graph_problems(nodes, edges, roots).orderBy("problem", "node").first()
    if found:
        raise SplatError("MK2136", f"{found['problem']}: node {found['node']}")


def broken_references(table: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target."""
    return table.filter(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)), column, "left_anti")


def resolve_accessors(accessors: DataFrame, views: DataFrame, buffers: DataFrame) -> DataFrame:
    """(accessor, buffer, first_byte, stride, end_byte, ok) of accessors (id, view, offset, count, size), views
    (id, buffer, offset, length, stride) and buffers (id, length)."""
    a, v, b = accessors.alias("a"), views.alias("v"), buffers.alias("b")
    stride = F.when(F.coalesce(F.col("v.stride"), F.lit(0)) > 0, F.col("v.stride")).otherwise(F.col("a.size"))
    used = F.when(F.col("a.count") > 0, (F.col("a.count") - 1) * stride + F.col("a.size")).otherwise(F.lit(0))
    first = F.col("v.offset") + F.col("a.offset")
    inside = (F.col("a.offset") + used <= F.col("v.length")) & (F.col("v.offset") + F.col("v.length") <= F.col("b.length"))
    return a.join(v, F.col("a.view") == F.col("v.id")).join(b, F.col("v.buffer") == F.col("b.id")).select(
        F.col("a.id").alias("accessor"), F.col("v.buffer").alias("buffer"), first.alias("first_byte"),
        stride.alias("stride"), (first + used).alias("end_byte"), inside.alias("ok"),
    )


def attribute_zip(columns: dict[str, DataFrame], keys: tuple[str, str] = ("prim", "row")) -> DataFrame:
    """One row of each (prim, row) with the attributes' values, by position; all must have the same rows."""
    out = None
    for name, df in columns.items():
        part = df.select(*keys, F.col("value").alias(name))
        out = part if out is None else out.join(part, list(keys), "full")
    return out


def degree_scan(coefficients: DataFrame) -> DataFrame:
    """(prim, degree, ok) of present coefficients (prim, l, n): complete bands without a gap."""
    bands = coefficients.distinct().groupBy("prim", "l").agg(F.count("*").alias("c")).withColumn("whole", F.col("c") == 2 * F.col("l") + 1)
    return bands.groupBy("prim").agg(
        F.max("l").alias("degree"), (F.bool_and("whole") & (F.count("*") == F.max("l") + 1)).alias("ok")
    )


# Splats under transforms.


def is_identity(a: list[float], tolerance: float = 1e-9) -> bool:
    return all(abs(x - y) <= tolerance for x, y in zip(a, IDENTITY))


def is_positive_scale(a: list[float], tolerance: float = 1e-6) -> bool:
    most = max(abs(x) for x in a)
    return all(a[k] > 0 for k in (0, 4, 8)) and all(abs(a[k]) <= tolerance * most for k in (1, 2, 3, 5, 6, 7))


def rotation_for_harmonics(a: list[float]) -> list[float] | None:
    return a if covariance.is_proper_rotation(a) else covariance.polar_rotation(a)


def transform_primitive(df: DataFrame, linear: list[float], translation: list[float], degree: int) -> tuple[DataFrame, list[dict]]:
    """Canonical rows under a literal affine map, and the losses. Identity keeps rotation and scale as they are;
    a singular map drops all rows."""
    losses = []
    p = [F.col(a).cast("double") for a in "xyz"]
    place = {n: (linear[3 * i] * p[0] + linear[3 * i + 1] * p[1] + linear[3 * i + 2] * p[2] + translation[i]).cast("float") for i, n in enumerate("xyz")}  # fmt: skip # noqa: E501
    if is_identity(linear):
        return df.withColumns({n: (p[i] + translation[i]).cast("float") for i, n in enumerate("xyz")}), losses
    if covariance.is_singular(linear):
        losses.append({"code": "LOSS_INVALID_SPLAT_DROPPED", "severity": "warning"})
        return df.filter(F.lit(False)), losses
    q = tuple(F.col(n).cast("double") for n in ROTATION)
    s = tuple(F.col(n).cast("double") for n in SCALE)
    sigma = covariance.affine(covariance.covariance(q, s), linear)
    rest = [c for c in df.columns if c not in (*SCALE, *ROTATION)]
    wide = df.withColumns(dict(zip(covariance.NAMES, sigma))).select(*rest, *covariance.NAMES)
    out = covariance.decompose(wide).filter("valid").withColumns(place)
    if degree >= 1 and not is_positive_scale(linear):
        turn = rotation_for_harmonics(linear)
        if turn is None:
            losses.append({"code": "LOSS_SH_ROTATION_NOT_APPLIED", "severity": "severe"})
        else:
            out = out.withColumn("sh", sh.rotate(F.col("sh"), turn, degree).cast("array<float>"))
    narrow = [F.col(n).cast("float").alias(n) if n in (*SCALE, *ROTATION) else F.col(n) for n in df.columns]
    return out.select(*narrow), losses


def union_batches(batches: list[tuple[DataFrame, int]]) -> DataFrame:
    """Clouds with their degrees as one, harmonics padded to the highest degree."""
    top = max(d for _, d in batches)
    out = None
    for df, _ in batches:
        part = df.withColumn("sh", sh.pad(F.col("sh"), top)).withColumn("sh_degree", F.lit(top))
        out = part if out is None else out.unionByName(part)
    return out


def position_to_frame(p: list[Column], basis: list[float], unit: float) -> list[Column]:
    """Positions in the canonical frame: a literal orthogonal basis (row-major) and metres a unit."""
    return [unit * (basis[3 * i] * p[0] + basis[3 * i + 1] * p[1] + basis[3 * i + 2] * p[2]) for i in range(3)]


def frame_is_reflected(basis: list[float]) -> bool:
    m = basis
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6]) < 0


# 4x4 column-major matrices, as clouds and meshes carry them.


def transform_coordinates(p: list[Column], m: list[float]) -> list[Column]:
    """Positions alone, without a perspective divide."""
    return [m[i] * p[0] + m[4 + i] * p[1] + m[8 + i] * p[2] + m[12 + i] for i in range(3)]


def transform_point(p: list[Column], m: list[float]) -> list[Column]:
    """With the perspective divide; null where w vanishes."""
    w = m[3] * p[0] + m[7] * p[1] + m[11] * p[2] + m[15]
    return [F.when(F.abs(w) >= 1e-15, v / F.when(F.abs(w) >= 1e-15, w).otherwise(F.lit(1.0))) for v in transform_coordinates(p, m)]


def transform_normal(n: list[Column], m: list[float]) -> list[Column]:
    """By the inverse transpose, from cofactors; unit length, null for singular maps."""
    a = [[m[4 * c + r] for c in range(3)] for r in range(3)]
    cof = [[a[(i + 1) % 3][(j + 1) % 3] * a[(i + 2) % 3][(j + 2) % 3] - a[(i + 1) % 3][(j + 2) % 3] * a[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]  # fmt: skip # noqa: E501
    det = sum(a[0][j] * cof[0][j] for j in range(3))
    if not math.isfinite(det) or abs(det) < 1e-15:
        return [F.lit(None).cast("double")] * 3
    out = [(cof[i][0] * n[0] + cof[i][1] * n[1] + cof[i][2] * n[2]) / det for i in range(3)]
    size = F.sqrt(out[0] * out[0] + out[1] * out[1] + out[2] * out[2])
    return [F.when(size > 0, v / F.when(size > 0, size).otherwise(F.lit(1.0))) for v in out]


def y_up_to_z_up(p: list[Column]) -> list[Column]:
    return [p[0], -p[2], p[1]]
