"""Spatial operators: grids, exact k nearest neighbours, range joins, normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from splatframe.functions import covariance
from splatframe.functions.activation import is_finite
from splatframe.operators import neighbours, ranks
from splatframe.operators.cut import cut

MAX_CELLS, MAX_SHELL, MAX_K = 1 << 22, 16, 32
XYZ = ("x", "y", "z")


def finite(df: DataFrame) -> DataFrame:
    return df.filter(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("z")))


def bounds(df: DataFrame) -> DataFrame:
    """One row of min and max by axis; zeros for an empty cloud."""
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return df.agg(*(zero(f(F.col(a).cast("double"))).alias(f"{n}_{a}") for a in XYZ for n, f in (("min", F.min), ("max", F.max))))


def grid_parameters(df: DataFrame, factor: float = 2.0) -> dict | None:
    """min, cell and dims of a grid; None for clouds without extent. One aggregate of fixed size."""
    row = df.agg(F.count("*").alias("n"), *(f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in XYZ for n, f in (("min", F.min), ("max", F.max)))).first()  # fmt: skip # noqa: E501
    if not row["n"]:
        return None
    low = [row[f"min_{a}"] for a in XYZ]
    extent = [row[f"max_{a}"] - row[f"min_{a}"] for a in XYZ]
    if max(extent) < 1e-9:
        return None
    cell = max(extent) / row["n"] ** (1 / 3) * factor
    while True:
        dims = [max(1, -int(-e // cell)) for e in extent]
        if dims[0] * dims[1] * dims[2] <= MAX_CELLS:
            return {"n": row["n"], "low": low, "cell": cell, "dims": dims}
        cell *= 1.5


def with_cells(df: DataFrame, grid: dict) -> DataFrame:
    """Adds cx, cy, cz; the last cell takes the far edge."""
    place = lambda k: F.greatest(F.lit(0), F.least(F.floor((F.col(XYZ[k]).cast("double") - grid["low"][k]) / grid["cell"]), F.lit(grid["dims"][k] - 1))).cast("int")  # noqa: E731, E501
    return df.withColumns({c: place(k) for k, c in enumerate(("cx", "cy", "cz"))})


def flat_cell(grid: dict) -> Column:
    _, dy, dz = grid["dims"]
    return ((F.col("cx") * dy + F.col("cy")) * dz + F.col("cz")).cast("long")


def cell_histogram(df: DataFrame, grid: dict) -> DataFrame:
    return with_cells(df, grid).groupBy(flat_cell(grid).alias("cell")).agg(F.count("*").alias("n"))


def cell_starts(histogram: DataFrame) -> DataFrame:
    """Adds start: the exclusive running total over cells, in two levels so that no task sees all cells."""
    block = F.shiftright(F.col("cell"), 12)
    blocks = histogram.groupBy(block.alias("block")).agg(F.sum("n").alias("t"))
    before = blocks.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # fmt: skip # noqa: E501
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # fmt: skip # noqa: E501
    return histogram.withColumn("block", block).withColumn("own", inside).join(before.select("block", "base"), "block").select("cell", "n", (F.col("base") + F.col("own")).alias("start"))  # fmt: skip # noqa: E501


def cell_rank(df: DataFrame, grid: dict) -> DataFrame:
    own = Window.partitionBy("cell").orderBy("splat_id")
    return with_cells(df, grid).withColumn("cell", flat_cell(grid)).withColumn("slot", F.row_number().over(own) - 1)


def _distance(a: str, b: str) -> Column:
    d = [F.col(f"{a}.{v}").cast("double") - F.col(f"{b}.{v}").cast("double") for v in XYZ]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def knn(df: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """(splat_id, other, d, rank, ox, oy, oz): the k nearest of each point, exact. Fewer where the cloud is smaller.

    Duplicate splat_ids are not supported; non-finite points neither ask nor answer. One place or a far outlier may hold
    any share of the points.
    """
    return _ranked(_nearest(df, k, itself))


def _nearest(df: DataFrame, k: int, itself: bool) -> DataFrame:
    """(splat_id, x, y, z, near): the same with a row for each point."""
    points = finite(df.select("splat_id", *XYZ))
    row = points.agg(F.count("*").alias("n"), *(f(F.col(a).cast("double")).alias(f"{n}_{a}") for a in XYZ for n, f in (("min", F.min), ("max", F.max)))).first()  # fmt: skip # noqa: E501
    n = row["n"]
    k = min(k, n - (0 if itself else 1))
    low = [row[f"min_{a}"] or 0.0 for a in XYZ]
    extent = max((row[f"max_{a}"] or 0.0) - x for a, x in zip(XYZ, low)) or 1.0
    found = neighbours.nearest(points, n, low, extent, max(1, k), itself) if n else points.select("splat_id", *(F.col(a).cast("double").alias(a) for a in XYZ), F.expr(f"cast(null as {neighbours.NEAR_SQL})").alias("near"))  # fmt: skip # noqa: E501
    return found


def _ranked(found: DataFrame) -> DataFrame:
    """(splat_id, other, d, rank, ox, oy, oz): a row for each neighbour."""
    each = found.select("splat_id", F.posexplode("near").alias("at", "p"))
    return each.select("splat_id", "p.other", "p.d", (F.col("at") + 1).alias("rank"), "p.ox", "p.oy", "p.oz")


def knn_brute(df: DataFrame, k: int) -> DataFrame:
    """The same by all pairs, as a check: its time is quadratic, memory and disk aren't."""
    points = finite(df.select("splat_id", *XYZ))
    return _ranked(neighbours.brute(points, points, k, False))


def knn_stats(df: DataFrame, k: int = 8) -> DataFrame:
    """(splat_id, mean_d, gx, gy, gz): mean distance to the k nearest, and the point less their centroid."""
    near = _nearest(df, min(k, MAX_K), False).filter(F.size("near") > 0)
    # Spark pushes a caller's filter of means below this one and may divide before it has dropped empty lists.
    some = F.nullif(F.size("near"), F.lit(0))
    mean = lambda n: F.aggregate("near", F.lit(0.0), lambda t, p: t + p[n]) / some
    return near.select("splat_id", mean("d").alias("mean_d"), *((F.col(a) - mean(f"o{a}")).alias(f"g{a}") for a in XYZ))


def adaptive_scales(df: DataFrame, k: int = 8, factor: float = 0.5, low: float = 0.001, high: float = 0.1) -> DataFrame:
    """(splat_id, scale): half the mean distance times factor, within limits."""
    means = knn(df, k).groupBy("splat_id").agg(F.avg("d").alias("mean_d"))
    scale = F.greatest(F.lit(low), F.least(F.lit(high), 0.5 * F.col("mean_d") * factor))
    return df.select("splat_id").join(means, "splat_id", "left").select("splat_id", F.coalesce(scale, F.lit(low)).alias("scale"))


def upper_median(df: DataFrame, column: str) -> float | None:
    """The element of rank n // 2 (from 0) of the positive values, without interpolation."""
    placed = cut(ranks.numbered(df.filter(F.col(column) > 0).select(column), [column], "place"))
    found = placed.filter(F.col("place") == placed.count() // 2 + 1).first()
    return found[0] if found else None


def _met(candidates: DataFrame, cloud: DataFrame, radius: float) -> DataFrame:
    """(candidate_id, min_dist, ahead) of candidates with a point within radius."""
    cell = lambda a: F.floor(F.col(a).cast("double") / radius).cast("long")
    q = candidates.withColumns({f"c{a}": cell(a) for a in XYZ})
    span = F.sequence(F.lit(-1), F.lit(1))
    for a in XYZ:
        q = q.withColumn("s", F.explode(span)).withColumn(f"c{a}", F.col(f"c{a}") + F.col("s")).drop("s")
    p = finite(cloud.select(*XYZ)).withColumns({f"c{a}": cell(a) for a in XYZ})
    on = (F.col("q.cx") == F.col("p.cx")) & (F.col("q.cy") == F.col("p.cy")) & (F.col("q.cz") == F.col("p.cz"))
    ahead = sum((((F.col(f"p.{a}") - F.col(f"q.{a}")) * F.col(f"q.dir{a}")) for a in XYZ[1:]), (F.col("p.x") - F.col("q.x")) * F.col("q.dirx"))  # fmt: skip # noqa: E501
    return (
        q.alias("q").join(p.alias("p"), on).withColumn("d", _distance("q", "p")).filter(F.col("d") <= radius)
        .groupBy("q.candidate_id").agg(F.min("d").alias("min_dist"), F.bool_or(ahead > 1e-6).alias("ahead"))
    )


def crowding(df: DataFrame, side: float) -> float:
    """How many points share the cell of a point, on the mean."""
    cells = finite(df).groupBy(*(F.floor(F.col(a).cast("double") / side) for a in XYZ)).agg(F.count("*").cast("double").alias("n"))
    row = cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s")).first()
    return row["s"] / row["n"] if row["n"] else 0.0


def nearest_and_support(candidates: DataFrame, cloud: DataFrame, radius: float, least: float = 0.0) -> DataFrame:
    """(candidate_id, min_dist, supported) of candidates (candidate_id, x, y, z, dirx, diry, dirz).

    min_dist is infinite without a point within radius; supported means that a point within radius lies ahead along
    the direction, or that there is no direction. The search begins where cells hold few points: who has met a point and
    a support there needn't look farther, as the nearest of all is nearest in the small ball, too. No point is known to be
    nearer than least, so narrower searches are left out.
    """
    radii = [radius]
    while len(radii) < 8 and radii[-1] / 4 > least and crowding(cloud, radii[-1]) > 4:
        radii.append(radii[-1] / 4)
    free = (F.col("dirx") == 0) & (F.col("diry") == 0) & (F.col("dirz") == 0)
    asking, found = candidates.select("candidate_id", *XYZ, *(f"dir{a}" for a in XYZ)), []
    for r in reversed(radii):
        tested = asking.join(_met(asking, cloud, r), "candidate_id", "left").withColumn("supported", free | F.coalesce("ahead", F.lit(False)))
        if r != radius:
            tested = cut(tested)
            settled = F.col("min_dist").isNotNull() & F.col("supported")
            asking = tested.filter(~F.coalesce(settled, F.lit(False))).select(*asking.columns)
            tested = tested.filter(settled)
        found.append(tested.select("candidate_id", F.coalesce("min_dist", F.lit(float("inf"))).alias("min_dist"), "supported"))
    out = found[0]
    for each in found[1:]:
        out = out.unionByName(each)
    return out


def pca_normals(df: DataFrame, k: int = 8) -> DataFrame:
    """(splat_id, nx, ny, nz): the direction of least spread of a point and its neighbours, pointing away from their
    centroid; (0, 0, 1) with fewer than three neighbours."""
    k = max(3, k)
    near = knn(df, k).select("splat_id", *(F.col(f"o{a}").alias(a) for a in XYZ))
    own = df.select("splat_id", *(F.col(a).cast("double").alias(a) for a in XYZ))
    origin = own.select("splat_id", *(F.col(a).alias(f"p{a}") for a in XYZ))
    # Relative to the point itself, so far-off clouds keep their digits.
    moved = near.unionByName(own).join(origin, "splat_id").withColumns({f"r{a}": F.col(a) - F.col(f"p{a}") for a in XYZ})
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    sums = moved.groupBy("splat_id").agg(
        F.count("*").alias("n"), *(F.avg(f"r{a}").alias(f"m{a}") for a in XYZ),
        *(F.avg(F.col(f"r{a}") * F.col(f"r{b}")).alias(f"{a}{b}") for a, b in pairs),
    )
    s = [F.col(f"{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}") for a, b in pairs]
    out = covariance.with_smallest_axis(sums.select("splat_id", "n", "mx", "my", "mz", *(v.alias(n) for v, n in zip(s, covariance.NAMES))))
    side = -(F.col("ux") * F.col("mx") + F.col("uy") * F.col("my") + F.col("uz") * F.col("mz"))
    sign = F.when(side < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    few = F.col("n") < 4
    pick = lambda c, e: F.when(few, F.lit(e)).otherwise(sign * F.col(c))
    return out.select("splat_id", pick("ux", 0.0).alias("nx"), pick("uy", 0.0).alias("ny"), pick("uz", 1.0).alias("nz"))


def by_distance(df: DataFrame, camera: tuple[float, float, float]) -> DataFrame:
    """Adds d2 and distance_rank, near to far, by (d2, splat_id)."""
    d = [F.col(a).cast("double") - c for a, c in zip(XYZ, camera)]
    out = df.withColumn("d2", d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return ranks.numbered(out, ["d2", "splat_id"], "distance_rank").withColumn("distance_rank", F.col("distance_rank").cast("int"))


def sort_by_distance(df: DataFrame, camera: tuple[float, float, float]) -> DataFrame:
    """Rows near to far: a range-partitioned sort, without a rank."""
    d = [F.col(a).cast("double") - c for a, c in zip(XYZ, camera)]
    return df.orderBy(d[0] * d[0] + d[1] * d[1] + d[2] * d[2], "splat_id")


def voxel_fuse(df: DataFrame, size: float) -> DataFrame:
    """One row of each voxel: the least splat_id's."""
    voxel = [F.floor(F.col(a).cast("double") / size).alias(f"v{a}") for a in XYZ]
    first = df.groupBy(*voxel).agg(F.min("splat_id").alias("splat_id"), F.count("*").alias("n_fused"))
    return df.join(first, "splat_id")
