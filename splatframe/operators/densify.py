"""Hole filling by an advancing front.

Each pass measures spacing, proposes points at rims and in sparse places, and accepts them in order. The sequential
acceptance is a lexicographic maximal independent set: a candidate stays if no earlier one that stays is too near. It
is solved in rounds that settle all candidates whose earlier neighbours are settled, so a round is joins only. Pairs of
neighbours are written only where candidates are few; crowded places are thinned before, by first candidates of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatframe.functions import quaternion
from splatframe.operators import ranks, spatial
from splatframe.operators.cut import cut

XYZ = ("x", "y", "z")
#: Candidates that a cell as wide as the separation may have, seen from a candidate, before pairs are written.
CROWDED = 8


@dataclass(frozen=True)
class Config:
    # Defaults of the densifier.
    k: int = 8
    iterations: int = 3
    spacing: float = 1.0
    boundary: float = 0.30
    sparse: float = 2.5
    separation: float = 0.7
    hole: float = 8.0
    growth: float = 1.0


@dataclass(frozen=True)
class Stats:
    added: int
    passes: int
    median_spacing: float


def candidates(cloud: DataFrame, stats: DataFrame, median: float, config: Config = Config()) -> DataFrame:
    """(candidate_id, source, x, y, z, dirx, diry, dirz) of training rows: one ahead of each rim point, two along the
    long axis of each sparse one. Order: by source, then the side -1 before +1."""
    step = median * config.spacing
    length = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    rows = cloud.join(stats, "splat_id").withColumn("gap", length)
    rim = F.col("gap") > config.boundary * F.col("mean_d")
    edge = rows.filter(rim & (F.col("gap") > 0)).select(
        F.col("splat_id").alias("source"), F.lit(0).alias("side"),
        *((F.col(a).cast("double") + F.col(f"g{a}") / F.col("gap") * step).alias(a) for a in XYZ),
        *((F.col(f"g{a}") / F.col("gap")).alias(f"dir{a}") for a in XYZ),
    )
    q = quaternion.normalize_compat(*(F.col(c).cast("double") for c in ("rot_1", "rot_2", "rot_3", "rot_0")))
    axis = quaternion.major_axis(q, tuple(F.col(f"scale_{k}").cast("double") for k in range(3)))
    thin = rows.filter(~rim & (F.col("mean_d") > config.sparse * median)).withColumns({f"u{a}": v for a, v in zip(XYZ, axis)})
    split = thin.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).select(
        F.col("splat_id").alias("source"), "side",
        *((F.col(a).cast("double") + F.col("side") * 0.5 * F.col("mean_d") * F.col(f"u{a}")).alias(a) for a in XYZ),
        *(F.lit(0.0).alias(f"dir{a}") for a in XYZ),
    )
    return edge.unionByName(split).withColumn("candidate_id", F.col("source") * 4 + F.col("side") + 1)


def _thinned(points: DataFrame, distance: float) -> tuple[DataFrame | None, DataFrame]:
    """(kept, undecided): rounds over crowded places, without a pair of candidates.

    Cells are so small that two candidates of one are too near each other, so a cell is asked for its first one only. It
    stays if no cell that its ball meets has an earlier one. What it keeps away goes; then cells have new first ones.
    """
    side, kept = distance / 1.8, None
    keys = [f"c{a}" for a in XYZ]
    undecided = points.select("candidate_id", *(F.col(a).cast("double").alias(a) for a in XYZ)).withColumns({f"c{a}": F.floor(F.col(a) / side).cast("long") for a in XYZ})  # fmt: skip # noqa: E501

    def met(df: DataFrame) -> DataFrame:
        """A row for each cell that the ball of a row meets."""
        for a in XYZ:
            df = df.withColumn("s", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn(f"c{a}", F.col(f"c{a}") + F.col("s")).drop("s")
        gap = sum(F.pow(F.greatest(F.col(f"c{a}") * side - F.col(a), F.col(a) - (F.col(f"c{a}") + 1) * side, F.lit(0.0)), 2) for a in XYZ)
        return df.filter(gap < distance * distance * (1 + 1e-9))

    while spatial.crowding(undecided, distance) > CROWDED:
        first = cut(undecided.groupBy(*keys).agg(F.min(F.struct("candidate_id", *XYZ)).alias("h")).select("h.*", *keys))
        before = met(first).join(first.select(F.col("candidate_id").alias("other"), *keys), keys).filter("other < candidate_id")
        stay = cut(first.join(before.select("candidate_id").distinct(), "candidate_id", "left_anti"))
        kept = stay.select("candidate_id") if kept is None else kept.unionByName(stay.select("candidate_id"))
        # Those that stay keep their distance, so few of them reach a cell.
        reach = met(stay).groupBy(*keys).agg(F.collect_list(F.struct(*XYZ)).alias("held"))
        d = [lambda h, a=a: F.col(a) - h[a] for a in XYZ]
        near = F.exists("held", lambda h: F.sqrt(d[0](h) * d[0](h) + d[1](h) * d[1](h) + d[2](h) * d[2](h)) < distance)
        undecided = cut(undecided.join(reach, keys, "left").filter(~F.coalesce(near, F.lit(False))).drop("held"))
    return kept, undecided


def greedy_separation(points: DataFrame, distance: float) -> DataFrame:
    """candidate_ids that stay when rows are taken by candidate_id and one nearer than distance to a kept one goes."""
    placed = spatial.finite(points)
    elsewhere = points.filter(~F.coalesce(spatial.is_finite(F.col("x")) & spatial.is_finite(F.col("y")) & spatial.is_finite(F.col("z")), F.lit(False)))
    kept, points = _thinned(placed, distance)
    elsewhere = elsewhere.select("candidate_id")
    kept = elsewhere if kept is None else kept.unionByName(elsewhere)
    cells = points.select("candidate_id", *XYZ, *(F.floor(F.col(a) / distance).cast("long").alias(f"c{a}") for a in XYZ))
    asked = cells
    for a in XYZ:
        asked = asked.withColumn("s", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{a}", F.col(f"c{a}") + F.col("s")).drop("s")  # fmt: skip # noqa: E501
    on = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.cz") == F.col("b.cz"))
    near = asked.alias("a").join(cells.alias("b"), on & (F.col("a.candidate_id") > F.col("b.candidate_id")))
    edges = cut(
        near.filter(spatial._distance("a", "b") < distance)
        .select(F.col("a.candidate_id").alias("later"), F.col("b.candidate_id").alias("earlier")).distinct()
    )
    undecided = points.select("candidate_id")
    while True:
        # A candidate without undecided earlier neighbours stays: those that were kept have removed theirs already.
        waits = edges.select(F.col("later").alias("candidate_id")).distinct()
        stay = cut(undecided.join(waits, "candidate_id", "left_anti"))
        kept = kept.unionByName(stay)
        gone = edges.join(stay.withColumnRenamed("candidate_id", "earlier"), "earlier", "left_semi").select(F.col("later").alias("candidate_id")).distinct()  # fmt: skip # noqa: E501
        undecided = cut(undecided.join(stay, "candidate_id", "left_anti").join(gone, "candidate_id", "left_anti"))
        if undecided.isEmpty():
            return kept
        open_ = undecided.select("candidate_id")
        edges = cut(
            edges.join(open_.withColumnRenamed("candidate_id", "later"), "later", "left_semi")
            .join(open_.withColumnRenamed("candidate_id", "earlier"), "earlier", "left_semi")
            .select("later", "earlier")
        )


def synthesise(accepted: DataFrame, cloud: DataFrame, median: float, first_id: int) -> DataFrame:
    """Rows for accepted candidates: the source's values at a new place, scales at most log(1.5 median)."""
    top = F.ln(F.lit(1.5 * median))
    numbered = ranks.numbered(accepted, ["candidate_id"], "place")
    new = numbered.select(F.col("source").alias("splat_id"), "place", *(F.col(a).alias(f"n{a}") for a in XYZ))
    rows = new.join(cloud, "splat_id")
    replaced = {a: F.col(f"n{a}").cast(cloud.schema[a].dataType) for a in XYZ}
    replaced |= {f"scale_{k}": F.least(F.col(f"scale_{k}"), top).cast(cloud.schema[f"scale_{k}"].dataType) for k in range(3)}
    replaced["splat_id"] = (F.lit(first_id) + F.col("place")).cast("long")
    return rows.withColumns(replaced).select(*cloud.columns)


def fill_holes(cloud: DataFrame, config: Config = Config()) -> tuple[DataFrame, Stats]:
    """The training-domain cloud with the points that fill its holes, and what was done."""
    n0 = cloud.count()
    added, passes, reported = 0, 0, 0.0
    if n0 < 4:
        return cloud, Stats(0, 0, 0.0)
    cap = int(config.growth * n0)
    for step in range(config.iterations):
        k = max(1, min(config.k, n0 + added - 1, spatial.MAX_K))
        if spatial.grid_parameters(spatial.finite(cloud)) is None:  # no extent, no spacing
            break
        stats = cut(spatial.knn_stats(cloud, k))
        median = spatial.upper_median(stats, "mean_d")
        if not median:
            break
        reported = reported or median
        offered = cut(candidates(cloud, stats, median, config))
        apart, radius = median * config.separation, median * config.hole
        if apart <= radius:  # those too near the cloud go before the wide search
            crowd = spatial._met(offered, cloud, apart).filter(F.col("min_dist") < apart).select("candidate_id")
            offered = cut(offered.join(crowd, "candidate_id", "left_anti"))
        tests = spatial.nearest_and_support(offered, cloud, radius, apart if apart <= radius else 0.0)
        fit = offered.join(tests, "candidate_id").filter((F.col("min_dist") >= apart) & F.col("supported"))
        fit = cut(fit.select(*offered.columns))
        kept = fit.join(greedy_separation(fit, median * config.separation), "candidate_id", "left_semi")
        kept = cut(kept.orderBy("candidate_id").limit(cap - added))
        n = kept.count()
        if not n:
            break
        last = cloud.agg(F.max("splat_id")).first()[0]
        cloud = cut(cloud.unionByName(synthesise(kept, cloud, median, last)))
        added, passes = added + n, step + 1
        if added >= cap:
            break
    return cloud, Stats(added, passes, reported)
