"""Clouds, graphs and views made of the star-schema tables, each with the same view in SQL for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(c: Column) -> Column:
    """To six places in a way that two engines agree on, without negative zeros."""
    return F.floor(c * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def sql_rnd(x: str) -> str:
    return f"(floor(({x})*1e6+0.5)/1e6+0.0)"


_TRAIN = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "opacity"]


def cloud_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows in double: embeddings as positions, log scales, wxyz, logit and 16 x 3 harmonics."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("splat_id"), *(e[k].cast("double").alias(n) for k, n in enumerate(_TRAIN)),
        F.slice(e, 13, 48).cast("array<double>").alias("sh"), F.lit(3).alias("sh_degree"),
        *(e[k].cast("double").alias(f"e{k}") for k in (11, 60, 61, 62, 63)),
    )


TRAIN_SQL = (
    "t AS (SELECT vec_id AS splat_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {n}" for k, n in enumerate(_TRAIN))
    + ", CAST(embedding[13:60] AS DOUBLE[]) AS sh, 3 AS sh_degree, "
    + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in (11, 60, 61, 62, 63)) + " FROM embeddings)"
)

_N = "sqrt(rot_1*rot_1+rot_2*rot_2+rot_3*rot_3+rot_0*rot_0)"
#: Canonical rows: unit xyzw, linear scales and opacity.
CANON_SQL = (
    TRAIN_SQL + f", c AS (SELECT splat_id, x, y, z, exp(scale_0) AS sx, exp(scale_1) AS sy, exp(scale_2) AS sz, rot_1/{_N} AS qx, rot_2/{_N} AS qy, "
    f"rot_3/{_N} AS qz, rot_0/{_N} AS qw, CASE WHEN opacity >= 0 THEN 1/(1+exp(-abs(opacity))) ELSE exp(-abs(opacity))/(1+exp(-abs(opacity))) END AS opacity, sh, sh_degree, "
    "e11, e60, e61, e62, e63 FROM t)"
)


def cloud_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from splatframe.schema import to_canonical

    return to_canonical(cloud_train(spark, sf_dir), narrow=False)


def cloud_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point an order."""
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("splat_id"), (F.col("o_totalprice") / 1e4).alias("x"),
        ((F.col("o_custkey") % 1009) / F.lit(10.0)).alias("y"), (days / F.lit(20.0)).alias("z"),
    )


BIG_SQL = (
    "b AS (SELECT o_orderkey AS splat_id, o_totalprice/1e4 AS x, (o_custkey % 1009)/CAST(10.0 AS DOUBLE) AS y, "
    "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))/CAST(20.0 AS DOUBLE) AS z FROM orders)"
)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mesh vertices of parts; every seventh lacks a normal, every fifth a colour."""
    k = F.col("p_partkey")
    nx, ny = (k % 7 - 3).cast("double"), (k % 5 - 2).cast("double")
    size = F.sqrt(nx * nx + ny * ny + 1)
    some = lambda v, n: F.when(k % n != 0, v)
    return table(spark, sf_dir, "part").select(
        k.alias("splat_id"), (F.col("p_size") / F.lit(10.0)).alias("x"), (F.col("p_retailprice") / 100).alias("y"), ((k % 97) / F.lit(9.0)).alias("z"),
        some(nx / size, 7).alias("nx"), some(ny / size, 7).alias("ny"), some(1 / size, 7).alias("nz"),
        some((k % 256) / F.lit(255.0), 5).alias("r"), some((k % 128) / F.lit(127.0), 5).alias("g"), some((k % 64) / F.lit(63.0), 5).alias("b"),
    )


VERTICES_SQL = (
    "v0 AS (SELECT p_partkey AS splat_id, p_size/CAST(10.0 AS DOUBLE) AS x, p_retailprice/100 AS y, (p_partkey % 97)/CAST(9.0 AS DOUBLE) AS z, "
    "CAST(p_partkey % 7 - 3 AS DOUBLE) AS a, CAST(p_partkey % 5 - 2 AS DOUBLE) AS b FROM part), "
    "v AS (SELECT splat_id, x, y, z, CASE WHEN splat_id % 7 <> 0 THEN a/sqrt(a*a+b*b+1) END AS nx, CASE WHEN splat_id % 7 <> 0 THEN b/sqrt(a*a+b*b+1) END AS ny, "
    "CASE WHEN splat_id % 7 <> 0 THEN 1/sqrt(a*a+b*b+1) END AS nz, CASE WHEN splat_id % 5 <> 0 THEN (splat_id % 256)/CAST(255.0 AS DOUBLE) END AS r, "
    "CASE WHEN splat_id % 5 <> 0 THEN (splat_id % 128)/CAST(127.0 AS DOUBLE) END AS g, CASE WHEN splat_id % 5 <> 0 THEN (splat_id % 64)/CAST(63.0 AS DOUBLE) END AS b FROM v0)"
)


#: Line items of a task that makes depth views.
VIEW_ROWS = 1_000_000


def depth_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of depth views, made of line items by (part, supplier)."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    # Nearly all keys are distinct, so combining before the shuffle only fills memory; partitions follow the rows.
    parts = max(spark.sparkContext.defaultParallelism, li.count() // VIEW_ROWS + 1)
    li = li.repartition(parts, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(
        F.max("l_quantity").alias("depth"), F.max("l_discount").alias("conf"), F.min("l_tax").alias("tax"), F.max("l_extendedprice").alias("price")
    )
    return li.select(
        (F.col("l_suppkey") % 4).alias("view"), (F.col("l_partkey") % 64).alias("u"), F.floor(F.col("l_partkey") / 64).alias("v"), F.col("l_suppkey").alias("s"), "depth",
        (F.col("conf") + 0.0).alias("conf"), (F.col("tax") * 10).alias("sky"), *(((F.col("price") % n) / F.lit(float(n))).alias(c) for c, n in zip("rgb", (251, 241, 239))),
    )


DEPTH_SQL = (
    "l AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS depth, max(l_discount) AS conf, min(l_tax) AS tax, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL), "
    "d AS (SELECT l_suppkey % 4 AS view, l_partkey % 64 AS u, CAST(floor(l_partkey/64) AS BIGINT) AS v, l_suppkey AS s, depth, conf+0.0 AS conf, tax*10 AS sky, "
    "(price % 251)/CAST(251.0 AS DOUBLE) AS r, (price % 241)/CAST(241.0 AS DOUBLE) AS g, (price % 239)/CAST(239.0 AS DOUBLE) AS b FROM l)"
)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("sequence"), F.floor(seconds / 3600).cast("long").alias("frame"), F.col("ts").cast("timestamp").alias("event_time"), "value"
    )


FRAMES_SQL = "f AS (SELECT event_id, user_id AS sequence, CAST(floor((epoch_us(ts)/CAST(1e6 AS DOUBLE))/3600) AS BIGINT) AS frame, ts AS event_time, value FROM events)"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as losses: the type is the code, the severity follows from the user."""
    severity = F.element_at(F.array(*map(F.lit, ("info", "warning", "severe", "fatal"))), (F.least(F.col("user_id") % 40, F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), F.col("event_type").alias("code"), severity.alias("severity"), F.floor("value").cast("long").alias("affected_splats"))  # fmt: skip # noqa: E501


LOSSES_SQL = "o AS (SELECT event_id AS place, event_type AS code, ['info','warning','severe','fatal'][least(user_id % 40, 3)+1] AS severity, CAST(floor(value) AS BIGINT) AS affected_splats FROM events)"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots): regions, nations and suppliers; node ids by level."""
    def node(df: DataFrame, key: str, base: int) -> DataFrame:
        k = F.col(key).cast("long")
        d = lambda v: v.cast("double")
        linear = F.array(*(d(v) for v in (k % 3 + 1, F.lit(0), F.lit(0), F.lit(0), k % 2 + 1, F.lit(0), F.lit(0), F.lit(0), F.lit(1))))
        return df.select((k + base).alias("node"), F.struct(linear.alias("linear"), F.array(d(k), d(k % 5), F.lit(1.0)).alias("translation")).alias("transform"))

    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    nodes = node(region, "r_regionkey", 0).unionByName(node(nation, "n_nationkey", 1000)).unionByName(node(supplier, "s_suppkey", 2000))
    edges = nation.select(F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") + 1000).cast("long").alias("child")).unionByName(
        supplier.select((F.col("s_nationkey") + 1000).cast("long").alias("parent"), (F.col("s_suppkey") + 2000).cast("long").alias("child"))
    )
    return nodes, edges, region.select(F.col("r_regionkey").cast("long").alias("node"))
