"""Connected components of an edge table by alternating stars, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splatframe.llm.common import Scratch, delete_saved, fresh_dir

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """Each vertex links its larger neighbours (large) or its smaller ones and itself to the least of all.

    The least ones are a table of their own: so the join has plain sides, and a vertex with very many neighbours is
    split by adaptive execution.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Partial minima before the shuffle, so a vertex with very many neighbours is no hot key of the aggregate.
    least = scratch.saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-least")
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, label): each vertex of the edges (a, b) but the least of its component, with that least vertex.

    Null ends and loops are ignored; repeated edges are harmless. Each round is written to the shared folder and the
    one before is deleted.
    """
    spark = edges.sparkSession

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = fresh_dir(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    now, path = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _state(now)
    if not seen[0]:
        return now.select("a", F.col("b").alias("label"))
    for _ in range(MAX_ROUNDS):
        with Scratch(spark) as scratch:
            middle = scratch.saved(_star(now, True, scratch), "components-middle")
            after, fresh = put(_star(middle, False, scratch))
        delete_saved(spark, path)
        state, (now, path) = _state(after), (after, fresh)
        if state == seen:
            return now.select("a", F.col("b").alias("label"))
        seen = state
    raise RuntimeError("components did not settle")
