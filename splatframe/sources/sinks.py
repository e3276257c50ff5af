"""One way out for all formats: a cloud is validated first, then written whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame

from splatframe.operators import validate
from splatframe.plans.governance import SplatError
from splatframe.sources import glb, ply, spz
from splatframe.sources.files import write_bytes


def validate_then_write(df: DataFrame, path: str, kind: str, overwrite: bool = False) -> list[dict]:
    """Writes a canonical cloud as ply, ply_ascii, spz, splat or glb, and returns what the format lost.

    Nothing is written for an empty cloud or one with an invalid row: the first offender's code is raised. PLY is
    written by tasks. The other formats are one compressed or framed block of at most a few million rows by their own
    limits, so their rows meet on the driver.
    """
    if kind not in ("ply", "ply_ascii", "spz", "splat", "glb"):
        raise SplatError("MK0401", kind, "argument")
    validate.require_valid(df)
    spark = df.sparkSession
    if kind.startswith("ply"):
        spark.dataSource.register(ply.PlyDataSource)
        degree = df.agg({"sh_degree": "max"}).first()[0]
        writer = df.select(*ply.CANONICAL.names).write.format("ply").option("path", path).option("degree", str(degree))
        encoding = "ascii" if kind == "ply_ascii" else "binary_little_endian"
        writer.option("encoding", encoding).mode("overwrite" if overwrite else "append").save()
        return []
    if kind == "glb":
        data, losses = glb.write_glb(df)
    else:
        columns, degree = spz.columns_of(df)
        losses = []
        if kind == "spz":
            data = spz.pack(columns, degree)
        else:
            data = spz.pack_splat(columns)
            if degree:
                losses.append({"code": "LOSS_SH_DEGREE_TRUNCATED", "severity": "severe", "affected_splats": len(columns["position"])})
    write_bytes(spark, path, data, overwrite)
    return losses
