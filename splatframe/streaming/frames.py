"""Frame sequences: residency windows over tables, and the same sequences as streams (an extension)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splatframe.sources.files import write_bytes


def frame_window(df: DataFrame, behind: int = 2, ahead: int = 6, key: str = "sequence", frame: str = "frame") -> DataFrame:
    """Adds first_resident, last_resident and n_resident: the frames held when this one is shown."""
    near = Window.partitionBy(key).orderBy(frame).rangeBetween(-behind, ahead)
    return df.withColumns({"first_resident": F.min(frame).over(near), "last_resident": F.max(frame).over(near), "n_resident": F.count("*").over(near)})


def frame_order(df: DataFrame, name: str = "name") -> DataFrame:
    """By the trailing number, then by name."""
    from splatframe.sources.files import frames

    return frames(df, name)


def manifest(spark: SparkSession, path: str, names: list[str], fps: float) -> None:
    write_bytes(spark, f"{path}/manifest.json", json.dumps({"fps": fps, "frames": names}).encode())


def write_sequence(df: DataFrame, path: str, fps: float, frame: str = "frame") -> None:
    """One folder for each frame, and a manifest in frame order."""
    df.write.partitionBy(frame).parquet(f"{path}/frames")
    numbers = [r[0] for r in df.select(frame).distinct().orderBy(frame).toLocalIterator()]
    manifest(df.sparkSession, path, [f"frames/{frame}={n}" for n in numbers], fps)


def with_event_time(df: DataFrame, fps: float, start: str = "2024-01-01 00:00:00", frame: str = "frame") -> DataFrame:
    return df.withColumn("event_time", (F.unix_timestamp(F.lit(start)) + F.col(frame) / fps).cast("timestamp"))


def windowed(df: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", time: str = "event_time", value: str = "value") -> DataFrame:  # fmt: skip # noqa: E501
    """Counts and sums by tumbling or sliding windows; batch or stream. Rows later than the watermark drop out."""
    source = df.withWatermark(time, late) if df.isStreaming else df
    span = F.window(time, width, slide) if slide else F.window(time, width)
    return source.groupBy(span.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total"
    )


def sessions(df: DataFrame, gap: str, late: str = "1 hour", key: str = "sequence", time: str = "event_time") -> DataFrame:
    source = df.withWatermark(time, late) if df.isStreaming else df
    return source.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"
    )


def latest(df: DataFrame, key: str = "sequence", token: str = "token", value: str = "event_id") -> DataFrame:
    """(key, token, value): the newest seek of each sequence wins; of equal tokens the greatest value.

    As a stream it runs in update mode, with one row of state for each sequence: a seek that comes after a newer one is
    stale and changes nothing.
    """
    newest = df.groupBy(key).agg(F.max(F.struct(token, value)).alias("k"))
    return newest.select(key, F.col(f"k.{token}").alias(token), F.col(f"k.{value}").alias(value))


def once(df: DataFrame, late: str = "10 minutes", token: str = "token", time: str = "event_time") -> DataFrame:
    """Each token once: repeats drop out while the watermark remembers them."""
    if df.isStreaming:
        return df.withWatermark(time, late).dropDuplicatesWithinWatermark([token])
    return df.dropDuplicates([token])


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a memory table, and reads it."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()  # fmt: skip # noqa: E501
    query.awaitTermination()
    return df.sparkSession.table(name)
