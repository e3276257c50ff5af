"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch that a Python worker holds decoded at once, and their bytes of text.
SLICE_ROWS = 1024
SLICE_BYTES = 8 << 20

#: A-Z to a-z; every other ASCII character that is neither a letter nor a digit to a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a temporary one only where that is unset and Spark local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="splatframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again."""
    path = fresh_dir(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of saved() that are deleted together, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_dir(self.spark, label)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete_saved(self.spark, path)


def new_name(taken: list[str], name: str) -> str:
    """name, with underscores behind it until it differs from all of taken in more than case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name += "_"
    return name


def delete_saved(spark: SparkSession, path: str) -> None:
    """Deletes a folder of saved() by the file system that holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and bytes, so that very long texts don't meet in memory; a row is never cut."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = lengths[at - 1] if at else 0
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(lengths, base + SLICE_BYTES, "right"))))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in batch[text].cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Above 0x7F UTF-8 has no ASCII byte, so bytes do."""
    return text.translate(WORD_BYTES).split()
