"""Bytes of files by Spark's own file systems, atomic single-file output, and listings."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splatframe.plans.governance import SplatError

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp", ".heic")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file, by the file system of its path."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """Writes beside the target and renames, so readers see the old file or the whole new one: one step on local file
    systems and HDFS, also where a file is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p) and not overwrite:
        raise SplatError("MK0501", f"{p.getName()} exists", "io")
    held = hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(held, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark._sc._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(held), fs.makeQualified(p), options)
    except Exception as e:
        fs.delete(held, False)
        raise SplatError("MK0502", f"{p.getName()} could not be put in place", "io") from e


def write_local(path: str, data: bytes, overwrite: bool = False, sync: bool = False) -> None:
    """The same on a local disk; neither follows nor replaces links."""
    if os.path.islink(path) or os.path.exists(path) and not overwrite:
        raise SplatError("MK0501", os.path.basename(path), "io")
    fd, held = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            if sync:
                f.flush()
                os.fsync(f.fileno())
        os.replace(held, path)
    except BaseException:
        os.unlink(held)
        raise


def same_file(a: str, b: str) -> bool:
    return os.path.samefile(a, b)


def contained(root: str, name: str) -> str:
    """The path of an external buffer, which must lie in root: no schemes, no parents, no links that lead out."""
    plain = unquote(name)
    if ":" in plain or plain.startswith(("/", "\\")) or ".." in plain.replace("\\", "/").split("/") or "\0" in plain:
        raise SplatError("MK2107", "unsafe path", "data")
    local = root.removeprefix("file://")
    if "://" not in local:  # other file systems have no links
        base, path = os.path.realpath(local), os.path.realpath(os.path.join(local, plain))
        if os.path.commonpath([base, path]) != base:
            raise SplatError("MK2107", "unsafe path", "data")
    return f"{root.rstrip('/')}/{plain}"


def probe(content: Column) -> tuple[Column, Column]:
    """(format, confidence) by the first bytes."""
    head = F.substring(content, 1, 4)
    is_ply = F.hex(F.substring(content, 1, 3)) == "706C79"
    is_glb, is_gzip = F.hex(head) == "676C5446", F.hex(F.substring(content, 1, 2)) == "1F8B"
    is_json = F.hex(F.substring(content, 1, 1)) == "7B"
    kind = F.when(is_glb, "glb").when(is_ply, "ply").when(is_json, "gltf").when(is_gzip, "spz").otherwise("unknown")
    return kind, F.when(is_glb | is_ply, "high").when(is_json | is_gzip, "low").otherwise("none")


def suffix_matches(kind: Column, suffix: Column) -> Column:
    """Whether a lower-cased suffix (with its dot) is the format's."""
    return F.coalesce(suffix == F.concat(F.lit("."), kind), F.lit(False))


def frame_number(path: Column) -> Column:
    """The last number of a file's name before its suffix; null for none."""
    found = F.regexp_extract(path, r"(\d+)(?=\.[^./]+$)", 1)
    return F.when(found != "", found).try_cast("bigint")


def frames(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths in order of frame number, then name."""
    return paths.withColumn("frame_number", frame_number(F.col(path))).orderBy(F.col("frame_number").asc_nulls_first(), path)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Files with an image suffix, with their bytes left on disk until asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return df.filter(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*IMAGE_SUFFIXES))


def project_kind(listing: DataFrame, path: str = "path") -> DataFrame:
    """One row: colmap, images or invalid; and a warning for fewer than 20 images. Under 3 is an error."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    image = F.regexp_extract(name, r"(\.[^.]*)$", 1).isin(*IMAGE_SUFFIXES)
    found = listing.agg(F.count_if(image).alias("n_images"), F.coalesce(F.bool_or(name.rlike(r"^cameras\.(bin|txt)$")), F.lit(False)).alias("sparse"))
    kind = F.when(F.col("sparse"), "colmap").when(F.col("n_images") >= 3, "images").otherwise("invalid")
    return found.select(kind.alias("kind"), "n_images", (F.col("n_images") < 20).alias("few"))
