"""File manifests, and the guard that keeps held-out files out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BlockedFileError(ValueError):
    """A training input is part of the held-out set."""


def file_manifest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length, sha256)`` of every file under ``path``, hashed by the executors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of path -> sha256, as rows."""
    text = spark.read.text(path, wholetext=True)
    pairs = F.explode(F.from_json("value", "map<string,string>"))
    return text.select(pairs.alias("path", "sha256"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select("path", "sha256").write.mode("overwrite").json(path)


def plain_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def blocked_paths(files: DataFrame, manifest: DataFrame, blocked_dir: str, path: str = "path") -> DataFrame:
    """Rows of ``files`` in the blocked folder, in the manifest by path, or by content hash."""
    listed = manifest.select(plain_path(F.col("path")).alias("_p")).distinct().withColumn("_listed", F.lit(True))
    rows = files.withColumn("_p", plain_path(F.col(path))).join(listed, "_p", "left")
    hit = F.col("_p").contains(blocked_dir) | F.coalesce("_listed", F.lit(False))
    if "sha256" in files.columns and "sha256" in manifest.columns:
        known = manifest.filter("sha256 IS NOT NULL").select("sha256").distinct().withColumn("_known", F.lit(True))
        rows = rows.join(known, "sha256", "left")
        hit = hit | F.coalesce("_known", F.lit(False))
    return rows.filter(hit).select(*files.columns)


def allowed_paths(files: DataFrame, manifest: DataFrame, blocked_dir: str, path: str = "path") -> DataFrame:
    """Rows of ``files`` that may be used for training."""
    return files.join(blocked_paths(files, manifest, blocked_dir, path).select(path).distinct(), path, "left_anti")


def check_training_files(files: DataFrame, manifest: DataFrame, blocked_dir: str, path: str = "path") -> None:
    """Raise if any training input is blocked."""
    first = blocked_paths(files, manifest, blocked_dir, path).select(path).first()
    if first is not None:
        raise BlockedFileError(f"held-out file used for training: {first[0]}")


def check_training_path(
    spark: SparkSession, path: str, blocked_dir: str, manifest: DataFrame | None = None
) -> None:
    """The same check for one path about to be read."""
    plain = path.replace("\\", "/")
    if blocked_dir in plain:
        raise BlockedFileError(f"held-out file used for training: {path}")
    if manifest is not None and not manifest.filter(plain_path(F.col("path")) == plain).isEmpty():
        raise BlockedFileError(f"held-out file used for training: {path}")

