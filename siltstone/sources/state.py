"""Tables kept as versions: each save is a new folder, and readers take the newest whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions under ``path`` that were written to the end, in order; none where there is no such folder."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place)]
    whole = [n for n in names if n.startswith("v") and n[1:].isdigit() and files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[1])]
    return sorted(int(n[1:]) for n in whole)


def save_state(df: DataFrame, path: str) -> int:
    """Write ``df`` as the next version and return its number. A version counts once its ``_SUCCESS`` mark is
    there, so a writer that fails leaves the one before in force. There is one writer at a time."""
    version = max(versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v{version:06d}")
    return version


def load_state(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest whole version, or the one asked for; ValueError where there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no such version under {path}")
    return spark.read.parquet(f"{path}/v{version or known[-1]:06d}")
