"""The few things done to files themselves, on whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing if there is no such folder."""
    place, system = _at(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, system = _at(spark, path)
    system.delete(place, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file that is there whole or not at all."""
    place, system = _at(spark, path)
    beside, _ = _at(spark, f"{place.getParent()}/_{place.getName()}")
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(beside, place):
        raise OSError(f"cannot name {path}")


def get_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "\n".join(r[0] for r in spark.read.text(path).collect())
