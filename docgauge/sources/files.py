"""Small files on whatever file system Spark writes to, through Hadoop's interface: the driver and the executors see the same ones."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers name it."""
    system, place = _at(spark, path)
    return system.makeQualified(place).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    system, place = _at(spark, path)
    return sorted(s.getPath().toString() for s in system.listStatus(place)) if system.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    system, place = _at(spark, path)
    stream = system.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, parts: Iterable[str], overwrite: bool = True) -> None:
    """Writes the parts one after the other; none is kept."""
    system, place = _at(spark, path)
    stream = system.create(place, overwrite)
    try:
        for part in parts:
            stream.write(bytearray(part.encode("utf-8")))
    finally:
        stream.close()
