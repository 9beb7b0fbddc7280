"""Folders of tables on any file system that Spark reaches."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple[Any, Any]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it isn't there."""
    fs, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """The bytes of all files below a folder, by path."""
    fs, at = _at(spark, path)
    found, files = {}, fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found[f.getPath().toString()] = f.getLen()
    return found


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, at = _at(spark, path)
    return fs.rename(at, _at(spark, to)[1])


def make(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.mkdirs(at)
