"""Folders of any store that Spark can reach: whether they are there, what they hold, moving and removing them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):  # noqa: ANN202 - a Java object
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _store(spark, path).exists(_path(spark, path))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of the files and folders in a folder; none if it is not there."""
    store, folder = _store(spark, path), _path(spark, path)
    return sorted(entry.getPath().getName() for entry in store.listStatus(folder)) if store.exists(folder) else []


def make(spark: SparkSession, path: str) -> None:
    _store(spark, path).mkdirs(_path(spark, path))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all it holds, if it is there."""
    _store(spark, path).delete(_path(spark, path), True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Move a folder; the one above ``target`` is made if it is missing."""
    store = _store(spark, path)
    store.mkdirs(_path(spark, target.rpartition("/")[0]))
    if not store.rename(_path(spark, path), _path(spark, target)):
        raise OSError(f"{path} could not be moved to {target}")
