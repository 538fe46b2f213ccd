"""Small files of the driver in any file system that Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it is absent."""
    path, store = _at(spark, folder)
    return sorted(s.getPath().getName() for s in store.listStatus(path)) if store.exists(path) else []


def read_text(spark: SparkSession, path: str) -> str:
    found, store = _at(spark, path)
    stream = store.open(found)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that is not there yet, whole or not at all."""
    final, store = _at(spark, path)
    part, _ = _at(spark, f"{final.getParent().toString()}/.{uuid.uuid4().hex}")
    stream = store.create(part, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if store.exists(final) or not store.rename(part, final):
        store.delete(part, False)
        raise FileExistsError(path)


def delete(spark: SparkSession, path: str) -> None:
    found, store = _at(spark, path)
    store.delete(found, True)
