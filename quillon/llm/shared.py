"""Shared folder, lineage cuts and small helpers."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.lineage import ranked, shared_dir

__all__ = ["discard", "fresh_dir", "ranked", "running", "saved", "sent", "shared_dir", "sized_parts"]

#: Bytes of a table up to which it is sent to all tasks.
SEND = 8 << 20


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """Written to the shared folder and read again, which cuts the lineage. ``saved_at`` is its
    path. Where a bound on its rows is known, it takes no more files than ``each`` rows a file
    need, however many partitions a shuffle has left."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    (df if rows is None else df.coalesce(sized_parts(rows, each))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``saved`` wrote; for tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent(df: DataFrame, each: int) -> DataFrame:
    """``df``, a saved table of rows of ``each`` bytes, to be sent to all tasks of a join if it is
    counted to be at most ``SEND`` bytes; else joined by shuffle."""
    return F.broadcast(df) if df.count() * each <= SEND else df


def sized_parts(rows: int, each: int) -> int:
    """Groups of about ``each`` rows that ``rows`` rows need."""
    return max(1, -(-rows // each))


def running(df: DataFrame, order: list, value: str, parts: int, row: str, before: str) -> tuple[DataFrame, int]:
    """``df`` sorted by ``order``, with each row's number (``row``, from 0) and the sum of
    ``value`` over the rows before it (``before``); and the whole sum. Rows are sorted by ranges
    and kept with the sums inside their partition; the driver sees two figures for each
    partition, no task sees all rows of a key."""
    schema = df.schema.add("part__", "integer").add("row__", "long").add("inside__", "long")
    at = df.columns.index(value)

    def run(batches):
        n = total = 0
        part = TaskContext.get().partitionId()
        for b in batches:
            sums = np.cumsum(b.column(at).to_numpy())
            m = b.num_rows
            inside = total + sums - b.column(at).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(m, part, np.int32)), pa.array(np.arange(n, n + m)), pa.array(inside)], names=schema.names)
            n, total = n + m, total + (int(sums[-1]) if m else 0)

    out = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "running")
    rows, total, offsets = 0, 0, []
    for p, n, s in sorted(tuple(r) for r in out.groupBy("part__").agg(F.count("*"), F.sum(value)).collect()):
        offsets.append((p, rows, total))
        rows, total = rows + n, total + s
    table = df.sparkSession.createDataFrame(offsets, "part__ int, rows__ long, ahead__ long")
    out = out.join(F.broadcast(table), "part__").withColumns({row: F.col("row__") + F.col("rows__"), before: F.col("inside__") + F.col("ahead__")})
    return out.drop("part__", "row__", "inside__", "rows__", "ahead__"), total
