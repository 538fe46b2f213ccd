"""Cutting lineage in iterative operators, by files in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK_ROWS = 250_000
MOST = 5  # a task may hold so many times its rows before a shuffle has more partitions than it writes straight to files


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session. Where it is
    unset and Spark runs in one process (tests), a folder of this machine is set as its own; a
    cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from reliable storage from then on."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """So many partitions that a task holds ``each`` of ``rows`` rows, the session's at least. For more partitions than
    Spark writes straight to files a map task sorts its whole split in memory, so their number stays there until a task
    would hold ``MOST`` times ``each``, and a task never holds more."""
    n = -(-rows // each)
    straight = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if n > straight:
        n = max(straight, -(-rows // (MOST * each)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)


def dealt(df: DataFrame, key: str | list[str], rows: int, each: int = TASK_ROWS) -> DataFrame:
    """``df``, which has about ``rows`` rows, by ``key`` in so many partitions (``parts``) that sorts and groups by it hold
    a bounded number of rows a task, however many there are. A few rows stay where they are."""
    if rows <= 4 * each:
        return df
    return df.repartition(parts(df.sparkSession, rows, each), *([key] if isinstance(key, str) else key))


def ranked(df: DataFrame, order: list, name: str = "rank", rows: int = 0, each: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """``df`` with each row's rank from 0 in ``order``, and the number of rows. Rows are sorted by
    ranges and kept, so their places hold; a rank is a row's place in its partition plus the
    partition's offset. The driver sees one count for each partition, no task sees all rows; where
    ``df`` is known to have many ``rows``, no task sorts many more than ``parts`` gives it."""
    ranges = [parts(df.sparkSession, rows, each), *order] if rows > 4 * each else order
    placed = kept(df.repartitionByRange(*ranges).sortWithinPartitions(*order)).withColumn("at__", F.monotonically_increasing_id())
    part = F.shiftright("at__", 33)
    total, offsets = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "p__ long, ahead__ long")
    placed = placed.withColumn("p__", part).join(F.broadcast(table), "p__")
    return placed.withColumn(name, F.col("at__").bitwiseAND((1 << 33) - 1) + F.col("ahead__")).drop("at__", "p__", "ahead__"), total
