"""The keyed table: what changes touch, what readers see, and what a change that dies leaves."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.sources.store import Conflict, KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    out = KeyedTable(spark, f"file://{tmp_path}/t")
    out.create(spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("v"), F.lit(None).cast("string").alias("duplicate_of")), buckets=8)
    return out


def files(table):
    root = table.path.removeprefix("file://")
    return {b: sorted(n for n in os.listdir(f"{root}/{f}") if n.endswith(".parquet")) for b, f in table.manifest()["folders"].items()}


def values(df):
    return {r["id"]: r["v"] for r in df.collect()}


def test_a_merge_rewrites_only_what_it_touches(spark, table):
    before = files(table)
    new = spark.createDataFrame([("7", 1), ("new", 2), (None, 3)], "id string, v int")
    touched = {str(r[0]) for r in new.where("id IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    assert table.upsert(new) == 1
    after = files(table)
    assert {b for b in after if after[b] != before[b]} == touched and len(touched) < 8
    got = values(table.read())
    assert len(got) == 201 and got["7"] == 1 and got["new"] == 2 and got["8"] == 0
    assert values(table.read(0))["7"] == 0 and "new" not in values(table.read(0))


def test_the_last_row_of_a_key_wins(spark, table):
    table.upsert(spark.createDataFrame([("7", 1, 5), ("7", 2, 9), ("7", 3, 1)], "id string, v int, at int"), order="at")
    assert values(table.read())["7"] == 2 and table.read().count() == 200


def test_a_change_that_dies_leaves_the_version_before_it(spark, table):
    @F.udf("int")
    def dies(v):
        raise RuntimeError("lost")

    new = spark.createDataFrame([(str(i), 1) for i in range(50)], "id string, v int")
    with pytest.raises(Exception, match="lost"):
        table.upsert(new.withColumn("v", dies("v")))
    assert table.versions() == [0] and set(values(table.read()).values()) == {0}
    # files that were written without a version are nobody's
    table._write(new.withColumn("duplicate_of", F.lit(None).cast("string")), 8)
    assert set(values(table.read()).values()) == {0}
    assert table.vacuum() and table.read().count() == 200


def test_a_second_writer_fails(spark, table):
    first, second = (KeyedTable(spark, table.path) for _ in range(2))
    begun = second.manifest()
    first.upsert(spark.createDataFrame([("1", 1)], "id string, v int"))
    second.manifest = lambda version=None: begun
    with pytest.raises(Conflict):
        second.upsert(spark.createDataFrame([("1", 2)], "id string, v int"))
    assert values(table.read())["1"] == 1


def test_insert_ignore_marks_and_lookups(spark, table):
    table.insert_ignore(spark.createDataFrame([("1", 9), ("x", 9), ("x", 9)], "id string, v int"))
    got = values(table.read())
    assert got["1"] == 0 and got["x"] == 9 and len(got) == 201
    table.mark_duplicates(spark.createDataFrame([("1", "0"), ("absent", "0")], "mirror string, canonical string"))
    assert [tuple(r) for r in table.read().where("duplicate_of IS NOT NULL").select("id", "duplicate_of").collect()] == [("1", "0")]
    found = table.lookup(spark.createDataFrame([("1",), ("x",), ("none",)], "id string"))
    assert set(values(found)) == {"1", "x"}
    scanned = found._jdf.queryExecution().toString()
    assert scanned.count("bucket__=") or len(found.inputFiles()) < len(table.read().inputFiles())


def test_vectors(spark, tmp_path):
    rows = spark.range(30).select("id", F.when(F.col("id") % 5 != 0, F.array(F.lit(1.0))).alias("embedding"), F.create_map(F.lit("session_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")), F.lit("q"), F.lit(None).cast("string")).alias("metadata"))
    table = KeyedTable(spark, f"file://{tmp_path}/v")
    table.create(rows.where("id < 10"), buckets=4)
    assert tuple(table.add_vectors(rows).first()) == (30, 16, 14)
    assert table.read().count() == 26
    assert table.read().where("id = 11").first()["metadata"]["q"] == ""
    gone = table.read().where(F.col("metadata")["session_id"] == "s1").count()
    assert table.delete_session("s1").first()[0] == gone > 0 and table.read().count() == 26 - gone
    assert table.delete_session("none").first()[0] == 0 and table.versions() == [0, 1, 2]
    table.vacuum()
    assert table.versions() == [2] and table.read().count() == 26 - gone


def test_empty_tables(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/e")
    table.create(spark.createDataFrame([], "id string, v int"))
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([("a", 1)], "id string, v int"))
    assert values(table.read()) == {"a": 1}
    table.delete_where(F.col("v") == 1)
    assert table.read().count() == 0
    with pytest.raises(Conflict):
        table.create(table.read())
