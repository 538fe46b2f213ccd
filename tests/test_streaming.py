"""A stream's result equals the batch result on the same rows."""

import json

from conftest import SMALL
from pyspark.sql import functions as F

from quillon.operators import events, ingest
from quillon.plans import derived as D
from quillon.streaming import flows


def streamed(spark, df, path):
    df.repartition(3).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_last_write(spark, tmp_path):
    e = D.table(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    q = flows.last_write(streamed(spark, e, tmp_path / "in"), ["user_id", "event_type"], "value").writeStream.outputMode("complete").format("memory").queryName("last_write").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rs: sorted(tuple(r) for r in rs)
    assert key(spark.table("last_write").collect()) == key(events.last_write(e, ["user_id", "event_type"], "value").collect())


def test_spans(spark, tmp_path):
    e = D.span_events(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("user_id", F.col("user_id").cast("string"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = flows.span_latency(stream, "user_id").writeStream.outputMode("append").format("memory").queryName("spans").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["event_id"], r["kind"], r["latency_ms"] or -1) for r in spark.table("spans").collect())
    want = sorted((r["event_id"], r["kind"], r["latency_ms"] or -1) for r in events.spans(e, ["user_id"]).collect())
    assert got == want


def test_ingest_restarts(spark, tmp_path):
    crawled = D.crawled(spark, SMALL)
    stream = streamed(spark, crawled, tmp_path / "in")
    for _ in range(2):
        flows.ingest_pages(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    pages = spark.read.parquet(str(tmp_path / "out" / "pages"))
    assert pages.count() == crawled.count()
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).count() == ingest.chunk_rows(ingest.page_rows(crawled)).count()


def test_exports(spark, tmp_path):
    data = [("s1", "v2_plan", "old", 1, 1), ("s1", "v2_plan", "new", 2, 2), ("s1", "other", "x", 3, 3), ("s2", "v2_draft", "text", 1, 4)]
    df = spark.createDataFrame(data, "session_id string, key string, value string, ts int, event_id int")
    flows.export_state(streamed(spark, df.coalesce(1), tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), {"v2_plan": "plan.json", "v2_draft": "draft.md"}).awaitTermination()
    assert (tmp_path / "out/s1/plan.json").read_text() == "new" and (tmp_path / "out/s2/draft.md").read_text() == "text"


def test_trace_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"ts": "2024-01-01T00:00:00Z", "type": "tool_start", "session_id": "s", "tool": "t"}) + "\n")
    flows.append_trace(flows.trace_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_rate_limit_restarts_and_forgets(spark, tmp_path):
    """Three starts of one stream equal the batch form; domains that the watermark has passed leave no state."""
    rows = [(i, f"d{i % 3}", 1_700_000_000 + i // 2) for i in range(60)] + [(100 + i, "late", 1_700_100_000 + 600 * i) for i in range(4)]
    requests = spark.createDataFrame(rows, "request_id long, domain string, t long").withColumn("ts", F.timestamp_seconds("t"))
    folder, progress = str(tmp_path / "in"), str(tmp_path / "cp")
    cuts = [0, 20, 60, 1000]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        requests.where((F.col("request_id") >= lo) & (F.col("request_id") < hi)).coalesce(1).write.mode("append").parquet(folder)
        stream = flows.rate_limited(spark.readStream.schema(requests.schema).parquet(folder), gap=3.0)
        stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r["request_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = events.rate_schedule(requests.withColumn("ts", F.col("t").cast("double")), domain="domain", gap=3.0)
    assert got == {r["request_id"]: r["allowed"] for r in batch.collect()} and len(got) == 64
    state = spark.read.format("statestore").option("stateVarName", "following").load(progress)
    assert {r[0] for r in state.select("key.domain").collect()} == {"late"}


def test_spans_that_never_end_are_forgotten(spark, tmp_path):
    folder, progress = str(tmp_path / "in"), str(tmp_path / "cp")
    rows = [("slow", 0, "start", 0), ("quick", 1, "start", 5), ("quick", 2, "end", 7)], [("other", 3, "start", 10_000)], [("slow", 4, "end", 10_001)]
    schema = "key string, event_id long, kind string, ts timestamp"
    for some in rows:
        spark.createDataFrame(some, "key string, event_id long, kind string, t long").select("key", "event_id", "kind", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        flows.span_latency(spark.readStream.schema(schema).parquet(folder), "key", expire=60).writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["event_id"], r["latency_ms"]) for r in got) == [(2, 2000), (4, None)]


def test_spans_of_a_hot_key_in_parts(spark):
    """All rows in one key: the partitions of its range share them, and the pairs equal a walk."""
    df = spark.range(6_000).select(F.lit(1).alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.when(F.xxhash64("id") % 3 == 0, "end").when(F.xxhash64("id") % 7 == 0, "error").otherwise("start").alias("kind"))
    # so few rows would share a partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = events._in_parts(df, ["user_id", "ts", "event_id"]).groupBy("part__").count().collect()
        got = {r["event_id"]: r["latency_ms"] for r in events.spans(df, ["user_id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 6_000 * 0.7
    want, begun = {}, None
    for r in df.orderBy("event_id").collect():
        if r["kind"] == "start":
            begun = r["event_id"]
            continue
        want[r["event_id"]] = (r["event_id"] - begun) * 2000 if begun is not None and r["kind"] == "end" else None
        begun = None
    assert got == want
