"""Traces, retries, rate limits, state changes, retention and store statistics, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT, Config
from quillon.functions import policy as P
from quillon.functions import url as U
from quillon.lineage import kept


def seconds(ts: Column) -> Column:
    return ts.cast("timestamp").cast("double")


def micros(ts: Column) -> Column:
    """Whole microseconds, whose differences are exact; doubles of seconds are not."""
    return F.unix_micros(ts.cast("timestamp"))


def spans(events: DataFrame, keys: list[str], kind: str = "kind", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Start and end of the spans in each key: an end takes the latest start before it that no
    other end has taken, as a map that holds one start for a key does; a second start replaces
    the first, an end (or error) without one has no latency. ``kind`` is start, end or error. Rows
    are looked at in parts of a key, and the last row of a part is handed to the next, so that
    no task holds a key's rows."""
    rows = _in_parts(events, [*keys, ts, tie])
    own = Window.partitionBy("part__", *keys).orderBy(ts, tie)
    row = F.struct(F.col(kind).alias("kind"), F.col(ts).alias("ts"))
    parts = rows.groupBy("part__", *keys).agg(F.max_by(row, F.struct(ts, tie)).alias("last__"))
    parts = parts.withColumn("last__", F.lag("last__").over(Window.partitionBy(*keys).orderBy("part__")))
    rows = _with_parts(rows.withColumn("before__", F.lag(row).over(own)), parts, keys).withColumn("before__", F.coalesce("before__", "last__"))
    paired = F.col("before__.kind") == "start"
    out = rows.where(F.col(kind) != "start").withColumn("started", F.when(paired, F.col("before__.ts")))
    return out.withColumn("latency_ms", F.when(F.col(kind) == "end", F.round((micros(F.col(ts)) - micros(F.col("started"))) / 1000).cast("long"))).drop("before__", "last__", "part__")


def last_write(changes: DataFrame, keys: list[str], value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last value of each key."""
    return changes.groupBy(*keys).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def retry_outcome(attempts: DataFrame, key: str, retries: int = DEFAULT.retries, base: float = DEFAULT.backoff) -> DataFrame:
    """For each key the attempt that counts (the first that is not to be repeated, else the last
    allowed), and the delay before it. ``attempts``: key, attempt (from 0), status_code, success."""
    rows = attempts.where(F.col("attempt") <= retries).withColumn("again", P.retryable(F.col("status_code"), F.col("success")))
    done = F.min(F.when(~F.col("again"), F.struct("attempt", "status_code", "success")))
    final = F.max(F.struct("attempt", "status_code", "success"))
    out = rows.groupBy(key).agg(F.coalesce(done, final).alias("r"))
    waited = F.aggregate(F.sequence(F.lit(0), F.col("r.attempt")), F.lit(0.0), lambda s, i: s + F.when(i < F.col("r.attempt"), F.pow(F.lit(2.0), i) * base).otherwise(0.0))
    return out.select(key, F.col("r.attempt").alias("attempts_before"), F.col("r.status_code").alias("status_code"), F.col("r.success").alias("success"), waited.alias("waited"))


def _in_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` kept in ranges of their order, keys first, which ``part__`` numbers: a key of many rows is
    in many parts, and those after one hold its later rows."""
    return kept(rows.repartitionByRange(*order)).withColumn("part__", F.spark_partition_id())


def _with_parts(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their part and keys."""
    names = {c: f"k{i}__" for i, c in enumerate(keys)}
    met = F.col("part__") == F.col("p__")
    for c, other in names.items():
        met &= F.col(c).eqNullSafe(F.col(other))
    return rows.join(parts.withColumnsRenamed({"part__": "p__"} | names), met).drop("p__", *names.values())


def rate_schedule(requests: DataFrame, url: str | None = "url", domain: str | None = None, ts: str = "ts", tie: str = "request_id", gap: float = DEFAULT.spacing) -> DataFrame:
    """When each request may go: at its time, or ``gap`` seconds after the one before it of its
    registrable domain. In closed form: with i its place, max over earlier ones of (ts - i gap),
    plus i gap. Both are taken in parts of a domain, then over its parts, so that no task holds a
    domain's requests. ``ts`` is in seconds."""
    rows = requests if domain else requests.withColumn("domain", F.coalesce(F.nullif(U.registrable(F.col(url)), F.lit("")), F.col(url)))
    key = domain or "domain"
    rows = _in_parts(rows, [key, ts, tie])
    own = Window.partitionBy("part__", key).orderBy(ts, tie)
    rows = rows.withColumn("i__", F.row_number().over(own) - 1)
    rows = rows.withColumn("slack__", F.max(F.col(ts) - F.col("i__") * gap).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(key).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part__", key).agg(F.count("*").alias("n__"), F.max("slack__").alias("most__"))
    parts = parts.withColumn("ahead__", F.coalesce(F.sum("n__").over(before), F.lit(0)))
    parts = parts.withColumn("most__", F.max(F.col("most__") - F.col("ahead__") * gap).over(before)).drop("n__")
    rows = _with_parts(rows, parts, [key])
    allowed = F.greatest(F.col("slack__") - F.col("ahead__") * gap, "most__") + (F.col("ahead__") + F.col("i__")) * gap
    return rows.withColumn("allowed", allowed).withColumn("wait", F.greatest(F.col("allowed") - F.col(ts), F.lit(0.0))).drop("part__", "i__", "slack__", "ahead__", "most__")


def prune(sessions: DataFrame, now: str, days: int, ts: str = "last_update") -> tuple[DataFrame, DataFrame]:
    """(kept, stale) sessions: stale were last changed before ``now`` less ``days``; a window of 0
    days or fewer keeps all. The stale list is what a dry run shows."""
    if days <= 0:
        return sessions, sessions.limit(0)
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return sessions.where(F.col(ts) >= cutoff), sessions.where(F.col(ts) < cutoff)


def store_stats(sessions: DataFrame, pages: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, session: str | None = None) -> DataFrame:
    """One row of counts. They are global, as a session is only echoed; vectors that cannot be
    counted are -1."""
    out = sessions.agg(F.count("*").alias("sessions")).join(pages.agg(F.count("*").alias("pages"), F.count_if("success").alias("successful_pages"))).join(chunks.agg(F.count("*").alias("chunks")))
    out = out.join(vectors.agg(F.count("*").alias("vectors"))) if vectors is not None else out.withColumn("vectors", F.lit(-1).cast("long"))
    return out.withColumn("session_id", F.lit(session).cast("string"))


def scoped_stats(pages: DataFrame, chunks: DataFrame, session: str) -> DataFrame:
    """The counts of one session."""
    own = pages.where(F.col("session_id") == session)
    return own.agg(F.count("*").alias("pages"), F.count_if("success").alias("successful_pages")).join(chunks.join(own.select(F.col("id").alias("page_id")), "page_id", "left_semi").agg(F.count("*").alias("chunks")))


def top_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    return pages.where("success").orderBy(F.desc("total_score"), "url").limit(n).select("url", "title", "total_score")


def peak(samples: DataFrame, value: str, order: str) -> DataFrame:
    """Running maximum of a series in each key ``probe``, in parts of a series, then over these."""
    rows = _in_parts(samples, ["probe", order])
    own = Window.partitionBy("part__", "probe").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("probe").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part__", "probe").agg(F.max(value).alias("most__")).withColumn("most__", F.max("most__").over(before))
    return _with_parts(rows.withColumn("peak", F.max(value).over(own)), parts, ["probe"]).withColumn("peak", F.greatest("peak", "most__")).drop("part__", "most__")


def research_passes(passes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of passes that are run: up to and with the pass at which the rule stops."""
    from quillon.operators.claims import stop_passes

    stops = stop_passes(passes, config).select("subtopic_id", "stop_iteration")
    return passes.join(stops, "subtopic_id").where(F.coalesce(F.col("iteration") <= F.col("stop_iteration"), F.lit(True))).drop("stop_iteration")
