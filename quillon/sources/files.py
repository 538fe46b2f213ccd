"""Files: seeds that must lie in a folder, artifacts of a session, traces, reports.

Paths of seeds are checked on the driver before anything is read; contents are read by Spark."""

from __future__ import annotations

import os
import shutil
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import schemas
from quillon.functions import text as T
from quillon.operators import chunk

_SEED = "file string, path string, text string, error string"


def resolve_seed(folder: str, name: str) -> str | None:
    """Path of a seed file, or null if it leaves the folder or is no regular file."""
    base = os.path.realpath(folder)
    path = os.path.realpath(name if os.path.isabs(name) else os.path.join(base, name))
    inside = path == base or path.startswith(base.rstrip(os.sep) + os.sep)
    return path if inside and os.path.isfile(path) else None


def seed_files(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A row for each named file: its text (UTF-8, bad bytes replaced), or an error."""
    found = [(n, resolve_seed(folder, n)) for n in names]
    table = spark.createDataFrame([(n, p, None if p else "not a file of the seed folder") for n, p in found], "file string, path string, error string")
    paths = sorted({p for _, p in found if p})
    if not paths:
        return table.withColumn("text", F.lit(None).cast("string")).select("file", "path", "text", "error")
    raw = spark.read.format("binaryFile").load([f"file://{p}" for p in paths])
    raw = raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text"))
    return table.join(raw, "path", "left").select("file", "path", "text", "error")


def seed_pages(seeds: DataFrame, session: str | None = None) -> DataFrame:
    """Page rows of seed files that were read."""
    rows = seeds.where(F.col("error").isNull())
    return rows.select(
        T.content_id(F.col("path")).alias("id"),
        F.lit(session).cast("string").alias("session_id"),
        F.concat(F.lit("file://"), F.col("path")).alias("url"),
        F.element_at(F.split("path", "/"), -1).alias("title"),
        F.col("text").alias("raw_markdown"),
        F.col("text").alias("fit_markdown"),
        T.word_count(F.col("text")).alias("word_count"),
        T.word_count(F.col("text")).alias("fit_word_count"),
        F.lit("seed_file").alias("strategy"),
        F.lit(0.0).alias("total_score"),
        F.lit(200).alias("status_code"),
        F.lit(True).alias("success"),
    )


def ingest_seeds(spark: SparkSession, folder: str, names: list[str], urls: DataFrame | None = None, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(a row for each seed, counts): files as above, URLs looked up among crawled pages."""
    files = seed_files(spark, folder, names).select(F.col("file").alias("seed"), F.col("error"), F.size(chunk.chunks(F.coalesce("text", F.lit("")))).alias("chunks"))
    rows = files
    if urls is not None and pages is not None:
        met = urls.join(pages.select("url", F.col("success").alias("ok"), F.size(chunk.chunks(F.col("fit_markdown"))).alias("chunks")), "url", "left")
        rows = files.unionByName(met.select(F.col("url").alias("seed"), F.when(~F.coalesce("ok", F.lit(False)), "crawl failed").alias("error"), F.coalesce("chunks", F.lit(0)).alias("chunks")))
    counts = rows.agg(F.count("*").alias("requested"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    return rows, counts


ARTIFACTS = {"stage": (schemas.STAGE, "stage.json"), "plan": (schemas.PLAN, "plan.json"), "scored_urls": (schemas.SCORED_URL, "scored_urls.json"), "ledger": (schemas.LEDGER, "ledger.json")}


def local_path(path: str) -> str:
    return unquote(urlsplit(path).path) if path.startswith("file:") else path


def read_artifact(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    """An artifact of a session. Absent URLs and ledgers are empty; an absent stage or plan is None."""
    schema, name = ARTIFACTS[kind]
    path = os.path.join(local_path(folder), name)
    if not os.path.exists(path):
        return spark.createDataFrame([], schema) if kind in ("scored_urls", "ledger") else None
    return spark.read.schema(schema).json(f"file://{path}", multiLine=True)


def write_artifact(text: str, folder: str, name: str) -> str:
    """Write one artifact's text, whole or not at all; returns its path. A folder with a scheme
    other than ``file`` is written to by the file system of that scheme."""
    folder = local_path(folder)
    if "://" in folder:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path = f"{base}/{name}"
        part = f"{path}.{uuid.uuid4().hex}.new"
        with store.open_output_stream(part) as out:
            out.write(text.encode())
        store.move(part, path)
        return f"{folder}/{name}"
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    # a name of its own for each attempt, as two of them may write at once
    part = f"{path}.{uuid.uuid4().hex}.new"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(part, path)
    return path


def stale_exports(folder: str, cutoff: float) -> list[str]:
    """Names of the folders directly in ``folder`` that were last changed before ``cutoff`` (seconds)."""
    base = local_path(folder)
    if not os.path.isdir(base):
        return []
    found = [e for e in os.scandir(base) if e.is_dir(follow_symlinks=False)]
    return sorted(e.name for e in found if e.stat().st_mtime < cutoff)


def prune_exports(folder: str, cutoff: float, dry_run: bool = False) -> list[str]:
    """Delete those folders; one that cannot be deleted is passed over. Returns what went (or would)."""
    gone = []
    for name in stale_exports(folder, cutoff):
        if not dry_run:
            try:
                shutil.rmtree(os.path.join(local_path(folder), name))
            except OSError:
                continue
        gone.append(name)
    return gone


def create_session(spark: SparkSession, query: str, now: str) -> DataFrame:
    """The first stage row of a session; ``now`` is a timestamp, never the clock."""
    name = T.session_name(F.lit(query), F.lit(now).cast("timestamp"))
    return spark.range(1).select(name.alias("session_id"), F.lit(query).alias("raw_query"), F.lit("").alias("normalized_query"), F.lit("intake").alias("stage"), F.lit(None).cast("string").alias("current_subtopic_id"), F.lit(0).alias("iteration"), F.lit(now).alias("updated_at"))


def set_stage(state: DataFrame, stage: str, now: str, **fields) -> DataFrame:
    """The stage row moved on; other fields carry over unless given."""
    return state.withColumns({"stage": F.lit(stage), "updated_at": F.lit(now)} | {k: F.lit(v) for k, v in fields.items()})
