"""Discovery: source resolution, merging of hits by canonical URL, caps.

Order decides what wins, so hits carry ``src_ord`` (place of the source in the request) and
``rank`` (place within the source). Grouping is by canonical URL with ordered aggregates that
combine before the shuffle; no window over all hits is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT, DEFAULT_SOURCES, SOURCES
from quillon.functions import url as U

HIT = "source string, src_ord int, rank int, url string, title string, snippet string"


def resolve_sources(requested: list[str | None] | None, known: tuple[str, ...] = SOURCES, default: tuple[str, ...] = DEFAULT_SOURCES) -> list[str]:
    """Known sources among those asked for, trimmed and lower-cased, each once, in order."""
    asked = [s.strip().lower() for s in (requested or default) if s and s.strip()]
    return list(dict.fromkeys(s for s in asked if s in known))


def resolve_column(requested: Column, known: tuple[str, ...] = SOURCES) -> Column:
    """The same on an array column."""
    clean = F.transform(requested, lambda s: F.lower(F.trim(s)))
    return F.array_distinct(F.filter(clean, lambda s: s.isin(*known)))


def as_hits(df: DataFrame, url: str = "url", title: str = "title", snippet: str = "snippet") -> DataFrame:
    """Projection to hits: null titles and snippets are empty, rows without a URL go."""
    empty = F.lit("")
    return df.where(F.coalesce(F.col(url), empty) != "").select(F.col("source"), F.col("src_ord"), F.col("rank"), F.col(url).alias("url"), F.coalesce(F.col(title), empty).alias("title"), F.coalesce(F.col(snippet), empty).alias("snippet"))


def first_seen(hits: DataFrame) -> DataFrame:
    """One row for each canonical URL: the first hit by (src_ord, rank)."""
    return _merged(hits).drop("also_in")


def _merged(hits: DataFrame) -> DataFrame:
    rows = hits.withColumn("canon", U.canonical(F.col("url")))
    first = F.min_by(F.struct("source", "src_ord", "rank", "title", "snippet"), F.struct("src_ord", "rank", "source", "title", "snippet"))
    seen = F.collect_set(F.struct("src_ord", "source"))
    # a source is met first where it is met first in the request: one entry for each source
    out = rows.groupBy("canon").agg(first.alias("f"), seen.alias("s"))
    others = F.array_distinct(F.transform(F.array_sort("s"), lambda x: x["source"]))
    return out.select(
        F.col("canon").alias("url"),
        "f.source",
        "f.src_ord",
        "f.rank",
        "f.title",
        "f.snippet",
        F.array_except(others, F.array("f.source")).alias("also_in"),
    )


def merge(hits: DataFrame) -> DataFrame:
    """Merged hits with ``also_in`` (other sources, in order) and ``etld1``."""
    return _merged(hits).withColumn("etld1", U.registrable(F.col("url")))


def by_source(merged: DataFrame) -> DataFrame:
    """First-seen hits of each source; no cap applies here."""
    return merged.groupBy("source").agg(F.count("*").alias("hits"))


def cap_per_source(hits: DataFrame, n: int = DEFAULT.per_source) -> DataFrame:
    order = Window.partitionBy("src_ord").orderBy("rank", "url")
    return hits.withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= n).drop("n__")


def cap_total(merged: DataFrame, n: int = DEFAULT.total) -> DataFrame:
    return merged.orderBy("src_ord", "rank", "url").limit(n)


def with_supplemental(urls: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Scored URLs and those found later for a subtopic; nothing is dropped, also not what repeats."""
    return urls.unionByName(supplemental, allowMissingColumns=True)


def union_sources(spark: SparkSession, parts: dict[str, DataFrame | Exception]) -> tuple[DataFrame, dict[str, str]]:
    """Hits of several sources in request order, and the message of each that failed."""
    errors, out = {}, spark.createDataFrame([], HIT)
    for i, (source, part) in enumerate(parts.items()):
        if isinstance(part, Exception):
            errors[source] = f"{type(part).__name__}: {part}"
            continue
        out = out.unionByName(part.withColumns({"source": F.lit(source), "src_ord": F.lit(i)}).select("source", "src_ord", "rank", "url", "title", "snippet"))
    return out, errors
