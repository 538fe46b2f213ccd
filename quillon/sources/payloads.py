"""Scans of landed search results: the responses of each source, one text a row, to hits.

There is no network in an executor's path: responses land as files or tables (source, query,
payload) and are parsed here. A source that is not configured gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HIT = ["source", "rank", "url", "title", "snippet"]


def _kept(rows: DataFrame) -> list[str]:
    """A query that a payload answers stays with its hits."""
    return [c for c in rows.columns if c == "query"]


def _hits(rows: DataFrame, source: str, url, title, snippet) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(*_kept(rows), F.lit(source).alias("source"), F.col("pos").alias("rank"), url.alias("url"), text(title).alias("title"), text(snippet).alias("snippet")).where(F.coalesce("url", F.lit("")) != "")


def web(results: DataFrame, payload: str = "payload", n: int = 10) -> DataFrame:
    """JSON list of objects with href (or url), title, body."""
    kind = "array<struct<href:string,url:string,title:string,body:string>>"
    rows = results.select(*_kept(results), F.posexplode(F.from_json(payload, kind)).alias("pos", "r")).where(F.col("pos") < n)
    return _hits(rows, "duckduckgo", F.coalesce(F.nullif("r.href", F.lit("")), F.col("r.url")), F.col("r.title"), F.col("r.body"))


def arxiv(results: DataFrame, payload: str = "payload") -> DataFrame:
    """Atom feed: each entry's id, title and summary, trimmed; entries without an id go."""
    entry = "array<struct<id:string,title:string,summary:string>>"
    feed = F.from_xml(F.col(payload), F.lit(f"struct<entry:{entry}>"), {"mode": "PERMISSIVE"})
    rows = results.select(*_kept(results), F.posexplode(feed["entry"]).alias("pos", "r"))
    return _hits(rows, "arxiv", F.trim("r.id"), F.trim("r.title"), F.trim("r.summary"))


def scholar(results: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON ``data`` list: the open-access file's URL before the page's."""
    kind = "struct<data:array<struct<title:string,url:string,abstract:string,openAccessPdf:struct<url:string>>>>"
    rows = results.select(*_kept(results), F.posexplode(F.from_json(payload, kind)["data"]).alias("pos", "r"))
    return _hits(rows, "semantic_scholar", F.coalesce(F.nullif("r.openAccessPdf.url", F.lit("")), F.col("r.url")), F.col("r.title"), F.col("r.abstract"))


def serp(results: DataFrame, payload: str = "payload", configured: bool = True) -> DataFrame:
    """JSON ``organic_results``; without a key there are no hits."""
    kind = "struct<organic_results:array<struct<link:string,title:string,snippet:string>>>"
    rows = results.select(*_kept(results), F.posexplode(F.from_json(payload, kind)["organic_results"]).alias("pos", "r"))
    return _hits(rows if configured else rows.limit(0), "serpapi", F.col("r.link"), F.col("r.title"), F.col("r.snippet"))


def google(results: DataFrame, payload: str = "payload", n: int = 10, enabled: bool = True) -> DataFrame:
    """JSON with ``organic_schema`` or ``organic``, each a list or a list in a string; the first n
    hits. A payload with an error raises."""
    item = "array<struct<link:string,title:string,snippet:string>>"
    both = F.from_json(payload, "struct<error:string,organic_schema:string,organic:string>")
    chosen = F.coalesce(F.nullif(both["organic_schema"], F.lit("")), both["organic"])
    checked = F.when(F.coalesce(both["error"], F.lit("")) == "", chosen).otherwise(F.raise_error(F.concat(F.lit("search error: "), both["error"])))
    rows = results.select(*_kept(results), F.posexplode(F.from_json(checked, item)).alias("pos", "r"))
    return _hits(rows if enabled else rows.limit(0), "google_serp", F.col("r.link"), F.col("r.title"), F.col("r.snippet")).where(F.col("rank") < n)


READERS = {"duckduckgo": web, "arxiv": arxiv, "semantic_scholar": scholar, "serpapi": serp, "google_serp": google}


def register(name: str, reader) -> None:
    """Add a source: ``reader`` takes a table of payloads and gives hits."""
    READERS[name] = reader


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Responses (payload, source, query) that have landed as files of ``source=.../query=...`` folders. Source and
    query are partitions: a filter on them reads no file of another."""
    rows = spark.read.schema("payload string, source string, query string").option("wholetext", True).text(folder)
    return rows.select("payload", "source", "query")


def _error(payload, source):
    """What is wrong with a response: no JSON, or the error that it names; an Atom feed says nothing of itself."""
    parsed = F.try_parse_json(payload)
    named = F.nullif(F.get_json_object(payload, "$.error"), F.lit(""))
    return F.when(source != "arxiv", F.when(F.coalesce(F.trim(payload), F.lit("")) == "", "empty response").when(parsed.isNull(), "no JSON").otherwise(named))


def failures(responses: DataFrame) -> DataFrame:
    """(source, query, error) of the responses that give no hits."""
    found = responses.select("source", "query", _error(F.col("payload"), F.col("source")).alias("error"))
    return found.where("error IS NOT NULL")


def landed_hits(spark: SparkSession, folder: str, sources: list[str]) -> DataFrame:
    """Hits (query, source, src_ord, rank, url, title, snippet) of the asked sources, in their order; responses that
    failed are passed over, as ``failures`` tells. A source without a reader is none."""
    rows, out = landed(spark, folder), None
    for i, source in enumerate(s for s in sources if s in READERS):
        fine = rows.where((F.col("source") == source) & _error(F.col("payload"), F.lit(source)).isNull())
        hits = READERS[source](fine.select("query", "payload")).withColumn("src_ord", F.lit(i))
        out = hits if out is None else out.unionByName(hits)
    schema = "query string, source string, src_ord int, rank int, url string, title string, snippet string"
    return spark.createDataFrame([], schema) if out is None else out.select(*[c.split()[0] for c in schema.split(", ")])
