"""Page, link and chunk tables from crawled pages, and keyed writes.

Plain Parquet has no update: replacing, ignoring and marking are joins that give the new table,
which a caller writes beside the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import url as U
from quillon.functions import values as V

from . import chunk


def page_rows(crawled: DataFrame, strategy: str = "crawl_url") -> DataFrame:
    """Page table of crawled rows: page_id, session_id, url, html, status_code, success, error,
    total_score, crawled_at (those absent get defaults)."""
    has = set(crawled.columns)
    col = lambda name, default: F.coalesce(F.col(name), default) if name in has else default
    null = F.lit(None).cast("string")
    raw, fit = T.raw_text(F.col("html")), T.html_text(F.col("html"))
    ok = col("success", F.lit(True))
    out = crawled.select(
        F.col("page_id").cast("string").alias("id"),
        col("session_id", null).alias("session_id"),
        "url",
        T.title(F.col("html")).alias("title"),
        raw.alias("raw_markdown"),
        T.fit_or_raw(fit, raw).alias("fit_markdown"),
        F.lit(strategy).alias("strategy"),
        col("total_score", F.lit(0.0)).alias("total_score"),
        col("status_code", F.lit(200)).alias("status_code"),
        ok.alias("success"),
        F.when(~ok, col("error", null)).alias("error"),
        col("crawled_at", F.lit(None).cast("timestamp")).alias("crawled_at"),
        null.alias("duplicate_of"),
    )
    return out.withColumns({"word_count": T.word_count(F.col("raw_markdown")), "fit_word_count": T.word_count(F.col("fit_markdown"))})


def link_rows(crawled: DataFrame) -> DataFrame:
    """Edges of the anchors: internal (relative, or of the page's own host) before external."""
    rows = crawled.select(F.col("page_id").cast("string").alias("page_id"), "url", F.posexplode(T.links(F.col("html"))).alias("pos", "href"))
    inner = ~F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | U.same_host(F.col("href"), F.col("url"))
    rows = rows.withColumn("link_type", F.when(inner, "internal").otherwise("external"))
    return with_link_defaults(rows.select("page_id", "href", "link_type", "pos"))


def with_link_defaults(links: DataFrame) -> DataFrame:
    """Absent or null scores are 0, an absent type is internal, an absent text is empty."""
    has = set(links.columns)
    fill = {"text": F.lit(""), "link_type": F.lit("internal"), "intrinsic_score": F.lit(0.0), "contextual_score": F.lit(0.0), "total_score": F.lit(0.0)}
    return links.withColumns({c: F.coalesce(F.col(c), d) if c in has else d for c, d in fill.items()})


def chunk_rows(pages: DataFrame, strategy: str = "sliding_window") -> DataFrame:
    """Chunks of the fitted text, with ids that follow from page and index."""
    rows = chunk.exploded(pages.where(F.trim("fit_markdown") != "").select(F.col("id").alias("page_id"), "url", "fit_markdown"), chunk.chunks(F.col("fit_markdown"), strategy))
    return rows.select(
        T.content_id(F.col("page_id"), F.col("chunk_index").cast("string")).alias("id"),
        "page_id",
        "chunk_index",
        F.col("text").alias("chunk_text"),
        "token_count",
        U.registrable(F.col("url")).alias("etld1"),
    )


def block_rows(extracted: DataFrame) -> DataFrame:
    """Chunks of blocks that a model extracted: ``extracted_content`` is a JSON list of objects
    whose ``content`` is a list; blank blocks go, the index is the place in the list."""
    kind = "array<struct<content:array<string>>>"
    rows = extracted.withColumn("b__", F.from_json("extracted_content", kind))
    rows = rows.select("page_id", "url", F.posexplode("b__").alias("chunk_index", "block"))
    return rows.select("page_id", "url", "chunk_index", V.block_text(F.col("block.content")).alias("chunk_text")).where("chunk_text <> ''").withColumn("token_count", T.word_count(F.col("chunk_text")))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Adds the metadata map of the vector store; a date is a key only where there is one."""
    keys = ["url", "title", "session_id", "query", "chunk_index", "strategy", "page_id", "etld1", "extraction"]
    values = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return chunks.withColumn("metadata", V.present([*keys, "publication_date"], [*values, F.col("publication_date").cast("string")]))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; a replaced page loses
    its mark as a duplicate, as ``new`` does not carry one."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def mark_duplicates(pages: DataFrame, mapping: DataFrame) -> DataFrame:
    """``pages`` with ``duplicate_of`` set from ``mapping`` (mirror, canonical)."""
    named = mapping.select(F.col("mirror").alias("id"), F.col("canonical").alias("c__"))
    return pages.join(named, "id", "left").withColumn("duplicate_of", F.coalesce("c__", "duplicate_of")).drop("c__")


def add_vectors(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, counts): rows with a new id and a vector are added, the others are counted; values
    of the metadata become strings and nulls empty ones."""
    fresh = new.join(old.select("id"), "id", "left_anti").where(F.col("embedding").isNotNull()).dropDuplicates(["id"])
    clean = fresh.withColumn("metadata", F.transform_values("metadata", lambda _, v: F.coalesce(v.cast("string"), F.lit(""))))
    counts = new.agg(F.count("*").alias("given")).join(fresh.agg(F.count("*").alias("added"))).withColumn("skipped", F.col("given") - F.col("added"))
    return old.unionByName(clean, allowMissingColumns=True), counts


def delete_session(vectors: DataFrame, session: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, number deleted) for one session."""
    mine = F.coalesce(F.col("metadata")["session_id"] == session, F.lit(False))
    return vectors.where(~mine), vectors.agg(F.count_if(mine).alias("deleted"))


def latest_page(pages: DataFrame) -> DataFrame:
    """The newest row of each URL."""
    rest = [c for c in pages.columns if c != "url"]
    newest = F.max_by(F.struct(*rest), F.struct("crawled_at", "id"))
    return pages.groupBy("url").agg(newest.alias("p__")).select("url", *[f"p__.{c}" for c in rest])


def by_id(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    """The rows of one key: a session, a page, a chunk."""
    return rows.where(F.col(column) == key)


def crawl_url(pages: DataFrame, url: str) -> DataFrame:
    """The newest crawled row of one URL."""
    return pages.where(F.col("url") == url).orderBy(F.desc("crawled_at"), F.desc("page_id")).limit(1)


def crawl_many(urls: DataFrame, pages: DataFrame, each: bool = False) -> DataFrame:
    """The crawled pages of a list of URLs, in its order; absent pages are failures. With ``each`` a
    page is the answer to one request, whose ``ord`` it has, so that requests that repeat a URL
    have one row each, with their own outcome."""
    return urls.join(pages, ["url", "ord"] if each else "url", "left").withColumn("success", F.coalesce("success", F.lit(False)) if "success" in pages.columns else F.col("page_id").isNotNull())


def crawl_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"))


def preview(pages: DataFrame, chars: int = 300) -> DataFrame:
    return pages.withColumn("preview", T.cut(F.col("fit_markdown"), chars))
