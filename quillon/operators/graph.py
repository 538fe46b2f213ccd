"""Bounded graph walks: citations, citation enrichment, site crawls, adaptive crawls.

Walks go level by level; a level is a join of the frontier with the edges and an anti-join with
what was found before. Levels are few and bounded, and each is kept in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT
from quillon.functions import url as U
from quillon.functions.text import words
from quillon.lineage import kept

DIRECTIONS = ("references", "citations")


def paper_metadata(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Papers of a list of raw ids: those that are no id, or unknown, are absent."""
    named = ids.select(U.paper_id(F.col("raw")).alias("paper_id")).where("paper_id IS NOT NULL").distinct()
    return papers.join(named, "paper_id")


def citation_bfs(papers: DataFrame, seeds: DataFrame, direction: str = "references", hops: int = DEFAULT.hops, scorer: Column | None = None, threshold: float = DEFAULT.citation_relevance) -> DataFrame:
    """(seed, paper_id, hop) of every paper that each seed reaches in ``hops`` levels. ``papers``:
    paper_id and the two lists of ids. A candidate without a row is passed over; with ``scorer``
    (a column on papers) those below the threshold are not followed. Seeds that are unknown
    reach nothing."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    found = kept(seeds.select(F.col("paper_id")).distinct().join(papers.select("paper_id"), "paper_id").select(F.col("paper_id").alias("seed"), "paper_id", F.lit(0).alias("hop")))
    allowed = papers if scorer is None else papers.where(scorer >= threshold)
    edges = papers.select(F.col("paper_id"), F.explode(direction).alias("next")).where("next IS NOT NULL")
    frontier = found
    for hop in range(1, hops + 1):
        reached = frontier.select("seed", "paper_id").join(edges, "paper_id").select("seed", F.col("next").alias("paper_id")).distinct()
        new = reached.join(found, ["seed", "paper_id"], "left_anti").join(allowed.select("paper_id"), "paper_id", "left_semi")
        frontier = kept(new.select("seed", "paper_id", F.lit(hop).alias("hop")))
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier)
    return found


def enrich(urls: DataFrame, papers: DataFrame, **options) -> DataFrame:
    """Scored URLs (url, ord, query, score, publication_date, ...) with ``citation_refs`` and missing
    dates of those that name a paper, and a new row for each paper found whose page is not yet
    among them: the first seed by ``ord`` that reaches it passes on query and score."""
    seeds = urls.withColumn("paper_id", U.paper_id(F.col("url")))
    walks = citation_bfs(papers, seeds.where("paper_id IS NOT NULL"), **options)
    facts = papers.select("paper_id", "s2_paper_id", F.col("publication_date").alias("date"))
    refs = walks.where("paper_id <> seed").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("hop", "paper_id"))).alias("r")).select(F.col("seed").alias("paper_id"), F.transform("r", lambda x: x["paper_id"]).alias("refs"))
    empty = F.array().cast("array<string>")
    old = seeds.join(refs, "paper_id", "left").join(facts.select("paper_id", "date"), "paper_id", "left")
    old = old.withColumns({"citation_refs": F.coalesce("refs", empty), "publication_date": F.coalesce("publication_date", "date")}).drop("refs", "date", "paper_id")
    reached = walks.where("paper_id <> seed").join(facts, "paper_id").withColumn("page", U.paper_page(F.col("s2_paper_id"), F.col("paper_id")))
    by_seed = reached.join(seeds.select(F.col("paper_id").alias("seed"), "ord", "query", "score"), "seed")
    fresh = by_seed.groupBy("page").agg(F.min_by(F.struct("ord", "query", "score", "date"), F.struct("ord", "hop", "paper_id")).alias("s"))
    fresh = fresh.join(urls.select(F.col("url").alias("page")), "page", "left_anti")
    new = fresh.select(
        F.col("page").alias("url"),
        F.lit(None).cast("long").alias("ord"),
        "s.query",
        "s.score",
        F.lit("crawl_url").alias("strategy"),
        F.lit("citation_bfs").alias("source"),
        F.lit("semanticscholar.org").alias("etld1"),
        F.col("s.date").alias("publication_date"),
        empty.alias("citation_refs"),
    )
    return old.unionByName(new, allowMissingColumns=True)


def followable(links: DataFrame, seed_url: Column, pattern: str | None = None, stay: bool = True, score: float = 0.0) -> DataFrame:
    """Links that a site crawl may follow: absolute, of the seed's host, matching, scored enough."""
    out = links.where(F.col("href").startswith("http") & U.matches(F.col("href"), pattern))
    if stay:
        out = out.where(U.same_host(F.col("href"), seed_url))
    if score > 0:
        out = out.where(F.coalesce(F.col("intrinsic_score"), F.lit(0.0)) >= score)
    return out


def _popped(level: int, depth: int, limit: int) -> Column:
    """State of a seed after its queue of one level, taken first in, first out: what was visited,
    the results, and the next level's queue. Every array has at most a few times ``limit`` elements."""
    state = F.struct("visited", "results", F.expr("cast(array() as array<string>)").alias("queue"), F.size("entries").alias("left"))

    def step(s: Column, e: Column) -> Column:
        skip = (F.size(s["results"]) >= limit) | F.array_contains(s["visited"], e["url"])
        visited = F.when(skip, s["visited"]).otherwise(F.array_append(s["visited"], e["url"]))
        result = F.struct(e["url"].alias("url"), F.lit(level).alias("depth"), e["success"].alias("success"))
        results = F.when(skip | e["success"].isNull(), s["results"]).otherwise(F.array_append(s["results"], result))
        room = F.greatest(F.lit(limit) - F.size(results) - (s["left"] - 1) - F.size(s["queue"]), F.lit(0))
        unseen = F.filter(e["hrefs"], lambda h: ~F.array_contains(visited, h))
        grows = ~skip & F.coalesce(e["success"], F.lit(False)) & F.lit(level < depth)
        queue = F.when(grows, F.concat(s["queue"], F.slice(unseen, F.lit(1), room))).otherwise(s["queue"])
        return F.struct(visited.alias("visited"), results.alias("results"), queue.alias("queue"), (s["left"] - 1).alias("left"))

    return F.aggregate("entries", state, step)


def site_crawls(links: DataFrame, pages: DataFrame, seeds: DataFrame, depth: int = DEFAULT.crawl_depth, limit: int = DEFAULT.crawl_pages, pattern: str | None = None, stay: bool = True, score: float = 0.0, newest: str | None = None) -> DataFrame:
    """Breadth-first crawls over known pages from every row of ``seeds`` (seed, a URL): (seed, url, depth,
    ord, success), at most ``limit`` rows a seed.

    ``links``: page_url, pos, href, intrinsic_score; ``pages``: url, success; of rows that repeat a URL the
    one that is largest in ``newest`` counts, without it any that succeeded. A page that is absent
    fails without using up the cap (as an exception does); one with ``success`` false uses it
    but is not expanded. Links enter a seed's queue while results and queue are below the cap, so
    repeated links use up its budget, and later pages may be cut by them.

    A page's links are gathered once, not for each seed and level; a level is a join of all seeds' queues with the
    pages and a fold over each queue, whose length is at most ``limit``; no step passes through the driver."""
    known = pages.groupBy("url").agg((F.max_by("success", newest) if newest else F.max("success")).alias("success"))
    known = known.withColumn("success", F.coalesce("success", F.lit(False)))
    kinds = "visited array<string>, results array<struct<url:string,depth:int,success:boolean>>, queue array<string>"
    empty = [F.array().cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in ("visited array<string>", "results array<struct<url:string,depth:int,success:boolean>>")]
    state = seeds.select("seed").where("seed IS NOT NULL").distinct().select("seed", *empty, F.array("seed").alias("queue"))
    links = links.select(F.col("page_url").alias("url"), "pos", "href", "intrinsic_score")
    # enough links of a page for any queue: of each target as many as the cap, of all those that a
    # crawl may have visited, and the cap again; a crawl that stays is on the host of each of its pages
    out = followable(known.where("success").join(links, "url"), F.col("url"), pattern, stay, score)
    out = out.withColumn("same", F.row_number().over(Window.partitionBy("url", "href").orderBy("pos"))).where(F.col("same") <= limit)
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("pos", "href"))).where(F.col("n") <= limit * (limit * (depth + 1) + 1))
    out = out.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "href"))), lambda x: x["href"]).alias("hrefs"))
    known = kept(known.join(out, "url", "left").withColumn("hrefs", F.coalesce("hrefs", F.array().cast("array<string>"))))
    for level in range(depth + 1):
        state = kept(state)
        waiting = state.where(F.size("queue") > 0)
        if not waiting.limit(1).count():
            break
        rows = waiting.select("seed", F.posexplode("queue").alias("at", "url")).join(known, "url", "left")
        taken = rows.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("at", "url", "success", "hrefs"))).alias("entries"))
        now = state.join(taken, "seed", "left").withColumn("entries", F.coalesce("entries", F.expr("cast(array() as array<struct<at:int,url:string,success:boolean,hrefs:array<string>>>)")))
        state = now.withColumn("s", _popped(level, depth, limit)).select("seed", *[f"s.{c.split()[0]}" for c in kinds.split(", ")])
    found = state.select("seed", F.posexplode("results").alias("ord", "r"))
    return found.select("seed", "r.url", "r.depth", F.col("ord").cast("long").alias("ord"), "r.success")


def site_crawl(links: DataFrame, pages: DataFrame, seed: str, **options) -> DataFrame:
    """``site_crawls`` from one seed: (url, depth, ord, success)."""
    seeds = links.sparkSession.createDataFrame([(seed,)], "seed string")
    return site_crawls(links, pages, seeds, **options).drop("seed")


def crawl_stats(crawled: DataFrame) -> DataFrame:
    return crawled.agg(F.count("*").alias("total_pages"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest_depth"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): least number of edges (src, dst) from each seed, up to ``hops``."""
    found = kept(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hop")).distinct())
    frontier = found
    for hop in range(1, hops + 1):
        new = frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct().join(found, ["seed", "node"], "left_anti")
        frontier = kept(new.select("seed", "node", F.lit(hop).alias("hop")))
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier)
    return found


def adaptive_crawl(pages: DataFrame, query: str, confidence: float = DEFAULT.adaptive_confidence, limit: int = DEFAULT.adaptive_pages, text: str = "text", order: str = "ord") -> DataFrame:
    """Pages in order until the words seen cover enough of the query's, or ``limit`` pages: (order,
    gained, confidence). Confidence is the share of the query's words met so far, a definition of
    our own. Only pages up to the limit reach the window."""
    asked = sorted(set(query.lower().split()))
    bit = F.array_intersect(F.array_distinct(words(F.lower(F.col(text)))), F.array(*[F.lit(w) for w in asked]).cast("array<string>"))
    rows = pages.select(order, bit.alias("hit")).orderBy(order).limit(limit)
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.array_distinct(F.flatten(F.collect_list("hit").over(before)))
    rows = rows.withColumn("confidence", F.size(seen) / F.lit(float(max(1, len(asked)))))
    rows = rows.withColumn("prior", F.coalesce(F.lag("confidence").over(Window.orderBy(order)), F.lit(0.0)))
    return rows.where(F.col("prior") < confidence).select(order, (F.col("confidence") - F.col("prior")).alias("gained"), "confidence")


def aggregated_text(pages: DataFrame, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """One text of the pages of a crawl (or of each, told apart by the columns ``by``) with its
    words and first 500 characters. The pages of one crawl are few: their number is capped by it."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit("## Source: "), F.col("url"), F.lit("\n\n"), F.col("fit_markdown")).alias("t")))), lambda x: x["t"]), "\n\n---\n\n")
    out = pages.groupBy(*by).agg(joined.alias("text"))
    return out.select(*by, "text", F.size(words(F.col("text"))).alias("n_words"), F.substring("text", 1, 500).alias("preview"))
