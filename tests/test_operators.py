"""Operators on small hand-made tables, with the reference's own cases."""

import os
import random
from datetime import date, datetime
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon import lineage, schemas
from quillon.operators import chunk, discover, events, graph, ingest, metric, report, search, suffix, triage
from quillon.operators import claims as C
from quillon.plans import research
from quillon.sources import files, payloads


def rows(df):
    return [tuple(r) for r in df.collect()]


def hits(spark, *lists):
    data = [(src, i, j, url, "", "") for i, (src, urls) in enumerate(lists) for j, url in enumerate(urls)]
    return spark.createDataFrame(data, discover.HIT)


def test_discover_merges(spark):
    h = hits(spark, ("duckduckgo", ["https://example.com/a", "https://example.com/b/"]), ("arxiv", ["https://example.com/b", "https://arxiv.org/abs/1234"]))
    merged = discover.merge(h)
    found = {r["url"]: r for r in merged.collect()}
    assert set(found) == {"https://example.com/a", "https://example.com/b", "https://arxiv.org/abs/1234"}
    assert found["https://example.com/b"]["also_in"] == ["arxiv"]
    assert dict(rows(discover.by_source(merged))) == {"duckduckgo": 2, "arxiv": 1}


def test_failing_source(spark):
    good = spark.createDataFrame([(0, "https://ok.com/1", "ok", "")], "rank int, url string, title string, snippet string")
    out, errors = discover.union_sources(spark, {"duckduckgo": good, "arxiv": RuntimeError("boom")})
    assert [r["url"] for r in out.collect()] == ["https://ok.com/1"] and "boom" in errors["arxiv"]


def test_resolve_sources():
    assert discover.resolve_sources([" ArXiv", "bing", None, "arxiv", "serpapi"]) == ["arxiv", "serpapi"]
    assert discover.resolve_sources(None) == ["duckduckgo", "arxiv", "semantic_scholar"]


def test_triage_heads(spark):
    urls = spark.createDataFrame([("https://e.com/page1", 0), ("https://e.com/x", 1), ("https://e.com/page1", 2)], "url string, ord int")
    heads = spark.createDataFrame([("https://e.com/page1", "valid", "Page 1", "d" * 500, 0.35, None), ("https://e.com/x", "failed", None, None, None, "e" * 300)], "url string, status string, title string, description string, relevance_score double, error string")
    out = triage.triage(triage.scored(urls, heads, "test research"))
    got = {r["url"]: r for r in out.collect()}
    assert got["https://e.com/page1"]["qualified"] and len(got["https://e.com/page1"]["description"]) == 200
    assert not got["https://e.com/x"]["qualified"] and len(got["https://e.com/x"]["error"]) == 120 and got["https://e.com/x"]["title"] is None
    assert rows(triage.stats(urls, out)) == [(3, 1, 1)]


def test_payload_readers(spark):
    one = lambda t: spark.createDataFrame([(t,)], "payload string")
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id> http://arxiv.org/abs/1 </id><title> T </title><summary>S</summary></entry><entry><id></id><title>none</title></entry></feed>"
    assert [(r["url"], r["title"], r["snippet"]) for r in payloads.arxiv(one(atom)).collect()] == [("http://arxiv.org/abs/1", "T", "S")]
    s2 = '{"data":[{"title":"a","url":"u1","abstract":null,"openAccessPdf":{"url":"pdf"}},{"title":"b","url":"u2","openAccessPdf":null},{"title":"c"}]}'
    assert [(r["url"], r["snippet"]) for r in payloads.scholar(one(s2)).collect()] == [("pdf", ""), ("u2", "")]
    serp = '{"organic_results":[{"link":"l","title":"t","snippet":"s"},{"title":"x"}]}'
    assert payloads.serp(one(serp)).count() == 1 and payloads.serp(one(serp), configured=False).count() == 0
    nested = '{"organic": "[{\\"link\\":\\"l1\\"},{\\"link\\":\\"l2\\"}]"}'
    assert [r["url"] for r in payloads.google(one(nested), n=1).collect()] == ["l1"]
    assert payloads.google(one('{"organic_schema":[{"link":"z"}]}')).first()["url"] == "z"
    with pytest.raises(Exception, match="quota"):
        payloads.google(one('{"error":"quota"}')).collect()
    assert payloads.web(one('[{"href":"h","body":"b"},{"url":"u"},{}]')).count() == 2


def chunks_of(spark, text, strategy="sliding_window"):
    return spark.range(1).select(F.explode(chunk.chunks(F.lit(text), strategy)).alias("c")).select("c.*").collect()


@pytest.mark.parametrize("n", [1, 199, 200, 201, 360, 361, 1000])
def test_sliding_covers_all_words(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = chunks_of(spark, " ".join(words))
    seen = [w for c in got for w in c["text"].split()]
    assert set(seen) == set(words) and all(c["token_count"] <= 200 for c in got) and got[-1]["text"].endswith(words[-1])
    for c in got:
        assert " ".join(words)[c["char_start"] : c["char_end"]] == c["text"]


def sought(text, pieces):
    """Places of pieces, each sought in the whole text from behind the start of the one before."""
    at, out = 0, []
    for p in pieces:
        found = text.find(p, at)
        out.append(found if found >= 0 else at)
        at = max(at, out[-1] + 1)
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 8192])
def test_places_of_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(chunk, "BLOCK", block)
    rng = random.Random(block)
    texts = ["".join(rng.choice(["a", "b", "ab", "é"]) + rng.choice([" "] * rng.choice([1, 40]) + ["  ", "\n", "\n\n", "\t"]) for _ in range(rng.choice([1, 5, 60, 400]))) for _ in range(60)]
    texts += ["a b " * 300, "a b " * 150 + "\n" + "b a " * 150, "\n\n x\n\n  y \n\n", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    for pieces in (chunk.sliding(F.col("text"), 5, 4), chunk.overlapping(F.col("text"), 6, 2), chunk.by_pattern(F.col("text"))):
        for r in df.select("text", pieces.alias("p"), chunk.located(F.col("text"), pieces).alias("c")).collect():
            full = [p for p in r["p"] if p.strip()]
            assert [c["text"] for c in r["c"]] == full
            assert [c["char_start"] for c in r["c"]] == sought(r["text"], full)


def test_places_in_a_long_text(spark):
    words = [f"w{i % 7919}" for i in range(400_000)]
    text = " ".join(words)
    got = spark.createDataFrame([(text,), ("\n".join(words),)], "text string").select(F.explode(chunk.chunks(F.col("text"))).alias("c")).select("c.char_start", "c.char_end", F.length("c.text").alias("n")).collect()
    assert len(got) == 2 * (len(range(0, 400_000 - 200, 160)) + 1) and all(c["char_end"] - c["char_start"] == c["n"] for c in got)


def test_chunks_of_blanks(spark):
    for s in ("sliding_window", "overlapping", "regex"):
        assert chunks_of(spark, " \n ", s) == [] and chunks_of(spark, "", s) == []
    assert [c["chunk_index"] for c in chunks_of(spark, "a\n\n \n\nb", "regex")] == [0, 2]


def test_legacy_chunker(spark):
    text = " ".join(f"w{i}" for i in range(200))
    got = spark.range(1).select(chunk.legacy(F.lit(text), 50, 5).alias("c")).first()["c"]
    assert [c["token_count"] for c in got] == [50, 50, 50, 50, 20] and got[1]["text"].split()[0] == "w45"
    assert spark.range(1).select(chunk.legacy(F.lit(" "), 50, 5).alias("c")).first()["c"] == []


def test_store_writes(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 5)], "id string, v int")
    assert sorted(rows(ingest.upsert(old, new.where("v < 5")))) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(r[0] for r in rows(ingest.insert_ignore(old, new))) == ["a", "b", "c"]
    twice = ingest.upsert(ingest.upsert(old, new.where("v < 5")), new.where("v < 5"))
    assert sorted(rows(twice)) == [("a", 1), ("b", 3), ("c", 4)]


def test_near_duplicate_pages(spark):
    pages = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.999, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None)], "ord long, vector array<double>")
    got = {r["page"]: r["leader"] for r in search.collapse(pages).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert rows(search.collapse_stats(search.collapse(pages))) == [(4, 1, 1)]


def test_leaders_are_not_components(spark):
    # 1~2, 2~3, 3~4: 2 joins 1, so 3 leads and takes 4
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.95), (3, 4, 0.95)], "a long, b long, similarity double")
    got = {r["page"]: r["leader"] for r in search.leaders(pairs, spark.createDataFrame([(i,) for i in range(1, 5)], "ord long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}


def test_leaders_against_loop(spark):
    rng = np.random.default_rng(3)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (90, 2)) if a != b})
    want, taken = {}, set()
    for p in range(40):
        if p in taken:
            continue
        want[p] = p
        for q in range(40):
            if q != p and q not in taken and q not in want and (min(p, q), max(p, q)) in pairs:
                want[q] = p
                taken.add(q)
    df = spark.createDataFrame([(a, b, 0.95) for a, b in pairs], "a long, b long, similarity double")
    got = {r["page"]: r["leader"] for r in search.leaders(df, spark.createDataFrame([(i,) for i in range(40)], "ord long")).collect()}
    assert got == want


def clustered(n, clusters=40, width=16, seed=5):
    """Vectors about a few directions, among them mirrors and copies."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, width))
    v = centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, width)) * 0.25
    v[n // 2 :: 3] = v[: len(v[n // 2 :: 3])] + rng.normal(size=(len(v[n // 2 :: 3]), width)) * 0.02
    v[n // 2 + 1 :: 7] = v[: len(v[n // 2 + 1 :: 7])]
    return v


@pytest.mark.parametrize("block_rows", [None, 60])
def test_metric_join_equals_product(spark, block_rows):
    v = clustered(900)
    pages = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [0.0] * 16), (5004, [1.0, 0.0]), (5005, [0.9, 0.1]), (5006, [None, 1.0])], "ord long, vector array<double>")
    reps, copies = metric.classes(pages)
    got = metric.mirror_pairs(reps, 0.92, block_rows).toPandas()
    first = {tuple(x): i for i, x in reversed(list(enumerate(v.tolist())))}
    rows = sorted(first.values())
    unit = v[rows] / np.linalg.norm(v[rows], axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T, 1) >= 0.92)
    want = {(rows[a], rows[b]) for a, b in zip(i, j, strict=True)} | {(5004, 5005)}
    assert not got.duplicated(["a", "b"]).any() and set(zip(got["a"], got["b"], strict=True)) == want and len(want) > 200
    assert {(r["first"], r["page"]) for r in copies.collect()} == {(first[tuple(x)], i) for i, x in enumerate(v.tolist()) if first[tuple(x)] != i}
    with pytest.raises(ValueError):
        metric.mirror_pairs(reps, 0.0)


def test_metric_join_compares_neighbours_only(spark):
    """With clusters as many as their data need, comparisons grow far slower than the square."""
    compared = []
    for n in (4_000, 16_000):
        rng = np.random.default_rng(1)
        centre = rng.normal(size=(n // 100, 24))
        v = centre[rng.integers(0, len(centre), n)] + rng.normal(size=(n, 24)) * 0.03
        reps, _ = metric.classes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vector array<double>"))
        _, cells = metric.dealt(reps, 100)
        compared.append(cells.compared(float(np.arccos(0.92))))
    assert np.log(compared[1] / compared[0]) / np.log(4) < 1.4, compared
    assert compared[1] < 0.1 * 16_000**2 / 2


def test_copies_are_linear(spark):
    pages = spark.range(400).select(F.col("id").alias("ord"), F.array(F.lit(1.0), F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.2)).alias("vector"))
    assert metric.mirror_links(pages, 0.92).count() == 1 + 398
    assert {r["leader"] for r in search.collapse(pages).collect()} == {0}
    docs = pages.select(F.col("ord").alias("doc_id"), F.lit("equal words of equal texts").alias("text"))
    assert search.sparse_pairs(docs).count() == 399


def test_leaders_of_a_long_chain(spark):
    """Each page is near the one before it: every other page leads; one turn for each block of pairs."""
    n = 10_000
    pairs = spark.range(1, n).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.lit(0.95).alias("similarity"))
    for each in (1 << 20, 3_000):
        got = search.leaders(pairs, spark.range(n).select(F.col("id").alias("ord")), each).toPandas()
        assert len(got) == n and (got["leader"] == got["page"] - got["page"] % 2).all()


def test_similar_pairs_of_many_pages(spark):
    """All pairs over a low threshold, in a table of more than 5,000 vectors, against one product."""
    v = np.random.default_rng(3).normal(size=(5200, 48))
    pages = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vector array<double>")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosines = np.triu(unit @ unit.T, 1)
    got = search.similar_pairs(pages, 0.35).toPandas()
    assert not got.duplicated(["a", "b"]).any() and (got["a"] < got["b"]).all()
    assert len(got) == (cosines >= 0.35).sum() > 10_000
    assert np.allclose(got["similarity"], cosines[got["a"], got["b"]], rtol=0, atol=1e-12) and got["similarity"].min() >= 0.35


def test_similar_pairs_awkward(spark):
    """Pairs without a cosine count as 0; ids of any type; empty tables."""
    data = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", [-1.0, 0.0]), ("f", None), ("g", []), ("h", [None, 1.0])]
    pages = spark.createDataFrame(data, "ord string, vector array<double>")
    assert rows(search.similar_pairs(pages, 0.5)) == [("a", "b", 1.0)]
    got = {(r["a"], r["b"]): r["similarity"] for r in search.similar_pairs(pages, 0.0).collect()}
    want = {(a, b): 0.0 for a in "abcdeh" for b in "abcdeh" if a < b} | {("a", "b"): 1.0}
    assert got == {k: s for k, s in want.items() if k not in (("a", "e"), ("b", "e"))}
    assert search.similar_pairs(pages.limit(0), 0.5).count() == 0


def test_search_cuts_text(spark):
    data = [("a", "x" * 5000, [1.0, 0.0], {"session_id": "s"}), ("b", "y" * 1000, [0.0, 1.0], {"session_id": "t"})]
    table = spark.createDataFrame(data, "id string, chunk_text string, embedding array<double>, metadata map<string,string>")
    assert [(r["id"], len(r["text"]), r["score"]) for r in search.search(table, [1.0, 0.0]).collect()] == [("a", 600, 1.0), ("b", 600, 0.0)]
    assert [(r["id"], len(r["text"])) for r in search.search(table, [1.0, 0.0], session="t", chars=50).collect()] == [("b", 50)]


PAPERS = "paper_id string, s2_paper_id string, title string, publication_date date, references array<string>, citations array<string>"


def papers(spark):
    return spark.createDataFrame(
        [("arXiv:2301.00001", "A", "Paper A", date(2023, 1, 1), ["B", "C"], []), ("B", "B", "Paper B", date(2022, 6, 1), ["D"], []), ("C", "C", "Paper C", date(2020, 1, 1), ["missing", "arXiv:2301.00001"], []), ("D", None, "Paper D", date(2019, 3, 3), [], [])],
        PAPERS,
    )


def test_citation_walks(spark):
    p, seed = papers(spark), spark.createDataFrame([("arXiv:2301.00001",)], "paper_id string")
    found = lambda **o: {r["paper_id"] for r in graph.citation_bfs(p, seed, **o).collect()}
    assert found() == {"arXiv:2301.00001", "B", "C", "D"}
    assert found(hops=1) == {"arXiv:2301.00001", "B", "C"}
    assert found(scorer=F.when(F.col("title") == "Paper B", 1.0).otherwise(0.0)) == {"arXiv:2301.00001", "B"}
    assert graph.citation_bfs(p, spark.createDataFrame([("nobody",)], "paper_id string")).count() == 0
    with pytest.raises(ValueError, match="direction"):
        graph.citation_bfs(p, seed, direction="sideways")


def test_citation_enrichment(spark):
    urls = spark.createDataFrame(
        [("https://arxiv.org/abs/2301.00001", 0, "q", 0.8, "crawl_url", "arxiv", "arxiv.org", None), ("https://www.semanticscholar.org/paper/B", 1, "q", 0.5, "crawl_url", "web", "semanticscholar.org", None), ("https://example.com/blog", 2, "q", 0.4, "crawl_url", "web", "example.com", None)],
        "url string, ord long, query string, score double, strategy string, source string, etld1 string, publication_date date",
    )
    out = {r["url"]: r for r in graph.enrich(urls, papers(spark)).collect()}
    assert len(out) == 5 and out["https://arxiv.org/abs/2301.00001"]["citation_refs"] == ["B", "C", "D"]
    assert out["https://arxiv.org/abs/2301.00001"]["publication_date"] == date(2023, 1, 1)
    new = out["https://www.semanticscholar.org/paper/D"]
    assert (new["score"], new["source"], new["strategy"], new["publication_date"]) == (0.8, "citation_bfs", "crawl_url", date(2019, 3, 3))
    assert out["https://example.com/blog"]["citation_refs"] == []


def crawl(spark, links, pages, seed, **o):
    lk = spark.createDataFrame([(p, i, h, s) for p, hs in links.items() for i, (h, s) in enumerate(hs)], "page_url string, pos int, href string, intrinsic_score double")
    pg = spark.createDataFrame(list(pages.items()), "url string, success boolean")
    return [(r["url"], r["depth"], r["success"]) for r in graph.site_crawl(lk, pg, seed, **o).orderBy("ord").collect()]


def test_site_crawl(spark):
    s = "https://h.org/"
    subs = [f"https://h.org/p{i}" for i in range(10)]
    links = {s: [(u, 0.5) for u in subs] + [("https://other.org/x", 0.9), ("/rel", 0.9)]}
    pages = {s: True, **dict.fromkeys(subs, True), "https://other.org/x": True}
    assert [u for u, _, _ in crawl(spark, links, pages, s, limit=3)] == [s, *subs[:2]]
    assert len(crawl(spark, links, pages, s, limit=50)) == 11
    assert len(crawl(spark, links, pages, s, limit=50, stay=False)) == 12
    assert [u for u, _, _ in crawl(spark, links, pages, s, pattern="p[37]$")] == [s, subs[3], subs[7]]
    assert len(crawl(spark, links, pages, s, score=0.6)) == 1
    # a failed page uses the cap and is not expanded, an absent one does neither
    chain = {s: [(subs[0], 0.0), (subs[1], 0.0)], subs[0]: [(subs[2], 0.0)]}
    assert crawl(spark, chain, {s: True, subs[0]: False, subs[1]: True}, s) == [(s, 0, True), (subs[0], 1, False), (subs[1], 1, True)]
    assert crawl(spark, chain, {s: True, subs[1]: True}, s, limit=2) == [(s, 0, True)]


def queue_crawl(links, pages, seed, depth, limit):
    """The same with a queue, page by page."""
    queue, visited, results = [(seed, 0)], set(), []
    while queue and len(results) < limit:
        u, d = queue.pop(0)
        if u in visited:
            continue
        visited.add(u)
        if u not in pages:
            continue
        results.append((seed, u, d, len(results), pages[u]))
        if pages[u] and d < depth:
            for h in links.get(u, []):
                if h.startswith("https://h.org/") and h not in visited and len(results) + len(queue) < limit:
                    queue.append((h, d + 1))
    return results


@pytest.mark.parametrize("limit, depth", [(5, 2), (20, 3), (1, 1), (7, 0)])
def test_crawls_of_many_seeds_equal_queues(spark, limit, depth):
    """Every page a seed; pages repeat, of which the newest counts; links repeat, lead away, and to absent pages."""
    rng = random.Random(limit)
    urls = [f"https://h.org/{i}" for i in range(40)]
    links = {u: [rng.choice([*urls, "https://else.org/1", "/rel", u]) for _ in range(rng.randrange(12))] for u in urls}
    links[urls[3]] = [urls[4]] * 60 + [urls[5]]
    pages = {u: rng.random() < 0.8 for u in urls if rng.random() < 0.85}
    crawls = [(u, n, ok if n == 3 else not ok) for u, ok in pages.items() for n in (1, 3, 2)]
    lk = spark.createDataFrame([(p, i, h, 0.5) for p, hs in links.items() for i, h in enumerate(hs)], "page_url string, pos int, href string, intrinsic_score double")
    got = graph.site_crawls(lk, spark.createDataFrame(crawls, "url string, crawl int, success boolean"), spark.createDataFrame([(u,) for u in [*urls, urls[0], "https://h.org/none", None]], "seed string"), depth, limit, newest="crawl")
    want = [r for u in urls for r in queue_crawl(links, pages, u, depth, limit)]
    assert sorted(map(tuple, got.select("seed", "url", "depth", "ord", "success").collect())) == sorted(want)


def test_crawls_read_links_once(spark):
    """Not once a level, nor once for each seed that meets a page; a page with many copies of a link to a visited page still gives others."""
    read = spark.sparkContext.accumulator(0)

    def counted(pos):
        read.add(1)
        return pos

    urls = [f"https://h.org/{i}" for i in range(30)]
    links = {u: [urls[i - 1]] * 40 + [urls[(i + k) % 30] for k in (1, 2, 3)] for i, u in enumerate(urls)}
    rows = [(p, i, h, 0.5) for p, hs in links.items() for i, h in enumerate(hs)]
    lk = spark.createDataFrame(rows, "page_url string, pos int, href string, intrinsic_score double").withColumn("pos", F.udf(counted, "int").asNondeterministic()("pos"))
    got = graph.site_crawls(lk, spark.createDataFrame([(u, True) for u in urls], "url string, success boolean"), spark.createDataFrame([(u,) for u in urls], "seed string"), 3, 6)
    want = [r for u in urls for r in queue_crawl(links, dict.fromkeys(urls, True), u, 3, 6)]
    assert sorted(map(tuple, got.select("seed", "url", "depth", "ord", "success").collect())) == sorted(want)
    assert read.value == len(rows)


def test_crawl_of_repeated_pages_keeps_urls(spark):
    s = "https://h.org/"
    subs = [f"https://h.org/p{i}" for i in range(6)]
    lk = spark.createDataFrame([(s, i, u, 0.5) for i, u in enumerate(subs)], "page_url string, pos int, href string, intrinsic_score double")
    for times in (1, 3):
        pages = spark.createDataFrame([(u, True) for u in [s, *subs] * times], "url string, success boolean")
        assert [r["url"] for r in graph.site_crawl(lk, pages, s, limit=5).orderBy("ord").collect()] == [s, *subs[:4]]


EV = "url string, etld1 string, quote string, publication_date date"


def claim(spark, sources, contradictions):
    st = lambda xs: [(f"https://{e}/{i}", e, "", d) for i, (e, d) in enumerate(xs)]
    struct = f"struct<{EV.replace(' ', ':').replace(',:', ',')}>"
    return spark.createDataFrame([("c", "s", 0, "t", st(sources), st(contradictions))], f"id string, subtopic_id string, ord int, text string, sources array<{struct}>, contradictions array<{struct}>")


@pytest.mark.parametrize(
    "sources, contradictions, want",
    [(["a", "b"], [], "kept"), (["a"], [], "uncorroborated"), (["a", "a"], [], "uncorroborated"), (["a", "b"], ["z"], "flagged"), (["a"], ["a"], "uncorroborated"), ([], ["z"], "uncorroborated"), (["", ""], [], "kept"), (["a"], [""], "flagged")],
)
def test_claim_status(spark, sources, contradictions, want):
    got = C.enrich(claim(spark, [(x, None) for x in sources], [(x, None) for x in contradictions])).first()
    assert got["status"] == want


def test_mirrors_are_one_source(spark):
    df = claim(spark, [("a", None), ("a", None), ("b", None), ("c", None)], [])
    from quillon.functions import policy as P

    near = lambda x, y: F.when(F.array_sort(F.array(x["etld1"], y["etld1"])) == F.array(F.lit("a"), F.lit("b")), 0.93).otherwise(0.0)
    got = df.select(P.independent_count(F.col("sources")).alias("n"), P.independent_count(F.col("sources"), near).alias("m")).first()
    assert tuple(got) == (3, 2)


def test_enrich_tags_drift(spark):
    got = C.enrich(claim(spark, [("a", date(2022, 6, 1))], [("b", date(2020, 1, 1)), ("c", None)])).first()
    assert got["status"] == "flagged" and got["temporal_status"] == "current"
    assert [c["conflict_type"] for c in got["contradictions"]] == ["temporal_drift", "factual"]
    assert C.enrich(claim(spark, [("a", date(2022, 6, 1))], [("c", None)])).first()["temporal_status"] == "uncertain"


def model_count(sources):
    taken = []
    for s in sources:
        if all(not (s and t and s == t) for t in taken):
            taken.append(s)
    return len(taken)


def test_policy_against_model(spark):
    rng = np.random.default_rng(11)
    pick = lambda: [["", "a", "b", "c"][i] for i in rng.integers(0, 4, rng.integers(0, 5))]
    for _ in range(15):
        s, c = pick(), pick()
        flagged = any(not (x and y and x == y) for x in c for y in s)
        want = "flagged" if flagged else "kept" if model_count(s) >= 2 else "uncorroborated"
        assert C.enrich(claim(spark, [(x, None) for x in s], [(x, None) for x in c])).first()["status"] == want


def test_merge_is_stable(spark):
    base = spark.createDataFrame([("a", "base", 0), ("b", "base", 1)], "id string, origin string, ord int")
    new = spark.createDataFrame([("b", "new", 0), ("c", "new", 1), ("c", "later", 2)], "id string, origin string, ord int")
    once = C.merge(base, new)
    assert sorted(r[:2] for r in rows(once)) == [("a", "base"), ("b", "base"), ("c", "new")]
    assert sorted(rows(C.merge(once, new))) == sorted(rows(once))


def test_merge_holds_a_bounded_number_of_claims_a_task(spark, monkeypatch):
    monkeypatch.setattr(C, "dealt", partial(lineage.dealt, each=100))
    new = spark.range(2000).select("id", F.lit("new").alias("origin"), F.col("id").alias("ord"))
    base = new.where("id % 3 = 0").withColumn("origin", F.lit("base"))
    got = C.merge(base, new.unionByName(new), rows=2000)
    sizes = [r["count"] for r in got.where("origin = 'new'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1333 and max(sizes) < 200, sizes
    assert sorted(r[0] for r in got.collect()) == list(range(2000))


def test_parts_of_many_rows_are_bounded_and_written_without_a_sort(spark):
    each = lineage.TASK_ROWS
    for rows in (10**6, 36 * 10**6, 216 * 10**6, 10**9, 10**11):
        n = lineage.parts(spark, rows)
        assert n * each * lineage.MOST >= rows and (n <= 200 or (n - 1) * each * lineage.MOST < rows), (rows, n)
    assert lineage.parts(spark, 36 * 10**6) == 144 and lineage.parts(spark, 216 * 10**6) == 200


@pytest.mark.parametrize(
    "reply, want, more",
    [
        ("", ["a", "b"], False),
        ("+ https://n.org", ["a", "b", "https://n.org"], True),
        ("- 0", ["b"], False),
        ("- 0\n- 0", [], False),
        ("- 7\n- x\n+\nhello", ["a", "b"], False),
        ("R c\ndone\n- 0", ["a", "b", "c"], True),
        ("  d", ["a", "b"], False),
    ],
)
def test_edit_commands(spark, reply, want, more):
    u = F.from_json(F.lit('[{"url":"a","score":0.5},{"url":"b","score":0.4}]'), "array<struct<url:string,score:double,strategy:string,source:string>>")
    got = spark.range(1).select(C.apply_verbs(u, F.lit(reply)).alias("v")).first()["v"]
    assert [x["url"] for x in got["urls"]] == want and got["needs_supplemental"] is more
    assert all(x["score"] == 1.0 and x["source"] == "user" for x in got["urls"] if x["url"] not in "ab")


def test_report(spark, tmp_path):
    subs = spark.createDataFrame([("s1", "first?", 1, 0), ("s2", "second?", 1, 1)], "id string, question string, target_evidence int, ord int")
    src = "array<struct<url:string,etld1:string,quote:string,publication_date:date>>"
    con = "array<struct<url:string,etld1:string,quote:string,publication_date:date,confidence_score:double,conflict_type:string>>"
    data = [
        ("c1", "s1", 0, "One.", "kept", [("https://a.com", "a.com", "", None)], [("https://x.com", "x.com", " q ", date(2023, 6, 1), 0.2, "factual"), ("https://y.com", "y.com", "", None, 0.9, "factual")]),
        ("c2", "s1", 1, "Two.", "flagged", [("https://b.com", "b.com", "", None), ("https://a.com", "a.com", "", None)], [("https://z.com", "z.com", "", date(2021, 1, 1), 0.5, "temporal_drift"), ("https://m.com", "m.com", "", None, 0.95, "methodological")]),
    ]
    claims = spark.createDataFrame(data, f"id string, subtopic_id string, ord int, text string, status string, sources {src}, contradictions {con}")
    text = report.render(subs, claims, body="Prose.")
    assert text.startswith("# Research Report\n\n## Coverage\n\n- `s1` (first?): covered — 2 claim(s), 1 kept\n- `s2` (second?): MISSING — coverage gap — 0 claim(s), 0 kept\n")
    assert "> Coverage gap: no claims gathered for subtopic(s): `s2`" in text
    lines = [x for x in text.split("\n") if x.startswith("- Claim")]
    assert [x.split("source: ")[1].split(";")[0] for x in lines] == ["https://y.com", "https://x.com", "https://m.com", "https://z.com"]
    assert '(contradicting source: https://x.com; dated 2023-06-01; confidence 0.20; "q")' in lines[1]
    assert text.endswith("## Sources\n\n- https://a.com\n- https://b.com\n")
    path = str(tmp_path / "report")
    report.write_report(report.document(subs, claims, body="Prose."), path)
    assert "\n".join(r.value for r in spark.read.text(path).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()).rstrip() + "\n" == text
    empty = report.render(subs, claims.limit(0))
    assert report.NO_GENUINE in empty and report.NO_DRIFT in empty and report.NO_SOURCES in empty
    graded = spark.createDataFrame([(text,), (empty,)], "d string").select(F.size(report.missing_sections(F.col("d"))), report.drift_section_filled(F.col("d"))).collect()
    assert [tuple(r) for r in graded] == [(0, True), (0, False)]


def test_retry_and_rate(spark):
    a = spark.createDataFrame([("x", 0, 429, False), ("x", 1, 429, False), ("x", 2, 200, True), ("x", 3, 500, False), ("y", 0, 429, False), ("y", 1, 429, False), ("y", 2, 429, False), ("z", 0, 404, False)], "k string, attempt int, status_code int, success boolean")
    got = {r["k"]: r for r in events.retry_outcome(a, "k", retries=2, base=1.0).collect()}
    assert (got["x"]["status_code"], got["x"]["waited"]) == (200, 3.0)
    assert (got["y"]["status_code"], got["y"]["attempts_before"]) == (429, 2) and got["z"]["waited"] == 0.0
    r = spark.createDataFrame([(0, "https://example.com/a", 0.0), (1, "https://www.example.com/b", 0.25), (2, "https://b.com/", 0.25), (3, "https://example.com/c", 9.0)], "request_id int, url string, ts double")
    assert {x["request_id"]: x["wait"] for x in events.rate_schedule(r).collect()} == {0: 0.0, 1: 0.75, 2: 0.0, 3: 0.0}


def test_schedule_and_peak_of_a_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", None]), float(rng.randrange(200)), float(rng.randrange(1000))) for i in range(500)]
    df = spark.createDataFrame(rows, "request_id int, probe string, ts double, value double").repartition(7)
    got = {r["request_id"]: r["allowed"] for r in events.rate_schedule(df, domain="probe", gap=2.0).collect()}
    after, want = {}, {}
    for i, key, t, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = after[key] = max(t, after.get(key, t - 2.0) + 2.0)
    assert got == want
    top, peaks = {}, {}
    for i, key, _, v in rows:
        peaks[i] = top[key] = max(v, top.get(key, v))
    assert {r["request_id"]: r["peak"] for r in events.peak(df, "value", "request_id").collect()} == peaks
    assert events.rate_schedule(df.limit(0), domain="probe").count() == 0 and events.peak(df.limit(0), "value", "request_id").count() == 0


def test_prune(spark):
    s = spark.createDataFrame([("stale", datetime(2024, 1, 1)), ("edge", datetime(2024, 3, 2)), ("new", datetime(2024, 3, 20))], "id string, last_update timestamp")
    kept, stale = events.prune(s, "2024-04-01 00:00:00", 30)
    assert {r["id"] for r in kept.collect()} == {"edge", "new"} and [r["id"] for r in stale.collect()] == ["stale"]
    assert events.prune(s, "2024-04-01 00:00:00", 0)[1].count() == 0


def test_seed_files(spark, tmp_path):
    seeds = tmp_path / "seeds"
    seeds.mkdir()
    (seeds / "note.md").write_text("seed words " * 30)
    (tmp_path / "secret").write_text("x")
    out, counts = files.ingest_seeds(spark, str(seeds), ["note.md", "../secret", "../../etc/passwd", "absent"])
    assert {r["seed"]: r["error"] is None for r in out.collect()} == {"note.md": True, "../secret": False, "../../etc/passwd": False, "absent": False}
    assert counts.first()["succeeded"] == 1 and counts.first()["requested"] == 4
    page = files.seed_pages(files.seed_files(spark, str(seeds), ["note.md"])).first()
    assert page["strategy"] == "seed_file" and page["title"] == "note.md" and page["word_count"] == 60


def test_artifacts(spark, tmp_path):
    assert files.read_artifact(spark, str(tmp_path), "plan") is None
    assert files.read_artifact(spark, str(tmp_path), "ledger").count() == 0
    files.write_artifact('{"subtopics":[{"id":"s","question":"q","target_evidence":1}],"depth":"deep"}', str(tmp_path), "plan.json")
    assert files.read_artifact(spark, str(tmp_path), "plan").first()["depth"] == "deep"
    state = files.create_session(spark, "What is Spark?", "2024-01-02 03:04:05")
    moved = files.set_stage(state, "research", "2024-01-02 03:05:00", iteration=2).first()
    assert moved["session_id"] == "20240102-030405_what-is-spark" and moved["stage"] == "research" and moved["iteration"] == 2


def test_migration(spark):
    old = spark.createDataFrame([("c1", "p1", 0, "t", 1, None)], "id string, page_id string, chunk_index int, chunk_text string, token_count int, chroma_doc_id string")
    got = schemas.migrated(old, schemas.CHUNKS, {"etld1": ""}).first()
    assert got["etld1"] == "" and got["created_at"] is None


def test_research_loop(spark):
    src = "array<struct<url:string,etld1:string,quote:string,publication_date:date>>"
    schema = f"id string, subtopic_id string, ord int, text string, sources {src}, contradictions {src}"
    two = [("u1", "a", "", None), ("u2", "b", "", None)]
    calls = []

    def stage(subtopic, n):
        calls.append((subtopic, n))
        ids = {"many": [f"m{i}" for i in range(3)], "same": ["s0"], "slow": [f"w{n}-{i}" for i in range(2)]}[subtopic]
        return spark.createDataFrame([(i, subtopic, k, "t", two if subtopic == "many" else two[:1], []) for k, i in enumerate(ids)], schema)

    start = C.enrich(spark.createDataFrame([], schema))
    seen = []
    ledger, passes = research.research(start, ["many", "same", "slow"], stage, milestone=lambda s, _: seen.append(s))
    assert passes == {"many": 1, "same": 1, "slow": 4} and seen == ["many", "same", "slow"]
    assert ledger.count() == 3 + 1 + 8
    assert research.phases("deep") == ["acquire", "mid_acquire", "extract", "verify"]
    assert research.called(lambda: {"a": 1}).data == {"a": 1} and not research.called(lambda: 1 / 0).ok


def test_a_session_goes_on_where_it_failed(spark, tmp_path):
    src = "array<struct<url:string,etld1:string,quote:string,publication_date:date>>"
    schema = f"id string, subtopic_id string, ord int, text string, sources {src}, contradictions {src}"
    two = [("u1", "a", "", None), ("u2", "b", "", None)]
    calls, seen, failing = [], [], {("slow", 1, "verify")}

    def phase(name):
        def run(subtopic, n, before):
            calls.append((subtopic, n, name))
            if (subtopic, n, name) in failing:
                raise RuntimeError("a model is away")
            if name == "acquire":
                ids = {"many": [f"m{i}" for i in range(3)], "slow": [f"w{n}-{i}" for i in range(2)]}[subtopic]
                return spark.createDataFrame([(i, subtopic, k, "t", two if subtopic == "many" else two[:1], []) for k, i in enumerate(ids)], schema)
            return before.withColumn("text", F.concat("text", F.lit(f" {name}")))

        return run

    stages = {name: phase(name) for name in research.phases("normal")}
    start = C.enrich(spark.createDataFrame([], schema))
    once = lambda: research.run_session(f"file://{tmp_path}/s", start, ["many", "slow"], stages, milestone=lambda s, _: seen.append(s))
    with pytest.raises(RuntimeError):
        once()
    assert calls[-1] == ("slow", 1, "verify") and seen == ["many"]
    done = list(calls[:-1])
    failing.clear()
    ledger, passes = once()
    # what failed is called again, what was done is not
    assert calls[len(done) + 1] == ("slow", 1, "verify") and len(set(calls)) == len(calls) - 1
    assert passes == {"many": 1, "slow": 4} and seen == ["many", "slow"]
    assert ledger.count() == 3 + 8 and ledger.select("text").distinct().count() == 1
    plain, same = research.research(start, ["many", "slow"], lambda s, n: phase("acquire")(s, n, None))
    assert same == passes and {r["id"] for r in plain.collect()} == {r["id"] for r in ledger.collect()}
    calls.clear()
    again, _ = once()
    assert not calls and seen == ["many", "slow"] and again.count() == 11


def test_aggregated_text(spark):
    p = spark.createDataFrame([(1, "u1", "b"), (0, "u0", "a")], "ord int, url string, fit_markdown string")
    assert graph.aggregated_text(p).first()["text"] == "## Source: u0\n\na\n\n---\n\n## Source: u1\n\nb"


def test_paths_are_checked(tmp_path):
    assert files.resolve_seed(str(tmp_path), str(tmp_path)) is None
    os.symlink("/etc/hostname", tmp_path / "link")
    assert files.resolve_seed(str(tmp_path), "link") is None


def test_verify_degrades(spark):
    ledger = '{"claims":[{"id":"c1","subtopic_id":"s1","text":"X","status":"kept","sources":[{"url":"u","etld1":"a.com"},{"url":"v","etld1":"b.com"}]}]}'
    data = [("good", ledger, None), ("second", "timed out", f"```json\n{ledger}\n```"), ("none", "prose", "prose again")]
    got = C.verify(spark.createDataFrame(data, "run string, first string, second string")).collect()
    assert sorted((r["run"], r["id"], r["status"]) for r in got) == [("good", "c1", "kept"), ("second", "c1", "kept")]


def test_summaries(spark):
    from quillon.functions import records as R
    from quillon.functions import text as T

    plan = spark.createDataFrame([('{"subtopics":[{"id":"s1","question":"q?","target_evidence":2}],"depth":"deep","seed_urls":["u"]}',)], "t string").select(R.plan(F.col("t")).alias("p")).select("p.*")
    assert report.plan_summary(plan).first()["summary"] == "=== Checkpoint 1: Research Plan ===\ndepth=deep  subtopics=1  seed_urls=1\n  - [s1] q? (target_evidence=2)"
    one = spark.range(1).select(report.draft_summary(F.lit("abc")).alias("d"), T.acquirer_prompt(F.lit("q"), F.lit("deep"), F.array(F.lit("web"), F.lit("academic"))).alias("p")).first()
    assert one["d"].endswith("(3 chars)") and one["p"] == "Depth: deep\nSource classes: web, academic\nQuestion: q"


def test_heads(spark):
    p = spark.createDataFrame([("a", "<title>Red fox</title>"), ("b", "<title>blue</title>"), ("c", "<title>green</title>")], "url string, html string")
    got = {r["url"]: r["relevance_score"] for r in triage.heads(p, "the red fox").collect()}
    assert 0 < got["a"] < 1 and got["b"] == got["c"] == 0.0
    failed = triage.triage(triage.scored(p.withColumn("ord", F.lit(0)), triage.failed_heads(p, "timeout"), "blue"))
    assert {r["error"] for r in failed.where("NOT qualified").collect()} == {"timeout"}


def test_export_folders(tmp_path):
    for n, t in (("old", 100), ("new", 900), ("edge", 500)):
        (tmp_path / n).mkdir()
        os.utime(tmp_path / n, (t, t))
    (tmp_path / "file").write_text("x")
    assert files.prune_exports(str(tmp_path), 500, dry_run=True) == ["old"] and (tmp_path / "old").exists()
    assert files.prune_exports(str(tmp_path), 500) == ["old"] and sorted(os.listdir(tmp_path)) == ["edge", "file", "new"]
    assert files.stale_exports(str(tmp_path / "absent"), 500) == []


def test_point_lookups(spark):
    p = spark.createDataFrame([("p1", "u", datetime(2024, 1, 1)), ("p2", "u", datetime(2024, 2, 1)), ("p3", "v", datetime(2024, 3, 1))], "page_id string, url string, crawled_at timestamp")
    assert ingest.crawl_url(p, "u").first()["page_id"] == "p2" and ingest.by_id(p, "p3", "page_id").count() == 1


def test_repeated_links_use_the_budget(spark):
    s, subs = "https://h.org/", [f"https://h.org/p{i}" for i in range(4)]
    links = {s: [(subs[0], 0.0)] * 5 + [(subs[1], 0.0)], subs[0]: [(s, 0.0)] * 9 + [(subs[2], 0.0)]}
    pages = {s: True, **dict.fromkeys(subs, True)}
    assert [u for u, _, _ in crawl(spark, links, pages, s, limit=4)] == [s, subs[0]]
    assert [u for u, _, _ in crawl(spark, links, pages, s, limit=20)] == [s, subs[0], subs[1], subs[2]]


@pytest.mark.parametrize(
    "host, want",
    [
        ("com", ""), ("name.com", "name.com"), ("a.b.name.com", "name.com"), ("NAME.com.", "name.com"),
        ("unlisted", ""), ("name.unlisted", "name.unlisted"), ("b.name.unlisted", "name.unlisted"),
        ("uk", ""), ("co.uk", ""), ("shop.co.uk", "shop.co.uk"), ("a.shop.co.uk", "shop.co.uk"), ("shop.uk", "shop.uk"),
        ("ck", ""), ("any.ck", ""), ("a.any.ck", "a.any.ck"), ("b.a.any.ck", "a.any.ck"), ("www.ck", "www.ck"), ("www.www.ck", "www.ck"),
        ("jp", ""), ("town.jp", "town.jp"), ("kobe.jp", "kobe.jp"), ("c.kobe.jp", ""), ("b.c.kobe.jp", "b.c.kobe.jp"), ("city.kobe.jp", "city.kobe.jp"), ("www.city.kobe.jp", "city.kobe.jp"),
        ("10.0.0.1", ""), ("[::1]", ""), ("", ""), (None, ""),
    ],
)
def test_suffix_rules(suffixes, host, want):
    assert suffixes[host] == want


@pytest.fixture(scope="module")
def suffixes(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rules") / "rules.txt"
    path.write_text("// a comment\n\ncom\nuk\nco.uk   // commercial\n*.ck\n!www.ck\njp\n*.kobe.jp\n!city.kobe.jp\n")
    hosts = ["com", "name.com", "a.b.name.com", "NAME.com.", "unlisted", "name.unlisted", "b.name.unlisted", "uk", "co.uk", "shop.co.uk", "a.shop.co.uk", "shop.uk", "ck", "any.ck", "a.any.ck", "b.a.any.ck", "www.ck", "www.www.ck", "jp", "town.jp", "kobe.jp", "c.kobe.jp", "b.c.kobe.jp", "city.kobe.jp", "www.city.kobe.jp", "10.0.0.1", "[::1]", "", None]
    rows = spark.createDataFrame([(h, h and f"https://me@{h}:81/p") for h in hosts], "h string, url string")
    return {r["h"]: r["etld1"] for r in suffix.registrable_domains(rows, suffix.read_rules(spark, f"file://{path}")).collect()}


def test_landed_responses(spark, tmp_path):
    """A folder for each source and query; only the files of asked sources are read, failures are rows."""
    put = {
        ("duckduckgo", "old maps"): '[{"href": "https://a.test/1", "title": "A"}, {"title": "no link"}]',
        ("duckduckgo", "new maps"): "timed out",
        ("semantic_scholar", "old maps"): '{"data": [{"title": "P", "url": "https://p.test"}]}',
        ("google_serp", "old maps"): '{"error": "quota"}',
        ("google_serp", "new maps"): '{"organic": [{"link": "https://g.test"}]}',
        ("arxiv", "old maps"): "<feed><entry><id>http://arxiv.test/1</id><title>T</title></entry></feed>",
        ("other", "old maps"): "{}",
    }
    for (source, query), text in put.items():
        folder = tmp_path / f"source={source}" / f"query={query}"
        folder.mkdir(parents=True)
        (folder / "page1.txt").write_text(text)
    at = f"file://{tmp_path}"
    got = payloads.landed_hits(spark, at, ["google_serp", "duckduckgo", "arxiv", "semantic_scholar", "none"])
    assert sorted((r["query"], r["source"], r["src_ord"], r["url"]) for r in got.collect()) == [
        ("new maps", "google_serp", 0, "https://g.test"),
        ("old maps", "arxiv", 2, "http://arxiv.test/1"),
        ("old maps", "duckduckgo", 1, "https://a.test/1"),
        ("old maps", "semantic_scholar", 3, "https://p.test"),
    ]
    assert sorted(rows(payloads.failures(payloads.landed(spark, at)))) == [("duckduckgo", "new maps", "no JSON"), ("google_serp", "old maps", "quota")]
    one = payloads.landed(spark, at).where((F.col("source") == "arxiv") & (F.col("query") == "old maps"))
    assert one.count() == 1 and "PartitionFilters: [isnotnull(source" in one._jdf.queryExecution().toString()
    assert payloads.landed_hits(spark, at, ["none"]).count() == 0


def test_blocks_meet_without_a_shuffle_of_pairs(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    reps, _ = metric.classes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vector array<double>"))
    found = metric.mirror_pairs(reps, 0.92, 7)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.92), strict=True) if i < j}
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_pairs_of_the_leader_election_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    pairs = spark.range(1, 500).select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.lit(0.95).alias("similarity"))
    got = search.leaders(pairs.mapInArrow(watched, pairs.schema), spark.range(500).select(F.col("id").alias("ord")), 100).toPandas()
    assert (got["leader"] == got["page"] - got["page"] % 2).all()
    assert made.value == 499


def test_groups_of_near_pages_take_no_turns(spark, monkeypatch):
    """Of 20 groups of 30 pages, all near each other, 8,700 pairs that would take 9 turns, no second block is left."""
    pairs = [(g * 100 + i, g * 100 + j, 0.95) for g in range(20) for j in range(30) for i in range(j)] + [(0, 3_000, 0.93), (2_999, 3_000, 0.94)]
    ids, leader = sorted({p for a, b, _ in pairs for p in (a, b)}), {}
    for b in ids:
        leader[b] = min((a for a, x, _ in pairs if x == b and leader[a] == a), default=b)
    blocks, real = [], search.kept
    monkeypatch.setattr(search, "kept", lambda df: blocks.append(list(df.columns)) or real(df))
    got = search.leaders(spark.createDataFrame(pairs, "a long, b long, similarity double"), spark.createDataFrame([(i,) for i in ids], "ord long"), 1_000).toPandas()
    assert dict(zip(got["page"], got["leader"], strict=True)) == leader
    assert blocks.count(["page", "leader", "similarity"]) == 1


def test_copies_are_joined_without_their_vectors(spark):
    pages = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)] + [(60, [0.0, 0.0]), (61, [0.0, 0.0]), (62, [-0.0, 1.0])], "ord long, vector array<double>")
    reps, copies = metric.classes(pages)
    assert {r["o"] for r in reps.collect()} == set(range(7))
    assert {(r["page"], r["first"]) for r in copies.collect()} == {(i, i % 7) for i in range(7, 60)} | {(62, 0)}
    assert "Join [h0" in copies._jdf.queryExecution().executedPlan().toString()


def test_small_blocks_are_read_as_packs(spark):
    """So that few rows meet, each of bounded size, though blocks are compared one by one."""
    v = np.random.default_rng(8).normal(size=(2_000, 3))
    reps, _ = metric.classes(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vector array<double>"))
    _, cells = metric.dealt(reps, 5)
    of = metric.packs(cells, 3)
    assert len(of) > 400 and (np.diff(of) >= 0).all() and 16 <= of.max() + 1 <= 40
    assert np.bincount(of, cells.rows).max() <= 2_000 / 16
    found = {(r["a"], r["b"]) for r in metric.mirror_pairs(reps, 0.999, 5).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert found == {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.999), strict=True) if i < j}


def test_documents_meet_by_short_vectors(spark):
    rng = np.random.default_rng(6)
    counts = rng.poisson(0.4, size=(90, 900)) + np.where(np.arange(900) < 3, rng.integers(0, 30, (90, 3)).repeat(300, 1), 0)
    counts[1] = counts[0]
    counts[2] = counts[0] + (np.arange(900) == 7)
    docs = spark.createDataFrame([(i, " ".join(f"w{t}" for t, n in enumerate(c) for _ in range(n))) for i, c in enumerate(counts)] + [(90, None), (91, " ")], "doc_id long, text string")
    got = {(r["a"], r["b"]): r["similarity"] for r in search.sparse_pairs(docs, 0.92, block_rows=11).collect()}
    unit = counts / np.linalg.norm(counts, axis=1)[:, None]
    want = {(i, j): (unit @ unit.T)[i, j] for i, j in zip(*np.nonzero(unit @ unit.T >= 0.92), strict=True) if i < j and i != 1 and (j != 1 or i == 0)}
    assert len(want) >= 2 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_terms_of_documents_are_counted_where_texts_are_read(spark):
    texts = [" a\u00a0b  a\tB\x0bb\n", "c", "c \u00e9\u00c9 c\u2003d", "\x1f x", "x" * 70_000, "y \r\f y y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    tv = search.term_vectors(docs)
    want = {(r["id"], r["w"]): r["n"] for r in docs.select("id", F.explode(search.T.words(F.lower("text"))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n")).collect()}
    got = tv.collect()
    assert {(r["id"], x["term"]): x["tf"] for r in got for x in r["x"]} == want and len(got) == len(texts)
    assert all(abs(r["norm"] ** 2 - sum(n * n for (i, _), n in want.items() if i == r["id"])) < 1e-9 for r in got)
    assert "Exchange hashpartitioning" not in tv._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [3, 9_000])
def test_products_of_documents_are_exact(spark, most):
    """Terms that many documents have and others, sums below 2^24 and above; a pair in two packs or in one."""
    rng = np.random.default_rng(9)
    common = rng.poisson(6, 12) + 1
    counts = np.concatenate([common + rng.integers(0, 3, (300, 12)), (rng.random((300, 4_000)) < 0.002) * 1], axis=1)
    counts[:, 0] *= most
    docs = pd.DataFrame([(i, t, int(n)) for i, c in enumerate(counts) for t, n in enumerate(c) if n], columns=["id", "term", "tf"])
    tv = docs.assign(term=docs["term"].map("w{}".format)).groupby("id").apply(lambda g: list(zip(g["term"], g["tf"], strict=True)), include_groups=False)
    norm = np.linalg.norm(counts, axis=1)
    tv = spark.createDataFrame([(int(i), float(norm[i]), x) for i, x in tv.items()], "id long, norm double, x array<struct<term string, tf int>>")
    cosines = counts @ counts.T / (norm[:, None] * norm[None])
    for ways in (1, 4):
        found = metric.product(search._packed(search._numbered(tv), ways), search._sparse(0.92), "a long, b long, similarity double").toPandas()
        low, high = found[["a", "b"]].min(axis=1), found[["a", "b"]].max(axis=1)
        assert set(zip(low, high, strict=True)) == {(i, j) for i, j in zip(*np.nonzero(cosines >= 0.92), strict=True) if i < j} and len(found) > 1_000
        assert (found["similarity"].to_numpy() == cosines[low, high]).all()


def test_texts_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "f e d c b a"), (3, "d e f"), (3, "d e f")], "doc_id long, text string")
    got = sorted((r["a"], r["b"], round(r["similarity"], 6)) for r in search.sparse_pairs(docs).collect())
    assert got == [(1, 2, 1.0), (1, 3, 1.0), (1, 3, 1.0)]
    assert search.sparse_pairs(docs.limit(0)).count() == 0


def test_different_texts_of_equal_terms_are_linked_to_all(spark):
    """Only equal texts stand for each other: 1, 2 and 4 have the same terms, 3 is a copy of 2, 5 near them, 6 and 7 blank."""
    texts = ["one two three four five six", "six five four three two one", "six five four three two one", "One two three four five SIX", "one two three four five six seven", " ", " "]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in search.sparse_pairs(docs).collect()}
    near = round(6 / (6 * 7) ** 0.5, 6)
    assert got == {(1, 2): 1.0, (1, 4): 1.0, (2, 4): 1.0, (2, 3): 1.0, (1, 5): near, (2, 5): near, (4, 5): near}


def test_legacy_chunks_of_a_long_text_are_linear(spark):
    w = [f"w{i % 997}" for i in range(40_000)]
    df = spark.createDataFrame([(" ".join(w),), ("",), (None,), ("a",)], "t string")
    got = [tuple(r) for r in df.select(F.explode(chunk.legacy(F.col("t"), 8, 2)).alias("c")).select("c.chunk_index", "c.token_count", "c.char_start", "c.char_end").collect()]
    want, at = [], 0
    for i in range(-(-(len(w) - 8) // 6) + 1):
        start = max(at - 1, 0)
        want.append((i, len(w[i * 6 : i * 6 + 8]), start, start + len(" ".join(w[i * 6 : i * 6 + 8]))))
        at += sum(len(x) + 1 for x in w[i * 6 : i * 6 + 6])
    assert got == [*want, (0, 1, 0, 1)]
