"""A stored BM25 index against the scan of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import bm25
from quillon.sources import textindex
from quillon.sources.textindex import TextIndex


def corpus():
    """Texts on thirty subjects with words of their own, a word that all hold, and odd rows."""
    draw = random.Random(5)
    rows = []
    for i in range(1800):
        subject = i % 30
        rows.append((i, " ".join(["Every"] + [f"s{subject}w{draw.randrange(40)}" for _ in range(draw.randrange(5, 60))])))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (None, "s1w1 s1w1 s1w2"), (7, rows[7][1]), (7, "s7w1 every"), (5003, "s2w1 " * 20000)]
    rows += [(6000 + i, "s3w3 s3w4 every") for i in range(700)]
    return rows


QUERIES = [(1, "what is s1w1 S1W2 s1w1"), (2, "s2w1 every s29w3"), (3, "s3w3"), (4, "nowhere seen"), (5, ""), (6, None), (7, "the of"), (8, "every"), (None, "s1w1")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in corpus()], "doc_id long, text string, term string, block int").repartition(5)
    return TextIndex.write(docs, f"file://{tmp_path_factory.mktemp('index')}/ix"), docs


def test_search_equals_scan(spark, index):
    built, docs = index
    got = {}
    for r in built.search(spark.createDataFrame(QUERIES, "query_id long, query string"), k=15).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], round(r["score"], 6), r["doc_id"], round(r["relevance"], 6)))
    for i, text in QUERIES:
        if not text or i is None:
            assert i not in got
            continue
        scored = [(round(r["score"], 9), r["doc_id"], r["relevance"]) for r in bm25.scores(docs, text).collect()]
        scored.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        want = [(n, round(s, 6), d, round(rel, 6)) for n, (s, d, rel) in enumerate(scored[:15], 1)]
        assert sorted(got.get(i, [])) == want, text


def test_many_queries_equal_few(spark, index, monkeypatch):
    """Queries that go to all tasks and those that do not find the same."""
    built, _ = index
    asked = spark.createDataFrame(QUERIES + [(100 + i, f"every s{i % 30}w{i} s{i * 7 % 30}w3") for i in range(40)], "query_id long, query string")
    few = sorted(map(repr, built.search(asked, k=5).collect()))
    monkeypatch.setattr(textindex, "SENT", 0)
    assert sorted(map(repr, built.search(asked, k=5).collect())) == few and len(few) > 200


def test_a_row_is_shuffled_once_for_all_queries(spark, index):
    """However many queries ask for a term, what a block has of it is one row."""
    built, _ = index
    asked = spark.createDataFrame([(i, "every s1w1") for i in range(300)], "query_id long, query string")
    found = built.search(asked, k=3)
    assert found.count() == 900 and "block#" in found._jdf.queryExecution().toString()
    pairs = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in x and "block#" in x]
    assert pairs and all("Aggregate [block#" in x for x in pairs), pairs


def test_most_blocks_are_not_read(spark, tmp_path):
    """Where partitions hold many texts of each subject: blocks that no asked term is in are not met, and
    of the others most are skipped by their bounds."""
    draw = random.Random(6)
    texts = [(i, " ".join(["every"] + [f"s{i % 30}w{draw.randrange(40)}" for _ in range(draw.randrange(5, 60))])) for i in range(9000)]
    built = TextIndex.write(spark.createDataFrame(texts, "doc_id long, text string").repartition(2), f"file://{tmp_path}/many")
    asked = spark.createDataFrame([(s, f"s{s}w1 s{s}w2 s{s}w3 every") for s in range(30)], "query_id int, query string")
    seen = dict(built.plan(asked, 10)[0].groupBy("state").count().collect())
    blocks = spark.read.parquet(f"{built.path}/postings").select("block").distinct().count()
    assert seen["skipped"] > seen.get("read", 0) + seen["lead"] and seen.get("read", 0) + seen["lead"] < 0.5 * 30 * blocks, (seen, blocks)


def test_rows_are_bounded(spark, index):
    """A word of all documents is in many rows of at most a block; a scan is told the terms of few queries."""
    built, _ = index
    rows = spark.read.parquet(f"{built.path}/postings")
    assert rows.agg(F.greatest(F.max(F.size("tfs")), F.max(F.size("ids")))).first()[0] <= 64 and rows.where("term = 'every'").count() > 30
    plan = built._of_terms(spark.createDataFrame([("s1w1",), ("every",)], "term string"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [" in plan


def test_empty_and_unfinished(spark, tmp_path):
    empty = TextIndex.write(spark.createDataFrame([], "name string, text string"), f"file://{tmp_path}/e", id_column="name")
    found = empty.search(spark.createDataFrame(QUERIES, "query_id long, query string"))
    assert found.columns == ["query_id", "rank", "name", "score", "relevance"] and found.count() == 0
    blank = TextIndex.write(spark.createDataFrame([("a", None), ("b", " ")], "name string, text string"), f"file://{tmp_path}/b", id_column="name")
    assert blank.search(spark.createDataFrame(QUERIES, "query_id long, query string")).count() == 0
    with pytest.raises(Exception):
        TextIndex(spark, f"file://{tmp_path}/none")
    with pytest.raises(Exception):
        TextIndex.write(spark.createDataFrame([("a", "x")], "name string, text string"), f"file://{tmp_path}/e", id_column="name")
