"""Every query of the reference's operators against its SQL, at the smallest scale."""

import re
from functools import partial

import duckdb
import pytest
from conftest import SMALL
from oracle import TABLES, same
from pyspark.sql import functions as F

from quillon.functions import url as U
from quillon.functions import values as V
from quillon.lineage import dealt, ranked
from quillon.operators import events, report
from quillon.plans import derived as D
from quillon.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The smallest tables as they are when grown: part keys of more than five digits, two pages of a URL, any microsecond."""
    at = tmp_path_factory.mktemp("grown")
    keys = "CASE WHEN p_partkey < 100 THEN p_partkey WHEN p_partkey < 150 THEN 11900 + p_partkey ELSE 118500 + p_partkey * 10 END"
    again = "SELECT * REPLACE (page_id + 51 AS page_id) FROM pages"
    late = "ts + to_microseconds(event_id * 37 % 1000 * 500 + event_id % 2 * 500)"
    changed = {"part": f"SELECT * REPLACE ({keys} AS p_partkey) FROM part", "pages": f"FROM pages UNION ALL {again}", "events": f"SELECT * REPLACE ({late} AS ts) FROM events"}
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        con.execute(f"COPY ({changed.get(t, f'FROM {t}')}) TO '{at}/{t}.parquet'")
    return str(at)


GROWN = ["citation_bfs", "citation_bfs_gated", "crawl_many", "span_latency", "strategy_dispatch", "triage_qualified", "triage_scores", "triage_stats"]


@pytest.mark.parametrize("name", GROWN)
def test_query_equals_sql_on_grown_tables(spark, grown, name):
    same(QUERIES[name](spark, grown), ORACLES[name], grown)


def test_papers_have_ids_of_their_own(spark, grown):
    rows = D.papers(spark, grown).select("paper_id", D.paper_key(F.col("paper_id")).alias("k"), U.paper_id(F.concat(F.lit("https://arxiv.org/abs/"), F.substring("paper_id", 7, 20))).alias("again")).collect()
    assert len({r["paper_id"] for r in rows}) == len(rows) == 200
    assert all(r["paper_id"] == r["again"] for r in rows)
    assert {r["k"] for r in rows} == {r[0] for r in spark.read.parquet(f"{grown}/part.parquet").select("p_partkey").collect()}


def test_small_numbers_below_zero_keep_their_sign(spark):
    df = spark.createDataFrame([(-1e-7,), (1e-7,), (-0.0,), (-0.0078125,), (0.0078125,), (None,)], "x double")
    got = [r[0] for r in df.select(V.rounded(F.col("x"), 6)).collect()]
    assert [str(x) for x in got] == ["-0.0", "0.0", "-0.0", "-0.007813", "0.007813", "None"]


def test_pairs_of_vectors_are_linked_from_the_lower_threshold(spark):
    assert QUERIES["neardup_pairs"](spark, SMALL).where("similarity < 0.5").count() > 0


def test_texts_of_equal_terms_are_documents_of_their_own(spark, tmp_path):
    """Words in another order, or in capitals, are another text: all its links are rows, as in SQL."""
    texts = "SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000, array_to_string(list_reverse(string_split(text, ' ')), ' ') FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id + 2000000, upper(text) FROM documents WHERE doc_id % 7 = 0"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        con.execute(f"COPY ({texts if t == 'documents' else f'FROM {t}'}) TO '{tmp_path}/{t}.parquet'")
    got = QUERIES["neardup_docs"](spark, str(tmp_path))
    same(got, ORACLES["neardup_docs"], str(tmp_path))
    assert got.where("a >= 1000000 AND b >= 2000000 AND a - 1000000 = b - 2000000").count() > 0


def test_latencies_are_differences_of_whole_microseconds(spark):
    base = 1_704_067_200_000_000
    rows = [(k, base + k * 86_400_137 + part * (k * 1000 + 500), 2 * k + part, ("start", "end")[part]) for k in range(200) for part in (0, 1)]
    e = spark.createDataFrame(rows, "user_id long, us long, event_id long, kind string").withColumn("ts", F.timestamp_micros("us"))
    got = {r["user_id"]: r["latency_ms"] for r in events.spans(e, ["user_id"]).collect()}
    assert got == {k: k + 1 for k in range(200)}


@pytest.mark.parametrize("sent", [0, D.SENT])
def test_evidence_is_dealt_in_parts_of_bounded_size(spark, monkeypatch, sent):
    """However many lines there are, a task of the queries over claims holds a bounded number of them."""
    monkeypatch.setattr(D, "dealt", partial(dealt, each=500))
    monkeypatch.setattr(D, "SENT", sent)
    sizes = [r["count"] for r in D.evidence(spark, SMALL).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == spark.read.parquet(f"{SMALL}/lineitem.parquet").count() and max(sizes) < 1000, sizes
    for name in ("cited_sources", "claims_status", "contradiction_buckets", "ledger_merge", "source_independence"):
        same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


@pytest.mark.parametrize("name", ["claims_status", "contradiction_scores", "coverage", "coverage_lines", "kept_counts"])
def test_queries_over_claims_sort_no_lines(spark, monkeypatch, name):
    """Suppliers and orders are hashed tables, and a claim's evidence is put in order within its row."""
    monkeypatch.setattr(D, "dealt", partial(dealt, each=500))
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Window" not in plan and "SortMergeJoin [l_" not in plan
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


@pytest.mark.parametrize("name", ["contradiction_buckets", "report_lines"])
def test_contradictions_are_ranked_in_parts_of_bounded_size(spark, monkeypatch, name):
    """However many contradictions there are, a task that ranks them or joins them to their places holds a bounded number."""
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    sorted_in = []

    def watched(*args):
        out = ranked(*args, each=100)
        sorted_in.append(sizes(out[0]))
        return out

    monkeypatch.setattr(report, "dealt", partial(dealt, each=100))
    monkeypatch.setattr(report, "ranked", watched)
    got = QUERIES[name](spark, SMALL)
    joined = sizes(got)
    assert sum(joined) == sum(sorted_in[0]) > 1000 and max(joined) < 200 and max(sorted_in[0]) < 300, (joined, sorted_in)
    same(got, ORACLES[name], SMALL)


@pytest.mark.parametrize("name", ["contradiction_scores", "coverage", "coverage_lines", "kept_counts"])
def test_lines_are_dealt_in_parts_that_are_written_without_a_sort(spark, monkeypatch, name):
    """For more than 200 partitions a map task would hold its whole split of lines in memory."""
    monkeypatch.setattr(D, "dealt", partial(dealt, each=20))
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    ways = [int(n) for n in re.findall(r"hashpartitioning\([lo]_orderkey#\d+L?, (\d+)\)", plan)]
    assert ways and set(ways) == {200}, ways
    same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_contradictions_are_ranked_in_parts_that_are_written_without_a_sort(spark, monkeypatch):
    """The ranks of ``report_lines`` and the join with them, dealt like lines."""
    monkeypatch.setattr(report, "dealt", partial(dealt, each=5))
    monkeypatch.setattr(report, "ranked", partial(ranked, each=5))
    got = QUERIES["report_lines"](spark, SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    ways = [int(n) for n in re.findall(r"hashpartitioning\(row__#\d+L?, (\d+)\)", plan)]
    assert got.count() > 1000 and len(ways) > 1 and set(ways) == {200}, ways
    same(got, ORACLES["report_lines"], SMALL)
