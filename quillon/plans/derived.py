"""Inputs derived from the provided tables, for queries and benchmarks, in Spark and in SQL.

Claims are order keys, sources line items, publishers the supplier's nation; a returned line is
a contradiction. Hits are pages, dealt to three sources by their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.config import DROPPED_TAGS, TRACKING_KEYS, TRACKING_PREFIX
from quillon.lineage import dealt
from quillon.operators import claims as C
from quillon.functions.text import MARKDOWN_ENTITIES, MARKDOWN_RULES

QUERY = "why is the attion of thanedble and the reting in tionoring"

SENT = 1_000_000  # suppliers that go to all tasks, two numbers each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    src = (F.col("page_id") % 3).cast("int")
    name = F.element_at(F.array(F.lit("duckduckgo"), F.lit("arxiv"), F.lit("semantic_scholar")), src + 1)
    return p.select(name.alias("source"), src.alias("src_ord"), F.col("page_id").cast("int").alias("rank"), "url", F.lit("").alias("title"), F.lit("").alias("snippet"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose ``ord`` is what its order goes by, a struct; no step sorts lines or holds more than a task's share."""
    li, su, o = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders"))
    # suppliers and orders are hashed tables; lines and orders are dealt by order in parts of bounded size
    small = F.broadcast if su.count() <= SENT else lambda t: t.hint("shuffle_hash")
    n = max(li.count(), o.count())
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag")
    rows = li.join(small(su.select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    o = o.select("o_orderkey", "o_orderpriority").hint("shuffle_hash")
    return dealt(rows, "l_orderkey", n).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("claim_id"),
        F.col("o_orderpriority").alias("subtopic_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("ord"),
        F.when(F.col("l_returnflag") == "R", "contradiction").otherwise("source").alias("side"),
        F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example/"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(F.col("s_nationkey") == 0, "").otherwise(F.col("s_nationkey").cast("string")).alias("etld1"),
        F.lit("").alias("quote"),
        F.when(F.col("l_linenumber") != 7, F.to_date("l_shipdate")).alias("publication_date"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("claim_id").orderBy("ord")
    return _lines(spark, sf_dir).withColumn("ord", F.row_number().over(order))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.gather(_lines(spark, sf_dir))
    return rows.withColumns({"ord": F.col("id"), "text": F.concat(F.lit("claim "), F.col("id").cast("string"))})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.enrich(claims(spark, sf_dir))


def subtopics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five priorities and one that no claim has; its target is 3."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("id")).distinct()
    o = o.unionByName(spark.createDataFrame([("9-NONE",)], "id string"))
    return o.select("id", F.concat(F.lit("what of "), F.col("id")).alias("question"), F.lit(3).alias("target_evidence"), F.substring("id", 1, 1).cast("int").alias("ord"))


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes of subtopics: a claim belongs to pass id % 4 of its customer segment's nation."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy(F.col("c_nationkey").alias("subtopic_id"), (F.col("o_orderkey") % 4).cast("int").alias("iteration")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("kept"), F.count_if(F.col("o_orderkey") % 97 == 0).alias("new_claims")).withColumns({"target_evidence": F.lit(300), "depth": F.lit("normal")})


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    n = p.agg(F.count("*").alias("n"))
    both = p.join(F.broadcast(n))
    step = lambda a, b: both.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * a + b) % F.col("n")).alias("dst"))
    return step(2, 1).unionByName(step(3, 2))


def paper_id(key: Column) -> Column:
    """An arXiv number for each part key: five digits, and months from 2301 on for what is above them."""
    month = F.lpad((2301 + F.floor(key / 100_000)).cast("string"), 4, "0")
    return F.concat(F.lit("arXiv:"), month, F.lit("."), F.lpad((key % 100_000).cast("string"), 5, "0"))


def paper_key(id: Column) -> Column:
    """The part key of a paper's id."""
    return (F.substring(id, 7, 4).cast("long") - 2301) * 100_000 + F.substring(id, 12, 5).cast("long")


def paper_name(id: Column) -> Column:
    """A paper's id as the SQL shows it: of keys above five digits the first five."""
    return F.concat(F.lit("arXiv:2301."), F.lpad(paper_key(id).cast("string"), 5, "0"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers whose references follow the same edges; ids are arXiv numbers made of part keys, no two alike."""
    e = edges(spark, sf_dir).groupBy("src").agg(F.array_sort(F.collect_set(paper_id(F.col("dst")))).alias("references"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    rows = p.join(e, F.col("p_partkey") == F.col("src"), "left")
    return rows.select(paper_id(F.col("p_partkey")).alias("paper_id"), F.lpad(F.hex("p_partkey"), 40, "0").alias("s2_paper_id"), F.col("p_name").alias("title"), F.make_date(1980 + F.col("p_size"), F.lit(1), F.lit(1)).alias("publication_date"), "references", F.array().cast("array<string>").alias("citations"))


def span_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "start").when(F.col("event_type") == "purchase", "error").otherwise("end")
    return e.select("event_id", "ts", "user_id", kind.alias("kind"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    code = F.when(F.col("event_type") == "click", 429).when(F.col("event_type") == "view", 503).when(F.col("event_type") == "purchase", F.lit(None)).otherwise(200).cast("int")
    return e.select("user_id", n.alias("attempt"), code.alias("status_code"), F.coalesce(code == 200, F.lit(False)).alias("success"))


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pages in id order."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))


def mirrored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as pages, each followed, after all of them, by a mirror (a little turned) and a copy."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    turned = F.transform("v", lambda x, i: x + 0.03 * ((i * 7 + F.col("vec_id")) % 5 - 2))
    ahead = F.lit(1_000_000_000_000)
    kinds = [(F.col("vec_id"), F.col("v")), (F.col("vec_id") + ahead, turned), (F.col("vec_id") + 2 * ahead, F.col("v"))]
    return e.select(F.explode(F.array(*[F.struct(o.alias("ord"), v.alias("vector")) for o, v in kinds])).alias("p")).select("p.ord", "p.vector")


#: ``mirrored_vectors`` in SQL, as ``m``.
SQL_MIRRORED = """m AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS v FROM embeddings
UNION ALL SELECT vec_id + 1000000000000, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.03 * (((i - 1) * 7 + vec_id) % 5 - 2)) FROM embeddings
UNION ALL SELECT vec_id + 2000000000000, embedding::DOUBLE[] FROM embeddings)"""


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit("s"), (F.col("page_id") % 4).cast("string")).alias("session_id"), "url", "html", (F.col("page_id") % 11 != 0).alias("success"), F.lit("timeout").alias("error"), (F.col("page_id") % 7 / 10).alias("total_score"), F.timestamp_seconds(F.col("page_id") * 60).alias("crawled_at"))


SQL_EVIDENCE = """evidence AS (
  SELECT l_orderkey AS claim_id, o_orderpriority AS subtopic_id,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS ord,
    CASE WHEN l_returnflag = 'R' THEN 'contradiction' ELSE 'source' END AS side,
    'https://s' || l_suppkey || '.example/' || l_partkey AS url,
    CASE WHEN s_nationkey = 0 THEN '' ELSE s_nationkey::VARCHAR END AS etld1,
    CASE WHEN l_linenumber <> 7 THEN l_shipdate::DATE END AS publication_date
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey)"""

# an empty publisher is independent of all (no likeness is known), equal ones are not
SQL_STATUS = (
    SQL_EVIDENCE
    + """,
disputed AS (
  SELECT DISTINCT c.claim_id FROM evidence c JOIN evidence s USING (claim_id)
  WHERE c.side = 'contradiction' AND s.side = 'source' AND (c.etld1 = '' OR s.etld1 = '' OR c.etld1 <> s.etld1)),
support AS (
  SELECT claim_id, count(DISTINCT nullif(etld1, '')) + count(*) FILTER (etld1 = '') AS independent FROM evidence WHERE side = 'source' GROUP BY claim_id),
ids AS (SELECT DISTINCT claim_id, subtopic_id FROM evidence),
status AS (
  SELECT i.claim_id, i.subtopic_id, coalesce(s.independent, 0)::INT AS independent,
    CASE WHEN d.claim_id IS NOT NULL THEN 'flagged' WHEN coalesce(s.independent, 0) >= 2 THEN 'kept' ELSE 'uncorroborated' END AS status
  FROM ids i LEFT JOIN disputed d USING (claim_id) LEFT JOIN support s USING (claim_id))"""
)

SQL_CONTRADICTIONS = """primary_source AS (
  SELECT claim_id, min_by(etld1, ord) AS se, min_by(struct_pack(d := publication_date), ord).d AS sd FROM evidence WHERE side = 'source' GROUP BY claim_id),
pairs AS (
  SELECT e.claim_id, e.subtopic_id, e.url, e.etld1, e.publication_date AS cd, coalesce(p.se, '') AS se, p.sd,
    row_number() OVER (PARTITION BY e.claim_id ORDER BY e.ord) - 1 AS pos,
    abs((year(p.sd) * 12 + month(p.sd)) - (year(e.publication_date) * 12 + month(e.publication_date))) AS gap
  FROM evidence e LEFT JOIN primary_source p USING (claim_id) WHERE e.side = 'contradiction'),
judged AS (
  SELECT *, (CASE WHEN se <> '' AND etld1 <> '' AND se = etld1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / 3 END)
      + (CASE WHEN sd IS NULL OR cd IS NULL OR gap >= 18 THEN 0.0::DOUBLE WHEN gap < 12 THEN 1.0::DOUBLE / 3 ELSE (1.0::DOUBLE - (gap - 12)::DOUBLE / 6) / 3 END) AS score,
    CASE WHEN sd IS NOT NULL AND cd IS NOT NULL AND gap >= 18 THEN 'temporal_drift' ELSE 'factual' END AS conflict_type,
    CASE WHEN sd IS NULL OR cd IS NULL THEN 'uncertain' WHEN gap >= 18 AND sd >= cd THEN 'current' WHEN gap >= 18 THEN 'dated' END AS label
  FROM pairs)"""

SQL_PASSES = """passes AS (
  SELECT c_nationkey AS subtopic_id, (o_orderkey % 4)::INT AS iteration, count(*) FILTER (o_orderstatus = 'F') AS kept, count(*) FILTER (o_orderkey % 97 = 0) AS new_claims
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
stops AS (
  SELECT *, sum(kept) OVER (PARTITION BY subtopic_id ORDER BY iteration) AS kept_total FROM passes),
first_stop AS (
  SELECT subtopic_id, min(iteration) FILTER (kept_total >= 300 OR iteration >= 4 OR (iteration >= 1 AND new_claims < 2)) AS stop_iteration, max(kept_total)::BIGINT AS kept_total FROM stops GROUP BY subtopic_id)"""

SQL_EDGES = """n AS (SELECT count(*) AS n FROM part),
edges AS (SELECT p_partkey AS src, (p_partkey * 2 + 1) % n AS dst FROM part, n UNION ALL SELECT p_partkey, (p_partkey * 3 + 2) % n FROM part, n)"""


def sql_canonical(url: str = "url") -> str:
    """Canonical form of URLs with a scheme and a host, in SQL."""
    host = f"lower(regexp_extract({url}, '^[^:]+://([^/?#]*)', 1))"
    scheme = f"lower(regexp_extract({url}, '^([^:]+)://', 1))"
    bare = f"CASE WHEN {scheme} = 'http' THEN regexp_replace({host}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({host}, ':443$', '') ELSE {host} END"
    path = f"coalesce(nullif(regexp_replace(regexp_extract({url}, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/')"
    query = f"""array_to_string(list_sort(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'),
      lambda x: regexp_matches(x, '=.') AND NOT regexp_matches(lower(x), '^({TRACKING_PREFIX}|({'|'.join(TRACKING_KEYS)})=)'))), '&')"""
    return f"{scheme} || '://' || {bare} || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END"


SQL_REGISTRABLE = """CASE WHEN len(string_split(h, '.')) < 2 OR regexp_matches(h, '^[0-9.]+$') THEN ''
  WHEN length(string_split(h, '.')[-1]) = 2 AND string_split(h, '.')[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'go', 'ne', 'net', 'nom', 'or', 'org', 'sch')
    THEN CASE WHEN len(string_split(h, '.')) < 3 THEN '' ELSE array_to_string(string_split(h, '.')[-3:], '.') END
  ELSE array_to_string(string_split(h, '.')[-2:], '.') END"""

def sql_text(html: str = "html", clean: bool = True) -> str:
    if clean:
        html = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
        for t in DROPPED_TAGS:
            html = f"regexp_replace({html}, '(?is)<{t}(?:\\s[^>]*)?>.*?</{t}>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({html}, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g'))"


def sql_markdown(html: str = "html") -> str:
    out = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
    for t in DROPPED_TAGS:
        out = f"regexp_replace({out}, '(?is)<{t}(?:\\s[^>]*)?>.*?</{t}>', ' ', 'g')"
    for pattern, put in MARKDOWN_RULES:
        out = f"regexp_replace({out}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    for entity, char in MARKDOWN_ENTITIES:
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '\\s+'), lambda w: w <> '')"
