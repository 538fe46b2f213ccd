"""Ledgers of claims: evidence policy, merging, stop rules, subtopics and edited source lists.

A claim's sources and contradictions are ordered arrays, small for each claim, so the policy is
folds within a row: no claim's evidence is spread, and none shuffles once it is gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.config import DEFAULT, Config
from quillon.functions import policy as P
from quillon.functions import records as R
from quillon.lineage import dealt

EMPTY_SOURCE = "named_struct('url', '', 'etld1', '', 'quote', '', 'publication_date', CAST(NULL AS DATE))"


def gather(evidence: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Claims from rows of evidence (claim, subtopic_id, ord, side, url, etld1, quote,
    publication_date): ordered arrays of sources and contradictions."""
    one = F.struct("ord", "url", "etld1", "quote", "publication_date")
    drop = lambda a: F.transform(F.array_sort(a), lambda x: F.struct(x["url"].alias("url"), x["etld1"].alias("etld1"), x["quote"].alias("quote"), x["publication_date"].alias("publication_date")))
    # by the claim alone, by which evidence is mostly dealt already; a claim has one subtopic
    both = evidence.groupBy(claim).agg(F.min("subtopic_id").alias("subtopic_id"), F.collect_list(F.when(F.col("side") == "source", one)).alias("s"), F.collect_list(F.when(F.col("side") == "contradiction", one)).alias("c"))
    return both.select(F.col(claim).alias("id"), "subtopic_id", drop("s").alias("sources"), drop("c").alias("contradictions"))


def enrich(claims: DataFrame, cosine=None, contradiction_cosine=None, method=None, methodological=None, config: Config = DEFAULT) -> DataFrame:
    """Status, temporal status, and score and type of each contradiction, from evidence alone:
    whatever a model wrote there is replaced. The signals are functions of records that give
    columns; none of them means 0 or false. The first source stands for the claim."""
    none = F.lit(0.0)
    c_cos = contradiction_cosine or (lambda s, c: none)
    meth = method or (lambda c: none)
    is_meth = methodological or (lambda c: F.lit(False))
    has = F.size("sources") > 0
    ref = F.coalesce(F.try_element_at("sources", F.lit(1)), F.expr(EMPTY_SOURCE))

    def judged(c: Column) -> Column:
        near = F.when(has, c_cos(ref, c)).otherwise(none)
        return F.struct(
            c["url"].alias("url"),
            c["etld1"].alias("etld1"),
            c["quote"].alias("quote"),
            c["publication_date"].alias("publication_date"),
            P.contradiction_score(ref["etld1"], ref["publication_date"], c["etld1"], c["publication_date"], near, meth(c), config).alias("confidence_score"),
            P.conflict_type(ref["publication_date"], c["publication_date"], is_meth(c), config).alias("conflict_type"),
        )

    labels = F.transform("contradictions", lambda c: P.conflict_label(ref["publication_date"], c["publication_date"], config))
    return claims.withColumns(
        {
            "status": P.claim_status(F.col("sources"), F.col("contradictions"), cosine, config),
            "temporal_status": P.label_fold(labels),
            "contradictions": F.transform("contradictions", judged),
        }
    )


def verify(replies: DataFrame, first: str = "first", second: str = "second", **signals) -> DataFrame:
    """Judged claims of a model's replies: the JSON of the first try, else of the second, else
    none. The policy is applied to whatever was parsed."""
    parsed = R.ledger(R.with_retry(F.col(first), F.col(second), '{"claims": []}'))
    rows = replies.select(*[c for c in replies.columns if c not in (first, second)], F.posexplode(parsed).alias("ord", "c__"))
    return enrich(rows.select("*", "c__.*").drop("c__"), **signals)


def signal_lookup(signals: Column, a: str = "a", b: str = "b", value: str = "cos"):
    """A likeness function over a claim's own array of (a, b, cos) records; unknown pairs are 0."""

    def near(x: Column, y: Column) -> Column:
        hit = F.filter(signals, lambda s: ((s[a] == x["url"]) & (s[b] == y["url"])) | ((s[a] == y["url"]) & (s[b] == x["url"])))
        return F.coalesce(F.try_element_at(hit, F.lit(1))[value], F.lit(0.0))

    return near


def merge(base: DataFrame, new: DataFrame, key: list[str] | None = None, order: str = "ord", rows: int = 0) -> DataFrame:
    """``base`` and the claims of ``new`` whose key it lacks, the first of each key. The key is the
    claim id; ``["subtopic_id", "id"]`` keeps equal ids of different subtopics apart. Where ``new`` is known
    to have many ``rows``, they are dealt in parts of bounded size."""
    key = key or ["id"]
    first = Window.partitionBy(*key).orderBy(order)
    fresh = dealt(new, key, rows).withColumn("n__", F.row_number().over(first)).where("n__ = 1").drop("n__")
    return base.unionByName(fresh.join(base.select(*key), key, "left_anti"), allowMissingColumns=True)


def kept_counts(claims: DataFrame) -> DataFrame:
    return claims.groupBy("subtopic_id").agg(F.count_if(F.col("status") == "kept").alias("kept"), F.count("*").alias("claims"))


def for_subtopic(claims: DataFrame, subtopic) -> DataFrame:
    return claims.where(F.col("subtopic_id") == subtopic)


def stop_passes(passes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """For each subtopic the first pass at which the loop stops. ``passes``: subtopic_id,
    iteration (completed passes), kept (of this pass), new_claims, target_evidence, depth."""
    so_far = Window.partitionBy("subtopic_id").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    rows = passes.withColumn("kept_total", F.sum("kept").over(so_far))
    rows = rows.withColumn("stops", P.stop(F.col("kept_total"), F.col("target_evidence"), F.col("iteration"), F.col("new_claims"), P.budget(F.col("depth"), config), config))
    return rows.groupBy("subtopic_id").agg(F.min(F.when(F.col("stops"), F.col("iteration"))).alias("stop_iteration"), F.max("kept_total").alias("kept_total"))


def apply_targets(plans: DataFrame) -> DataFrame:
    return plans.withColumn("subtopics", P.with_targets(F.col("subtopics"), F.col("depth")))


def dedup_evidence(claims: DataFrame) -> DataFrame:
    return claims.withColumn("sources", F.array_distinct("sources"))


# Edited source lists: one command a line.

_URL = "struct<url:string,score:double,strategy:string,source:string>"


def _parts(line: Column) -> tuple[Column, Column]:
    return F.lower(F.substring_index(line, " ", 1)), F.when(F.instr(line, " ") > 0, F.trim(F.regexp_replace(line, "^[^ ]* ", ""))).otherwise("")


def _lines(reply: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def apply_verbs(urls: Column, reply: Column) -> Column:
    """(urls, needs_supplemental) after the lines of a reply: ``+ url`` and ``r url`` add a URL,
    ``- n`` takes away number n of the list as it then is, ``d`` ends; other lines do nothing."""
    start = F.struct(urls.cast(f"array<{_URL}>").alias("urls"), F.lit(False).alias("more"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        verb, arg = _parts(line)
        user = F.struct(arg.alias("url"), F.lit(1.0).alias("score"), F.lit("crawl_url").alias("strategy"), F.lit("user").alias("source")).cast(_URL)
        adds = verb.isin("+", "r", "redirect") & (arg != "")
        n = F.when((verb == "-") & arg.rlike(r"^\d{1,9}$"), arg.cast("int"))
        takes = n.isNotNull() & (n < F.size(acc["urls"]))
        without = F.filter(acc["urls"], lambda _, i: i != n)
        next_urls = F.when(adds, F.concat(acc["urls"], F.array(user))).when(takes, without).otherwise(acc["urls"])
        ended = acc["done"] | verb.isin("d", "done")
        return F.struct(F.when(ended, acc["urls"]).otherwise(next_urls).alias("urls"), (acc["more"] | (~ended & adds)).alias("more"), ended.alias("done"))

    return F.aggregate(_lines(reply), start, step, lambda acc: F.struct(acc["urls"].alias("urls"), acc["more"].alias("needs_supplemental")))


def unknown_lines(reply: Column) -> Column:
    """Lines of a reply that begin with no command."""
    return F.filter(_lines(reply), lambda x: ~F.lower(F.substring_index(x, " ", 1)).isin("+", "-", "r", "redirect", "d", "done"))


def missing_dates(claims: DataFrame) -> DataFrame:
    return claims.select("id", F.size(F.filter("sources", lambda s: s["publication_date"].isNull())).alias("undated"))


