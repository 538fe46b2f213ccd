"""Coverage, contradiction buckets, sources and the rendered report, and the graders of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.lineage import dealt, kept, ranked

# Headings and placeholders of the report.
SECTIONS = ("## Coverage", "## Contradictions", "### Factual & Methodological Contradictions", "### Temporal Drift", "## Sources")
NO_GENUINE = "_No factual or methodological contradictions detected._"
NO_DRIFT = "_No temporal drift detected._"
DRIFT_NOTE = "_Informational: the following reflect how the field evolved over time rather than genuine factual conflicts._"
NO_SOURCES = "_No cited sources._"
COVERAGE, CONTRADICTIONS, GENUINE, DRIFT, SOURCES = SECTIONS
# Words of its lines and of the checkpoints.
CLAIM = "- Claim `"
SOURCE_OF, DATED, CONFIDENCE = "contradicting source: ", "dated ", "confidence "
GAP = "> Coverage gap: no claims gathered for subtopic(s): "
COVERED, MISSING = "covered", "MISSING — coverage gap"
COVERAGE_LINE = "- `%s` (%s): %s — %d claim(s), %d kept"
PLAN_HEAD = "=== Checkpoint 1: Research Plan ==="
DRAFT_HEAD = "=== Checkpoint 2: Draft Report ==="


def coverage(subtopics: DataFrame, claims: DataFrame) -> DataFrame:
    """For each subtopic (id, question, target_evidence, ord): claims, kept, complete, covered."""
    counts = claims.groupBy(F.col("subtopic_id").alias("id")).agg(F.count("*").alias("total_claims"), F.count_if(F.col("status") == "kept").alias("kept"))
    rows = subtopics.join(counts, "id", "left").withColumns({"total_claims": F.coalesce("total_claims", F.lit(0)), "kept": F.coalesce("kept", F.lit(0))})
    return rows.withColumns({"complete": F.col("kept") >= F.col("target_evidence"), "covered": F.col("total_claims") > 0})


def fully_covered(cover: DataFrame) -> DataFrame:
    return cover.agg(F.coalesce(F.bool_and("covered"), F.lit(True)).alias("fully_covered"), F.count_if("covered").alias("n_covered"), F.count_if(~F.col("covered")).alias("n_missing"))


def contradictions(claims: DataFrame) -> DataFrame:
    """A row for each contradiction with its rank in its bucket: score falls, then claim order and
    place in the claim."""
    rows = claims.select(F.col("id").alias("claim_id"), F.col("ord").alias("claim_ord"), "text", F.posexplode("contradictions").alias("pos", "c"))
    rows = rows.select("claim_id", "claim_ord", "text", "pos", "c.*")
    rows = kept(rows).withColumn("row__", F.monotonically_increasing_id())
    # there are three buckets, so a window would sort each in one task; only keys are sorted, in parts of bounded size as in the join
    n = rows.count()
    places, _ = ranked(rows.select("row__", F.col("conflict_type").alias("type__"), "confidence_score", "claim_ord", "pos"), ["type__", F.desc("confidence_score"), "claim_ord", "pos"], "place__", n)
    first = places.groupBy("type__").agg(F.min("place__").alias("first__"))
    places = places.join(F.broadcast(first), "type__").select("row__", (F.col("place__") - F.col("first__") + 1).alias("rank"))
    return dealt(rows, "row__", n).join(dealt(places, "row__", n), "row__").drop("row__")


def sources(claims: DataFrame) -> DataFrame:
    """Each cited URL once, with the place where it is met first."""
    rows = claims.select(F.col("ord").alias("claim_ord"), F.posexplode("sources").alias("pos", "s"))
    return rows.where(F.col("s.url") != "").groupBy(F.col("s.url").alias("url")).agg(F.min(F.struct("claim_ord", "pos")).alias("first")).select("url", "first.claim_ord", "first.pos")


def contradiction_line():
    """Line of a contradiction row."""
    tail = F.filter(
        F.array(
            F.when(F.col("url") != "", F.concat(F.lit(SOURCE_OF), F.col("url"))),
            F.when(F.col("publication_date").isNotNull(), F.concat(F.lit(DATED), F.col("publication_date").cast("string"))),
            F.concat(F.lit(CONFIDENCE), F.format_string("%.2f", F.col("confidence_score"))),
            F.when(F.col("quote") != "", F.concat(F.lit('"'), F.trim("quote"), F.lit('"'))),
        ),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.lit(CLAIM), F.col("claim_id").cast("string"), F.lit("`: "), F.trim("text"), F.lit(" ("), F.array_join(tail, "; "), F.lit(")"))


def coverage_line():
    state = F.when(F.col("covered"), COVERED).otherwise(MISSING)
    return F.format_string(COVERAGE_LINE, F.col("id"), F.col("question"), state, F.col("total_claims"), F.col("kept"))


def document(subtopics: DataFrame, claims: DataFrame, body: str = "", title: str = "Research Report") -> DataFrame:
    """The report as lines (place, major, minor, line) to be sorted by the first three. Only the
    plan, a few subtopics of its own, passes the driver; contradictions and sources do not."""
    spark = claims.sparkSession
    cover = coverage(subtopics, claims).withColumn("line", coverage_line()).orderBy("ord").select("id", "line", "covered").collect()
    head = [f"# {title}", "", COVERAGE, "", *[r.line for r in cover]]
    if missing := [f"`{r.id}`" for r in cover if not r.covered]:
        head += ["", f"{GAP}{', '.join(missing)}"]
    head += ["", ""] + ([body.strip(), ""] if body.strip() else []) + [CONTRADICTIONS, "", GENUINE]
    kind = F.when(F.col("conflict_type") == "factual", 0).when(F.col("conflict_type") == "methodological", 1).otherwise(2)
    held = contradictions(claims).select(kind.alias("k"), F.col("rank").cast("long").alias("minor"), contradiction_line().alias("line"))
    found = sources(claims).select(F.col("claim_ord").cast("long").alias("major"), F.col("pos").cast("long").alias("minor"), F.concat(F.lit("- "), "url").alias("line"))
    some = {r[0] for r in held.select(F.col("k") < 2).distinct().collect()}
    fixed = [(0, x) for x in head] + ([] if True in some else [(1, NO_GENUINE)]) + [(2, x) for x in ("", DRIFT, DRIFT_NOTE if False in some else NO_DRIFT)]
    fixed += [(4, x) for x in ("", "", SOURCES, "")] + ([] if found.limit(1).count() else [(5, NO_SOURCES)])
    out = spark.createDataFrame([(p, 0, i, x) for i, (p, x) in enumerate(fixed)], "place int, major long, minor long, line string")
    place = F.when(F.col("k") < 2, 1).otherwise(3).alias("place")
    return out.unionByName(held.select(place, F.col("k").cast("long").alias("major"), "minor", "line")).unionByName(found.select(F.lit(5).alias("place"), "major", "minor", "line"))


def write_report(lines: DataFrame, path: str) -> None:
    """Lines of ``document`` as text files, which in order of their names are the report."""
    lines.orderBy("place", "major", "minor").select(F.coalesce("line", F.lit("")).alias("value")).write.text(path)


def render(subtopics: DataFrame, claims: DataFrame, body: str = "", title: str = "Research Report") -> str:
    """The report as one text of the driver, for a caller that wants no files; see ``write_report``."""
    lines = document(subtopics, claims, body, title).orderBy("place", "major", "minor").select("line")
    return "\n".join(r.line for r in lines.toLocalIterator()).rstrip() + "\n"


def report_lines(claims: DataFrame) -> DataFrame:
    """Lines of the appendix as rows (conflict_type, rank, line), for ledgers of any size."""
    return contradictions(claims).select("conflict_type", "rank", contradiction_line().alias("line"))


def missing_sections(draft, required: tuple[str, ...] = SECTIONS):
    """Sections that a draft (a column) lacks."""
    return F.filter(F.array(*[F.when(~F.contains(draft, F.lit(s)), F.lit(s)) for s in required]), lambda x: x.isNotNull())


def acceptance(claims: DataFrame) -> DataFrame:
    """Whether a ledger holds a flagged claim, an uncorroborated one, and temporal drift."""
    return claims.agg(
        F.coalesce(F.bool_or(F.col("status") == "flagged"), F.lit(False)).alias("has_flagged"),
        F.coalesce(F.bool_or(F.col("status") == "uncorroborated"), F.lit(False)).alias("has_uncorroborated"),
        F.coalesce(F.bool_or(F.exists("contradictions", lambda c: c["conflict_type"] == "temporal_drift")), F.lit(False)).alias("has_drift"),
    )


def drift_section_filled(draft):
    """True where a draft's section on drift holds more than its placeholder."""
    section = F.regexp_extract(draft, r"(?s)### Temporal Drift(.*?)(?:\n## |$)", 1)
    return F.contains(draft, F.lit(DRIFT)) & ~F.contains(section, F.lit(NO_DRIFT))


def plan_summary(plans: DataFrame) -> DataFrame:
    """Text of a plan for review."""
    lines = F.transform("subtopics", lambda s: F.format_string("  - [%s] %s (target_evidence=%d)", s["id"], s["question"], s["target_evidence"]))
    head = F.format_string("depth=%s  subtopics=%d  seed_urls=%d", F.col("depth"), F.size("subtopics"), F.size("seed_urls"))
    return plans.withColumn("summary", F.concat_ws("\n", F.lit(PLAN_HEAD), head, lines))


def draft_summary(draft):
    return F.concat(F.lit(f"{DRAFT_HEAD}\n("), F.length(draft).cast("string"), F.lit(" chars)"))


def url_list(urls: DataFrame) -> DataFrame:
    """Numbered lines of scored URLs for review: ``[i] score  etld1  url``."""
    numbered, _ = ranked(urls, ["ord", "url"], "n__")
    return numbered.select("ord", F.format_string("  [%d] %s  %s  %s", F.col("n__"), F.format_string("%.2f", F.col("score")), F.coalesce(F.nullif(F.col("etld1"), F.lit("")), F.lit("?")), F.col("url")).alias("line"))


def first_urls(urls: Column, n: int = 10) -> Column:
    """The first ``n`` of an ordered array of URLs, and a line that counts the others."""
    more = F.array(F.concat(F.lit("… and "), (F.size(urls) - n).cast("string"), F.lit(" more")))
    return F.when(F.size(urls) > n, F.concat(F.slice(urls, 1, n), more)).otherwise(urls)
