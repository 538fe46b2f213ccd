"""JSON in model output: first value in noisy text, typed records with defaults, retries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import schemas


#: A text whose brackets are open deeper has no value: parsers end somewhere, and a scan that begins
#: again at each bracket reads a text at most so many times.
MAX_DEPTH = 500


def depth_of(text: str) -> int:
    """Most brackets that are open at once, those in strings included."""
    most = now = 0
    for m in re.finditer(r"[\[\]{}]", text):
        now = now + 1 if m[0] in "[{" else max(now - 1, 0)
        most = max(most, now)
    return most


def first_value(text: str | None) -> str | None:
    """The text itself if it is JSON; else the first complete object or list in it, as JSON; null where
    brackets are open deeper than ``MAX_DEPTH``."""
    if text is None:
        return None
    text = text.strip()
    if depth_of(text) > MAX_DEPTH:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return json.dumps(decoder.raw_decode(text, m.start())[0], ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def _scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(first_value, na_action="ignore")


def first_json(text: Column) -> Column:
    """First JSON value of a text, or null. SQL has no scanner that stops at the end of a value, so
    this one function is Python, by Arrow batches."""
    return _scan(text)


def has_json(text: Column) -> Column:
    return first_json(text).isNotNull()


def outermost(text: Column) -> Column:
    """The text if it is JSON; else what stands from its first brace to its last."""
    strict = F.try_parse_json(text)
    return F.when(strict.isNotNull(), text).otherwise(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


def with_retry(first: Column, second: Column, empty: str) -> Column:
    """First JSON of a reply, else that of the second try, else the empty value."""
    return F.coalesce(first_json(first), first_json(second), F.lit(empty))


def ledger(text: Column) -> Column:
    """Claims of a ledger in JSON; contradictions of older ledgers get their defaults."""
    parsed = F.from_json(text, schemas.LEDGER)["claims"]

    def whole(c: Column) -> Column:
        contradictions = F.transform(
            c["contradictions"],
            lambda x: x.withField("confidence_score", F.coalesce(x["confidence_score"], F.lit(0.0))).withField("conflict_type", F.coalesce(x["conflict_type"], F.lit("factual"))).withField("etld1", F.coalesce(x["etld1"], F.lit(""))).withField("quote", F.coalesce(x["quote"], F.lit(""))),
        )
        sources = F.transform(c["sources"], lambda x: x.withField("etld1", F.coalesce(x["etld1"], F.lit(""))).withField("quote", F.coalesce(x["quote"], F.lit(""))))
        return c.withField("contradictions", F.coalesce(contradictions, F.slice(c["contradictions"], 1, 0))).withField("sources", F.coalesce(sources, F.slice(c["sources"], 1, 0)))

    return F.transform(parsed, whole)


def scored_urls(text: Column) -> Column:
    """Scored URLs of a JSON list or single object, with defaults."""
    kind = "array<struct<url:string,query:string,score:double,strategy:string,source:string,also_in:array<string>,etld1:string,publication_date:date,citation_refs:array<string>>>"
    many = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    empty = F.array().cast("array<string>")

    def whole(u: Column) -> Column:
        for name in ("query", "source", "etld1"):
            u = u.withField(name, F.coalesce(u[name], F.lit("")))
        return u.withField("also_in", F.coalesce(u["also_in"], empty)).withField("citation_refs", F.coalesce(u["citation_refs"], empty))

    return F.transform(F.from_json(many, kind), whole)


def plan(text: Column) -> Column:
    """A plan in JSON with its defaults; null if it breaks a bound."""
    p = F.from_json(text, schemas.PLAN)
    p = p.withField("depth", F.coalesce(p["depth"], F.lit("normal"))).withField("est_iterations", F.coalesce(p["est_iterations"], F.lit(1)))
    fine = p["subtopics"].isNotNull() & F.forall(p["subtopics"], lambda s: F.coalesce(s["target_evidence"] >= 1, F.lit(False))) & (p["est_iterations"] >= 1)
    return F.when(fine, p)


def clarified(text: Column) -> Column:
    """A clarifier's reply: status lower-cased, no questions once clear, null if it asks nothing
    though it needs input."""
    c = F.from_json(outermost(text), schemas.CLARIFIED)
    questions = F.coalesce(F.filter(c["questions"], lambda q: F.trim(q) != ""), F.array().cast("array<string>"))
    status = F.regexp_replace(F.lower(F.trim(c["status"])), r"[\s-]+", "_")
    clear = status == "clear"
    out = F.struct(status.alias("status"), c["normalized_query"].alias("normalized_query"), F.when(clear, F.slice(questions, 1, 0)).otherwise(questions).alias("questions"))
    return F.when(clear | ((status == "needs_input") & (F.size(questions) > 0)), out)
