"""Column functions of the evidence policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.config import BUDGETS, DEFAULT, TARGETS, Config

from .values import month_gap


def independent(etld_a: Column, etld_b: Column, cosine: Column, config: Config = DEFAULT) -> Column:
    """Two sources of different publishers and different contents. Without both publishers only
    the contents count."""
    apart = cosine < config.mirror_cosine
    known = (etld_a != "") & (etld_b != "")
    return F.when(known & (etld_a == etld_b), F.lit(False)).otherwise(apart)


def independent_count(sources: Column, cosine=None, config: Config = DEFAULT) -> Column:
    """Size of the set that grows, in order, by each source independent of all in it.
    ``cosine(a, b)`` gives the likeness of two sources; none means 0, and the set is then one source
    of each publisher and all without one, which takes a pass instead of a comparison of each with all taken."""
    if cosine is None and config.mirror_cosine > 0:
        known = F.filter(F.transform(sources, lambda s: s["etld1"]), lambda e: e != "")
        return F.size(sources) - F.size(known) + F.size(F.array_distinct(known))
    near = cosine or (lambda a, b: F.lit(0.0))

    def grow(taken: Column, s: Column) -> Column:
        free = F.forall(taken, lambda t: independent(s["etld1"], t["etld1"], near(s, t), config))
        return F.when(free, F.concat(taken, F.array(s))).otherwise(taken)

    return F.size(F.aggregate(sources, F.slice(sources, 1, 0), grow))


def disputed(sources: Column, contradictions: Column, cosine=None, config: Config = DEFAULT) -> Column:
    """Whether a contradiction is independent of a source; without ``cosine`` none is only where all of both
    are of one known publisher."""
    if cosine is None and config.mirror_cosine > 0:
        names = F.transform(F.concat(*[F.transform(x, lambda s: s["etld1"]) for x in (sources, contradictions)]), lambda e: F.coalesce(e, F.lit("")))
        one = ~F.array_contains(names, "") & (F.size(F.array_distinct(names)) == 1)
        return (F.size(contradictions) > 0) & (F.size(sources) > 0) & ~one
    near = cosine or (lambda a, b: F.lit(0.0))
    return F.exists(contradictions, lambda c: F.exists(sources, lambda s: independent(c["etld1"], s["etld1"], near(c, s), config)))


def claim_status(sources: Column, contradictions: Column, cosine=None, config: Config = DEFAULT) -> Column:
    return F.when(disputed(sources, contradictions, cosine, config), "flagged").when(independent_count(sources, cosine, config) >= 2, "kept").otherwise("uncorroborated")


def contradiction_score(etld_s: Column, date_s: Column, etld_c: Column, date_c: Column, cosine: Column, method: Column, config: Config = DEFAULT) -> Column:
    """Confidence in a contradiction: a third each for independence, recency and method."""
    third, limit = 1.0 / 3.0, config.mirror_cosine
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    distinct = unit((limit - cosine) / limit) if limit > 0 else F.lit(1.0)
    same = (etld_s != "") & (etld_c != "") & (etld_s == etld_c)
    one = F.when(same, 0.0).otherwise(distinct * third)
    gap, drift, recent = month_gap(date_s, date_c), max(1, config.drift_months), config.recent_months
    fading = (1.0 - (gap - recent) / (drift - recent)) * third if drift > recent else F.lit(0.0)
    two = F.when(date_s.isNull() | date_c.isNull(), 0.0).when(gap < recent, third).when(gap >= drift, 0.0).otherwise(fading)
    return unit(one + two + unit(method) * third)


def conflict_type(date_s: Column, date_c: Column, methodological: Column, config: Config = DEFAULT) -> Column:
    drift = date_s.isNotNull() & date_c.isNotNull() & (month_gap(date_s, date_c) >= config.drift_months)
    return F.when(drift, "temporal_drift").when(methodological, "methodological").otherwise("factual")


def conflict_label(date_s: Column, date_c: Column, config: Config = DEFAULT) -> Column:
    """What a contradiction says of a claim's age: uncertain, current, dated or nothing."""
    drift = month_gap(date_s, date_c) >= config.drift_months
    return F.when(date_s.isNull() | date_c.isNull(), "uncertain").when(drift & (date_s >= date_c), "current").when(drift, "dated")


def label_fold(labels: Column) -> Column:
    """The last current or dated of the labels; else uncertain if there is any; else null."""
    firm = F.filter(labels, lambda x: x.isin("current", "dated"))
    return F.when(F.size(firm) > 0, F.try_element_at(firm, F.lit(-1))).when(F.exists(labels, lambda x: F.coalesce(x == "uncertain", F.lit(False))), "uncertain")


def budget(depth: Column, config: Config = DEFAULT) -> Column:
    table = F.create_map(*[F.lit(x) for p in BUDGETS.items() for x in p])
    return F.coalesce(F.try_element_at(table, depth), F.lit(config.fallback_budget))


def target(depth: Column) -> Column:
    table = F.create_map(*[F.lit(x) for p in TARGETS.items() for x in p])
    return F.try_element_at(table, depth)


def with_targets(subtopics: Column, depth: Column) -> Column:
    """Every subtopic's evidence target set by depth; an unknown depth leaves them."""
    return F.transform(subtopics, lambda s: s.withField("target_evidence", F.coalesce(target(depth), s["target_evidence"])))


def stop(kept: Column, target_: Column, iteration: Column, new_claims: Column, budget_: Column, config: Config = DEFAULT) -> Column:
    return (kept >= target_) | (iteration >= budget_) | ((iteration >= 1) & (new_claims < config.min_new_claims))


def next_phase(phase: Column, depth: Column) -> Column:
    """Phase that follows within a pass, or null at its end."""
    return F.when(phase == "acquire", F.when(depth == "deep", "mid_acquire").otherwise("extract")).when(phase == "mid_acquire", "extract").when(phase == "extract", "verify")


def citation_gate(source_classes: Column, depth: Column) -> Column:
    return F.array_contains(source_classes, "academic") & (depth == "deep")


def retryable(status: Column, success: Column) -> Column:
    return F.coalesce(status == 429, F.lit(False)) | (~success & (status.isNull() | status.between(500, 599)))
