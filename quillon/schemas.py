"""Record types of tables and artifacts, domains of their codes, and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOMAINS = {
    "depth": ("shallow", "normal", "deep"),
    "source_class": ("web", "academic", "code", "seed"),
    "strategy": ("adaptive_crawl", "deep_crawl", "crawl_url", "skip"),
    "claim_status": ("kept", "uncorroborated", "flagged"),
    "conflict_type": ("factual", "methodological", "temporal_drift"),
    "temporal_status": ("current", "dated", "uncertain"),
}

SESSIONS = "id string, query string, strategy string, created_at timestamp, metadata string"
PAGES = (
    "id string, session_id string, url string, title string, raw_markdown string, fit_markdown string, word_count int, fit_word_count int, "
    "strategy string, total_score double, status_code int, success boolean, error string, crawled_at timestamp, metadata string, duplicate_of string"
)
LINKS = "page_id string, href string, text string, link_type string, intrinsic_score double, contextual_score double, total_score double"
CHUNKS = "id string, page_id string, chunk_index int, chunk_text string, token_count int, chroma_doc_id string, etld1 string, created_at timestamp"

SOURCE_REF = "url string, etld1 string, quote string, publication_date date"
CONTRADICTION = f"{SOURCE_REF}, confidence_score double, conflict_type string"
CLAIM = f"id string, subtopic_id string, text string, status string, temporal_status string, sources array<struct<{SOURCE_REF.replace(' ', ':').replace(',:', ', ')}>>, contradictions array<struct<{CONTRADICTION.replace(' ', ':').replace(',:', ', ')}>>"
LEDGER = f"claims array<struct<{CLAIM.replace(' string', ':string').replace(' array', ':array')}>>"
SCORED_URL = "url string, query string, score double, strategy string, source string, also_in array<string>, etld1 string, publication_date date, citation_refs array<string>"
SUBTOPIC = "id string, question string, target_evidence int, source_classes array<string>"
PLAN = "subtopics array<struct<id:string, question:string, target_evidence:int, source_classes:array<string>>>, depth string, seed_urls array<string>, est_iterations int"
STAGE = "session_id string, raw_query string, normalized_query string, stage string, current_subtopic_id string, iteration int, updated_at string"
CLARIFIED = "status string, normalized_query string, questions array<string>"


def parsed(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def migrated(df: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` with every column of ``schema``: those it lacks are added with a default or null,
    those it has keep their place in the schema; further columns follow."""
    defaults = defaults or {}
    want = parsed(schema)
    out = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in want]
    return df.select(*out, *[c for c in df.columns if c not in want.names])


def in_domain(column: str, domain: str):
    """True where a code is null or belongs to its domain."""
    return F.col(column).isNull() | F.col(column).isin(*DOMAINS[domain])


def check_bounds(target="target_evidence", iterations="est_iterations", confidence="confidence_score") -> dict:
    """Conditions that records must meet, by name."""
    return {
        "target_evidence": F.col(target) >= 1,
        "est_iterations": F.col(iterations) >= 1,
        "confidence": F.col(confidence).between(0, 1),
    }
