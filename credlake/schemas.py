"""Explicit schemas of the relational tables and exchange formats."""
from __future__ import annotations

# Allowed values of the enum columns.
SOURCE_TYPES = ["primary", "secondary", "fact_check", "social_media", "unknown"]
RELATIONS = ["supports", "contradicts", "neutral", "partially_supports", "partially_contradicts"]
INPUT_TYPES = ["url", "headline", "article", "claim"]

# DDL by table; keys are unique by convention, request_id is the foreign key.
TABLES = {
    "verification_requests": (
        "request_id string, input_type string, original_text string, input_url string, "
        "status string, created_at timestamp, completed_at timestamp"
    ),
    "claims": (
        "claim_id string, request_id string, text string, subject string, action string, "
        "object string, location string, date_time string, numerical_values string, "
        "entities string, category string, certainty_level string"
    ),
    "sources": (
        "source_id string, request_id string, url string, title string, domain string, "
        "source_type string, publisher string, author string, publication_date string, "
        "credibility_score double, is_independent boolean, original_source_id string"
    ),
    "evidence": (
        "evidence_id string, request_id string, claim_id string, source_id string, url string, "
        "title string, text string, relation string, confidence double, extraction_method string"
    ),
    "fact_checks": (
        "fact_check_id string, request_id string, organization string, claim_checked string, "
        "conclusion string, summary string, date string, url string"
    ),
    "media_items": (
        "media_id string, request_id string, media_type string, url string, caption string, "
        "is_reused boolean, reuse_evidence string"
    ),
    "verdicts": (
        "request_id string, verdict string, confidence double, evidence_strength string, "
        "explanation string, limitations string, supporting_evidence_count int, "
        "contradicting_evidence_count int, neutral_evidence_count int, created_at timestamp"
    ),
}

SEARCH_RESULT = "url string, title string, snippet string, source string, score double, published_date string"
REGISTRY_SOURCE = "name string, url string, country string, category string, language string, credibility string"

# The 14 columns of the headerless truth-label files.
TRUTH_COLUMNS = [
    "id", "label", "statement", "subject", "speaker", "job", "state", "party", "barely_true_ct",
    "false_ct", "half_true_ct", "mostly_true_ct", "pants_fire_ct", "context",
]
TRUTH_FAKE_LABELS = ["false", "pants-fire", "barely-true"]
