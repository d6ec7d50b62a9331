"""Declared schemas of the pipeline's tables."""

from __future__ import annotations

SOURCES = (
    "id bigint, domain string, name string, tier int, is_official boolean, lang string, "
    "fetch_policy_json string, enabled boolean"
)
FETCH_ATTEMPTS = (
    "source_id bigint, url string, status_code int, error_class string, latency_ms int, bytes int, "
    "attempted_at timestamp, pool string, snapshot_hash string"
)
SNAPSHOTS = "url string, fetched_at timestamp, snapshot_hash string"
DOCUMENTS = (
    "doc_id bigint, source_id bigint, url string, title string, clean_text string, content_hash string, "
    "body_hash string, version_no int, seen_at timestamp"
)
DOC_ANCHORS = (
    "doc_id bigint, anchor_no int, anchor_type string, anchor_value string, evidence_ptr string, confidence double"
)
FEATURES = (
    "doc_id bigint, evidence_score double, anchors_count bigint, has_official_domain boolean, has_pdf boolean, "
    "money_count bigint, has_table_like boolean"
)
EVENT_SCORES = (
    "event_id bigint, breaking_score double, gap_score double, "
    "reasons struct<breaking:array<string>,gap:array<string>>, computed_at timestamp"
)
EVENT_DOCS = "event_id bigint, doc_id bigint, source_id bigint, seen_at timestamp, is_primary boolean"
EVENTS = (
    "event_id bigint, canonical_event_id bigint, status string, summary string, lane string, "
    "breaking_score double, first_seen_at timestamp, last_seen_at timestamp, created_at timestamp"
)
EVENT_STATE = "event_id bigint, status string, status_reason string, updated_at timestamp"
ALERT_STATE = "event_id bigint, alert_hash string, last_alert_at timestamp, cooldown_until timestamp"
MERGE_AUDIT = (
    "from_event_id bigint, to_event_id bigint, reason_code string, evidence_json string, created_at timestamp"
)
FEEDBACK = "event_id bigint, action string, actor string, payload_json string, created_at timestamp"

# Shape of the JSON policy column of a source.
SOURCE_POLICY = (
    "source_id string, source_domain string, tier int, is_official boolean, lang string, pool string, "
    "strategy string, endpoints map<string,string>, headers map<string,string>, "
    "cadence struct<cron:string, interval_seconds:int>, "
    "limits struct<rate_limit_req_per_min:int, concurrency_per_domain:int, timeout_seconds:int, max_bytes:bigint>, "
    "observability struct<starvation_window_hours:int, yield_keys:array<string>, baseline_rolling:boolean, "
    "calendar_profile:string>"
)

# Feed bodies: the parts of RSS and Atom documents that ingest reads.
RSS_BODY = (
    "channel struct<item:array<struct<title:string, link:string, description:string, summary:string>>>"
)
ATOM_BODY = "entry array<struct<title:string, link:struct<_href:string>, summary:string>>"
