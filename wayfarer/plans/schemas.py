"""Logical tables as Spark DDL, and the closed value sets of their columns."""

from __future__ import annotations

DEFAULT_WORKSPACE = "00000000-0000-0000-0000-000000000000"
NOT_SET = "(not set)"

EVENTS = (
    "id string, workspace_id string, visitor_id string, session_id string, event_type string, event_name string, "
    "link_id string, click_id string, partner_id string, referral_link_id string, referral_click_id string, "
    "url string, host string, path string, referrer string, referrer_url string, source_platform string, "
    "source_medium string, source_campaign string, source map<string,string>, fingerprint string, ip_address string, "
    "user_agent string, device_type string, browser string, os string, browser_version string, os_version string, "
    "device_brand string, device_model string, bot_name string, amount_cents bigint, currency string, "
    "properties map<string,string>, connector_source_context string, inserted_at timestamp"
)
VISITORS = (
    "id string, workspace_id string, fingerprints array<string>, anonymous_ids array<string>, click_ids array<string>, "
    "ga_id string, person_external_id string, person_email string, person_phone string, person_name string, "
    "person_metadata map<string,string>, first_source map<string,string>, first_click_id string, first_partner_id string, "
    "first_referral_link_id string, first_referral_click_id string, first_seen_at timestamp, "
    "last_source map<string,string>, last_click_id string, last_partner_id string, last_referral_link_id string, "
    "last_referral_click_id string, last_seen_at timestamp, attribution_path array<map<string,string>>, "
    "click_id_params map<string,string>, connector_identifiers map<string,string>, geo map<string,string>, "
    "device map<string,string>, total_sessions int, total_pageviews int, total_events int, total_time_seconds int, "
    "avg_scroll_depth decimal(38,18), top_pages array<map<string,string>>, lead_quality_score decimal(38,18), "
    "fraud_risk_score decimal(38,18), status string, merged_into_id string, identified_at timestamp, "
    "converted_at timestamp, ltv_cents bigint, inserted_at timestamp, updated_at timestamp"
)
SESSIONS = (
    "id string, workspace_id string, visitor_id string, anonymous_id string, started_at timestamp, last_event_at timestamp, "
    "entry_url string, entry_page string, exit_page string, pageviews int, events int, duration_seconds int, "
    "engaged_seconds int, is_bounce boolean, is_engaged boolean, source_platform string, source_medium string, "
    "source_campaign string, click_id string, device_type string, browser string, os string, "
    "inserted_at timestamp, updated_at timestamp"
)
LINKS = (
    "id string, workspace_id string, domain string, key string, url string, link_type string, partner_id string, "
    "utm_source string, utm_medium string, utm_campaign string, utm_content string, utm_term string, "
    "password_hash string, expires_at timestamp, ios_url string, android_url string, geo_targeting map<string,string>, "
    "og_title string, og_description string, og_image string, total_clicks int, unique_clicks int, total_leads int, "
    "total_sales int, total_revenue_cents bigint, tags array<string>, external_id string, metadata map<string,string>, "
    "archived_at timestamp, inserted_at timestamp, updated_at timestamp"
)
PARTNERS = (
    "id string, workspace_id string, key string, name string, status string, external_id string, "
    "metadata map<string,string>, archived_at timestamp, inserted_at timestamp, updated_at timestamp"
)
DISPATCHES = (
    "id string, workspace_id string, connector_type string, connector_event_id string, event_id string, "
    "event_inserted_at timestamp, visitor_id string, payload_snapshot string, source_context string, status string, "
    "attempts int, max_attempts int, last_attempted_at timestamp, next_retry_at timestamp, response_status int, "
    "response_body string, error_type string, error_message string, replayed_from_id string, replayed_at timestamp, "
    "inserted_at timestamp, updated_at timestamp"
)
FUNNELS = "id string, workspace_id string, name string, definition string, archived_at timestamp, inserted_at timestamp, updated_at timestamp"
SETTINGS = "workspace_id string, key string, value string, updated_at timestamp"

#: Fixed values.
EVENT_TYPES = ("link_click", "pageview", "session_start", "identify", "lead", "sale", "share", "engagement", "custom", "api_request")
INGEST_TYPES = EVENT_TYPES[:-1]
INTERACTIVE_TYPES = ("link_click", "identify", "lead", "sale", "share", "custom")
CONVERSION_TYPES = ("lead", "sale")
MAX_SOURCE_CHARS = 255
