"""Schemas of the canonical tables."""

from __future__ import annotations

SIGNALS = "recording_id string, band string, channel_idx int, channel string, t int, v double"
EVENTS = "recording_id string, event_idx int, onset bigint, code int, label string, subject string"
RECORDINGS = "recording_id string, source_format string, source_path string, sampling_rate double, n_channels int, n_samples bigint, channel_names array<string>, event_id_map map<int,string>"
CHUNKS = "chunk_id string, document_id string, source string, title string, ord int, content string, enabled boolean, headers map<string,string>"
TEXTS = "path string, suffix string, modified timestamp, size bigint, text string"

# The metadata tables.
PROJECTS = "id string, name string, created_at timestamp, updated_at timestamp, metadata_json string"
SETTINGS = "key string, value string, updated_at timestamp"
DATASETS = "id string, name string, filename string, path string, suffix string, summary_json string, created_at timestamp, updated_at timestamp"
EXPERIMENTS = "id string, name string, dataset_id string, config_json string, status string, result_json string, explanation_json string, report_path string, created_at timestamp, updated_at timestamp"
JOBS = "id string, kind string, status string, progress double, message string, payload_json string, result_json string, error string, logs_json string, created_at timestamp, updated_at timestamp"
CHAT_SESSIONS = "id string, title string, messages_json string, steps_json string, created_at timestamp, updated_at timestamp"
