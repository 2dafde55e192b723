"""Table schemas and row checks.  Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R

SCHEMAS = {
    "sources": "id string, kind string, detail string, created_at timestamp",
    "captures_raw": "capture_id string, source_id string, input_type string, raw_text string, occurred_at timestamp, "
    "sensitivity string, pii_score double, status string, parsed_note_id string, parsed_task_id string, "
    "created_at timestamp, updated_at timestamp",
    "notes": "note_id string, source_capture_id string, note_type string, title string, summary string, body string, "
    "occurred_at string, journal_date string, mood_score int, energy_score int, source_url string, source_id string, "
    "sensitivity string, review_status string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "tasks": "task_id string, source_capture_id string, source_note_id string, title string, details string, status string, "
    "priority int, due_at string, scheduled_at string, done_at string, source string, sensitivity string, "
    "created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "key_facts": "fact_id string, note_id string, task_id string, subject string, predicate string, object_text string, "
    "object_type string, object_json string, evidence_excerpt string, occurred_at string, confidence double, "
    "sensitivity string, extractor_version string, updated_at timestamp, deleted_at timestamp",
    "app_entries": "entry_id string, declared_type string, title string, body string, tags array<string>, occurred_at timestamp, "
    "sensitivity string, payload string, analysis_state string, latest_analysis_job_id string, created_at timestamp, updated_at timestamp",
    "app_history": "id string, entry_id string, source string, before_json string, after_json string, created_at timestamp",
    "fact_documents": "document_id string, entry_id string, capture_id string, declared_type string, raw_text string, "
    "occurred_at_utc timestamp, sensitivity string, pii_score double, redaction_state string, language string, "
    "normalized_text string, token_count int, analysis_state string, created_at timestamp, updated_at timestamp",
    "fact_entities": "entity_id string, entity_type string, canonical_name string, created_at timestamp",
    "fact_entity_aliases": "entity_id string, alias string, normalized_alias string",
    "fact_claims": "claim_id string, document_id string, entry_id string, extraction_id string, subject_text string, "
    "subject_entity_id string, predicate string, object_text_raw string, object_text_canonical string, object_entity_id string, "
    "me_role string, modality string, polarity string, certainty double, quality_score double, quality_flags array<string>, "
    "time_start_utc timestamp, time_end_utc timestamp, status string, supersedes_claim_id string, extractor_version string, "
    "revision_note string, created_at timestamp, updated_at timestamp, deleted_at timestamp",
    "fact_evidence_spans": "claim_id string, document_id string, char_start int, char_end int, excerpt string, created_at timestamp",
    "fact_claim_links": "from_claim_id string, to_claim_id string, relation_type string, confidence double, created_at timestamp",
    "fact_claim_dimensions": "claim_id string, dimension_type string, dimension_value string, normalized_value string, "
    "confidence double, source string, created_at timestamp",
    "fact_claim_feedback": "claim_id string, action string, before_json string, after_json string, actor string, created_at timestamp",
    "fact_rollups": "scope_type string, scope_key string, period_type string, period_start timestamp, period_end timestamp, "
    "summary_text string, key_claim_ids array<string>, generated_by_model string, created_at timestamp, updated_at timestamp",
    "fact_extraction_jobs": "job_id string, status string, requested_by string, requested_at timestamp, total_items int, "
    "succeeded_items int, failed_items int, error_summary string",
    "fact_extraction_job_items": "item_id string, job_id string, entry_id string, status string, attempt_count int, "
    "claims_inserted int, last_error string, next_retry_at timestamp, created_at timestamp, updated_at timestamp",
    "fact_extractions": "extraction_id string, job_item_id string, document_id string, entry_id string, model string, "
    "schema_version string, status string, created_at timestamp",
    "fact_analysis_artifacts": "extraction_id string, artifact_type string, sha256 string, metadata_json string, expires_at timestamp",
    "api_requests": "request_id string, request_started_at timestamp, request_finished_at timestamp, status string, "
    "environment string, endpoint string, model string, operation string, workflow string, source_ref_type string, "
    "source_ref_id string, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, reasoning_output_tokens bigint, "
    "total_tokens bigint, request_cost_usd decimal(12,6), error_type string, error_message string, created_at timestamp",
}


def _in(column: str, values: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# row checks: a name and a condition that must not be false
CHECKS = {
    "captures_raw": {"pii_range": "pii_score BETWEEN 0 AND 1", "sensitivity": _in("sensitivity", R.SENSITIVITY_LEVELS)},
    "notes": {
        "note_type": _in("note_type", R.NOTE_LABELS),
        "mood_range": "mood_score BETWEEN 1 AND 5",
        "energy_range": "energy_score BETWEEN 1 AND 5",
    },
    "tasks": {"priority_range": "priority BETWEEN 1 AND 4"},
    "key_facts": {
        "one_owner": "(note_id IS NULL) <> (task_id IS NULL)",
        "object_type": _in("object_type", R.OBJECT_TYPES),
        "confidence_range": "confidence BETWEEN 0 AND 1",
    },
    "app_entries": {
        "declared_type": _in("declared_type", R.ENTRY_TYPES),
        "sensitivity": _in("sensitivity", R.SENSITIVITY_LEVELS),
        "analysis_state": _in("analysis_state", R.ENTRY_STATES),
    },
    "fact_claims": {
        "modality": _in("modality", R.MODALITIES),
        "polarity": _in("polarity", R.POLARITIES),
        "me_role": _in("me_role", R.ME_ROLES),
        "status": _in("status", R.CLAIM_STATUSES),
        "certainty_range": "certainty BETWEEN 0 AND 1",
    },
    "fact_evidence_spans": {
        "offsets": "(char_start IS NULL AND char_end IS NULL) OR coalesce(char_start >= 0 AND char_end > char_start, false)"
    },
    "fact_claim_links": {"relation": _in("relation_type", R.RELATIONS)},
    "fact_claim_dimensions": {"type": _in("dimension_type", R.DIMENSION_TYPES), "source": _in("source", R.DIMENSION_SOURCES)},
    "fact_claim_feedback": {"action": _in("action", R.FEEDBACK_ACTIONS)},
    "fact_rollups": {"scope": _in("scope_type", R.ROLLUP_SCOPES), "period": _in("period_type", R.ROLLUP_PERIODS)},
    "fact_extraction_job_items": {"status": _in("status", R.ITEM_STATUSES)},
    "api_requests": {
        "status": _in("status", R.REQUEST_STATUSES),
        "tokens": "input_tokens >= 0 AND cached_input_tokens >= 0 AND output_tokens >= 0",
        "finish": "request_finished_at >= request_started_at",
    },
}
# unique keys; rows with a deleted_at count only while it is null
UNIQUE = {
    "notes": ["source_capture_id"],
    "tasks": ["source_capture_id"],
    "key_facts": ["note_id", "task_id", "subject", "predicate", "object_text"],
    "fact_documents": ["entry_id"],
    "fact_entities": ["entity_type", "canonical_name"],
    "fact_entity_aliases": ["entity_id", "normalized_alias"],
    "fact_claim_links": ["from_claim_id", "to_claim_id", "relation_type"],
    "fact_claim_dimensions": ["claim_id", "dimension_type", "normalized_value", "source"],
    "fact_rollups": ["scope_type", "scope_key", "period_type", "period_start", "period_end"],
    "fact_extraction_job_items": ["job_id", "entry_id"],
}


def validate(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``broken``: the failed checks)."""
    tests = [
        F.when(~F.coalesce(F.expr(condition), F.lit(True)), F.lit(check)) for check, condition in CHECKS.get(name, {}).items()
    ]
    broken = F.filter(F.array(*tests), lambda t: t.isNotNull()) if tests else F.array().cast("array<string>")
    checked = df.withColumn("broken", broken)
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)


def duplicate_keys(df: DataFrame, name: str) -> DataFrame:
    """Unique keys that occur more than once, with their count."""
    live = df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df
    return live.groupBy(*UNIQUE[name]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
