"""Schemas of the evidence tables (DDL) and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVIDENCE = "id string, case_id string, role string, filename string, stored_path string, media_type string, mime_type string, size_bytes long, sha256 string, ingested_at timestamp, width int, height int, image_format string, phash string, dhash string, ahash string, source_id string, parent_id string, generation int, platform string, observed_at timestamp, transformation string, is_synthetic boolean, acquisition_context string, indexed boolean"
CASES = "id string, case_number string, title string, description string, examiner string, status string, priority string, complaint_reference string, created_at timestamp, updated_at timestamp"
ANALYSIS = "id string, case_id string, evidence_id string, kind string, status string, score double, verdict string, model string, model_version string, payload string, created_at timestamp"
MATCHES = "id string, case_id string, query_evidence_id string, candidate_evidence_id string, phash_distance int, dhash_distance int, distance int, similarity double, confidence_band string, rank int, method string, created_at timestamp"
AUDIT = "seq long, audit_id string, case_id string, event string, timestamp string, actor string, details string, previous_hash string, row_hash string"
TIMELINE = "id string, case_id string, evidence_id string, event_type string, occurred_at timestamp, platform string, generation int, description string"
SIGNALS = "evidence_id string, media_type string, signal_id string, score double, status string, role string, execution_status string"


def migrated(rows: DataFrame, ddl: str, defaults: dict | None = None) -> DataFrame:
    """The rows with every column of ``ddl``: missing ones are added with their default, extra ones kept, none retyped."""
    out = rows
    for field in StructType.fromDDL(ddl):
        if field.name not in rows.columns:
            out = out.withColumn(field.name, F.lit((defaults or {}).get(field.name)).cast(field.dataType))
    return out
