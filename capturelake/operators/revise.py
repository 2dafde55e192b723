"""Claim revisions and one-off backfills, as snapshot transforms."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.pii import redaction_state
from capturelake.functions.rx import blank_to_null
from capturelake.functions.rules import ENTRY_TYPES
from capturelake.functions.scalars import at, legacy_ts

from .jobs import map_entry_state
from .merge import insert_ignore, latest_per_key, stable_id, top_per_key


def _replaced(df: DataFrame, changed: dict) -> DataFrame:
    return df.select(*[changed.get(c, F.col(c)).alias(c) for c in df.columns])


def before_image(claims: DataFrame) -> Column:
    """A claim's whole row as it was, nulls too, for the feedback that changes it."""
    return F.to_json(F.struct(*[F.col(c) for c in claims.columns]), {"ignoreNullFields": "false"})


def revise_claims(claims: DataFrame, revisions: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(claim snapshot, feedback rows) after a batch of revisions.

    ``revisions`` has claim_id, object_text_canonical and revision_note; one
    per claim, for active claims; of several, the smallest text, then note.
    The old row is closed and a successor is
    added; the claims are joined once and the pair comes from one explode.
    """
    order = [F.asc("object_text_canonical"), F.asc("revision_note")]
    wanted = top_per_key(revisions, ["claim_id"], order).select(
        "claim_id", F.col("object_text_canonical").alias("_text"), F.col("revision_note").alias("_note"), F.lit(True).alias("_hit")
    )
    joined = claims.join(wanted, "claim_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("deleted_at").isNull()
    next_id = stable_id(F.lit("revision"), "claim_id", "_text")
    sides = joined.withColumn("_next", F.explode(F.when(hit, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    successor = F.col("_next")
    closed = hit & ~successor
    now = at(as_of)
    changed = {
        "claim_id": F.when(successor, next_id).otherwise(F.col("claim_id")),
        "object_text_canonical": F.when(successor, F.col("_text")).otherwise(F.col("object_text_canonical")),
        "status": F.when(closed, "superseded").when(successor, "active").otherwise(F.col("status")),
        "supersedes_claim_id": F.when(successor, F.col("claim_id")).otherwise(F.col("supersedes_claim_id")),
        "revision_note": F.when(successor, F.col("_note")).otherwise(F.col("revision_note")),
        "created_at": F.when(successor, now).otherwise(F.col("created_at")),
        "updated_at": F.when(closed | successor, now).otherwise(F.col("updated_at")),
        "deleted_at": F.when(closed, now).when(successor, F.lit(None)).otherwise(F.col("deleted_at")),
    }
    snapshot = sides.select(*[changed.get(c, F.col(c)).alias(c) for c in claims.columns])
    active = claims.where(F.col("deleted_at").isNull()).join(wanted, "claim_id")
    rows = F.array(
        F.struct(
            F.col("claim_id").alias("claim_id"),
            F.lit("supersede").alias("action"),
            before_image(claims).alias("before_json"),
            F.to_json(F.struct(next_id.alias("supersededBy"), now.alias("at"))).alias("after_json"),
        ),
        F.when(
            blank_to_null("_note").isNotNull(),
            F.struct(
                next_id.alias("claim_id"),
                F.lit("revise").alias("action"),
                F.to_json(F.struct(F.col("claim_id").alias("id"))).alias("before_json"),
                F.to_json(F.struct(F.col("_note").alias("revisionNote"))).alias("after_json"),
            ),
        ),
    )
    feedback = active.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("f")).select(
        "f.*", F.lit("user").alias("actor"), now.alias("created_at")
    )
    return snapshot, feedback


def retract_claims(claims: DataFrame, retractions: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(claim snapshot, feedback rows); retracted claims stay searchable.

    Of several retractions of a claim, the smallest reason counts.
    """
    wanted = top_per_key(retractions, ["claim_id"], [F.asc("reason")]).select("claim_id", F.col("reason").alias("_reason"), F.lit(True).alias("_hit"))
    joined = claims.join(wanted, "claim_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("deleted_at").isNull()
    changed = {
        "status": F.when(hit, "retracted").otherwise(F.col("status")),
        "revision_note": F.when(hit, F.coalesce("_reason", "revision_note")).otherwise(F.col("revision_note")),
        "updated_at": F.when(hit, at(as_of)).otherwise(F.col("updated_at")),
    }
    snapshot = joined.select(*[changed.get(c, F.col(c)).alias(c) for c in claims.columns])
    feedback = claims.where(F.col("deleted_at").isNull()).join(wanted, "claim_id").select(
        "claim_id",
        F.lit("retract").alias("action"),
        before_image(claims).alias("before_json"),
        F.to_json(F.struct(F.col("_reason").alias("reason")), {"ignoreNullFields": "false"}).alias("after_json"),
        F.lit("user").alias("actor"),
        at(as_of).alias("created_at"),
    )
    return snapshot, feedback


# --- backfills ----------------------------------------------------------------


def backfill_documents(entries: DataFrame, captures: DataFrame, docs: DataFrame) -> DataFrame:
    """Document rows to add for entries, from their latest capture."""
    latest = latest_per_key(captures, ["capture_id"], ["created_at"]).select(
        F.col("capture_id").alias("entry_id"),
        F.col("capture_id"),
        F.col("raw_text").alias("_raw"),
        F.col("pii_score").alias("_pii"),
    )
    known = entries.where(F.col("declared_type").isin(*ENTRY_TYPES))
    score = F.greatest(F.coalesce("_pii", F.lit(0.0)), F.lit(0.0))
    rows = known.join(latest, "entry_id", "left").select(
        F.col("entry_id").alias("document_id"),
        "entry_id",
        "capture_id",
        "declared_type",
        F.coalesce("_raw", "body", F.lit("")).alias("raw_text"),
        F.col("occurred_at").alias("occurred_at_utc"),
        "sensitivity",
        score.alias("pii_score"),
        redaction_state(score).alias("redaction_state"),
    )
    return insert_ignore(docs, rows, ["document_id"])


def _owned_facts(facts: DataFrame, notes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Active facts with the capture of their note or task.

    Notes and tasks are one keyed frame, so there is one join on the owner
    and no null key.
    """
    owners = notes.select(F.lit("note").alias("_kind"), F.col("note_id").alias("_owner"), "source_capture_id").unionByName(
        tasks.select(F.lit("task").alias("_kind"), F.col("task_id").alias("_owner"), "source_capture_id")
    )
    keyed = facts.where(F.col("deleted_at").isNull()).select(
        "*",
        F.when(F.col("note_id").isNotNull(), "note").otherwise("task").alias("_kind"),
        F.coalesce("note_id", "task_id").alias("_owner"),
    )
    owned = keyed.join(owners.where(F.col("source_capture_id").isNotNull()), ["_kind", "_owner"])
    return owned.withColumnRenamed("source_capture_id", "document_id").drop("_kind", "_owner")


def backfill_claims(facts: DataFrame, notes: DataFrame, tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """Claims of old facts whose document exists."""
    rows = _owned_facts(facts, notes, tasks).join(docs.select("document_id"), "document_id", "left_semi")
    return rows.select(
        F.concat(F.lit("legacy-claim-"), "fact_id").alias("claim_id"),
        "document_id",
        F.col("document_id").alias("entry_id"),
        F.col("subject").alias("subject_text"),
        "predicate",
        "object_text",
        F.lit("fact").alias("modality"),
        F.lit("affirm").alias("polarity"),
        F.coalesce("confidence", F.lit(0.8)).alias("certainty"),
        legacy_ts("occurred_at").alias("time_start_utc"),
        legacy_ts("occurred_at").alias("time_end_utc"),
        F.lit("active").alias("status"),
        F.coalesce("extractor_version", F.lit("legacy-key-facts")).alias("extractor_version"),
    )


def backfill_evidence(facts: DataFrame, notes: DataFrame, tasks: DataFrame, docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence rows of old facts whose document and claim exist."""
    rows = (
        _owned_facts(facts, notes, tasks)
        .join(docs.select("document_id"), "document_id", "left_semi")
        .withColumn("claim_id", F.concat(F.lit("legacy-claim-"), "fact_id"))
        .join(claims.select("claim_id"), "claim_id", "left_semi")
    )
    return rows.select(
        F.concat(F.lit("legacy-evidence-"), "fact_id").alias("span_id"),
        "claim_id",
        "document_id",
        F.lit(None).cast("int").alias("char_start"),
        F.lit(None).cast("int").alias("char_end"),
        F.coalesce(blank_to_null("evidence_excerpt"), "object_text").alias("excerpt"),
    )


def backfill_extractions(claims: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with filled columns, extraction rows to add)."""
    legacy_id = F.concat(F.lit("legacy-extraction-"), "claim_id")
    raw = F.coalesce("object_text_raw", "object_text")
    changed = {
        "object_text_raw": raw,
        "object_text_canonical": F.coalesce(F.col("object_text_canonical"), raw),
        "me_role": F.coalesce("me_role", F.lit("none")),
        "quality_score": F.when(F.col("quality_score") == 0, F.coalesce("certainty", F.lit(0.0))).otherwise(F.col("quality_score")),
        "extraction_id": F.coalesce(F.col("extraction_id"), legacy_id),
    }
    missing = claims.where(F.col("extraction_id").isNull()).select(
        legacy_id.alias("extraction_id"),
        "document_id",
        "entry_id",
        F.coalesce(blank_to_null("extractor_version"), F.lit("legacy")).alias("model"),
        F.lit("v1").alias("schema_version"),
        F.lit("succeeded").alias("status"),
    )
    return _replaced(claims, changed), insert_ignore(existing, missing, ["extraction_id"])


def backfill_entry_state(entries: DataFrame, items: DataFrame, tie: str = "item_id") -> DataFrame:
    """Entries with the state and job of their latest item."""
    latest = latest_per_key(items, ["entry_id"], ["updated_at", tie]).select(
        "entry_id", map_entry_state("status").alias("_state"), F.col("job_id").alias("_job")
    )
    joined = entries.join(latest, "entry_id", "left")
    return joined.withColumn("analysis_state", F.coalesce("_state", "analysis_state")).withColumn(
        "latest_analysis_job_id", F.coalesce("_job", "latest_analysis_job_id")
    ).drop("_state", "_job")
