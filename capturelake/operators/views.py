"""Read views over notes, tasks and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memory_items(notes: DataFrame, tasks: DataFrame) -> DataFrame:
    def empty(c: str):
        return F.coalesce(F.col(c), F.lit(""))

    note_rows = notes.where(F.col("deleted_at").isNull()).select(
        F.lit("note").alias("item_type"),
        F.col("note_id").alias("item_id"),
        F.col("note_type").alias("subtype"),
        empty("title").alias("title"),
        empty("summary").alias("summary"),
        F.col("body").alias("content"),
        "occurred_at",
        F.lit("").alias("status"),
        F.lit(None).cast("int").alias("priority"),
        "sensitivity",
    )
    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    task_rows = tasks.where(F.col("deleted_at").isNull()).select(
        F.lit("task").alias("item_type"),
        F.col("task_id").alias("item_id"),
        F.col("status").alias("subtype"),
        "title",
        empty("details").alias("summary"),
        F.coalesce("details", "title").alias("content"),
        F.coalesce("done_at", "due_at", "scheduled_at", created).alias("occurred_at"),
        "status",
        "priority",
        "sensitivity",
    )
    return note_rows.unionByName(task_rows)


def key_facts_view(facts: DataFrame, notes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Facts whose owner is not deleted.

    Owners are one keyed frame, so facts shuffle once on their owner and the
    absent half of (note, task) never piles up as a null join key.
    """
    deleted = notes.where(F.col("deleted_at").isNotNull()).select(
        F.lit("note").alias("source_type"), F.col("note_id").alias("source_id")
    ).unionByName(
        tasks.where(F.col("deleted_at").isNotNull()).select(
            F.lit("task").alias("source_type"), F.col("task_id").alias("source_id")
        )
    )
    live = facts.where(F.col("deleted_at").isNull()).select(
        "fact_id",
        F.when(F.col("note_id").isNotNull(), "note").otherwise("task").alias("source_type"),
        F.coalesce("note_id", "task_id").alias("source_id"),
        "subject",
        "predicate",
        "object_text",
        "object_type",
        "object_json",
        "evidence_excerpt",
        "occurred_at",
        "confidence",
        "sensitivity",
    )
    return live.join(deleted, ["source_type", "source_id"], "left_anti")
