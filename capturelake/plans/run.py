"""The three-stage run: raw texts -> notes and tasks -> facts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.operators import facts as K
from capturelake.operators import structure as S
from capturelake.operators.merge import counted, merge_rows
from capturelake.sources.captures import ingest_captures


@dataclass(frozen=True)
class Staged:
    """Frames of one run; each is written once by ``write_run``."""

    captures: DataFrame
    routed: DataFrame
    notes: DataFrame
    tasks: DataFrame
    facts: DataFrame


def stage(raw: DataFrame, as_of: datetime, max_facts: int | None = None) -> Staged:
    """Lazy plan of all three stages over raw texts."""
    ingested = ingest_captures(raw, as_of)
    accepted = ingested.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return stage_captures(accepted, as_of, max_facts)


def stage_captures(captures: DataFrame, as_of: datetime, max_facts: int | None = None, stored: DataFrame | None = None) -> Staged:
    """Stages two and three; ``stored`` is a routed table already written."""
    routed = stored if stored is not None else S.route_captures(captures)
    known = stored is not None
    notes = S.to_notes(routed, as_of, stored=known)
    tasks = S.to_tasks(routed, as_of, stored=known)
    facts = K.fact_rows(K.extract_note_facts(notes, max_facts), "note").unionByName(
        K.fact_rows(K.extract_task_facts(tasks, max_facts), "task")
    )
    return Staged(S.mark_captures(routed, as_of), routed, notes, tasks, facts)


def run_counts(staged: Staged, dry_run: bool = True) -> DataFrame:
    """One row of counts of a run; nothing is written."""
    return merge_rows(S.structure_counts(staged.routed, dry_run), counted(staged.facts, "facts"))


def write_run(spark: SparkSession, captures: DataFrame, out: str, as_of: datetime, dry_run: bool = False) -> DataFrame:
    """Runs stages two and three into parquet tables below ``out``.

    The routed captures are written first, partitioned by route, so texts
    are classified once and notes and tasks read only their partition.  A
    lost executor costs the task at hand and not the classification.
    """
    if dry_run:
        return run_counts(stage_captures(captures, as_of))
    S.route_captures(captures).write.mode("overwrite").partitionBy("route").parquet(f"{out}/routed")
    routed = spark.read.parquet(f"{out}/routed")
    staged = stage_captures(captures, as_of, stored=routed)
    for name in ("notes", "tasks"):
        getattr(staged, name).write.mode("overwrite").parquet(f"{out}/{name}")
    notes, tasks = spark.read.parquet(f"{out}/notes"), spark.read.parquet(f"{out}/tasks")
    facts = K.fact_rows(K.extract_note_facts(notes), "note").unionByName(
        K.fact_rows(K.extract_task_facts(tasks), "task")
    )
    facts.write.mode("overwrite").parquet(f"{out}/key_facts")
    staged.captures.write.mode("overwrite").parquet(f"{out}/captures_raw")
    return merge_rows(S.structure_counts(routed), counted(spark.read.parquet(f"{out}/key_facts"), "facts"))
