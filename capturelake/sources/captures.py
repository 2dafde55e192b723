"""Capture ingest: raw texts become captures_raw rows with a source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions.pii import resolve_pii
from capturelake.functions.rx import blank_to_null
from capturelake.functions.scalars import at
from capturelake.functions.text import strip
from capturelake.operators.classify import detect_input_type
from capturelake.operators.merge import insert_ignore, stable_id, top_per_key


def capture_text(arg_text: str, stdin_text: str | None = None):
    """Argument text and piped text, each trimmed, joined by a newline."""
    parts = [blank_to_null(strip(c)) for c in (arg_text, stdin_text) if c is not None]
    return strip(F.concat_ws("\n", *parts))


def ingest_captures(raw: DataFrame, as_of: datetime, stdin_text: str | None = None) -> DataFrame:
    """captures_raw rows plus ``reject_reason`` (null for accepted rows).

    ``raw`` has capture_id, raw_text, input_type (or "auto"), occurred_at,
    sensitivity, pii_override, source_id.
    """
    text = raw.withColumn("raw_text", capture_text("raw_text", stdin_text))
    scored = resolve_pii(text, "raw_text")
    return scored.select(
        "capture_id",
        "source_id",
        detect_input_type("raw_text", "input_type").alias("input_type"),
        "raw_text",
        F.coalesce(F.col("occurred_at").cast("timestamp"), at(as_of)).alias("occurred_at"),
        "sensitivity",
        "pii_score",
        F.lit("new").alias("status"),
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
        F.when(F.col("raw_text") == "", "no capture text")
        .when(~F.col("pii_valid"), "pii score out of range")
        .alias("reject_reason"),
    )


def resolve_sources(
    captures: DataFrame, sources: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """(captures with source_id, sources to create).

    A given id is used as it is; otherwise the earliest source of the same
    kind and detail; otherwise a new one.  Sources are reduced to one row per
    key before the join, so a hot source only makes the capture side uneven,
    which adaptive execution splits.
    """
    detail = F.coalesce(F.col("detail"), F.lit(""))
    earliest = top_per_key(
        sources.select("kind", detail.alias("detail"), "id", "created_at"),
        ["kind", "detail"],
        [F.asc("created_at"), F.asc("id")],
    ).select(F.col("kind").alias("source_kind"), F.col("detail").alias("source_detail"), F.col("id").alias("_found"))
    keyed = captures.withColumn("source_detail", F.coalesce("source_detail", F.lit("")))
    made = stable_id(F.lit("source"), "source_kind", "source_detail")
    resolved = keyed.join(earliest, ["source_kind", "source_detail"], "left").withColumn(
        "source_id", F.coalesce("source_id", "_found", made)
    )
    wanted = resolved.select(
        F.col("source_id").alias("id"),
        F.col("source_kind").alias("kind"),
        F.col("source_detail").alias("detail"),
        at(as_of).alias("created_at"),
    )
    created = insert_ignore(sources.select("id"), wanted, ["id"], [F.asc("kind"), F.asc("detail")])
    return resolved.drop("_found"), created


def web_source(as_of: datetime, spark) -> DataFrame:
    return spark.range(1).select(
        F.lit(R.WEB_SOURCE_ID).alias("id"),
        F.lit(R.WEB_SOURCE_KIND).alias("kind"),
        F.lit(R.WEB_SOURCE_DETAIL).alias("detail"),
        at(as_of).alias("created_at"),
    )
