"""Request log: filters, cost buckets, totals and the daily view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.functions.scalars import period_start

TOKEN_COLUMNS = ["input_tokens", "cached_input_tokens", "output_tokens", "total_tokens"]


def bounded(df: DataFrame, column: str, from_ts: str | None, to_ts: str | None) -> DataFrame:
    """Inclusive range; an absent bound adds no predicate, so it can push down."""
    if from_ts is not None:
        df = df.where(F.col(column) >= F.lit(from_ts).cast(df.schema[column].dataType))
    if to_ts is not None:
        df = df.where(F.col(column) <= F.lit(to_ts).cast(df.schema[column].dataType))
    return df


def _measures():
    ok = F.col("status") == "ok"
    return [
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(ok).alias("ok_count"),
        F.count_if(~ok).alias("error_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in TOKEN_COLUMNS],
        F.coalesce(F.sum("request_cost_usd"), F.lit(0)).cast("decimal(28,6)").alias("total_cost_usd"),
    ]


def cost_buckets(
    df: DataFrame,
    period: str = "day",
    from_ts: str | None = None,
    to_ts: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    out = (
        bounded(df, "created_at", from_ts, to_ts)
        .groupBy(period_start("created_at", period).alias("period_start"))
        .agg(*_measures())
        .orderBy(F.desc("period_start"))
    )
    return out if limit is None else out.limit(limit)


def cost_totals(df: DataFrame, from_ts: str | None = None, to_ts: str | None = None) -> DataFrame:
    """One row over the whole range, also when nothing is in it."""
    return bounded(df, "created_at", from_ts, to_ts).agg(*_measures())


def cost_daily(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(F.to_date("created_at").alias("day_utc"))
        .agg(*_measures())
        .withColumn("total_cost_usd", F.col("total_cost_usd").cast("decimal(14,6)"))
    )


def list_requests(
    df: DataFrame,
    from_ts: str | None = None,
    to_ts: str | None = None,
    status: str | None = None,
    model: str | None = None,
    operation: str | None = None,
    workflow: str | None = None,
    limit: int | None = None,
    order: tuple[str, ...] = ("request_started_at", "created_at"),
    tie: str | None = None,
) -> DataFrame:
    out = bounded(df, "created_at", from_ts, to_ts)
    wanted = {"status": status, "model": model, "operation": operation, "workflow": workflow}
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    keys = [F.desc(c) for c in order if c in df.columns]
    out = out.orderBy(*keys, *([F.asc(tie)] if tie else []))
    return out if limit is None else out.limit(limit)
