"""Queries over the request log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from capturelake.functions import scalars as S
from capturelake.operators import usage as U

from .frames import frame
from .registry import query, step

TS = "%Y-%m-%d %H:%M:%S"


def text_ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def priced(spark, sf_dir):
    return S.request_cost(frame(spark, sf_dir, "api_requests"))


step(
    "priced",
    """
    SELECT r.*, p.inp AS input_price, p.cached AS cached_price, p.outp AS output_price,
      CAST(coalesce(round(
        (CAST(greatest(r.input_tokens, 0) - least(greatest(r.cached_input_tokens, 0), greatest(r.input_tokens, 0)) AS DECIMAL(13,0)) * p.inp
         + CAST(least(greatest(r.cached_input_tokens, 0), greatest(r.input_tokens, 0)) AS DECIMAL(13,0)) * p.cached
         + CAST(greatest(r.output_tokens, 0) AS DECIMAL(13,0)) * p.outp) * CAST(0.000001 AS DECIMAL(7,6)), 6), 0) AS DECIMAL(12,6)) AS request_cost_usd
    FROM api_requests r LEFT JOIN (
      SELECT m.model, CAST(l.inp AS DECIMAL(12,6)) AS inp, CAST(l.cached AS DECIMAL(12,6)) AS cached, CAST(l.outp AS DECIMAL(12,6)) AS outp
      FROM (SELECT DISTINCT model FROM api_requests) m
      JOIN (VALUES (1,'gpt-4.1-mini','0.40','0.10','1.60'),(2,'gpt-4o-mini','0.15','0.075','0.60'),(3,'gpt-4.1','2.00','0.50','8.00'))
        AS l(ord, name, inp, cached, outp) ON starts_with(m.model, l.name)
      QUALIFY row_number() OVER (PARTITION BY m.model ORDER BY CASE WHEN m.model = l.name THEN 0 ELSE 1 END, l.ord) = 1
    ) p ON p.model = r.model
    """,
    ["api_requests"],
)
MEASURES = """count(*) AS request_count, count(*) FILTER (WHERE status = 'ok') AS ok_count,
    count(*) FILTER (WHERE status <> 'ok') AS error_count,
    CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(cached_input_tokens), 0) AS BIGINT) AS cached_input_tokens,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
    CAST(coalesce(sum(request_cost_usd), 0) AS DOUBLE) AS total_cost_usd"""


def _buckets(name, period, from_ts=None, to_ts=None, limit=None):
    where = " AND ".join(
        ["1=1"]
        + ([f"created_at >= TIMESTAMP '{from_ts}'"] if from_ts else [])
        + ([f"created_at <= TIMESTAMP '{to_ts}'"] if to_ts else [])
    )

    @query(
        name,
        f"""SELECT strftime(date_trunc('{period}', created_at), '{TS}') AS period_start, {MEASURES}
        FROM priced WHERE {where} GROUP BY 1 ORDER BY 1 DESC{f' LIMIT {limit}' if limit else ''}""",
        ["priced"],
    )
    def run(spark, sf_dir):
        out = U.cost_buckets(priced(spark, sf_dir), period, from_ts, to_ts, limit)
        return out.withColumn("period_start", text_ts("period_start")).withColumn(
            "total_cost_usd", F.col("total_cost_usd").cast("double")
        )


_buckets("usage_cost_daily", "day")
_buckets("usage_cost_weekly", "week")
_buckets("usage_cost_monthly", "month")
_buckets("usage_cost_range", "day", "2024-01-05 00:00:00", "2024-01-20 12:00:00", 10)


@query(
    "usage_cost_totals",
    f"SELECT {MEASURES} FROM priced WHERE created_at >= TIMESTAMP '2024-01-03 00:00:00'",
    ["priced"],
)
def usage_cost_totals(spark, sf_dir):
    out = U.cost_totals(priced(spark, sf_dir), from_ts="2024-01-03 00:00:00")
    return out.withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))


@query(
    "usage_cost_daily_view",
    f"SELECT strftime(created_at, '%Y-%m-%d') AS day_utc, {MEASURES} FROM priced GROUP BY 1",
    ["priced"],
)
def usage_cost_daily_view(spark, sf_dir):
    return (
        U.cost_daily(priced(spark, sf_dir))
        .withColumn("day_utc", F.col("day_utc").cast("string"))
        .withColumn("total_cost_usd", F.col("total_cost_usd").cast("double"))
    )


@query(
    "usage_request_filter",
    f"""SELECT request_id, strftime(created_at, '{TS}') AS created_at, status, model, operation, workflow,
        CASE WHEN source_ref_type IN ('none','capture','note','task','entry','other') THEN source_ref_type ELSE 'other' END AS source_ref_type
    FROM priced WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at <= TIMESTAMP '2024-01-28 00:00:00'
      AND status = 'ok' AND model = 'gpt-4.1-mini' AND operation = 'extract_claims_llm' AND workflow = 'fact_extraction'
    ORDER BY priced.created_at DESC, request_id""",
    ["priced"],
)
def usage_request_filter(spark, sf_dir):
    out = U.list_requests(
        frame(spark, sf_dir, "api_requests"),
        from_ts="2024-01-02 00:00:00",
        to_ts="2024-01-28 00:00:00",
        status="ok",
        model="gpt-4.1-mini",
        operation="extract_claims_llm",
        workflow="fact_extraction",
        tie="request_id",
    )
    return out.select(
        "request_id",
        text_ts("created_at").alias("created_at"),
        "status",
        "model",
        "operation",
        "workflow",
        S.source_ref_type("source_ref_type").alias("source_ref_type"),
    )


@query(
    "usage_request_cost",
    """SELECT request_id, model, CAST(input_price AS DOUBLE) AS input_price, CAST(cached_price AS DOUBLE) AS cached_price,
      CAST(output_price AS DOUBLE) AS output_price, CAST(request_cost_usd AS DOUBLE) AS request_cost_usd FROM priced""",
    ["priced"],
)
def usage_request_cost(spark, sf_dir):
    money = ["input_price", "cached_price", "output_price", "request_cost_usd"]
    return priced(spark, sf_dir).select("request_id", "model", *[F.col(c).cast("double").alias(c) for c in money])


@query(
    "usage_price_override",
    """SELECT request_id, CAST(round((CAST(input_tokens - least(cached_input_tokens, input_tokens) AS DECIMAL(13,0)) * CAST(1.5 AS DECIMAL(12,6))
      + CAST(least(cached_input_tokens, input_tokens) AS DECIMAL(13,0)) * CAST(1.5 AS DECIMAL(12,6))
      + CAST(output_tokens AS DECIMAL(13,0)) * CAST(2.5 AS DECIMAL(12,6))) * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DOUBLE) AS request_cost_usd
    FROM api_requests""",
    ["api_requests"],
)
def usage_price_override(spark, sf_dir):
    out = S.request_cost(frame(spark, sf_dir, "api_requests"), override=("1.5", None, "2.5"))
    return out.select("request_id", F.col("request_cost_usd").cast("double").alias("request_cost_usd"))


@query(
    "scalar_numbers",
    """SELECT event_id,
      CAST(coalesce(trunc(try_cast(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)), 0) AS BIGINT) AS k,
      CAST(0 AS BIGINT) AS bad_int,
      greatest(CAST(coalesce(trunc(try_cast('-' || CAST(value AS VARCHAR) AS DOUBLE)), 0) AS BIGINT), 0) AS clamped,
      CAST(trunc(value) AS BIGINT) AS whole, coalesce(try_cast(event_type AS DOUBLE), 0.0::DOUBLE) AS bad_double
    FROM events""",
)
def scalar_numbers(spark, sf_dir):
    df = frame(spark, sf_dir, "events")
    return df.select(
        "event_id",
        S.safe_int(F.regexp_extract("props", "[0-9]+", 0)).alias("k"),
        S.safe_int("event_type").alias("bad_int"),
        S.safe_int(F.concat(F.lit("-"), F.col("value").cast("string")), minimum=0).alias("clamped"),
        S.safe_int("value").alias("whole"),
        S.safe_double("event_type").alias("bad_double"),
    )


AS_OF = datetime(2024, 2, 1, 12, 0, 0)


@query(
    "scalar_times",
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text_ts, strftime(ts, '%Y-%m-%d') AS journal_date,
      strftime(date_trunc('week', ts), '{TS}') AS week_start, strftime(date_trunc('month', ts), '{TS}') AS month_start,
      ts >= TIMESTAMP '2024-01-10 00:00:00' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-20 00:00:00' AND event_type <> 'view' AS in_range,
      CASE WHEN event_type <> 'view' THEN strftime(date_trunc('second', ts), '{TS}') END AS utc,
      CASE WHEN event_type <> 'view' THEN strftime(date_trunc('second', ts), '{TS}') END AS legacy,
      '2024-02-01 12:05:00' AS retry_at, '2024-03-02 12:00:00' AS expires_at,
      round(1 / log2(greatest((epoch_us(TIMESTAMP '2024-02-01 12:00:00') - epoch_us(ts)) / 3600000000.0::DOUBLE, 1) + 2), 9) AS boost
    FROM events""",
)
def scalar_times(spark, sf_dir):
    df = frame(spark, sf_dir, "events").withColumn("text_ts", S.to_text_ts("ts"))
    maybe = F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("unknown")
    return df.select(
        "event_id",
        "text_ts",
        S.journal_date("text_ts").alias("journal_date"),
        text_ts(S.period_start("ts", "week")).alias("week_start"),
        text_ts(S.period_start("ts", "month")).alias("month_start"),
        S.in_range(maybe, "2024-01-10 00:00:00", "2024-01-20 00:00:00").alias("in_range"),
        text_ts(S.to_utc(maybe)).alias("utc"),
        text_ts(S.legacy_ts(maybe)).alias("legacy"),
        text_ts(S.retry_at(AS_OF)).alias("retry_at"),
        text_ts(S.expires_at(AS_OF)).alias("expires_at"),
        F.round(S.recency_boost("ts", AS_OF), 9).alias("boost"),
    )
