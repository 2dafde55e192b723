"""Frames derived from the driver's tables.

Each frame is a base table plus one expression per column.  An expression is
one text where Spark SQL and DuckDB agree, else a (spark, duckdb) pair, so
both engines derive the same rows.  Whole tables and whole texts are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capturelake.sources.tables import read_table

# JSON-safe text: no quotes, backslashes or control characters
CLEAN = "replace(replace(replace(replace(replace({0}, chr(92), ''), chr(34), ''), chr(10), ' '), chr(13), ' '), chr(9), ' ')"
Q = "chr(34)"


def _ts(start: str, unit: str, n: str) -> tuple[str, str]:
    return (
        f"timestampadd({unit.upper()}, CAST({n} AS INT), TIMESTAMP_NTZ'{start} 00:00:00')",
        f"(TIMESTAMP '{start} 00:00:00' + to_{unit}s(CAST({n} AS INT)))",
    )


def _json(*pairs: tuple[str, str]) -> str:
    """Portable text building a JSON object out of already encoded values."""
    fields = " || ',' || ".join(f"{Q} || '{k}' || {Q} || ':' || {v}" for k, v in pairs)
    return f"('{{' || {fields} || '}}')"


def _s(expr: str) -> str:
    return f"{Q} || {expr} || {Q}"


BODY = CLEAN.format("text")
PAYLOAD = (
    "CASE turn % 5 "
    "WHEN 0 THEN "
    + _json(
        ("mood", "CAST(conv_id % 7 AS STRING)"),
        ("energy", "'3'"),
        ("reflection", _s(BODY)),
    )
    + " WHEN 1 THEN "
    + _json(
        ("status", _s("CASE WHEN conv_id % 3 = 0 THEN 'paused' ELSE 'todo' END")),
        ("priority", "CAST(1 + conv_id % 4 AS STRING)"),
        ("flag", "'true'"),
        ("details", _s(BODY)),
    )
    + " WHEN 2 THEN "
    + _json(
        ("url", _s("CASE WHEN conv_id % 2 = 0 THEN 'https://example.com/c/' || CAST(conv_id AS STRING) ELSE '' END")),
        ("takeaway", _s(BODY)),
    )
    + " WHEN 3 THEN CASE WHEN conv_id % 2 = 0 THEN "
    + _json(("note", _s(BODY)))
    + " ELSE "
    + _json(("item", _s("'item ' || CAST(conv_id AS STRING)")))
    + " END ELSE "
    + _json(
        ("context", _s("'conversation ' || CAST(conv_id AS STRING)")),
        ("notes", _s(BODY)),
        ("decisions", f"'[' || {Q} || 'keep' || {Q} || ',' || {Q} || 'ship it' || {Q} || ']'"),
        ("actions", "'[]'"),
    )
    + " END"
)


FRAMES: dict[str, tuple[str, dict[str, str | tuple[str, str]]]] = {
    "api_requests": (
        "events",
        {
            "request_id": "event_id",
            "created_at": "ts",
            "status": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'timeout' ELSE 'ok' END",
            "environment": "CASE WHEN user_id % 5 = 0 THEN 'production' ELSE 'local' END",
            "model": "CASE user_id % 4 WHEN 0 THEN 'gpt-4.1-mini' WHEN 1 THEN 'gpt-4o-mini-2024-07-18'"
            " WHEN 2 THEN 'gpt-4.1' ELSE 'unlisted-model' END",
            "operation": "CASE WHEN event_type IN ('purchase', 'signup') THEN 'extract_claims_llm'"
            " ELSE 'extract_facts_llm' END",
            "workflow": "CASE WHEN user_id % 10 = 3 THEN 'evaluation' ELSE 'fact_extraction' END",
            "source_ref_type": "CASE user_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'task' WHEN 2 THEN 'entry' ELSE 'page' END",
            "input_tokens": "10 * CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)",
            "cached_input_tokens": "3 * CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)",
            "output_tokens": "CAST(floor(value) AS BIGINT)",
            "total_tokens": "10 * CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) + CAST(floor(value) AS BIGINT)",
        },
    ),
    "captures": (
        "documents",
        {
            "capture_id": "CAST(doc_id AS STRING)",
            "source_kind": "'import'",
            "source_detail": "source",
            "input_type": "CASE doc_id % 12 WHEN 0 THEN 'quick' WHEN 1 THEN 'task' WHEN 5 THEN 'url' WHEN 6 THEN 'url' ELSE 'note' END",
            "raw_text": "CASE doc_id % 12"
            " WHEN 0 THEN 'TODO: ' || text || ' p1'"
            " WHEN 1 THEN 'task ' || text"
            " WHEN 2 THEN 'next ' || text"
            " WHEN 3 THEN '今日の振り返り。mood:4 energy:3 ' || text"
            " WHEN 4 THEN '昨日は睡眠が浅い。' || text"
            " WHEN 5 THEN 'https://example.com/d/' || CAST(doc_id AS STRING) || ' 記事で学んだこと。' || text"
            " WHEN 6 THEN 'https://example.com/u/' || CAST(doc_id AS STRING)"
            " WHEN 7 THEN 'why should I keep this idea? ' || text"
            " WHEN 8 THEN 'メモ'"
            " WHEN 9 THEN text"
            " WHEN 10 THEN text || ' contact user@example.com 123-4567'"
            " ELSE 'api_key=ABCDEFGHIJKL1234 ' || text END",
            "occurred_at": (
                f"CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {_ts('2024-01-01', 'hour', 'doc_id')[0]} END",
                f"CASE WHEN doc_id % 10 = 0 THEN NULL ELSE {_ts('2024-01-01', 'hour', 'doc_id')[1]} END",
            ),
            "created_at": _ts("2024-02-01", "minute", "doc_id"),
            "sensitivity": "'internal'",
            "status": "CASE WHEN doc_id % 97 = 0 THEN 'archived' ELSE 'new' END",
            "pii_override": "CASE WHEN doc_id % 50 = 7 THEN CAST(0.3 AS DOUBLE) WHEN doc_id % 50 = 8 THEN CAST(1.7 AS DOUBLE) ELSE NULL END",
        },
    ),
    "entries": (
        "conversations",
        {
            "entry_id": "CAST(conv_id * 1000 + turn AS STRING)",
            "declared_type": "CASE turn % 5 WHEN 0 THEN 'journal' WHEN 1 THEN 'todo' WHEN 2 THEN 'learning'"
            " WHEN 3 THEN 'thought' ELSE 'meeting' END",
            "title": "CASE WHEN turn % 4 = 0 THEN role || ' turn ' || CAST(turn AS STRING) ELSE NULL END",
            "body": "text",
            "tags": (
                "CASE turn % 3 WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array(role) ELSE array(role, 'thread') END",
                "CASE turn % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [role] ELSE [role, 'thread'] END",
            ),
            "occurred_at": _ts("2024-01-01", "minute", "conv_id * 1000 + turn"),
            "created_at": _ts("2024-03-01", "minute", "conv_id * 8 + turn"),
            "updated_at": _ts("2024-04-01", "minute", "(conv_id * 37 + turn) % 5000"),
            "sensitivity": "CASE conv_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'sensitive' END",
            "analysis_state": "CASE conv_id % 4 WHEN 0 THEN 'not_requested' WHEN 1 THEN 'succeeded' WHEN 2 THEN 'failed' ELSE 'blocked' END",
            "payload": PAYLOAD,
        },
    ),
    "jobs": (
        "orders",
        {
            "job_id": "o_orderkey",
            "requested_at": "o_orderdate",
            "requested_by": "o_custkey",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END",
        },
    ),
    "items": (
        "lineitem",
        {
            "item_id": "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
            " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)",
            "job_id": "l_orderkey",
            "entry_id": "l_partkey",
            "attempt_no": "l_linenumber",
            "created_at": "l_shipdate",
            "updated_at": "l_shipdate",
            "claims_inserted": "CAST(l_quantity AS BIGINT)",
            "status": "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed'"
            " WHEN l_returnflag = 'R' THEN 'blocked' WHEN l_returnflag = 'A' THEN 'succeeded'"
            " WHEN l_linestatus = 'F' THEN 'running' ELSE 'queued' END",
        },
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    if name not in FRAMES:
        return read_table(spark, sf_dir, name, spread)
    base, columns = FRAMES[name]
    df = frame(spark, sf_dir, base, spread)
    return df.selectExpr(*[f"{_pick(e, 0)} AS {c}" for c, e in columns.items()])


def frame_sql(name: str) -> str:
    base, columns = FRAMES[name]
    fields = ", ".join(f"{_pick(e, 1)} AS {c}" for c, e in columns.items())
    return f"SELECT {fields} FROM {base}"


def _pick(expr: str | tuple[str, str], side: int) -> str:
    return expr if isinstance(expr, str) else expr[side]
