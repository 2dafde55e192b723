"""Readers, table checks, whole runs and a sample of SQL comparisons."""

from datetime import datetime

import pytest

import __spark_entry__ as entry
from capturelake.plans.run import stage, write_run
from capturelake.sources import schemas
from capturelake.sources.tables import read_jsonl
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "usage_cost_weekly", "usage_request_cost", "pii_masked", "text_clamp", "structured_notes", "fact_tasks", "entries_search",
    "job_items_latest", "claim_normalised", "rollup_scoped", "backfill_claims", "eval_gate", "token_index", "lww_merge",
]


def test_jsonl_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"id": "a", "n": 1}\n\n  \n{"id": "b", "n": 2, "x": 3}\n')
    rows = read_jsonl(spark, str(path), "id string, n int").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 2)]


def test_validate_splits_rows(spark):
    df = spark.sql("SELECT 'c' AS claim_id, 'd' AS document_id, 5 AS char_start, 2 AS char_end, 'x' AS excerpt UNION ALL SELECT 'c', 'd', null, null, 'y'")
    good, bad = schemas.validate(df, "fact_evidence_spans")
    assert good.count() == 1 and bad.first()["broken"] == ["offsets"]


def test_run_twice_gives_the_same_tables(spark, tmp_path):
    raw = spark.sql(
        "SELECT cast(id AS string) capture_id, 's' source_id, 'auto' input_type, concat('TODO: write part ', id, '. next tested item') raw_text, "
        "cast(null AS timestamp) occurred_at, 'internal' sensitivity, cast(null AS double) pii_override FROM range(20)"
    )
    columns = "capture_id, source_id, input_type, raw_text, occurred_at, sensitivity, pii_score, status, created_at, updated_at"
    accepted = stage(raw, datetime(2024, 1, 1)).routed.select(*columns.split(", "))
    dry = write_run(spark, accepted, "", datetime(2024, 1, 1), dry_run=True).first()
    first = write_run(spark, accepted, str(tmp_path / "one"), datetime(2024, 1, 1)).first()
    again = write_run(spark, accepted, str(tmp_path / "two"), datetime(2024, 1, 1)).first()
    assert dry["facts"] == first["facts"] and dry["dry_run"] and not first["dry_run"]
    assert first == again and first["tasks_created"] == 20 and first["facts"] >= 60


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    rows, problem = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert problem is None and rows > 0
