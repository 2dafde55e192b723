"""Queries over rollups, revisions, backfills, contracts, prompts, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.functions import pii as P
from capturelake.functions import scalars as SC
from capturelake.operators import claims as C
from capturelake.operators import contract as K
from capturelake.operators import revise as V
from capturelake.operators import rollups as Ro
from capturelake.operators import structure as St
from capturelake.session import work_dir
from capturelake.sources.schemas import duplicate_keys, validate
from capturelake.streaming import streams as Sm

from .claims import claims_table, documents
from .entries import entries, items
from .facts import key_facts, owners_facts, written_facts
from .frames import FRAMES, frame
from .registry import query, step
from .run import write_run
from .structure import AS_OF, notes, routed, stored_captures, tasks, written_owners
from .text import sql_key, sql_one_line, sql_parts
from .usage import text_ts

# --- rollups: events as claims, so that created_at spreads over the month ------

CLAIM_SQL = """SELECT 'c' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS claim_id, ts AS created_at, 'user ' || CAST(user_id AS VARCHAR) AS subject_text, event_type AS predicate,
  props AS object_text_canonical, event_type AS entry_type, CAST(user_id % 7 AS VARCHAR) AS project FROM events WHERE event_type <> 'error'"""
step("event_claims", CLAIM_SQL)


def event_claims(spark, sf_dir):
    e = frame(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("c"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("claim_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject_text"),
        F.col("event_type").alias("predicate"),
        F.col("props").alias("object_text_canonical"),
        F.col("event_type").alias("entry_type"),
        (F.col("user_id") % 7).cast("string").alias("project"),
        F.when(F.col("event_type") == "error", F.col("ts").cast("timestamp")).alias("deleted_at"),
    )


SENT = "subject_text || ' ' || predicate || ' ' || object_text_canonical"


@query(
    "rollup_build",
    f"""SELECT 'all' AS scope_type, string_agg(s, ' / ' ORDER BY rn) FILTER (WHERE rn <= 10) AS summary_text, string_agg(claim_id, ',' ORDER BY rn) AS key_claim_ids FROM (
      SELECT *, {SENT} AS s, row_number() OVER (ORDER BY created_at DESC, claim_id) AS rn FROM event_claims WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00') WHERE rn <= 12""",
    ["event_claims"],
)
def rollup_build(spark, sf_dir):
    out = Ro.build_rollup(event_claims(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    return out.select("scope_type", "summary_text", F.array_join("key_claim_ids", ",").alias("key_claim_ids"))


@query("rollup_empty", "SELECT '期間内の事実データがありません。' AS summary_text, 0 AS n FROM (SELECT count(*) FROM events)")
def rollup_empty(spark, sf_dir):
    out = Ro.build_rollup(event_claims(spark, sf_dir), "2030-01-01 00:00:00", "2030-02-01 00:00:00")
    return out.select("summary_text", F.size("key_claim_ids").alias("n"))


step(
    "scoped_rollups",
    f"""SELECT scope_type, scope_key, 'weekly' AS period_type, period_start, period_start + INTERVAL 7 DAY AS period_end, string_agg(s, ' / ' ORDER BY rn) FILTER (WHERE rn <= 10) AS summary_text, string_agg(claim_id, ',' ORDER BY rn) AS key_claim_ids FROM (
      SELECT *, row_number() OVER (PARTITION BY scope_type, scope_key, period_start ORDER BY created_at DESC, claim_id) AS rn FROM (
        SELECT claim_id, created_at, {SENT} AS s, date_trunc('week', created_at) AS period_start, 'all' AS scope_type, 'all' AS scope_key FROM event_claims
        UNION ALL SELECT claim_id, created_at, {SENT}, date_trunc('week', created_at), 'entry_type', entry_type FROM event_claims
        UNION ALL SELECT claim_id, created_at, {SENT}, date_trunc('week', created_at), 'project', project FROM event_claims)) WHERE rn <= 12 GROUP BY ALL""",
    ["event_claims"],
)


def scoped(spark, sf_dir):
    return Ro.build_rollups(event_claims(spark, sf_dir), "weekly", {"entry_type": "entry_type", "project": "project"})


ROLL_OUT = "scope_type, scope_key, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end, summary_text, key_claim_ids"


def _roll_out(df):
    return df.select(
        "scope_type", "scope_key", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
        F.date_format("period_end", "yyyy-MM-dd").alias("period_end"), "summary_text", F.array_join("key_claim_ids", ",").alias("key_claim_ids"),
    )


@query("rollup_scoped", f"SELECT {ROLL_OUT} FROM scoped_rollups", ["scoped_rollups"])
def rollup_scoped(spark, sf_dir):
    return _roll_out(scoped(spark, sf_dir))


@query(
    "rollup_upsert",
    f"SELECT {ROLL_OUT}, CASE WHEN scope_type = 'project' THEN '2023' ELSE '2024' END AS created FROM scoped_rollups",
    ["scoped_rollups"],
)
def rollup_upsert(spark, sf_dir):
    new = scoped(spark, sf_dir).withColumn("created", F.lit("2024"))
    old = new.where("scope_type = 'project'").withColumn("summary_text", F.lit("old")).withColumn("created", F.lit("2023"))
    out = Ro.upsert_rollups(old, new)
    return _roll_out(out.drop("created")).withColumn("created", F.when(F.col("scope_type") == "project", "2023").otherwise("2024"))


step(
    "topic_rollups",
    f"""SELECT scope_type, scope_key, 'weekly' AS period_type, period_start, period_start + INTERVAL 7 DAY AS period_end, string_agg(s, ' / ' ORDER BY rn) FILTER (WHERE rn <= 10) AS summary_text, string_agg(claim_id, ',' ORDER BY rn) AS key_claim_ids FROM (
      SELECT *, row_number() OVER (PARTITION BY scope_type, scope_key, period_start ORDER BY created_at DESC, claim_id) AS rn FROM (
        SELECT claim_id, created_at, {SENT} AS s, date_trunc('week', created_at) AS period_start, 'all' AS scope_type, 'all' AS scope_key FROM event_claims
        UNION ALL SELECT claim_id, created_at, {SENT}, date_trunc('week', created_at), 'topic', entry_type FROM event_claims
        UNION ALL SELECT claim_id, created_at, {SENT}, date_trunc('week', created_at), 'topic', 'part ' || project FROM event_claims
        UNION ALL SELECT claim_id, created_at, {SENT}, date_trunc('week', created_at), 'project', project FROM event_claims WHERE entry_type <> 'click')) WHERE rn <= 12 GROUP BY ALL""",
    ["event_claims"],
)


def event_dimensions(spark, sf_dir):
    """Dimension rows of the event claims: two topics, one of them from two sources, and a project that is null for clicks."""
    rows = event_claims(spark, sf_dir)
    project = F.when(F.col("entry_type") != "click", F.col("project"))
    made = [("topic", F.col("entry_type"), "llm"), ("topic", F.col("entry_type"), "rule"), ("topic", F.concat(F.lit("part "), "project"), "llm"), ("project", project, "llm"), ("mood", F.lit("any"), "llm")]
    each = F.array(*[F.struct(F.lit(t).alias("dimension_type"), v.alias("normalized_value"), F.lit(s).alias("source")) for t, v, s in made])
    return rows.select("claim_id", F.explode(each).alias("d")).select("claim_id", "d.*")


@query("rollup_topics", f"SELECT {ROLL_OUT} FROM topic_rollups", ["topic_rollups"])
def rollup_topics(spark, sf_dir):
    """Rollups by all topics and projects of a claim, from its dimension rows."""
    many = Ro.dimension_scopes(event_dimensions(spark, sf_dir), ["topic", "project"])
    return _roll_out(Ro.build_rollups(event_claims(spark, sf_dir), "weekly", {}, many=many))


@query(
    "rollup_list",
    f"SELECT {ROLL_OUT} FROM (SELECT * FROM scoped_rollups WHERE scope_type = 'entry_type' AND scope_key = 'click' AND period_type = 'weekly' AND period_start >= TIMESTAMP '2024-01-08 00:00:00' AND period_end <= TIMESTAMP '2024-01-29 00:00:00' ORDER BY period_start DESC)",
    ["scoped_rollups"],
)
def rollup_list(spark, sf_dir):
    return _roll_out(
        Ro.list_rollups(scoped(spark, sf_dir), "entry_type", "click", "weekly", "2024-01-08 00:00:00", "2024-01-29 00:00:00")
    )


# --- revisions ----------------------------------------------------------------


def _revisions(claims):
    note = F.when(F.col("polarity") == "affirm", F.lit("clearer"))
    return claims.where("predicate = 'felt'").select(
        "claim_id", F.concat(F.lit("revised "), "object_text_canonical").alias("object_text_canonical"), note.alias("revision_note")
    )


NEXT = f"sha256('revision|' || claim_id || '|revised ' || {sql_key('canonical')})"
LATER = AS_OF.replace(month=7)


@query(
    "claim_revise",
    f"""SELECT claim_id, md5(canonical) AS canonical, CASE WHEN predicate = 'felt' THEN 'superseded' ELSE 'active' END AS status, NULL AS supersedes_claim_id, NULL AS revision_note, CASE WHEN predicate = 'felt' THEN '2024-07-01 00:00:00' END AS deleted_at FROM stored_claims
    UNION ALL SELECT {NEXT}, md5('revised ' || canonical), 'active', claim_id, CASE WHEN polarity = 'affirm' THEN 'clearer' END, NULL FROM stored_claims WHERE predicate = 'felt'""",
    ["stored_claims"],
)
def claim_revise(spark, sf_dir):
    claims = claims_table(spark, sf_dir)
    out, _ = V.revise_claims(claims, _revisions(claims), LATER)
    return out.select(
        "claim_id", F.md5("object_text_canonical").alias("canonical"), "status", "supersedes_claim_id", "revision_note",
        text_ts("deleted_at").alias("deleted_at"),
    )


@query(
    "claim_revise_feedback",
    f"""SELECT claim_id, 'supersede' AS action, {NEXT} AS detail FROM stored_claims WHERE predicate = 'felt' UNION ALL SELECT {NEXT}, 'revise', 'clearer' FROM stored_claims WHERE predicate = 'felt' AND polarity = 'affirm'""",
    ["stored_claims"],
)
def claim_revise_feedback(spark, sf_dir):
    claims = claims_table(spark, sf_dir)
    _, feedback = V.revise_claims(claims, _revisions(claims), LATER)
    detail = F.coalesce(F.get_json_object("after_json", "$.supersededBy"), F.get_json_object("after_json", "$.revisionNote"))
    return feedback.select("claim_id", "action", detail.alias("detail"))


@query(
    "claim_retract",
    """SELECT claim_id, CASE WHEN predicate = 'learned' THEN 'retracted' ELSE 'active' END AS status, CASE WHEN predicate = 'learned' AND polarity = 'negate' THEN 'wrong' END AS revision_note FROM stored_claims""",
    ["stored_claims"],
)
def claim_retract(spark, sf_dir):
    claims = claims_table(spark, sf_dir)
    gone = claims.where("predicate = 'learned'").select("claim_id", F.when(F.col("polarity") == "negate", "wrong").alias("reason"))
    out, _ = V.retract_claims(claims, gone, LATER)
    return out.select("claim_id", "status", "revision_note")


@query(
    "claim_revise_images",
    f"""SELECT claim_id, 'supersede' AS action, claim_id AS before_id, md5(canonical) AS before_text, 'active' AS before_status, {NEXT} AS detail, '2024-07-01T00:00:00.000Z' AS told_at, 'user' AS actor, '2024-07-01 00:00:00' AS created_at FROM stored_claims WHERE predicate = 'felt'
    UNION ALL SELECT {NEXT}, 'revise', claim_id, NULL, NULL, 'clearer', NULL, 'user', '2024-07-01 00:00:00' FROM stored_claims WHERE predicate = 'felt' AND polarity = 'affirm'""",
    ["stored_claims"],
)
def claim_revise_images(spark, sf_dir):
    """Feedback of revisions with the claim's row before and what it became."""
    claims = claims_table(spark, sf_dir)
    return _images(V.revise_claims(claims, _revisions(claims), LATER)[1])


@query(
    "claim_retract_images",
    """SELECT claim_id, 'retract' AS action, claim_id AS before_id, md5(canonical) AS before_text, 'active' AS before_status, CASE WHEN polarity = 'negate' THEN 'wrong' END AS detail, NULL AS told_at, 'user' AS actor, '2024-07-01 00:00:00' AS created_at
    FROM stored_claims WHERE predicate = 'learned'""",
    ["stored_claims"],
)
def claim_retract_images(spark, sf_dir):
    claims = claims_table(spark, sf_dir)
    gone = claims.where("predicate = 'learned'").select("claim_id", F.when(F.col("polarity") == "negate", "wrong").alias("reason"))
    return _images(V.retract_claims(claims, gone, LATER)[1])


def _images(feedback):
    before, after = (lambda f, c=c: F.get_json_object(c, f"$.{f}") for c in ("before_json", "after_json"))
    return feedback.select(
        "claim_id", "action", F.coalesce(before("claim_id"), before("id")).alias("before_id"), F.md5(before("object_text_canonical")).alias("before_text"),
        before("status").alias("before_status"), F.coalesce(after("supersededBy"), after("revisionNote"), after("reason")).alias("detail"),
        after("at").alias("told_at"), "actor", text_ts("created_at").alias("created_at"),
    )


# --- backfills ----------------------------------------------------------------


@query(
    "backfill_documents",
    f"""SELECT e.entry_id AS document_id, CASE WHEN sensitivity = 'public' THEN e.entry_id END AS capture_id, CASE WHEN sensitivity = 'public' THEN 'stored' ELSE body END AS raw_text,
      CASE WHEN sensitivity = 'public' THEN 0.6::DOUBLE ELSE 0 END AS pii_score, CASE WHEN sensitivity = 'public' THEN 'masked' ELSE 'none' END AS redaction_state FROM entries e WHERE analysis_state <> 'blocked'""",
    ["entries"],
)
def backfill_documents(spark, sf_dir):
    e = entries(spark, sf_dir)
    captures = e.where("sensitivity = 'public'").select(
        F.col("entry_id").alias("capture_id"), F.lit("stored").alias("raw_text"), F.lit(0.6).alias("pii_score"), "created_at"
    )
    docs = e.where("analysis_state = 'blocked'").select(F.col("entry_id").alias("document_id"))
    out = V.backfill_documents(e, captures, docs)
    return out.select("document_id", "capture_id", "raw_text", "pii_score", "redaction_state")


LEGACY = """SELECT k.*, coalesce(n.source_capture_id, t.source_capture_id) AS document_id FROM key_facts k LEFT JOIN notes n ON n.note_id = k.note_id LEFT JOIN tasks t ON t.task_id = k.task_id
  WHERE coalesce(n.source_capture_id, t.source_capture_id) IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE lang <> 'fr')"""
step("legacy_facts", LEGACY, ["key_facts", "notes", "tasks"])


def _legacy(spark, sf_dir, facts, of_notes, of_tasks):
    docs = documents(spark, sf_dir).where("lang <> 'fr'").select("document_id")
    return facts.withColumn("deleted_at", F.lit(None).cast("timestamp")), of_notes, of_tasks, docs


@query(
    "backfill_claims",
    """SELECT 'legacy-claim-' || fact_id AS claim_id, document_id, subject AS subject_text, predicate, confidence AS certainty, strftime(CAST(replace(replace(occurred_at, 'T', ' '), 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS time_start FROM legacy_facts""",
    ["legacy_facts"],
)
def backfill_claims(spark, sf_dir):
    out = V.backfill_claims(*_legacy(spark, sf_dir, key_facts(spark, sf_dir), notes(spark, sf_dir), tasks(spark, sf_dir)))
    return out.select("claim_id", "document_id", "subject_text", "predicate", "certainty", text_ts("time_start_utc").alias("time_start"))


@query(
    "backfill_evidence",
    "SELECT 'legacy-evidence-' || fact_id AS span_id, document_id, coalesce(nullif(evidence_excerpt, ''), object_text) AS excerpt FROM legacy_facts WHERE confidence > 0.8",
    ["legacy_facts"],
)
def backfill_evidence(spark, sf_dir):
    # captures are classified and written once, and so are the facts, from which the claims derive too
    owners = written_owners(spark, sf_dir)
    facts, n, t, docs = _legacy(spark, sf_dir, written_facts(spark, sf_dir, owners_facts(*owners)), *owners)
    claims = facts.where("confidence > 0.8").select(F.concat(F.lit("legacy-claim-"), "fact_id").alias("claim_id"))
    return V.backfill_evidence(facts, n, t, docs, claims).select("span_id", "document_id", "excerpt")


def _bare_claims(spark, sf_dir):
    null = F.lit(None).cast("string")
    return frame(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("claim_id"),
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").cast("string").alias("entry_id"),
        F.col("source").alias("object_text"),
        F.when(F.col("lang") == "en", F.col("lang")).alias("object_text_raw"),
        null.alias("object_text_canonical"),
        F.when(F.col("lang") == "de", "actor").alias("me_role"),
        F.when(F.col("lang") == "es", 0.4).otherwise(0.0).alias("quality_score"),
        F.lit(0.7).alias("certainty"),
        F.when(F.col("lang") == "fr", F.lit("kept")).alias("extraction_id"),
        F.when(F.col("lang") == "en", "").otherwise("rules-v1").alias("extractor_version"),
    )


@query(
    "backfill_extractions",
    """SELECT CAST(doc_id AS VARCHAR) AS claim_id, CASE WHEN lang = 'en' THEN lang ELSE source END AS object_text_canonical, CASE WHEN lang = 'de' THEN 'actor' ELSE 'none' END AS me_role,
      CASE WHEN lang = 'es' THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS quality_score, CASE WHEN lang = 'fr' THEN 'kept' ELSE 'legacy-extraction-' || CAST(doc_id AS VARCHAR) END AS extraction_id FROM documents""",
)
def backfill_extractions(spark, sf_dir):
    claims = _bare_claims(spark, sf_dir)
    none = claims.select("extraction_id").where(F.lit(False))
    out, _ = V.backfill_extractions(claims, none)
    return out.select("claim_id", "object_text_canonical", "me_role", "quality_score", "extraction_id")


@query(
    "backfill_extraction_rows",
    "SELECT 'legacy-extraction-' || CAST(doc_id AS VARCHAR) AS extraction_id, CASE WHEN lang = 'en' THEN 'legacy' ELSE 'rules-v1' END AS model FROM documents WHERE lang <> 'fr'",
)
def backfill_extraction_rows(spark, sf_dir):
    claims = _bare_claims(spark, sf_dir)
    none = claims.select("extraction_id").where(F.lit(False))
    return V.backfill_extractions(claims, none)[1].select("extraction_id", "model")


@query(
    "backfill_states",
    """SELECT p_partkey AS entry_id, coalesce(CASE WHEN s.status IN ('queued','running','succeeded','failed','blocked') THEN s.status ELSE CASE WHEN s.status IS NOT NULL THEN 'not_requested' END END, 'not_requested') AS analysis_state, s.job_id AS latest_analysis_job_id
    FROM part p LEFT JOIN (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY updated_at DESC, item_id DESC) = 1) s ON s.entry_id = p.p_partkey""",
    ["items"],
)
def backfill_states(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entry_id"),
        F.lit("not_requested").alias("analysis_state"),
        F.lit(None).cast("bigint").alias("latest_analysis_job_id"),
    )
    return V.backfill_entry_state(parts, items(spark, sf_dir))


# --- contracts and prompts -------------------------------------------------------


@query(
    "structure_contract",
    "SELECT count(*) FILTER (WHERE route <> 'skipped') AS captures_processed, '' AS violations FROM routed",
    ["routed"],
)
def structure_contract(spark, sf_dir):
    out = K.check_contract(St.structure_counts(routed(spark, sf_dir)), K.STRUCTURE_RESULT)
    return out.select("captures_processed", F.array_join("violations", ";").alias("violations"))


@query(
    "request_contract",
    """SELECT event_id AS request_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click','purchase','error') THEN '$.event_type: not in enum' END, CASE WHEN value < 1 THEN '$.value: below minimum' END,
      CASE WHEN value > 100 THEN '$.value: above maximum' END, '$.props: additional property'], lambda x: x IS NOT NULL), ';') AS violations FROM events""",
)
def request_contract(spark, sf_dir):
    rules = {
        "event_id": {"type": "integer"},
        "event_type": {"type": "string", "enum": ["click", "purchase", "error"]},
        "value": {"type": "number", "minimum": 1, "maximum": 100},
    }
    rows = frame(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    out = K.check_contract(rows, rules)
    return out.select(F.col("event_id").alias("request_id"), F.array_join("violations", ";").alias("violations"))


@query(
    "prompts_notes",
    f"SELECT note_id, CAST(part AS INTEGER) AS part, title, md5(substr(body, part * 6000 + 1, 6000)) AS body, mood_score FROM ({sql_parts('note_id, title, mood_score', 'body', sql_one_line('body'), 6000, 'notes')})",
    ["notes"],
)
def prompts_notes(spark, sf_dir):
    out = C.note_prompts(notes(spark, sf_dir))
    return out.select(
        "note_id", "part", F.get_json_object("prompt", "$.title").alias("title"), F.md5(F.get_json_object("prompt", "$.body")).alias("body"),
        F.get_json_object("prompt", "$.mood_score").cast("int").alias("mood_score"),
    )


@query(
    "prompts_tasks",
    f"SELECT task_id, CAST(part AS INTEGER) AS part, title, md5(substr(details, part * 6000 + 1, 6000)) AS details, priority FROM ({sql_parts('task_id, title, priority', 'details', sql_one_line('details'), 6000, 'tasks')})",
    ["tasks"],
)
def prompts_tasks(spark, sf_dir):
    out = C.task_prompts(tasks(spark, sf_dir))
    return out.select(
        "task_id", "part", F.get_json_object("prompt", "$.title").alias("title"), F.md5(F.get_json_object("prompt", "$.details")).alias("details"),
        F.get_json_object("prompt", "$.priority").cast("int").alias("priority"),
    )


@query(
    "prompts_documents",
    f"SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(part AS INTEGER) AS part, md5(substr(safe, part * 7000 + 1, 7000)) AS text FROM ({sql_parts('doc_id', 'safe', 'CASE WHEN pii_score >= 0.5 THEN m ELSE text END', 7000, '(SELECT * FROM masked_docs WHERE pii_score < 0.9)')})",
    ["masked_docs"],
)
def prompts_documents(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "text", F.lit("thought").alias("declared_type"), F.lit("2024-02-02T00:00:00Z").alias("occurred_at_utc")
    )
    out = C.document_prompts(P.redact(docs))
    return out.select("document_id", "part", F.md5(F.get_json_object("prompt", "$.text")).alias("text"))


# --- whole runs and table checks -----------------------------------------------

RUN_COUNTS = """SELECT count(*) FILTER (WHERE route = 'note') AS notes_created, count(*) FILTER (WHERE route = 'task') AS tasks_created, count(*) FILTER (WHERE route = 'blocked') AS captures_blocked,
  (SELECT count(*) FROM key_facts) AS facts, {dry} AS dry_run FROM routed"""
RUN_OUT = ["notes_created", "tasks_created", "captures_blocked", "facts", "dry_run"]


@query("three_stage_counts", RUN_COUNTS.format(dry="true"), ["routed", "key_facts"])
def three_stage_counts(spark, sf_dir):
    return write_run(spark, stored_captures(spark, sf_dir), "", AS_OF, dry_run=True).select(*RUN_OUT)


@query("three_stage_written", RUN_COUNTS.format(dry="false"), ["routed", "key_facts"])
def three_stage_written(spark, sf_dir):
    return write_run(spark, stored_captures(spark, sf_dir), work_dir(spark, "run"), AS_OF).select(*RUN_OUT)


@query(
    "table_checks",
    """SELECT entry_id, CASE WHEN turn_kind = 'other' THEN 'declared_type' ELSE '' END AS broken FROM (SELECT entry_id, CASE WHEN declared_type = 'meeting' THEN 'other' ELSE 'known' END AS turn_kind FROM entries)
    WHERE turn_kind = 'other'""",
    ["entries"],
)
def table_checks(spark, sf_dir):
    """Rows that break a rule, with meetings renamed to an unknown type."""
    kind = F.when(F.col("declared_type") == "meeting", "party").otherwise(F.col("declared_type"))
    _, rejected = validate(entries(spark, sf_dir).withColumn("declared_type", kind), "app_entries")
    return rejected.select("entry_id", F.array_join("broken", ",").alias("broken"))


@query(
    "table_duplicates",
    "SELECT entry_id, job_id, count(*) AS n FROM items GROUP BY ALL HAVING count(*) > 1",
    ["items"],
)
def table_duplicates(spark, sf_dir):
    return duplicate_keys(items(spark, sf_dir), "fact_extraction_job_items")


# --- streams --------------------------------------------------------------------


def _columns(name):
    base, columns = FRAMES[name]
    return base, [f"{e if isinstance(e, str) else e[0]} AS {c}" for c, e in columns.items()]


@query("stream_structuring", "SELECT capture_id, route FROM routed", ["routed"])
def stream_structuring(spark, sf_dir):
    base, exprs = _columns("captures")
    rows = Sm.stream_table(spark, sf_dir, base).selectExpr(*exprs)
    ready = rows.withColumn("source_id", F.concat(F.lit("src-"), "source_detail")).withColumn("pii_score", P.pii_score("raw_text"))
    out = work_dir(spark, "structuring")
    Sm.stream_structure(ready, f"{out}/sink", f"{out}/checkpoint", AS_OF).awaitTermination()
    return spark.read.parquet(f"{out}/sink/routed").select("capture_id", "route")


@query(
    "stream_cost",
    """SELECT strftime(date_trunc('day', created_at), '%Y-%m-%d') AS day, count(*) AS request_count, count(*) FILTER (WHERE status = 'ok') AS ok_count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(request_cost_usd) AS DOUBLE) AS total_cost_usd
    FROM priced GROUP BY 1 HAVING date_trunc('day', min(created_at)) + INTERVAL 1 DAY <= (SELECT max(created_at) FROM priced) - INTERVAL 1 DAY""",
    ["priced"],
)
def stream_cost(spark, sf_dir):
    base, exprs = _columns("api_requests")
    rows = SC.request_cost(Sm.stream_table(spark, sf_dir, base).selectExpr(*exprs))
    out = work_dir(spark, "cost")
    Sm.stream_cost(rows, f"{out}/sink", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/sink").select(
        F.date_format("period_start", "yyyy-MM-dd").alias("day"), "request_count", "ok_count", "total_tokens",
        F.col("total_cost_usd").cast("double").alias("total_cost_usd"),
    )


@query(
    "stream_latest",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def stream_latest(spark, sf_dir):
    out = work_dir(spark, "latest")
    rows = Sm.stream_table(spark, sf_dir, "events")
    Sm.stream_latest(rows, f"{out}/sink", f"{out}/checkpoint", ["user_id"], "ts", "event_id").awaitTermination()
    return Sm.read_latest(spark, f"{out}/sink", ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")
