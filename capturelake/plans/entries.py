"""Queries over typed entries: payloads, captures, documents, lists, search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from capturelake.functions import text as T
from capturelake.operators import jobs as J
from capturelake.operators import search as S
from capturelake.operators import views as V
from capturelake.operators.merge import ranked_children, upsert
from capturelake.session import work_dir
from capturelake.sources import entries as E

from .facts import key_facts
from .frames import frame
from .pii import sql_risk, sql_score
from .registry import query, step
from .structure import AS_OF, notes, tasks
from .text import TOKENS, sql_strip
from .usage import text_ts

OUT_TS = "'%Y-%m-%d %H:%M:%S'"

step(
    "entry_fields",
    """SELECT e.entry_id, j.id AS pos, j.key AS key, j.type AS type, j.value->>'$' AS txt,
      CASE WHEN j.type = 'ARRAY' THEN json_extract_string(j.value, '$[*]') END AS items
    FROM entries e, json_each(e.payload) j""",
    ["entries"],
)
step(
    "entry_texts",
    """SELECT e.entry_id, coalesce(string_agg(part, chr(10) ORDER BY pos), '') AS txt FROM entries e LEFT JOIN (
      SELECT entry_id, -2 AS pos, title AS part FROM entries WHERE coalesce(title, '') <> ''
      UNION ALL SELECT entry_id, -1, body FROM entries WHERE coalesce(body, '') <> ''
      UNION ALL SELECT entry_id, pos, key || ': ' || CASE WHEN type = 'ARRAY' THEN array_to_string(items, ' / ') ELSE txt END
        FROM entry_fields WHERE CASE WHEN type = 'ARRAY' THEN len(items) > 0 ELSE coalesce(txt, '') <> '' END) p ON p.entry_id = e.entry_id
    GROUP BY e.entry_id""",
    ["entry_fields"],
)
step(
    "entry_search_texts",
    f"""SELECT e.entry_id, {sql_strip("string_agg(part, ' ' ORDER BY pos)")} AS txt FROM entries e LEFT JOIN (
      SELECT entry_id, -3 AS pos, coalesce(title, '') AS part FROM entries
      UNION ALL SELECT entry_id, -2, coalesce(body, '') FROM entries
      UNION ALL SELECT entry_id, -1, coalesce(array_to_string(tags, ' '), '') FROM entries
      UNION ALL SELECT entry_id, pos, CASE WHEN type = 'ARRAY' THEN coalesce(array_to_string(items, ' '), '') ELSE txt END
        FROM entry_fields WHERE type NOT IN ('BOOLEAN', 'OBJECT', 'NULL')) p ON p.entry_id = e.entry_id
    GROUP BY e.entry_id""",
    ["entry_fields"],
)


def entries(spark, sf_dir):
    return frame(spark, sf_dir, "entries")


@query("entry_text", "SELECT entry_id, txt AS raw_text FROM entry_texts", ["entry_texts"])
def entry_text(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", E.build_capture_text().alias("raw_text"))


@query("entry_searchable", "SELECT entry_id, txt AS searchable FROM entry_search_texts", ["entry_search_texts"])
def entry_searchable(spark, sf_dir):
    return entries(spark, sf_dir).select(
        "entry_id", T.searchable_text("title", "body", "tags", "payload").alias("searchable")
    )


@query(
    "entry_input_type",
    """SELECT entry_id, CASE WHEN declared_type = 'todo' THEN 'task' WHEN declared_type = 'learning' AND length(payload->>'$.url') > 0 THEN 'url' ELSE 'note' END AS input_type
    FROM entries""",
    ["entries"],
)
def entry_input_type(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", E.capture_input_type().alias("input_type"))


@query(
    "entry_from_text",
    f"""SELECT entry_id, {sql_strip('body')} AS body, CASE declared_type WHEN 'journal' THEN 'reflection' WHEN 'todo' THEN 'details,status,priority' WHEN 'learning' THEN 'takeaway'
      WHEN 'thought' THEN 'note' ELSE 'context,notes,decisions,actions' END AS fields, {sql_strip('body')} AS main, length({sql_strip('body')}) BETWEEN 1 AND 10000 AS valid FROM entries""",
    ["entries"],
)
def entry_from_text(spark, sf_dir):
    raw = entries(spark, sf_dir).select("entry_id", "declared_type", F.col("body").alias("text"))
    out = E.capture_to_entry(raw)
    main = F.coalesce(*[F.get_json_object("payload", f"$.{k}") for k in ("reflection", "details", "takeaway", "note", "context")])
    return out.select(
        "entry_id",
        "body",
        F.array_join(F.json_object_keys("payload"), ",").alias("fields"),
        main.alias("main"),
        "valid",
    )


@query(
    "entry_legacy_payload",
    """SELECT entry_id, CASE WHEN declared_type = 'thought' AND payload->>'$.note' IS NULL THEN payload->>'$.item' || ' / ' || body ELSE payload->>'$.note' END AS note
    FROM entries""",
    ["entries"],
)
def entry_legacy_payload(spark, sf_dir):
    return entries(spark, sf_dir).select(
        "entry_id", F.get_json_object(E.normalize_legacy_payload(), "$.note").alias("note")
    )


@query(
    "entry_payload_errors",
    """SELECT entry_id, CASE declared_type
      WHEN 'journal' THEN CASE WHEN CAST(payload->>'$.mood' AS INT) NOT BETWEEN 1 AND 5 THEN 'mood: invalid' ELSE '' END
      WHEN 'todo' THEN CASE WHEN payload->>'$.status' NOT IN ('todo','in_progress','done') THEN 'status: invalid' ELSE '' END
      WHEN 'learning' THEN CASE WHEN payload->>'$.url' = '' THEN 'url: invalid' ELSE '' END
      WHEN 'thought' THEN CASE WHEN payload->>'$.note' IS NULL THEN 'note: required' ELSE '' END ELSE '' END AS errors FROM entries""",
    ["entries"],
)
def entry_payload_errors(spark, sf_dir):
    return entries(spark, sf_dir).select("entry_id", F.array_join(E.validate_payload(), ";").alias("errors"))


# --- captures and documents of entries --------------------------------------

step(
    "entry_captures",
    f"""SELECT entry_id AS capture_id, 'cli' AS source_id, 'stored under its own id' AS raw_text, occurred_at, created_at, 0.6::DOUBLE AS pii_score FROM entries WHERE sensitivity = 'public'
    UNION ALL SELECT 'web-' || entry_id, 'source-web-api', t.txt, occurred_at, created_at + INTERVAL 1 DAY, CASE WHEN declared_type = 'todo' THEN 0.9::DOUBLE ELSE 0::DOUBLE END
      FROM entries JOIN entry_texts t USING (entry_id) WHERE analysis_state <> 'succeeded'""",
    ["entry_texts"],
)
step(
    "entry_map",
    f"""SELECT e.entry_id, coalesce(c.capture_id, e.entry_id) AS capture_id, greatest({sql_score('t.txt')}, coalesce(c.pii_score, 0)) AS pii_score, c.capture_id IS NULL AS is_new, t.txt
    FROM entries e JOIN entry_texts t USING (entry_id) LEFT JOIN entry_captures c
      ON c.capture_id = e.entry_id OR (c.source_id = 'source-web-api' AND c.raw_text = t.txt AND c.occurred_at = e.occurred_at)
    QUALIFY row_number() OVER (PARTITION BY e.entry_id ORDER BY c.created_at DESC NULLS LAST) = 1""",
    ["entry_captures"],
)


def entry_captures(spark, sf_dir):
    e = entries(spark, sf_dir)
    own = e.where("sensitivity = 'public'").select(
        F.col("entry_id").alias("capture_id"),
        F.lit("cli").alias("source_id"),
        F.lit("stored under its own id").alias("raw_text"),
        "occurred_at",
        "created_at",
        F.lit(0.6).alias("pii_score"),
    )
    web = e.where("analysis_state <> 'succeeded'").select(
        F.concat(F.lit("web-"), "entry_id").alias("capture_id"),
        F.lit("source-web-api").alias("source_id"),
        E.build_capture_text().alias("raw_text"),
        "occurred_at",
        (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
        F.when(F.col("declared_type") == "todo", 0.9).otherwise(0.0).alias("pii_score"),
    )
    return own.unionByName(web)


def ensured(spark, sf_dir):
    return E.ensure_captures(entries(spark, sf_dir), entry_captures(spark, sf_dir), AS_OF)


@query("entry_captures_ensured", "SELECT entry_id, capture_id, pii_score FROM entry_map", ["entry_map"])
def entry_captures_ensured(spark, sf_dir):
    return ensured(spark, sf_dir)[0]


@query(
    "entry_captures_inserted",
    "SELECT capture_id, 'source-web-api' AS source_id, txt AS raw_text, pii_score FROM entry_map WHERE is_new",
    ["entry_map"],
)
def entry_captures_inserted(spark, sf_dir):
    return ensured(spark, sf_dir)[1].select("capture_id", "source_id", "raw_text", "pii_score")


@query(
    "entry_documents",
    f"""SELECT e.entry_id, CASE WHEN e.title IS NOT NULL THEN 'doc-' || e.entry_id ELSE e.entry_id END AS document_id, m.capture_id, e.declared_type, m.txt AS raw_text, m.pii_score,
      {sql_risk('m.pii_score', ('blocked', 'masked', 'none'))} AS redaction_state, 'ja' AS language, lower(e.body) AS normalized_text, CAST(length(e.body) AS INTEGER) AS token_count, 'ready' AS analysis_state
    FROM entries e JOIN entry_map m USING (entry_id)""",
    ["entry_map"],
)
def entry_documents(spark, sf_dir):
    mapped = E.map_entries(entries(spark, sf_dir), entry_captures(spark, sf_dir))
    titled = E.document_rows(mapped.where("title IS NOT NULL"), datetime(2024, 5, 1))
    docs = titled.select(
        F.concat(F.lit("doc-"), "entry_id").alias("document_id"),
        *[F.lit("old").alias(c) if c == "raw_text" else F.col(c) for c in titled.columns if c != "document_id"],
    )
    out = E.upsert_documents(mapped, docs, AS_OF)
    return out.select(
        "entry_id", "document_id", "capture_id", "declared_type", "raw_text", "pii_score", "redaction_state",
        "language", "normalized_text", "token_count", "analysis_state",
    )


@query(
    "upsert_counts",
    """SELECT coalesce(o.k, l.k) AS k, CASE WHEN l.k IS NOT NULL THEN l.v ELSE o.v END AS v, coalesce(o.since, l.since) AS since FROM
      (SELECT o_custkey AS k, count(*) AS v, strftime(min(o_orderdate), '%Y') AS since FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) o
      FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS v, strftime(min(o_orderdate), '%Y') AS since FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) l ON o.k = l.k""",
)
def upsert_counts(spark, sf_dir):
    def per_customer(where):
        return frame(spark, sf_dir, "orders").where(where).groupBy(F.col("o_custkey").alias("k")).agg(
            F.count(F.lit(1)).alias("v"), F.date_format(F.min("o_orderdate"), "yyyy").alias("since")
        )

    return upsert(per_customer("o_orderstatus <> 'O'"), per_customer("o_orderpriority <> '5-LOW'"), ["k"], ["v"])


# --- lists and search ---------------------------------------------------------


@query(
    "entries_list",
    f"""SELECT entry_id, declared_type, strftime(occurred_at, {OUT_TS}) AS occurred_at FROM (SELECT * FROM entries WHERE declared_type IN ('todo', 'learning', 'meeting')
      AND occurred_at >= TIMESTAMP '2024-01-02 00:00:00' AND occurred_at <= TIMESTAMP '2024-03-01 00:00:00' AND list_has_all(tags, ['user', 'thread']) AND sensitivity = 'internal'
      ORDER BY occurred_at DESC, entry_id LIMIT 100)""",
    ["entries"],
)
def entries_list(spark, sf_dir):
    out = S.list_entries(
        entries(spark, sf_dir),
        types=["todo", "learning", "meeting"],
        from_ts="2024-01-02 00:00:00",
        to_ts="2024-03-01 00:00:00",
        tags=["user", "thread"],
        sensitivity="internal",
        limit=100,
    )
    return out.select("entry_id", "declared_type", text_ts("occurred_at").alias("occurred_at"))


SEARCH_OF = datetime(2024, 6, 1)


def _search_sql(q: str, pool: str) -> str:
    return f"""SELECT entry_id, CAST(m AS INTEGER) AS "match", round(m + 1 / log2(greatest((epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(occurred_at)) / 3600000000.0::DOUBLE, 1) + 2), 9) AS score,
      CASE WHEN len(f) = 0 THEN 'payload' ELSE array_to_string(f, ',') END AS matched_fields FROM (
      SELECT p.*, CASE WHEN contains(x, ' {q} ') OR x = '{q}' THEN 3 WHEN len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: starts_with(w, '{q}'))) > 0 THEN 2 WHEN contains(x, '{q}') THEN 1 ELSE 0 END AS m,
        list_filter([CASE WHEN contains(lower(coalesce(title, '')), '{q}') THEN 'title' END, CASE WHEN contains(lower(body), '{q}') THEN 'body' END,
          CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), '{q}'))) > 0 THEN 'tags' END], lambda f: f IS NOT NULL) AS f
      FROM (SELECT e.*, lower(s.txt) AS x FROM ({pool}) e JOIN entry_search_texts s USING (entry_id)) p) WHERE m >= 1"""


def _search_out(df):
    return df.select(
        "entry_id", "match", F.round("score", 9).alias("score"), F.array_join("matched_fields", ",").alias("matched_fields")
    )


@query("entries_search", _search_sql("the", "SELECT * FROM entries"), ["entry_search_texts"])
def entries_search(spark, sf_dir):
    return _search_out(S.search_entries(entries(spark, sf_dir), "The", SEARCH_OF))


@query(
    "entries_search_ranked",
    f"SELECT * FROM ({_search_sql('user', 'SELECT * FROM entries')}) ORDER BY score DESC, entry_id LIMIT 50",
    ["entry_search_texts"],
)
def entries_search_ranked(spark, sf_dir):
    return _search_out(S.search_entries(entries(spark, sf_dir), "user", SEARCH_OF, limit=50))


@query(
    "entries_search_recent",
    _search_sql("thread", "SELECT * FROM entries WHERE sensitivity = 'public' ORDER BY occurred_at DESC, entry_id LIMIT 100"),
    ["entry_search_texts"],
)
def entries_search_recent(spark, sf_dir):
    return _search_out(
        S.search_entries(
            entries(spark, sf_dir), "thread", SEARCH_OF, limit=100, limit_before_rank=True, sensitivity="public"
        )
    )


@query(
    "history_list",
    f"""SELECT event_id AS id, strftime(ts, {OUT_TS}) AS created_at, event_type FROM (SELECT * FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id)""",
)
def history_list(spark, sf_dir):
    log = frame(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entry_id"), F.col("ts").alias("created_at"), "event_type"
    )
    return S.list_history(log, 8).select("id", text_ts("created_at").alias("created_at"), "event_type")


@query(
    "dashboard_counts",
    """SELECT count(*) FILTER (WHERE CAST(occurred_at AS DATE) = DATE '2024-01-10') AS today_count, count(*) FILTER (WHERE analysis_state IN ('not_requested', 'failed')) AS ready_count,
      count(*) FILTER (WHERE declared_type = 'journal') AS journal_count, count(*) FILTER (WHERE declared_type = 'todo') AS todo_count, count(*) FILTER (WHERE declared_type = 'learning') AS learning_count,
      count(*) FILTER (WHERE declared_type = 'thought') AS thought_count, count(*) FILTER (WHERE declared_type = 'meeting') AS meeting_count FROM entries""",
    ["entries"],
)
def dashboard_counts(spark, sf_dir):
    return S.entry_stats(entries(spark, sf_dir), datetime(2024, 1, 10, 15, 0))


# --- jobs ---------------------------------------------------------------------

step(
    "job_items",
    """SELECT CAST(job_id AS VARCHAR) || '-' || CAST(attempt_no AS VARCHAR) AS item_id, job_id, min(entry_id) AS entry_id, min(created_at) AS created_at, max(updated_at) AS updated_at, max(status) AS status
    FROM items GROUP BY job_id, attempt_no""",
    ["items"],
)


def items(spark, sf_dir):
    return frame(spark, sf_dir, "items")


def job_items(spark, sf_dir):
    key = F.concat_ws("-", F.col("job_id").cast("string"), F.col("attempt_no").cast("string"))
    return items(spark, sf_dir).groupBy(key.alias("item_id"), "job_id").agg(
        F.min("entry_id").alias("entry_id"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.max("status").alias("status"),
    )


def extractions(spark, sf_dir):
    key = F.concat_ws("-", F.col("job_id").cast("string"), F.col("attempt_no").cast("string"))
    return items(spark, sf_dir).select(
        F.col("item_id").alias("extraction_id"), key.alias("job_item_id"), "created_at", F.col("status").alias("model")
    )


@query(
    "entry_latest_status",
    """SELECT p.p_partkey AS entry_id, s.status AS analysis_status FROM part p LEFT JOIN (
      SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY updated_at DESC, item_id DESC) = 1) s ON s.entry_id = p.p_partkey""",
    ["items"],
)
def entry_latest_status(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"))
    return J.with_latest_status(parts, items(spark, sf_dir))


@query(
    "entry_states",
    """SELECT item_id, CASE WHEN status IN ('queued','running','succeeded','failed','blocked') THEN status ELSE 'not_requested' END AS entry_state,
      CASE status WHEN 'queued' THEN 'queued_retry' WHEN 'failed' THEN 'error' ELSE status END AS result_status FROM items""",
    ["items"],
)
def entry_states(spark, sf_dir):
    return items(spark, sf_dir).select(
        "item_id", J.map_entry_state("status").alias("entry_state"), J.map_result_status("status").alias("result_status")
    )


@query(
    "job_items_latest",
    f"""SELECT j.job_id, j.status AS job_status, strftime(j.requested_at, {OUT_TS}) AS requested_at, i.item_id, i.entry_id, CASE WHEN i.status = 'queued' THEN 'queued_retry' ELSE i.status END AS item_status,
      x.item_id AS extraction_id, x.status AS model FROM (SELECT * FROM jobs WHERE status = 'succeeded' ORDER BY requested_at DESC, job_id DESC) j
      LEFT JOIN job_items i ON i.job_id = j.job_id LEFT JOIN (SELECT *, CAST(job_id AS VARCHAR) || '-' || CAST(attempt_no AS VARCHAR) AS k FROM items
        QUALIFY row_number() OVER (PARTITION BY job_id, attempt_no ORDER BY created_at DESC, item_id DESC) = 1) x ON x.k = i.item_id""",
    ["jobs", "job_items"],
)
def job_items_latest(spark, sf_dir):
    out = J.list_jobs(
        frame(spark, sf_dir, "jobs"), job_items(spark, sf_dir), extractions(spark, sf_dir), status="succeeded"
    )
    return out.select(
        "job_id", "job_status", text_ts("requested_at").alias("requested_at"), "item_id", "entry_id", "item_status",
        "extraction_id", "model",
    )


JOB_ONE = f"""SELECT j.job_id, j.status AS job_status, strftime(j.requested_at, {OUT_TS}) AS requested_at, i.item_id, i.entry_id
      FROM (SELECT * FROM jobs WHERE job_id = (SELECT min(job_id) FROM jobs)) j LEFT JOIN job_items i ON i.job_id = j.job_id"""


@query("job_by_id", JOB_ONE, ["jobs", "job_items"])
def job_by_id(spark, sf_dir):
    """The oldest id, which no page of newest jobs holds."""
    jobs = frame(spark, sf_dir, "jobs")
    first = jobs.agg(F.min("job_id")).first()[0]
    out = J.list_jobs(jobs, job_items(spark, sf_dir), extractions(spark, sf_dir), job_id=first)
    return out.select("job_id", "job_status", text_ts("requested_at").alias("requested_at"), "item_id", "entry_id")


@query(
    "job_counters",
    """SELECT job_id, count(*) AS total_items, count(*) FILTER (WHERE status = 'succeeded') AS succeeded_items, count(*) FILTER (WHERE status IN ('failed','blocked','queued')) AS failed_items,
      CASE WHEN count(*) FILTER (WHERE status IN ('failed','blocked','queued')) > 0 THEN 'failed' ELSE 'succeeded' END AS final_status FROM items GROUP BY job_id""",
    ["items"],
)
def job_counters(spark, sf_dir):
    return J.job_counters(items(spark, sf_dir))


@query(
    "job_history_view",
    f"""SELECT j.job_id, strftime(j.requested_at, {OUT_TS}) AS requested_at, i.entry_id, CAST(coalesce(c.n, 0) AS BIGINT) AS claims_shown, p.p_name AS preview
    FROM jobs j JOIN (SELECT DISTINCT job_id, entry_id FROM items) i USING (job_id) LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) c ON c.l_partkey = i.entry_id
      LEFT JOIN part p ON p.p_partkey = i.entry_id WHERE j.requested_at >= TIMESTAMP '1996-01-01 00:00:00' AND j.requested_at <= TIMESTAMP '1996-12-31 00:00:00'""",
    ["jobs", "items"],
)
def job_history_view(spark, sf_dir):
    claims = frame(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("entry_id"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at")
    )
    shown = frame(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("body"), F.lit("{}").alias("payload")
    )
    out = J.job_history(
        frame(spark, sf_dir, "jobs"), items(spark, sf_dir), claims, shown, "1996-01-01 00:00:00", "1996-12-31 00:00:00"
    )
    return out.select("job_id", text_ts("requested_at").alias("requested_at"), "entry_id", "claims_shown", "preview")


@query(
    "attempt_fold",
    f"""SELECT item_id, status, attempt_count, claims_inserted, CASE WHEN status <> 'succeeded' THEN CASE status WHEN 'blocked' THEN 'blocked_sensitive' WHEN 'queued' THEN 'queued_retry' ELSE 'analysis failed' END END AS last_error,
      CASE WHEN status = 'queued' THEN strftime(updated_at + INTERVAL 5 MINUTE, {OUT_TS}) END AS next_retry_at FROM (
      SELECT CAST(job_id AS VARCHAR) AS item_id, updated_at, claims_inserted, CASE WHEN status IN ('succeeded','blocked','queued') THEN status ELSE 'failed' END AS status,
        count(*) OVER (PARTITION BY job_id) AS attempt_count, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, attempt_no DESC, CASE WHEN status IN ('succeeded','blocked','queued') THEN status ELSE 'failed' END DESC, claims_inserted DESC) AS rn
      FROM items) WHERE rn = 1""",
    ["items"],
)
def attempt_fold(spark, sf_dir):
    attempts = items(spark, sf_dir).select(
        F.col("job_id").cast("string").alias("item_id"),
        "attempt_no",
        F.col("status").alias("worker_status"),
        "claims_inserted",
        F.lit(None).cast("string").alias("error"),
        F.col("updated_at").alias("finished_at"),
    )
    out = J.fold_attempts(attempts)
    return out.withColumn("next_retry_at", text_ts("next_retry_at"))


# --- views --------------------------------------------------------------------


@query(
    "memory_items",
    """SELECT 'note' AS item_type, note_id AS item_id, note_type AS subtype, title, summary, md5(body) AS content, occurred_at, '' AS status, NULL::INTEGER AS priority, sensitivity FROM notes
    UNION ALL SELECT 'task', task_id, status, title, details, md5(details), strftime(created_at, '%Y-%m-%dT%H:%M:%SZ'), status, priority, sensitivity FROM tasks""",
    ["notes", "tasks"],
)
def memory_items(spark, sf_dir):
    return V.memory_items(notes(spark, sf_dir), tasks(spark, sf_dir)).withColumn("content", F.md5("content"))


@query(
    "key_facts_view",
    """SELECT fact_id, CASE WHEN k.note_id IS NOT NULL THEN 'note' ELSE 'task' END AS source_type, coalesce(k.note_id, k.task_id) AS source_id, subject, predicate, object_text, confidence
    FROM key_facts k LEFT JOIN notes n ON n.note_id = k.note_id LEFT JOIN tasks t ON t.task_id = k.task_id
    WHERE (k.note_id IS NULL OR n.note_type <> 'thought') AND (k.task_id IS NULL OR t.priority <> 1)""",
    ["key_facts", "notes", "tasks"],
)
def key_facts_view(spark, sf_dir):
    gone = F.col("created_at")
    n = notes(spark, sf_dir).withColumn("deleted_at", F.when(F.col("note_type") == "thought", gone))
    t = tasks(spark, sf_dir).withColumn("deleted_at", F.when(F.col("priority") == 1, gone))
    facts = key_facts(spark, sf_dir).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    out = V.key_facts_view(facts, n, t)
    return out.select("fact_id", "source_type", "source_id", "subject", "predicate", "object_text", "confidence")


@query(
    "token_index",
    f"""SELECT token, doc_id, field, count(*) AS tf FROM (
      SELECT doc_id, 'text' AS field, unnest({TOKENS.format('text')}) AS token FROM documents
      UNION ALL SELECT doc_id, 'source', unnest({TOKENS.format('source')}) FROM documents) GROUP BY ALL""",
)
def token_index(spark, sf_dir):
    return S.token_index(frame(spark, sf_dir, "documents"), "doc_id", ["text", "source"])


@query(
    "group_ordered",
    """SELECT conv_id, string_agg(role || ':' || CAST(length(text) AS VARCHAR), ',' ORDER BY turn, role, length(text)) AS turns FROM conversations GROUP BY conv_id""",
)
def group_ordered(spark, sf_dir):
    from capturelake.operators.merge import group_ordered as group

    rows = frame(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    out = group(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("n")], ["role", "n"], "turns")
    return out.withColumn(
        "turns", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["n"].cast("string"))), ",")
    )


@query(
    "children_ranked",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS position, md5(text) AS text FROM conversations",
)
def children_ranked(spark, sf_dir):
    """Position of every turn among those of its conversation, newest first."""
    turns = frame(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = ranked_children(turns, "conv_id", [F.desc("turn")], work_dir(spark, "children"))
    return out.select("conv_id", "turn", "position", F.md5("text").alias("text"))


@query(
    "children_ranked_hot",
    """SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS position FROM lineitem""",
)
def children_ranked_hot(spark, sf_dir):
    """The same for three keys that hold all rows."""
    order = [F.asc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    out = ranked_children(frame(spark, sf_dir, "lineitem"), "l_returnflag", order, work_dir(spark, "children"))
    return out.select("l_returnflag", "l_orderkey", "l_linenumber", "position")
