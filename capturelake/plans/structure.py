"""Queries over capture ingest, classification and structuring."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from capturelake.functions import pii as P
from capturelake.functions import text as T
from capturelake.operators import classify as C
from capturelake.operators import structure as S
from capturelake.operators.merge import insert_counts, insert_ignore
from capturelake.session import work_dir
from capturelake.sources.captures import ingest_captures, resolve_sources

from .frames import frame
from .pii import sql_score
from .registry import query, step
from .text import sql_clamp, sql_strip
from .usage import text_ts

AS_OF = datetime(2024, 6, 1, 0, 0, 0)
URL = "https?://[^\\s)>\"]+"
TASK = (
    "(?i)^\\s*(?:\\[[ xX]\\]|\\( \\)|todo|task|やること|宿題|next)\\b"
    "|(?:\\bTODO\\b|締切|期限|やる|対応する)"
)
LEARN = "(?i)(学び|学ん|気づ|理解|読んだ|記事|動画|learn|lesson|insight|knowledge)"
JOURNAL = "(?i)(今日|昨日|朝|夜|日記|振り返り|体調|気分|睡眠|mood|journal|diary)"
THOUGHT = "(?i)(考え|思考|悩み|仮説|不安|why|how|should|idea)"


def hit(text: str, pattern: str, weight: float) -> str:
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN {weight}::DOUBLE ELSE 0::DOUBLE END"


NO_URL = sql_strip(f"regexp_replace(raw_text, '{URL}', '', 'g')")
step(
    "stored_captures",
    f"SELECT *, 'src-' || source_detail AS source_id, {sql_score('raw_text')} AS pii_score FROM captures",
    ["captures"],
)
step(
    "scored",
    f"""SELECT *, CASE WHEN input_type = 'task' THEN 4.0::DOUBLE ELSE 0 END + {hit('raw_text', TASK, 2.6)} AS s_task,
      {hit('raw_text', JOURNAL, 1.8)} AS s_journal,
      CASE WHEN input_type = 'url' THEN 3.5::DOUBLE ELSE 0 END + {hit('raw_text', LEARN, 2.0)} + {hit('raw_text', URL, 1.2)}
        + CASE WHEN regexp_matches(raw_text, '{URL}') AND {NO_URL} = '' THEN 1.0::DOUBLE ELSE 0 END AS s_learning,
      {hit('raw_text', THOUGHT, 1.5)} + CASE WHEN length({sql_strip('raw_text')}) <= 6 THEN 0.9::DOUBLE ELSE 0 END
        + CASE WHEN contains(raw_text, '?') OR contains(raw_text, '？') THEN 0.35::DOUBLE ELSE 0 END AS s_thought
    FROM stored_captures""",
    ["stored_captures"],
)
step(
    "routed",
    """SELECT *, CASE WHEN status IN ('blocked','processed','archived') THEN 'skipped' WHEN pii_score >= 0.9 THEN 'blocked'
        WHEN is_task THEN 'task' ELSE 'note' END AS route
    FROM (SELECT *, s_task >= 2.2 AS is_task,
      CASE WHEN list_sort([s_journal, s_learning, s_thought])[3] - list_sort([s_journal, s_learning, s_thought])[2] <= 0.35::DOUBLE THEN 'thought'
        WHEN s_journal >= s_learning AND s_journal >= s_thought THEN 'journal' WHEN s_learning >= s_thought THEN 'learning' ELSE 'thought' END AS note_type
      FROM scored)""",
    ["scored"],
)


def stored_captures(spark, sf_dir):
    raw = frame(spark, sf_dir, "captures", spread=True)
    return raw.withColumn("source_id", F.concat(F.lit("src-"), "source_detail")).withColumn(
        "pii_score", P.pii_score("raw_text")
    )


def routed(spark, sf_dir):
    return S.route_captures(stored_captures(spark, sf_dir))


@query(
    "capture_ingest",
    f"""SELECT capture_id, CASE WHEN input_type <> 'quick' THEN input_type WHEN regexp_matches({sql_strip('raw_text')}, '{URL}') THEN 'url'
        WHEN regexp_matches({sql_strip('raw_text')}, '{TASK}') THEN 'task' ELSE 'note' END AS input_type,
      md5({sql_strip('raw_text')}) AS digest, strftime(coalesce(occurred_at, TIMESTAMP '2024-06-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS occurred_at,
      coalesce(pii_override, {sql_score(sql_strip('raw_text'))}) AS pii_score, 'new' AS status,
      CASE WHEN {sql_strip('raw_text')} = '' THEN 'no capture text' WHEN NOT (pii_override IS NULL OR pii_override BETWEEN 0 AND 1) THEN 'pii score out of range' END AS reject_reason
    FROM captures""",
    ["captures"],
)
def capture_ingest(spark, sf_dir):
    raw = frame(spark, sf_dir, "captures").withColumn("source_id", F.lit(None).cast("string"))
    raw = raw.withColumn("input_type", F.when(F.col("input_type") == "quick", "auto").otherwise(F.col("input_type")))
    out = ingest_captures(raw, AS_OF)
    return out.select(
        "capture_id",
        "input_type",
        F.md5("raw_text").alias("digest"),
        text_ts("occurred_at").alias("occurred_at"),
        "pii_score",
        "status",
        "reject_reason",
    )


step(
    "known_sources",
    """SELECT 'known-' || lang || '-' || source AS id, 'import' AS kind, CASE WHEN source = 'src0' THEN NULL ELSE source END AS detail,
      min(TIMESTAMP '2023-01-01 00:00:00' + to_minutes(CAST(doc_id AS INT))) AS created_at
    FROM documents WHERE lang <> 'en' AND source <> 'src3' GROUP BY lang, source""",
)


def known_sources(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").where("lang <> 'en' AND source <> 'src3'")
    return docs.groupBy("lang", "source").agg(
        F.min(F.expr("timestampadd(MINUTE, CAST(doc_id AS INT), TIMESTAMP_NTZ'2023-01-01 00:00:00')")).alias("created_at")
    ).select(
        F.concat(F.lit("known-"), "lang", F.lit("-"), "source").alias("id"),
        F.lit("import").alias("kind"),
        F.when(F.col("source") != "src0", F.col("source")).alias("detail"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )


step(
    "resolved",
    """SELECT c.capture_id, c.source_kind, c.source_detail,
      CASE WHEN c.input_type = 'url' THEN 'given-url' ELSE coalesce(k.id, sha256('source|' || c.source_kind || '|' || c.source_detail)) END AS source_id
    FROM captures c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY kind, coalesce(detail, '') ORDER BY created_at, id) AS rn FROM known_sources) k
      ON k.kind = c.source_kind AND coalesce(k.detail, '') = c.source_detail AND k.rn = 1""",
    ["captures", "known_sources"],
)


def _resolved(spark, sf_dir):
    raw = frame(spark, sf_dir, "captures").withColumn(
        "source_id", F.when(F.col("input_type") == "url", F.lit("given-url"))
    )
    return resolve_sources(raw, known_sources(spark, sf_dir), AS_OF)


@query("source_resolve", "SELECT capture_id, source_id FROM resolved", ["resolved"])
def source_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("capture_id", "source_id")


@query(
    "source_create",
    """SELECT source_id AS id, min(source_kind) AS kind, min(source_detail) AS detail FROM resolved
    WHERE source_id NOT IN (SELECT id FROM known_sources) GROUP BY source_id""",
    ["resolved"],
)
def source_create(spark, sf_dir):
    return _resolved(spark, sf_dir)[1].select("id", "kind", "detail")


@query(
    "capture_scores",
    "SELECT capture_id, round(s_task, 3) AS score_task, round(s_journal, 3) AS score_journal, round(s_learning, 3) AS score_learning, round(s_thought, 3) AS score_thought FROM scored",
    ["scored"],
)
def capture_scores(spark, sf_dir):
    out = C.classify(stored_captures(spark, sf_dir))
    return out.select("capture_id", *[f"score_{x}" for x in C.LABELS])


@query("capture_classes", "SELECT capture_id, is_task, note_type, route FROM routed", ["routed"])
def capture_classes(spark, sf_dir):
    return routed(spark, sf_dir).select("capture_id", "is_task", "note_type", "route")


WORDS = {
    "task": ["the", "and", "for"],
    "journal": ["der", "die", "und", "das"],
    "learning": ["le", "la", "les", "de", "un", "une", "que"],
    "thought": ["el", "los", "que"],
}
SEEN = "list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g'), ' '), lambda t: t <> ''))"


def _lemma_sql(label: str, bonus: list[str] | None = None) -> str:
    words = "[" + ", ".join(f"'{w}'" for w in WORDS[label]) + "]"
    out = f"least(len(list_intersect(seen, {words})), 5) * 0.55::DOUBLE"
    if bonus:
        out += f" + CASE WHEN list_has_any(seen, {bonus}) THEN 0.8::DOUBLE ELSE 0 END"
    return f"round({out}, 3) AS lemma_{label}"


@query(
    "lemma_scores",
    f"""SELECT doc_id, {_lemma_sql('task', ['to'])}, {_lemma_sql('journal', ['on'])}, {_lemma_sql('learning')}, {_lemma_sql('thought')}
    FROM (SELECT doc_id, {SEEN} AS seen FROM documents)""",
)
def lemma_scores(spark, sf_dir):
    spaced = F.regexp_replace(F.lower("text"), "[^0-9a-z]+", " ")
    docs = frame(spark, sf_dir, "documents").withColumn("lemmas", F.filter(F.split(spaced, " "), lambda t: t != ""))
    out = C.score_lemmas(docs, "lemmas", WORDS, time_lemmas=["on"], action_lemmas=["to"])
    return out.select("doc_id", *[F.round(f"lemma_{x}", 3).alias(f"lemma_{x}") for x in C.LABELS])


FIRST = "coalesce(list_filter(list_transform(regexp_split_to_array(raw_text, '\\n'), lambda s: " + sql_strip("s") + "), lambda s: s <> '')[1], '')"
PREFIX = "(?i)^\\s*(?:\\[[ xX]\\]|\\(\\s\\)|todo[:：]?\\s*|task[:：]?\\s*|やること[:：]?\\s*)"
step(
    "tasks",
    f"""SELECT sha256('task|' || capture_id) AS task_id, capture_id AS source_capture_id, NULL::VARCHAR AS source_note_id,
      {sql_clamp('t', 120)} AS title, raw_text AS details, 'todo' AS status, priority, NULL::VARCHAR AS due_at, NULL::VARCHAR AS scheduled_at, NULL::VARCHAR AS done_at,
      'extracted' AS source, sensitivity, TIMESTAMP '2024-06-01 00:00:00' AS created_at, TIMESTAMP '2024-06-01 00:00:00' AS updated_at, NULL::TIMESTAMP AS deleted_at
    FROM (SELECT *, CAST(coalesce(nullif(regexp_extract(raw_text, '\\b[pP]([1-4])\\b', 1), ''), '3') AS INTEGER) AS priority,
        coalesce(nullif({sql_strip(f"regexp_replace({FIRST}, '{PREFIX}', '')")}, ''), 'Untitled task') AS t FROM routed WHERE route = 'task')""",
    ["routed"],
)
step(
    "notes",
    f"""SELECT sha256('note|' || capture_id) AS note_id, capture_id AS source_capture_id, note_type, {sql_clamp('first_line', 120)} AS title,
      {sql_clamp('no_url', 160)} AS summary, raw_text AS body, occurred AS occurred_at,
      CASE WHEN note_type = 'journal' THEN substr(occurred, 1, 10) END AS journal_date,
      CASE WHEN note_type = 'journal' THEN CAST(nullif(regexp_extract(raw_text, '(?i)(?:mood|気分)\\s*[:：]?\\s*([1-5])', 1), '') AS INTEGER) END AS mood_score,
      CASE WHEN note_type = 'journal' THEN CAST(nullif(regexp_extract(raw_text, '(?i)(?:energy|元気|活力)\\s*[:：]?\\s*([1-5])', 1), '') AS INTEGER) END AS energy_score,
      CASE WHEN note_type = 'learning' THEN url END AS source_url, source_id, sensitivity, 'active' AS review_status,
      TIMESTAMP '2024-06-01 00:00:00' AS created_at, TIMESTAMP '2024-06-01 00:00:00' AS updated_at, NULL::TIMESTAMP AS deleted_at
    FROM (SELECT *, strftime(coalesce(occurred_at, created_at), '%Y-%m-%dT%H:%M:%SZ') AS occurred,
        nullif(regexp_extract(raw_text, '{URL}', 0), '') AS url, coalesce(nullif({FIRST}, ''), note_type || ' note') AS first_line,
        CASE WHEN regexp_matches(raw_text, '{URL}') THEN coalesce(nullif({NO_URL}, ''), raw_text) ELSE raw_text END AS no_url
      FROM routed WHERE route = 'note')""",
    ["routed"],
)
NOTE_OUT = "note_id, source_capture_id, note_type, title, summary, md5(body) AS body, occurred_at, journal_date, mood_score, energy_score, source_url, source_id, sensitivity"


def notes(spark, sf_dir):
    return S.to_notes(routed(spark, sf_dir), AS_OF)


def tasks(spark, sf_dir):
    return S.to_tasks(routed(spark, sf_dir), AS_OF)


def written_owners(spark, sf_dir):
    """(notes, tasks) of captures that are classified and written once, dealt by their id as the captures are."""
    path = work_dir(spark, "routed")
    routed(spark, sf_dir).write.partitionBy("route").parquet(path)
    stored = spark.read.parquet(path).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "capture_id")
    return S.to_notes(stored, AS_OF, stored=True), S.to_tasks(stored, AS_OF, stored=True)


@query("structured_notes", f"SELECT {NOTE_OUT} FROM notes", ["notes"])
def structured_notes(spark, sf_dir):
    return notes(spark, sf_dir).withColumn("body", F.md5("body")).select(
        *[c.split(" AS ")[-1] for c in NOTE_OUT.split(", ")]
    )


@query(
    "structured_tasks",
    "SELECT task_id, source_capture_id, title, md5(details) AS details, status, priority, source, sensitivity FROM tasks",
    ["tasks"],
)
def structured_tasks(spark, sf_dir):
    return tasks(spark, sf_dir).withColumn("details", F.md5("details")).select(
        "task_id", "source_capture_id", "title", "details", "status", "priority", "source", "sensitivity"
    )


@query(
    "capture_status",
    """SELECT capture_id, CASE route WHEN 'skipped' THEN status WHEN 'blocked' THEN 'blocked' ELSE 'processed' END AS status,
      CASE WHEN route = 'note' THEN sha256('note|' || capture_id) END AS parsed_note_id,
      CASE WHEN route = 'task' THEN sha256('task|' || capture_id) END AS parsed_task_id FROM routed""",
    ["routed"],
)
def capture_status(spark, sf_dir):
    out = S.mark_captures(routed(spark, sf_dir), AS_OF)
    return out.select("capture_id", "status", "parsed_note_id", "parsed_task_id")


COUNTS = """SELECT count(*) FILTER (WHERE route <> 'skipped') AS captures_processed, count(*) FILTER (WHERE route = 'note') AS notes_created,
  count(*) FILTER (WHERE route = 'task') AS tasks_created, count(*) FILTER (WHERE route = 'blocked') AS captures_blocked,
  count(*) FILTER (WHERE route = 'skipped') AS captures_skipped, CAST(0 AS BIGINT) AS errors, {dry} AS dry_run FROM routed"""


@query("structure_counts", COUNTS.format(dry="false"), ["routed"])
def structure_counts(spark, sf_dir):
    return S.structure_counts(routed(spark, sf_dir))


@query("structure_dry_run", COUNTS.format(dry="true"), ["routed"])
def structure_dry_run(spark, sf_dir):
    return S.structure_counts(routed(spark, sf_dir), dry_run=True)


@query(
    "structure_new_oldest",
    "SELECT capture_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT * FROM stored_captures WHERE status = 'new' ORDER BY created_at, capture_id LIMIT 200)",
    ["stored_captures"],
)
def structure_new_oldest(spark, sf_dir):
    out = S.new_captures(stored_captures(spark, sf_dir), limit=200)
    return out.select("capture_id", text_ts("created_at").alias("created_at"))


@query(
    "structure_rerun",
    """SELECT count(*) AS offered, count(*) FILTER (WHERE note_type = 'thought') AS inserted, count(*) FILTER (WHERE note_type <> 'thought') AS reused
    FROM notes""",
    ["notes"],
)
def structure_rerun(spark, sf_dir):
    """A second run over the notes that a first one wrote, of which the thoughts were soft-deleted since."""
    path = work_dir(spark, "notes")
    new = notes(spark, sf_dir)
    new.write.parquet(path)
    stored = spark.read.parquet(path)
    existing = stored.withColumn(
        "deleted_at", F.when(F.col("note_type") == "thought", F.col("created_at")).otherwise(F.col("deleted_at"))
    )
    return S.reuse_counts(S.flag_reuse(new, existing, "note_id"))


@query(
    "insert_ignore_counts",
    """SELECT (SELECT count(*) FROM lineitem) AS offered,
      (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))) AS inserted,
      (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'))) AS skipped""",
)
def insert_ignore_counts(spark, sf_dir):
    lines = frame(spark, sf_dir, "lineitem")
    done = frame(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    existing = lines.join(done, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")
    return insert_counts(lines, insert_ignore(existing, lines.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]))
