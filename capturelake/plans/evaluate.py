"""Queries of the quality evaluation, and of merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.functions.text import split_sentences
from capturelake.operators import classify as C
from capturelake.operators import evaluate as Ev
from capturelake.operators import facts as K
from capturelake.operators.merge import latest_per_key, lww_merge
from capturelake.session import work_dir
from capturelake.sources.tables import read_jsonl

from .facts import sql_predicate
from .frames import frame
from .registry import query, step
from .structure import routed, stored_captures
from .text import SENTENCES, sql_dedupe_form
from .usage import text_ts


def _metrics_sql(src: str, labels: list[str]) -> str:
    values = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""SELECT label, tp, fp, fn, round(p, 4) AS "precision", round(r, 4) AS recall, round(f1, 4) AS f1, (SELECT count(*) FROM {src}) AS samples,
      (SELECT round(count(*) FILTER (WHERE expected = predicted) / count(*), 4) FROM {src}) AS accuracy, round(sum(f1) OVER () / {len(labels)}, 4) AS macro_f1
    FROM (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0::DOUBLE END AS f1 FROM (
      SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0::DOUBLE END AS r FROM (
        SELECT l.label, count(*) FILTER (WHERE predicted = label AND expected = label) AS tp, count(*) FILTER (WHERE predicted = label AND expected <> label) AS fp,
          count(*) FILTER (WHERE predicted <> label AND expected = label) AS fn FROM {src}, (VALUES {values}) AS l(i, label) GROUP BY l.label)))"""


step(
    "quality_gold",
    f"""SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS expected, CASE WHEN d.n_chars > 600 AND len({SENTENCES.format('d.text')}) > 4 THEN 'good' ELSE 'poor' END AS predicted
    FROM labels l JOIN documents d USING (doc_id)""",
)
step(
    "capture_gold",
    """SELECT capture_id, CASE CAST(capture_id AS BIGINT) % 12 WHEN 0 THEN 'task' WHEN 1 THEN 'task' WHEN 2 THEN 'task' WHEN 3 THEN 'journal' WHEN 4 THEN 'journal' WHEN 5 THEN 'learning' WHEN 6 THEN 'learning' ELSE 'thought' END AS expected,
      CASE WHEN is_task THEN 'task' ELSE note_type END AS predicted FROM routed""",
    ["routed"],
)


@query("eval_quality_classes", _metrics_sql("quality_gold", ["good", "poor"]), ["quality_gold"])
def eval_quality_classes(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    gold = frame(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("expected"),
        F.when((F.col("n_chars") > 600) & (F.size(split_sentences("text")) > 4), "good").otherwise("poor").alias("predicted"),
    )
    return Ev.class_metrics(gold, ["good", "poor"])


def capture_gold(spark, sf_dir):
    kind = F.col("capture_id").cast("bigint") % 12
    expected = F.when(kind <= 2, "task").when(kind <= 4, "journal").when(kind <= 6, "learning").otherwise("thought")
    predicted = F.when(F.col("is_task"), "task").otherwise(F.col("note_type"))
    return routed(spark, sf_dir).select(expected.alias("expected"), predicted.alias("predicted"))


@query("eval_classes", _metrics_sql("capture_gold", ["task", "journal", "learning", "thought"]), ["capture_gold"])
def eval_classes(spark, sf_dir):
    return Ev.class_metrics(capture_gold(spark, sf_dir), ["task", "journal", "learning", "thought"])


@query("eval_gold_lines", _metrics_sql("capture_gold", ["task", "journal", "learning", "thought"]), ["capture_gold"])
def eval_gold_lines(spark, sf_dir):
    """The same with the gold rows in a file of JSON lines: text, input_type and expected_label."""
    path = work_dir(spark, "gold")
    kind = F.col("capture_id").cast("bigint") % 12
    expected = F.when(kind <= 2, "task").when(kind <= 4, "journal").when(kind <= 6, "learning").otherwise("thought")
    gold = stored_captures(spark, sf_dir).select(F.col("raw_text").alias("text"), "input_type", expected.alias("expected_label"))
    gold.write.json(path)
    rows = read_jsonl(spark, path, "text string, input_type string, expected_label string")
    judged = C.classify(rows, text="text").select(F.col("expected_label").alias("expected"), C.predicted_label().alias("predicted"))
    return Ev.class_metrics(judged, ["task", "journal", "learning", "thought"])


step(
    "fact_gold",
    f"""SELECT l.doc_id, CASE WHEN l.quality = 1 THEN 'mentions' ELSE 'tested' END AS expected_predicate, CASE WHEN l.toxic = 1 THEN 'e' ELSE '' END AS object_contains,
      ({SENTENCES.format('d.text')}) AS sents FROM labels l JOIN documents d USING (doc_id)""",
)
step(
    "gold_facts",
    f"""SELECT * FROM (SELECT *, {sql_predicate('s')} AS p FROM (SELECT doc_id, expected_predicate, object_contains, unnest(sents) AS s, generate_subscripts(sents, 1) AS i FROM fact_gold))
    QUALIFY row_number() OVER (PARTITION BY doc_id, p, {sql_dedupe_form('s')} ORDER BY i) = 1""",
    ["fact_gold"],
)
FACT_METRICS = f"""SELECT (SELECT count(*) FROM fact_gold) AS samples,
  round((SELECT count(DISTINCT doc_id) FROM gold_facts WHERE p = expected_predicate) / (SELECT count(*) FROM fact_gold), 4) AS predicate_precision,
  round((SELECT count(DISTINCT doc_id) FROM gold_facts WHERE p = expected_predicate AND contains(lower(s), object_contains)) / (SELECT count(*) FROM fact_gold), 4) AS object_match_rate,
  round(((SELECT count(*) FROM gold_facts) - (SELECT count(*) FROM (SELECT DISTINCT p, {sql_dedupe_form('s')} FROM gold_facts))) / (SELECT count(*) FROM gold_facts), 4) AS duplicate_rate,
  (SELECT count(*) FROM gold_facts) AS facts_total"""


def fact_gold(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").select("doc_id", "text")
    none = F.lit(None).cast("string")
    gold = frame(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("note_id"),
        F.lit("thought").alias("note_type"),
        F.lit("").alias("title"),
        F.lit("").alias("summary"),
        F.col("text").alias("body"),
        *[none.alias(c) for c in ("occurred_at", "journal_date", "source_url")],
        *[F.lit(None).cast("int").alias(c) for c in ("mood_score", "energy_score")],
        F.when(F.col("quality") == 1, "mentions").otherwise("tested").alias("expected_predicate"),
        F.when(F.col("toxic") == 1, "e").otherwise("").alias("object_contains"),
    )
    return K.extract_note_facts(gold)


@query("eval_facts", FACT_METRICS, ["gold_facts"])
def eval_facts(spark, sf_dir):
    return Ev.fact_metrics(fact_gold(spark, sf_dir))


@query(
    "eval_gate",
    f"""SELECT *, captures_samples_ok AND facts_samples_ok AND macro_f1_ok AND predicate_ok AND duplicates_ok AS passed FROM (SELECT c.samples = 100 AS captures_samples_ok, f.samples = 100 AS facts_samples_ok,
      c.macro_f1 >= 0.80 AS macro_f1_ok, f.predicate_precision >= 0.85 AS predicate_ok, f.duplicate_rate <= 0.05 AS duplicates_ok
    FROM (SELECT samples, macro_f1 FROM ({_metrics_sql('capture_gold', ['task', 'journal', 'learning', 'thought'])}) LIMIT 1) c, ({FACT_METRICS}) f)""",
    ["capture_gold", "gold_facts"],
)
def eval_gate(spark, sf_dir):
    classes = Ev.class_metrics(capture_gold(spark, sf_dir), ["task", "journal", "learning", "thought"])
    return Ev.eval_gate(classes, Ev.fact_metrics(fact_gold(spark, sf_dir)))


# --- merges -------------------------------------------------------------------


@query(
    "lww_merge",
    """SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM (
      SELECT user_id, event_type, ts, 0 AS side FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
      UNION ALL SELECT user_id, event_type, ts, 1 FROM events WHERE event_type NOT IN ('click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, side DESC) = 1""",
)
def lww(spark, sf_dir):
    events = frame(spark, sf_dir, "events")
    local = latest_per_key(events.where("event_type IN ('click', 'view')"), ["user_id"], ["ts", "event_id"])
    incoming = latest_per_key(events.where("event_type NOT IN ('click')"), ["user_id"], ["ts", "event_id"])
    out = lww_merge(local, incoming, ["user_id"], "ts")
    return out.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(
    "latest_per_key",
    "SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY events.ts DESC, event_id DESC) = 1",
)
def latest(spark, sf_dir):
    out = latest_per_key(frame(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", text_ts("ts").alias("ts"))
