"""Queries over fact extraction and the fact tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions import scalars as SC
from capturelake.functions import text as T
from capturelake.functions.rx import explode_rows
from capturelake.operators import classify as C
from capturelake.operators import facts as K
from capturelake.session import work_dir

from .frames import frame
from .registry import query, step
from .structure import AS_OF, notes, tasks
from .text import SENTENCES, sentence_rows, sql_dedupe_form, sql_key, sql_strip
from .usage import text_ts

def sql_predicate(s: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({s}, '(?i){p}') THEN '{n}'" for p, n in R.PREDICATE_HINTS) + " ELSE 'mentions' END"


def sql_type(p: str, o: str) -> str:
    return (
        f"CASE WHEN {p} IN ('journal_date','due_at','scheduled_at','completed_at') OR regexp_matches({o}, '{R.DATE_TEXT}') THEN 'date' "
        f"WHEN {p} IN ('mood_score','energy_score','priority') OR (regexp_matches({o}, '{R.NUMBER_TEXT}') AND {sql_strip(o)} = regexp_extract({o}, '{R.NUMBER_TEXT}', 0)) THEN 'number' ELSE 'text' END"
    )


def sql_json(p: str, o: str) -> str:
    return (
        f"CASE WHEN {sql_type(p, o)} = 'number' THEN '{{\"value\": ' || "
        f"CAST(CAST(regexp_extract({o}, '{R.NUMBER_TEXT}', 0) AS DOUBLE) AS VARCHAR) || '}}' END"
    )


def _sentence_sql(subject: str, predicate: str, confidence: str, occurred: str, owner: str, source: str) -> str:
    return f"""SELECT {owner}, 100 + i AS ord, {subject} AS subject, p AS predicate, s AS object_text, {sql_type('p', 's')} AS object_type, {sql_json('p', 's')} AS object_json,
      s AS evidence_excerpt, {occurred} AS occurred_at, {confidence} AS confidence
    FROM (SELECT *, {predicate} AS p FROM (SELECT *, unnest(kept) AS s, generate_subscripts(kept, 1) AS i FROM {source}))"""


def _meta(owner: str, ord_: int, subject: str, predicate: str, value: str, kind: str, conf: float, occurred: str, where: str, source: str) -> str:
    json = f"'{{\"value\": ' || CAST({value} AS VARCHAR) || '}}'" if kind == "number" else "NULL::VARCHAR"
    return (
        f"SELECT {owner}, {ord_} AS ord, {subject} AS subject, '{predicate}' AS predicate, CAST({value} AS VARCHAR) AS object_text, "
        f"'{kind}' AS object_type, {json} AS object_json, NULL::VARCHAR AS evidence_excerpt, {occurred} AS occurred_at, {conf}::DOUBLE AS confidence FROM {source} WHERE {where}"
    )


def _dedupe(owner: str, source: str) -> str:
    return f"""SELECT * EXCLUDE (rn, k), row_number() OVER (PARTITION BY {owner} ORDER BY ord) AS k2 FROM (
      SELECT *, {sql_dedupe_form('object_text')} AS k, row_number() OVER (PARTITION BY {owner}, lower({sql_strip('subject')}), lower({sql_strip('predicate')}), {sql_dedupe_form('object_text')} ORDER BY ord) AS rn
      FROM {source} WHERE {sql_strip('object_text')} <> '') WHERE rn = 1"""


step(
    "note_sents",
    f"""SELECT *, {SENTENCES.format("title || chr(10) || summary || chr(10) || body")} AS sents,
      CAST(summary <> '' AS INT) + CAST(coalesce(source_url, '') <> '' AS INT) + CAST(note_type = 'journal' AND coalesce(journal_date, '') <> '' AS INT)
        + CAST(mood_score IS NOT NULL AS INT) + CAST(energy_score IS NOT NULL AS INT) AS n_meta FROM notes""",
    ["notes"],
)
step("note_kept", "SELECT *, sents AS kept FROM note_sents", ["note_sents"])
N = "note_kept"
step(
    "note_meta",
    " UNION ALL ".join(
        [
            _meta("note_id", 0, "'note:' || note_id", "summary", "summary", "text", 0.9, "occurred_at", "summary <> ''", N),
            _meta("note_id", 1, "'me'", "captured_source", "source_url", "text", 0.96, "occurred_at", "coalesce(source_url, '') <> ''", N),
            _meta("note_id", 2, "'me'", "journal_date", "journal_date", "date", 0.97, "occurred_at", "note_type = 'journal' AND coalesce(journal_date, '') <> ''", N),
            _meta("note_id", 3, "'me'", "mood_score", "mood_score", "number", 0.97, "occurred_at", "mood_score IS NOT NULL", N),
            _meta("note_id", 4, "'me'", "energy_score", "energy_score", "number", 0.97, "occurred_at", "energy_score IS NOT NULL", N),
        ]
    ),
    [N],
)
step(
    "note_candidates",
    "SELECT * FROM note_meta UNION ALL "
    + _sentence_sql("'me'", sql_predicate("s"), "CASE WHEN p = 'mentions' THEN 0.72::DOUBLE ELSE 0.82::DOUBLE END", "occurred_at", "note_id", N),
    ["note_meta"],
)
step("note_facts", _dedupe("note_id", "note_candidates"), ["note_candidates"])
step(
    "task_kept",
    f"SELECT *, ({SENTENCES.format('title || chr(10) || details')}) AS kept FROM tasks",
    ["tasks"],
)
step(
    "task_meta",
    _meta("task_id", 0, "'task:' || task_id", "status", "status", "text", 0.98, "NULL::VARCHAR", "true", "task_kept")
    + " UNION ALL "
    + _meta("task_id", 1, "'task:' || task_id", "priority", "priority", "number", 0.98, "NULL::VARCHAR", "true", "task_kept"),
    ["task_kept"],
)
step(
    "task_candidates",
    "SELECT * FROM task_meta UNION ALL "
    + _sentence_sql(
        "'task:' || task_id",
        f"CASE WHEN regexp_matches(s, '{R.BULLET}') THEN 'next_action' ELSE {sql_predicate('s')} END",
        "CASE WHEN p = 'next_action' THEN 0.84::DOUBLE WHEN p = 'mentions' THEN 0.72::DOUBLE ELSE 0.82::DOUBLE END",
        "NULL::VARCHAR",
        "task_id",
        "task_kept",
    ),
    ["task_meta"],
)
step("task_facts", _dedupe("task_id", "task_candidates"), ["task_candidates"])
step(
    "key_facts",
    f"""SELECT sha256('note|' || note_id || '|' || {sql_key('subject')} || '|' || predicate || '|' || {sql_key('object_text')}) AS fact_id, note_id, NULL::VARCHAR AS task_id, k2 - 1 AS ord,
      subject, predicate, object_text, object_type, object_json, evidence_excerpt, occurred_at, confidence FROM note_facts
    UNION ALL SELECT sha256('task|' || task_id || '|' || {sql_key('subject')} || '|' || predicate || '|' || {sql_key('object_text')}), NULL, task_id, k2 - 1,
      subject, predicate, object_text, object_type, object_json, evidence_excerpt, occurred_at, confidence FROM task_facts""",
    ["note_facts", "task_facts"],
)
COLS = [
    "subject", "predicate", "object_text", "object_type", "object_json", "evidence_excerpt", "occurred_at", "confidence",
]


def note_facts(spark, sf_dir):
    return K.fact_rows(K.extract_note_facts(notes(spark, sf_dir)), "note")


def task_facts(spark, sf_dir):
    return K.fact_rows(K.extract_task_facts(tasks(spark, sf_dir)), "task")


def key_facts(spark, sf_dir):
    return note_facts(spark, sf_dir).unionByName(task_facts(spark, sf_dir))


def owners_facts(of_notes, of_tasks):
    """Facts of notes and tasks that are there already."""
    return K.fact_rows(K.extract_note_facts(of_notes), "note").unionByName(K.fact_rows(K.extract_task_facts(of_tasks), "task"))


@query("fact_notes", f"SELECT note_id, CAST(ord AS INTEGER) AS ord, {', '.join(COLS)} FROM key_facts WHERE note_id IS NOT NULL", ["key_facts"])
def fact_notes(spark, sf_dir):
    return note_facts(spark, sf_dir).select("note_id", "ord", *COLS)


@query("fact_tasks", f"SELECT task_id, CAST(ord AS INTEGER) AS ord, {', '.join(COLS)} FROM key_facts WHERE task_id IS NOT NULL", ["key_facts"])
def fact_tasks(spark, sf_dir):
    return task_facts(spark, sf_dir).select("task_id", "ord", *COLS)


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TOKEN_WORD = "struct_pack(surface := w, lemma := lower(w), pos := CASE WHEN length(w) > 3 THEN '名詞' WHEN length(w) > 2 THEN '動詞' ELSE '助詞' END)"
LEMMA_BRANCH = " ".join(f"WHEN list_has_any(lem, {_sql_list(ws)}) THEN '{n}'" for n, ws in R.PREDICATE_LEMMAS.items())
LEMMA_WORDS = "CASE p " + " ".join(f"WHEN '{n}' THEN {_sql_list(ws)}" for n, ws in R.PREDICATE_LEMMAS.items()) + " ELSE [] END"
step(
    "token_sents",
    f"""SELECT note_id, occurred_at, s, i, toks, list_transform(toks, lambda t: t.lemma) AS lem FROM (
      SELECT *, list_transform(string_split(s, ' '), lambda w: {TOKEN_WORD}) AS toks FROM (
        SELECT note_id, occurred_at, unnest(kept) AS s, generate_subscripts(kept, 1) AS i FROM note_kept)) WHERE NOT (len(toks) = 1 AND length(s) < 10)""",
    ["note_kept"],
)
step(
    "token_verdicts",
    f"""SELECT *, coalesce(list_position(list_transform(lem, lambda l: list_contains({LEMMA_WORDS}, l)), true), 0) AS hit FROM (
      SELECT *, CASE WHEN hinted <> 'mentions' THEN hinted {LEMMA_BRANCH} ELSE 'mentions' END AS p FROM (SELECT *, {sql_predicate('s')} AS hinted FROM token_sents))""",
    ["token_sents"],
)
TOKEN_JOIN = "array_to_string(list_transform(list_filter({0}, lambda t: t.pos IN ({1}) AND NOT list_contains({2}, t.lemma)), lambda t: t.surface), '')"
step(
    "token_candidates",
    f"""SELECT * FROM note_meta UNION ALL SELECT note_id, 100 + i AS ord, 'me' AS subject, p AS predicate, o AS object_text, {sql_type('p', 'o')} AS object_type, {sql_json('p', 'o')} AS object_json,
      s AS evidence_excerpt, occurred_at, CASE WHEN hinted <> 'mentions' THEN 0.82::DOUBLE WHEN p <> 'mentions' THEN 0.79::DOUBLE ELSE 0.72::DOUBLE END AS confidence
    FROM (SELECT *, CASE WHEN length({sql_strip('words')}) >= 2 THEN {sql_strip('words')} ELSE s END AS o FROM (
      SELECT *, coalesce(nullif({TOKEN_JOIN.format('near', "'名詞','形容詞','動詞'", _sql_list(['', *R.STOP_LEMMAS]))}, ''), {TOKEN_JOIN.format('toks', "'名詞'", _sql_list(R.STOP_LEMMAS))}) AS words FROM (
        SELECT *, CASE WHEN hit > 0 THEN toks[greatest(hit - 4, 1):least(len(toks), hit + 4)] ELSE toks END AS near FROM token_verdicts)))""",
    ["note_meta", "token_verdicts"],
)
step("token_facts", _dedupe("note_id", "token_candidates"), ["token_candidates"])


def words_as_tokens(sentences):
    """The words of each sentence as tokens: the lemma is the word in lower case, the kind goes by its length."""

    def token(w):
        kind = F.when(F.length(w) > 3, "名詞").when(F.length(w) > 2, "動詞").otherwise("助詞")
        return F.struct(w.alias("surface"), F.lower(w).alias("lemma"), kind.alias("pos"))

    return F.transform(sentences, lambda s: F.transform(F.split(s, " "), token))


@query(
    "fact_notes_tokens", f"SELECT note_id, CAST(k2 - 1 AS INTEGER) AS ord, {', '.join(COLS)} FROM token_facts", ["token_facts"]
)
def fact_notes_tokens(spark, sf_dir):
    """Facts of notes whose sentences come with tokens."""
    found = K.extract_note_facts(notes(spark, sf_dir), tokenize=words_as_tokens)
    return K.fact_rows(found, "note").select("note_id", "ord", *COLS)


@query(
    "fact_meta",
    "SELECT note_id, predicate, object_text, object_type, object_json, confidence FROM note_meta",
    ["note_meta"],
)
def fact_meta(spark, sf_dir):
    rows = notes(spark, sf_dir).select("note_id", F.explode(K.note_meta_facts()).alias("f"))
    return rows.select("note_id", "f.predicate", "f.object_text", "f.object_type", "f.object_json", "f.confidence")


@query(
    "fact_sentences",
    f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, p AS predicate, CASE WHEN p = 'mentions' THEN 0.72::DOUBLE ELSE 0.82::DOUBLE END AS confidence,
      sentence AS object_text, {sql_type('p', 'sentence')} AS object_type, {sql_json('p', 'sentence')} AS object_json
    FROM (SELECT *, {sql_predicate('sentence')} AS p FROM sentence_rows)""",
    ["sentence_rows"],
)
def fact_sentences(spark, sf_dir):
    rows = sentence_rows(spark, sf_dir).withColumn("v", C.detect_predicate("sentence"))
    obj = K.object_text("sentence")
    return rows.select(
        "doc_id",
        "idx",
        "v.predicate",
        "v.confidence",
        obj.alias("object_text"),
        SC.object_type("v.predicate", obj).alias("object_type"),
        SC.object_json("v.predicate", obj).alias("object_json"),
    )


@query(
    "fact_predicate_lemmas",
    """SELECT doc_id, CAST(idx AS INTEGER) AS idx,
      CASE WHEN regexp_matches(sentence, '(?i)test') THEN 'tested' WHEN list_has_any(lem, ['the','and']) THEN 'english' WHEN list_has_any(lem, ['le','la','les']) THEN 'french' ELSE 'mentions' END AS predicate,
      CASE WHEN regexp_matches(sentence, '(?i)test') THEN 0.82::DOUBLE WHEN list_has_any(lem, ['the','and','le','la','les']) THEN 0.79::DOUBLE ELSE 0.72::DOUBLE END AS confidence
    FROM (SELECT *, list_transform(string_split(sentence, ' '), lambda t: lower(trim(t))) AS lem FROM sentence_rows)""",
    ["sentence_rows"],
)
def fact_predicate_lemmas(spark, sf_dir):
    rows = sentence_rows(spark, sf_dir).withColumn("lem", F.split("sentence", " "))
    verdict = C.detect_predicate(
        "sentence", "lem", hints=[("(test)", "tested")], lexicon={"english": ["the", "and"], "french": ["le", "la", "les"]}
    )
    return rows.withColumn("v", verdict).select("doc_id", "idx", "v.predicate", "v.confidence")


@query(
    "fact_dedupe",
    f"""SELECT doc_id, CAST(idx AS INTEGER) AS ord, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k2 FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_dedupe_form('sentence')} ORDER BY idx) AS rn FROM sentence_rows) WHERE rn = 1)""",
    ["sentence_rows"],
)
def fact_dedupe(spark, sf_dir):
    facts = sentence_rows(spark, sf_dir).select(
        "doc_id",
        F.col("idx").alias("ord"),
        F.lit("me").alias("subject"),
        F.lit("mentions").alias("predicate"),
        F.col("sentence").alias("object_text"),
    )
    return K.dedupe_facts(facts, "doc_id").select("doc_id", "ord", F.col("object_text").alias("sentence"))


@query(
    "fact_dedupe_array",
    f"""SELECT doc_id, CAST(k2 - 1 AS INTEGER) AS ord, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k2 FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_dedupe_form('sentence')} ORDER BY idx) AS rn FROM sentence_rows) WHERE rn = 1)""",
    ["sentence_rows"],
)
def fact_dedupe_array(spark, sf_dir):
    """In-row form, over all sentences of a document."""
    none = F.lit(None).cast("string")
    docs = frame(spark, sf_dir, "documents").withColumn(
        "facts",
        K.dedupe_array(
            F.transform(
                T.split_sentences("text"),
                lambda s: K.make_fact(F.lit("me"), F.lit("mentions"), s, F.lit("text"), none, none, none, F.lit(0.72)),
            )
        ),
    )
    return explode_rows(docs, "facts", "doc_id").select("doc_id", "ord", F.col("item.object_text").alias("sentence"))


@query(
    "fact_valid",
    f"""SELECT doc_id, CASE WHEN n_chars / 10000.0::DOUBLE NOT BETWEEN 0 AND 1 THEN 'confidence out of range'
      WHEN {sql_strip('text')} = '' THEN 'object_text is empty' WHEN length(text) > 1000 THEN 'object_text too long'
      WHEN length(text) > 500 THEN 'evidence_excerpt too long' END AS reason FROM documents""",
)
def fact_valid(spark, sf_dir):
    facts = frame(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("subject"),
        F.col("lang").alias("predicate"),
        F.col("text").alias("object_text"),
        F.lit("text").alias("object_type"),
        F.col("text").alias("evidence_excerpt"),
        (F.col("n_chars") / 10000.0).alias("confidence"),
    )
    return K.validate_facts(facts, length_limits=True).select("doc_id", "reason")


def _owners(spark, sf_dir):
    owners = frame(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("note_id"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate")).alias("deleted_at"),
    )
    facts = frame(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("note_id"),
        F.col("l_shipdate").alias("updated_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at"),
    )
    return owners, facts


CHANGED = """SELECT o_orderkey AS note_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at FROM orders o WHERE o_orderpriority <> '1-URGENT' AND (
  NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag <> 'R')
  OR o_orderdate > coalesce((SELECT max(l_shipdate) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey), TIMESTAMP '1970-01-01 00:00:00'))"""


@query("fact_changed_owners", CHANGED)
def fact_changed_owners(spark, sf_dir):
    out = K.changed_owners(*_owners(spark, sf_dir), "note_id")
    return out.select("note_id", text_ts("updated_at").alias("updated_at"))


@query("fact_changed_newest", CHANGED + " ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def fact_changed_newest(spark, sf_dir):
    out = K.changed_owners(*_owners(spark, sf_dir), "note_id", limit=200)
    return out.select("note_id", text_ts("updated_at").alias("updated_at"))


def written_facts(spark, sf_dir, found=None):
    """The run's facts, extracted and written once; the table before the run derives from them too."""
    path = work_dir(spark, "facts")
    (key_facts(spark, sf_dir) if found is None else found).write.parquet(path)
    return spark.read.parquet(path)


def _stored_facts(found):
    """The fact table after an earlier run that stored the surer note facts;
    summaries were deleted since."""
    facts = found.where("note_id IS NOT NULL AND confidence > 0.8")
    return facts.withColumn("updated_at", SC.at(AS_OF)).withColumn(
        "deleted_at", F.when(F.col("predicate") == "summary", SC.at(AS_OF))
    )


INSERT = """SELECT fact_id FROM key_facts WHERE confidence >= 0.75 AND NOT (note_id IS NOT NULL AND confidence > 0.8 AND predicate <> 'summary')"""


@query("fact_insert", INSERT, ["key_facts"])
def fact_insert(spark, sf_dir):
    found = written_facts(spark, sf_dir)
    return K.insert_facts(_stored_facts(found), found, 0.75)[0].select("fact_id")


@query(
    "fact_insert_counts",
    f"SELECT count(i.fact_id) AS facts_inserted, count(*) - count(i.fact_id) AS facts_skipped FROM key_facts k LEFT JOIN ({INSERT}) i USING (fact_id)",
    ["key_facts"],
)
def fact_insert_counts(spark, sf_dir):
    found = written_facts(spark, sf_dir)
    return K.insert_facts(_stored_facts(found), found, 0.75)[1]


@query(
    "fact_replace",
    """SELECT fact_id, CASE WHEN predicate = 'summary' THEN '2024-06-01 00:00:00' WHEN n.note_type = 'journal' THEN '2024-07-01 00:00:00' END AS deleted_at
    FROM key_facts k JOIN notes n USING (note_id) WHERE confidence > 0.8""",
    ["key_facts", "notes"],
)
def fact_replace(spark, sf_dir):
    owners = notes(spark, sf_dir).where("note_type = 'journal'")
    out = K.replace_facts(_stored_facts(written_facts(spark, sf_dir)), owners, "note_id", AS_OF.replace(month=7))
    return out.select("fact_id", text_ts("deleted_at").alias("deleted_at"))


@query(
    "fact_run_metrics",
    """SELECT (SELECT count(*) FROM notes) + (SELECT count(*) FROM tasks) AS items_processed, count(*) FILTER (WHERE confidence >= 0.7) AS facts_inserted,
      count(*) FILTER (WHERE confidence < 0.7) AS facts_skipped, CAST(0 AS BIGINT) AS facts_replaced, CAST(0 AS BIGINT) AS errors, 'rules-v1' AS extractor_version FROM key_facts""",
    ["key_facts", "notes", "tasks"],
)
def fact_run_metrics(spark, sf_dir):
    facts = K.fact_rows(K.extract_note_facts(notes(spark, sf_dir)), "note", outer=True).unionByName(
        K.fact_rows(K.extract_task_facts(tasks(spark, sf_dir)), "task", outer=True)
    )
    empty = facts.where(F.lit(False)).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return K.fact_run_metrics(K.flag_inserts(empty, facts))


@query(
    "fact_responses",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS ord, lang AS subject, sentence AS object_text, 0.8::DOUBLE AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, {sql_dedupe_form('sentence')} ORDER BY idx) AS rn FROM sentence_rows) WHERE rn = 1""",
    ["sentence_rows"],
)
def fact_responses(spark, sf_dir):
    """Facts of a model payload with one fact per sentence."""
    item = F.transform(
        T.split_sentences("text"),
        lambda s: F.struct(F.concat(F.lit(" "), "lang").alias("subject"), F.lit("mentions").alias("predicate"), s.alias("object_text")),
    )
    bare = F.to_json(item)
    content = F.when(F.col("lang") == "en", bare).otherwise(F.to_json(F.struct(item.alias("facts"))))
    out = K.facts_from_responses(frame(spark, sf_dir, "documents").withColumn("content", content))
    rows = explode_rows(out, "facts", "doc_id")
    return rows.select("doc_id", "ord", "item.subject", "item.object_text", "item.confidence")
