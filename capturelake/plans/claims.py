"""Queries over the claim job, claim reads, rollups and claim revisions.

Responses are derived from documents: one chat response per document with
one claim per sentence of its whole text, plus broken members and bodies.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions import scalars as SC
from capturelake.functions import text as T
from capturelake.functions.rx import explode_rows, let
from capturelake.operators import claim_store as CS
from capturelake.operators import claims as C
from capturelake.operators import search as S
from capturelake.session import work_dir

from .frames import frame
from .registry import STEPS, query, step
from .structure import AS_OF
from .text import SENTENCES, sql_strip
from .usage import text_ts

PREDICATES = ["did", "felt", "chose", "happened", "learned", "planned", "mentions", "teleported"]
CLAUSES = "。会議に行った、資料を準備した、会議に行った。"
RAW = f"CASE WHEN lang = 'de' THEN text || '{CLAUSES}' WHEN lang = 'en' AND doc_id % 3 = 0 THEN text || ' because of the storm' ELSE text END"
ERROR = (
    "CASE doc_id % 19 WHEN 3 THEN 'http_error' WHEN 4 THEN 'network_error' WHEN 5 THEN 'parse_error' WHEN 6 THEN 'parse_error' "
    "ELSE CASE WHEN doc_id % 23 = 1 THEN 'broken_content' ELSE 'none' END END"
)


def _pick(index, values):
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), index.cast("int"))


def documents(spark, sf_dir, spread=False):
    return frame(spark, sf_dir, "documents", spread).select(
        "doc_id",
        "lang",
        "source",
        "text",
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("doc_id").cast("string").alias("entry_id"),
        F.expr(RAW).alias("raw_text"),
        F.lit("2024-02-02T00:00:00Z").alias("occurred_at_utc"),
        F.expr(ERROR).alias("error_kind"),
        F.concat(F.lit("x-"), F.col("doc_id").cast("string")).alias("extraction_id"),
    )


def response_content(docs):
    """The JSON text a model would return for each document."""
    d, lang, source = F.col("doc_id"), F.col("lang"), F.col("source")

    def claim(s, i, dimensions):
        return F.struct(
            _pick(i % 4, [F.lit(" I "), F.lit("me"), F.lit("Team"), source]).alias("subject_text"),
            _pick((d + i) % 8, [F.lit(p) for p in PREDICATES]).alias("predicate"),
            s.alias("object_text_raw"),
            F.when(i % 9 == 8, F.lit("   "))
            .when(i % 10 == 3, F.concat(F.lit("throat condition "), s))
            .when(i % 10 == 5, F.lit("improved a bit"))
            .otherwise(s)
            .alias("object_text_canonical"),
            F.when(i % 3 == 0, "none").otherwise("actor").alias("me_role"),
            F.when((d % 7 == 0) & (i == 0), F.lit("bogus")).otherwise(_pick(i % 5, [F.lit(m) for m in R.MODALITIES])).alias("modality"),
            F.when(i % 4 == 3, "negate").otherwise("affirm").alias("polarity"),
            F.when((d % 17 == 0) & (i == 1), F.lit(1.5)).otherwise((i % 11) / F.lit(10.0)).alias("certainty"),
            F.when(i % 2 == 0, F.concat(F.lit("2024-01-1"), (i % 7).cast("string"), F.lit("T00:00:00Z"))).alias("time_start_utc"),
            F.lit(None).cast("string").alias("time_end_utc"),
            F.when(i % 6 == 0, lang).alias("subject_entity_name"),
            F.when(i % 3 == 0, F.concat(F.lit("source:"), source)).alias("object_entity_name"),
            dimensions.alias("dimensions"),
            F.when(i % 6 == 5, F.array().cast("array<struct<char_start:int,char_end:int,excerpt:string>>"))
            .otherwise(
                F.array(
                    F.struct(
                        (i - 1).cast("int").alias("char_start"),
                        F.when(d % 11 == 0, i - 2).otherwise(i + F.length(s)).cast("int").alias("char_end"),
                        F.when((lang == "de") & (i == 2), F.lit("雨が降った")).otherwise(s).alias("excerpt"),
                    )
                )
            )
            .alias("evidence_spans"),
        )

    sents = T.split_sentences("text")
    # what is the same for all claims of a document is computed once
    dimensions = F.array(
        _dim(F.lit("topic"), lang, 0.9, "llm"),
        _dim(F.lit("topic"), F.upper(lang), 0.5, "llm"),
        _dim(F.lit("place"), source, 0.4, "rule"),
        _dim(F.lit("mood"), source, 0.4, "rule"),
        _dim(F.lit("place"), source, 1.4, "rule"),
    )
    made = let(dimensions, lambda dims: F.transform(sents, lambda s, i: claim(s, i, dims)))
    claims = F.when(d % 13 == 0, F.slice(made, 1, 0)).otherwise(made)
    none = F.array().cast("array<string>")
    entities = F.array(
        _entity(F.concat(F.lit("source:"), source), "concept", F.array(source, F.upper(source), F.lit("  "))),
        _entity(lang, "place", none),
        _entity(lang, "galaxy", none),
        _entity(lang, "concept", F.array(F.concat(F.lit("lang "), lang))),
    )
    links = F.array(
        _link(0, 1, "supports", 0.8),
        _link(0, 1, "supports", 0.6),
        F.when(d % 5 == 0, _link(1, 0, "caused_by", 0.9)).otherwise(_link(1, 0, "follow_up", 0.9)),
        _link(0, 100000, "supports", 0.5),
        _link(0, 1, "likes", 0.5),
    )
    return F.to_json(F.struct(claims.alias("claims"), entities.alias("entities"), links.alias("links")))


def _dim(kind, value, confidence, source):
    return F.struct(
        kind.alias("dimension_type"), value.alias("dimension_value"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source")
    )


def _entity(name, kind, aliases):
    return F.struct(name.alias("name"), F.lit(kind).alias("entity_type"), aliases.alias("aliases"))


def _link(a, b, kind, confidence):
    return F.struct(
        F.lit(a).alias("from_claim_index"), F.lit(b).alias("to_claim_index"), F.lit(kind).alias("relation_type"), F.lit(confidence).alias("confidence")
    )


def responses(spark, sf_dir):
    """Chat responses as a provider returns them, with transport failures."""
    d = F.col("doc_id")
    docs = documents(spark, sf_dir, spread=True)
    content = F.when(F.col("error_kind") == "broken_content", F.lit('{"claims": [')).otherwise(response_content(docs))
    usage = F.struct(
        F.length("text").alias("prompt_tokens"),
        (d % 50).alias("completion_tokens"),
        F.struct((d % 100).alias("cached_tokens")).alias("prompt_tokens_details"),
        F.struct((d % 10).alias("reasoning_tokens")).alias("completion_tokens_details"),
    )

    def body(message_content):
        choice = F.struct(F.struct(message_content.alias("content")).alias("message"))
        return F.to_json(F.struct(F.concat(F.lit("resp-"), d.cast("string")).alias("id"), F.array(choice).alias("choices"), usage.alias("usage")))

    half = F.floor(F.length("_content") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit("text").alias("type"), F.substring(F.col("_content"), F.lit(1), half).alias("text")),
        F.struct(F.lit("text").alias("type"), F.substring(F.col("_content"), half + 1, F.length("_content")).alias("text")),
    )
    return docs.withColumn("_content", content).select(
        *docs.columns,
        _pick(d % 4, [F.lit("gpt-4.1-mini"), F.lit("gpt-4o-mini-2024-07-18"), F.lit("gpt-4.1"), F.lit("unlisted-model")]).alias("model"),
        F.when(F.col("error_kind") == "http_error", 500).otherwise(200).alias("http_status"),
        F.when(F.col("error_kind") == "http_error", "server error").alias("http_detail"),
        F.when(F.col("error_kind") == "network_error", F.when(d % 2 == 0, "read timed out").otherwise("connection refused")).alias("network_error"),
        F.when(F.col("error_kind").isin("http_error", "network_error"), F.lit(None))
        .when(d % 19 == 5, F.lit("not json"))
        .when(d % 19 == 6, F.lit('{"id": "resp-empty", "choices": []}'))
        .when(d % 4 == 1, body(parts))
        .otherwise(body(F.col("_content")))
        .alias("body"),
    )


def parsed(spark, sf_dir):
    """Bundles of the responses as received; a failed one has no claims."""
    return C.bundles_from_responses(SC.unwrap_responses(responses(spark, sf_dir)))


def usable(spark, sf_dir):
    """The same bundles without the transport detour, for queries that start
    from parsed content; the failures are excluded by their kind."""
    docs = documents(spark, sf_dir, spread=True).where("error_kind = 'none'")
    return C.bundles_from_responses(docs.withColumn("content", response_content(docs)))


def gated(spark, sf_dir):
    return C.quality_gate(C.normalize_bundles(usable(spark, sf_dir)))


# --- the same in SQL ----------------------------------------------------------

step("claim_docs", f"SELECT *, CAST(doc_id AS VARCHAR) AS document_id, {RAW} AS raw_text, {ERROR} AS error_kind FROM documents")
step(
    "parsed_claims",
    f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx FROM (
      SELECT d.doc_id, d.lang, d.source, d.raw_text, s.idx AS i,
        CASE s.idx % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'me' WHEN 2 THEN 'Team' ELSE d.source END AS subject_text,
        ({PREDICATES})[CAST((d.doc_id + s.idx) % 8 AS INT) + 1] AS predicate, s.sentence AS raw_obj,
        CASE WHEN s.idx % 9 = 8 THEN '' WHEN s.idx % 10 = 3 THEN 'throat condition ' || s.sentence WHEN s.idx % 10 = 5 THEN 'improved a bit' ELSE s.sentence END AS canonical,
        CASE WHEN s.idx % 3 = 0 THEN 'none' ELSE 'actor' END AS me_role,
        CASE WHEN d.doc_id % 7 = 0 AND s.idx = 0 THEN 'bogus' ELSE (['fact','plan','hypothesis','request','feeling'])[CAST(s.idx % 5 AS INT) + 1] END AS modality,
        CASE WHEN s.idx % 4 = 3 THEN 'negate' ELSE 'affirm' END AS polarity,
        CASE WHEN d.doc_id % 17 = 0 AND s.idx = 1 THEN 1.5::DOUBLE ELSE (s.idx % 11) / 10.0::DOUBLE END AS certainty,
        CASE WHEN s.idx % 2 = 0 THEN '2024-01-1' || CAST(s.idx % 7 AS VARCHAR) || 'T00:00:00Z' END AS time_start,
        CASE WHEN s.idx % 6 = 0 THEN d.lang END AS subject_entity_name, CASE WHEN s.idx % 3 = 0 THEN 'source:' || d.source END AS object_entity_name,
        CASE WHEN d.doc_id % 11 <> 0 AND s.idx >= 1 THEN CAST(s.idx - 1 AS INTEGER) END AS char_start, CASE WHEN d.doc_id % 11 <> 0 AND s.idx >= 1 THEN CAST(s.idx + length(s.sentence) AS INTEGER) END AS char_end,
        CASE WHEN d.lang = 'de' AND s.idx = 2 THEN '雨が降った' ELSE s.sentence END AS excerpt
      FROM claim_docs d JOIN sentence_rows s USING (doc_id) WHERE d.error_kind = 'none' AND d.doc_id % 13 <> 0 AND s.idx % 6 <> 5)
    WHERE predicate <> 'teleported' AND modality <> 'bogus' AND certainty <= 1 AND canonical <> ''""",
    ["claim_docs", "sentence_rows"],
)
step(
    "me_claims",
    f"""SELECT doc_id, lang, source, raw_text, idx, CASE WHEN lower(subject_text) IN ('i', 'me') THEN 'me' ELSE subject_text END AS subject_text, predicate, raw_obj,
      CASE WHEN regexp_matches(raw_text, '[ぁ-んァ-ヶ一-龠]') AND regexp_matches(excerpt, '[ぁ-んァ-ヶ一-龠]') THEN excerpt ELSE canonical END AS canonical,
      CASE WHEN lower(subject_text) IN ('i', 'me') AND me_role = 'none' THEN 'experiencer' ELSE me_role END AS me_role, modality, polarity, certainty, coalesce(time_start, '2024-02-02T00:00:00Z') AS time_start,
      subject_entity_name, object_entity_name, 3 AS n_dims, char_start, char_end, excerpt FROM parsed_claims
    UNION ALL SELECT doc_id, lang, source, raw_text, 0, 'me', 'experienced', {sql_strip('raw_text')}, {sql_strip('raw_text')}, 'experiencer', 'fact', 'affirm', 0.5::DOUBLE,
      '2024-02-02T00:00:00Z', NULL, NULL, 0, NULL, NULL, {sql_strip('raw_text')} FROM claim_docs WHERE error_kind = 'none' AND doc_id NOT IN (SELECT doc_id FROM parsed_claims)""",
    ["parsed_claims"],
)
TOPIC = "nullif(regexp_extract(canonical, '(?i)(喉(?:の調子)?|のど|体調|熱|咳|頭痛|胃|声|鼻|睡眠|気分|疲労|sore throat|throat|condition|health)', 1), '')"
NEEDS = "(regexp_matches(canonical, '(?i)(悪化|改善|回復|低下|上昇|不調|悪く|良く|崩れ|しんど|痛|つら|worsen|improv|recover)') AND length(canonical) <= 24)"
step(
    "complete_claims",
    f"""SELECT * REPLACE (CASE WHEN topic IS NULL AND {NEEDS} AND latest IS NOT NULL AND NOT contains(canonical, latest) THEN latest || 'が' || canonical ELSE canonical END AS canonical) FROM (
      SELECT *, last_value(topic IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (SELECT *, {TOPIC} AS topic FROM me_claims))""",
    ["me_claims"],
)
MATCH = "regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '[。、！？・,.;:()（）「」『』\"''`]', '', 'g')"
step(
    "clause_rows",
    f"""SELECT d.doc_id, lang, source, raw_text, clause, n, row_number() OVER (PARTITION BY d.doc_id ORDER BY n) - 1 AS k FROM claim_docs d, (VALUES (0, '会議に行った'), (1, '資料を準備した')) AS v(n, clause)
    WHERE d.lang = 'de' AND d.error_kind = 'none' AND NOT EXISTS (SELECT 1 FROM complete_claims c WHERE c.doc_id = d.doc_id AND contains({MATCH.format('c.canonical')}, {MATCH.format('clause')}))""",
    ["complete_claims"],
)
step("doc_sizes", "SELECT doc_id, count(*) AS n FROM complete_claims GROUP BY doc_id", ["complete_claims"])
step(
    "augmented",
    """SELECT doc_id, lang, source, raw_text, idx, subject_text, predicate, raw_obj, canonical, me_role, modality, polarity, certainty, time_start, subject_entity_name, object_entity_name, n_dims, char_start, char_end, excerpt FROM complete_claims
    UNION ALL SELECT c.doc_id, lang, source, raw_text, s.n + k, 'me', 'did', clause, clause, 'actor', 'fact', 'affirm', 0.68::DOUBLE, '2024-02-02T00:00:00Z', NULL, NULL, 0, NULL, NULL, clause FROM clause_rows c JOIN doc_sizes s USING (doc_id)""",
    ["clause_rows", "doc_sizes"],
)
step(
    "stated_links",
    """SELECT d.doc_id, f AS from_idx, t AS to_idx, rel AS relation_type, conf AS confidence, ord FROM claim_docs d JOIN doc_sizes s USING (doc_id),
      (VALUES (0, 0, 1, 'supports', 0.8::DOUBLE), (1, 0, 1, 'supports', 0.6::DOUBLE), (2, 1, 0, 'caused_by', 0.9::DOUBLE), (3, 1, 0, 'follow_up', 0.9::DOUBLE)) AS v(ord, f, t, rel, conf)
    WHERE s.n > 1 AND (rel = 'supports' OR (rel = 'caused_by') = (d.doc_id % 5 = 0))""",
    ["doc_sizes"],
)
step(
    "causes",
    """SELECT a.doc_id, min(idx) FILTER (WHERE predicate NOT IN ('chose','ended','decided') AND (predicate IN ('happened','experienced','was_affected_by') OR regexp_matches(canonical, '(?i)(rain|雨)'))) AS cause,
      bool_or(predicate IN ('happened','experienced','was_affected_by')) AS has_event, count(*) FILTER (WHERE predicate IN ('chose','ended','decided')) AS n_dec, count(*) AS n,
      coalesce(bool_or(predicate IN ('chose','ended','decided') AND idx = 1 AND a.doc_id % 5 = 0 AND (SELECT s.n FROM doc_sizes s WHERE s.doc_id = a.doc_id) > 1), false) AS stated,
      bool_or(regexp_matches(raw_text, '(?i)(rain|雨)') OR regexp_matches(raw_text, '(?i)(because|due to|ので|から|ため|せいで)')) AS hint
    FROM augmented a GROUP BY a.doc_id""",
    ["augmented"],
)
step(
    "final_links",
    """SELECT doc_id, from_idx, to_idx, relation_type, confidence FROM stated_links
    UNION ALL SELECT a.doc_id, idx, cause, 'caused_by', 0.75::DOUBLE FROM augmented a JOIN causes c USING (doc_id) WHERE predicate IN ('chose','ended','decided') AND NOT stated AND cause IS NOT NULL
    UNION ALL SELECT a.doc_id, idx, n, 'caused_by', 0.72::DOUBLE FROM augmented a JOIN causes c USING (doc_id) WHERE predicate IN ('chose','ended','decided') AND NOT has_event AND hint""",
    ["stated_links", "causes"],
)
step(
    "final_claims",
    """SELECT * FROM augmented UNION ALL SELECT d.doc_id, lang, source, raw_text, n, 'context', 'happened', raw_text, raw_text, 'none', 'fact', 'affirm', 0.7::DOUBLE, '2024-02-02T00:00:00Z', NULL, NULL, 0, NULL, NULL, raw_text
    FROM claim_docs d JOIN causes c USING (doc_id) WHERE n_dec > 0 AND NOT has_event AND hint""",
    ["augmented", "causes"],
)
STORED_SQL = "sha256('claim|' || CAST({d} AS VARCHAR) || '|x-' || CAST({d} AS VARCHAR) || '|' || CAST({i} AS VARCHAR))"
step(
    "stored_claims",
    f"""SELECT {STORED_SQL.format(d='doc_id', i='idx')} AS claim_id, CAST(doc_id AS VARCHAR) AS document_id, doc_id, idx, lang, source, subject_text, predicate, raw_obj, canonical, me_role, modality, polarity, certainty,
      CAST(replace(replace(time_start, 'T', ' '), 'Z', '') AS TIMESTAMP) AS time_start, n_dims,
      CASE WHEN subject_entity_name IS NOT NULL THEN sha256('entity|concept|' || subject_entity_name) END AS subject_entity_id,
      CASE WHEN object_entity_name IS NOT NULL THEN sha256('entity|concept|' || object_entity_name) END AS object_entity_id, char_start, char_end, excerpt FROM final_claims""",
    ["final_claims"],
)


@query(
    "response_unwrap",
    """SELECT doc_id, CASE WHEN doc_id % 19 = 5 THEN 'invalid json' WHEN doc_id % 19 = 6 THEN 'missing choices' WHEN error_kind IN ('http_error','network_error') THEN 'invalid json' END AS unwrap_error,
      CASE WHEN doc_id % 19 = 6 THEN 'resp-empty' WHEN doc_id % 19 NOT IN (3,4,5) THEN 'resp-' || CAST(doc_id AS VARCHAR) END AS response_id,
      CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0 ELSE length(text) END AS input_tokens, CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0 ELSE doc_id % 100 END AS cached_input_tokens,
      CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0 ELSE doc_id % 50 END AS output_tokens, CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0 ELSE doc_id % 10 END AS reasoning_output_tokens FROM claim_docs""",
    ["claim_docs"],
)
def response_unwrap(spark, sf_dir):
    out = SC.unwrap_responses(responses(spark, sf_dir))
    return out.select(
        "doc_id", "unwrap_error", "response_id", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"
    )


def logged(spark, sf_dir):
    opened = SC.unwrap_responses(responses(spark, sf_dir))
    broken = F.when(F.try_parse_json("content").isNull(), "content is not json")
    errors = C.classify_errors(opened.withColumn("parse_error", F.coalesce("unwrap_error", broken)), "parse_error")
    return SC.request_cost(errors)


ERRORS = """SELECT doc_id, CASE WHEN error_kind = 'network_error' AND doc_id % 2 = 0 THEN 'timeout' WHEN error_kind <> 'none' THEN 'error' ELSE 'ok' END AS request_status,
      CASE WHEN error_kind = 'none' THEN NULL WHEN error_kind = 'broken_content' THEN 'parse_error' ELSE error_kind END AS error_type,
      CASE error_kind WHEN 'http_error' THEN '500 server error' WHEN 'network_error' THEN CASE WHEN doc_id % 2 = 0 THEN 'read timed out' ELSE 'connection refused' END
        WHEN 'broken_content' THEN 'content is not json' WHEN 'parse_error' THEN CASE WHEN doc_id % 19 = 5 THEN 'invalid json' ELSE 'missing choices' END END AS error_message FROM claim_docs"""


@query("response_errors", ERRORS, ["claim_docs"])
def response_errors(spark, sf_dir):
    return logged(spark, sf_dir).select("doc_id", "request_status", "error_type", "error_message")


REQUEST_LOG = """SELECT CAST(doc_id AS VARCHAR) AS source_ref_id, CASE WHEN error_kind = 'network_error' AND doc_id % 2 = 0 THEN 'timeout' WHEN error_kind <> 'none' THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0 ELSE length(text) END AS input_tokens, CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0 ELSE length(text) + doc_id % 50 END AS total_tokens,
      CASE WHEN doc_id % 19 IN (3,4,5,6) THEN 0::DOUBLE ELSE CAST(CASE doc_id % 4
        WHEN 0 THEN round((CAST(length(text) - least(doc_id % 100, length(text)) AS DECIMAL(13,0)) * 0.40::DECIMAL(12,6) + CAST(least(doc_id % 100, length(text)) AS DECIMAL(13,0)) * 0.10::DECIMAL(12,6) + CAST(doc_id % 50 AS DECIMAL(13,0)) * 1.60::DECIMAL(12,6)) * 0.000001::DECIMAL(7,6), 6)
        WHEN 1 THEN round((CAST(length(text) - least(doc_id % 100, length(text)) AS DECIMAL(13,0)) * 0.15::DECIMAL(12,6) + CAST(least(doc_id % 100, length(text)) AS DECIMAL(13,0)) * 0.075::DECIMAL(12,6) + CAST(doc_id % 50 AS DECIMAL(13,0)) * 0.60::DECIMAL(12,6)) * 0.000001::DECIMAL(7,6), 6)
        WHEN 2 THEN round((CAST(length(text) - least(doc_id % 100, length(text)) AS DECIMAL(13,0)) * 2.00::DECIMAL(12,6) + CAST(least(doc_id % 100, length(text)) AS DECIMAL(13,0)) * 0.50::DECIMAL(12,6) + CAST(doc_id % 50 AS DECIMAL(13,0)) * 8.00::DECIMAL(12,6)) * 0.000001::DECIMAL(7,6), 6)
        ELSE 0 END AS DOUBLE) END AS request_cost_usd FROM claim_docs"""


@query("response_request_log", REQUEST_LOG, ["claim_docs"])
def response_request_log(spark, sf_dir):
    log = C.request_log(logged(spark, sf_dir))
    return log.select(
        "source_ref_id", "status", "input_tokens", "total_tokens", F.col("request_cost_usd").cast("double").alias("request_cost_usd")
    )


MODEL_SQL = "(['gpt-4.1-mini','gpt-4o-mini-2024-07-18','gpt-4.1','unlisted-model'])[CAST(doc_id % 4 AS INT) + 1]"
# a double of whole millionths as JSON writes it: plain from a thousandth on, else with an exponent
COST_TEXT = """CASE WHEN micros = 0 THEN '0.0' WHEN micros >= 1000 THEN CAST(micros / 1000000.0::DOUBLE AS VARCHAR)
  ELSE substr(CAST(micros AS VARCHAR), 1, 1) || '.' || coalesce(nullif(rtrim(substr(CAST(micros AS VARCHAR), 2), '0'), ''), '0') || 'E-' || CAST(7 - length(CAST(micros AS VARCHAR)) AS VARCHAR) END"""
step(
    "response_costs",
    f"""SELECT d.*, l.input_tokens, doc_id % 50 AS output_tokens, CAST(round(l.request_cost_usd * 1000000) AS BIGINT) AS micros, e.error_type, e.error_message
    FROM claim_docs d JOIN ({REQUEST_LOG}) l ON l.source_ref_id = d.document_id
      JOIN ({ERRORS}) e USING (doc_id)""",
    ["claim_docs"],
)
ARTIFACTS = f"""SELECT 'x-' || CAST(doc_id AS VARCHAR) AS extraction_id, a.kind AS artifact_type, sha256(a.body) AS sha256, '2024-07-01 00:00:00' AS expires_at
    FROM (SELECT doc_id, unnest([struct_pack(kind := 'prompt_meta', body := '{{"input_chars":' || CAST(length(raw_text) AS VARCHAR) || ',"model":"' || {MODEL_SQL} || '"}}'),
      CASE WHEN error_type IS NULL THEN struct_pack(kind := 'response_meta', body := '{{"input_tokens":' || CAST(input_tokens AS VARCHAR) || ',"openai_request_id":"resp-' || CAST(doc_id AS VARCHAR)
          || '","output_tokens":' || CAST(output_tokens AS VARCHAR) || ',"request_cost_usd":' || {COST_TEXT} || '}}')
        ELSE struct_pack(kind := 'validation_error', body := '{{"detail":"' || error_message || '","error_type":"' || error_type || '"}}') END]) AS a FROM response_costs)"""


@query("response_artifacts", ARTIFACTS, ["response_costs"])
@query("response_artifacts_all", ARTIFACTS, ["response_costs"])
def response_artifacts_all(spark, sf_dir):
    return C.artifacts(logged(spark, sf_dir), AS_OF).withColumn("expires_at", text_ts("expires_at"))


CLAIM_OUT = [
    "subject_text", "predicate", "me_role", "modality", "polarity", "certainty",
]


def _claim_rows(b):
    rows = explode_rows(b, "claims", "doc_id", ord_name="idx", item="c")
    return rows.select(
        "doc_id",
        "idx",
        *[F.col(f"c.{c}").alias(c) for c in CLAIM_OUT],
        F.md5("c.object_text_raw").alias("raw_obj"),
        F.md5("c.object_text_canonical").alias("canonical"),
        F.col("c.time_start_utc").alias("time_start"),
        F.size("c.dimensions").alias("n_dims"),
        F.col("c.evidence_spans")[0]["char_start"].alias("char_start"),
        F.col("c.evidence_spans")[0]["char_end"].alias("char_end"),
        F.md5(F.col("c.evidence_spans")[0]["excerpt"]).alias("excerpt"),
    )


def _claims_sql(src: str, dims: str = "CAST(n_dims AS INTEGER)") -> str:
    return f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, {', '.join(CLAIM_OUT)}, md5(raw_obj) AS raw_obj, md5(canonical) AS canonical, time_start, {dims} AS n_dims,
      char_start, char_end, md5(excerpt) AS excerpt FROM {src}"""


@query("claim_parse", _claims_sql("parsed_claims", "3"), ["parsed_claims"])
def claim_parse(spark, sf_dir):
    return _claim_rows(parsed(spark, sf_dir))


@query("claim_me_centric", _claims_sql("me_claims"), ["me_claims"])
def claim_me_centric(spark, sf_dir):
    return _claim_rows(C.fallback_claims(C.me_centric(usable(spark, sf_dir))))


@query("claim_context", _claims_sql("complete_claims"), ["complete_claims"])
def claim_context(spark, sf_dir):
    return _claim_rows(C.complete_context(C.fallback_claims(C.me_centric(usable(spark, sf_dir)))))


@query("claim_augmented", _claims_sql("augmented"), ["augmented"])
def claim_augmented(spark, sf_dir):
    return _claim_rows(C.augment_claims(C.complete_context(C.fallback_claims(C.me_centric(usable(spark, sf_dir))))))


@query("claim_normalised", _claims_sql("final_claims"), ["final_claims"])
def claim_normalised(spark, sf_dir):
    return _claim_rows(gated(spark, sf_dir))


@query(
    "claim_links",
    "SELECT doc_id, CAST(from_idx AS INTEGER) AS from_idx, CAST(to_idx AS INTEGER) AS to_idx, relation_type, confidence FROM final_links",
    ["final_links"],
)
def claim_links(spark, sf_dir):
    rows = explode_rows(gated(spark, sf_dir), "links", "doc_id", item="k")
    return rows.select("doc_id", "k.from_idx", "k.to_idx", "k.relation_type", "k.confidence")


@query(
    "claim_retry",
    """SELECT doc_id, CASE WHEN error_kind = 'none' THEN 'succeeded' ELSE 'queued' END AS status, CASE WHEN error_kind <> 'none' THEN '2024-06-01 00:05:00' END AS next_retry_at FROM claim_docs""",
    ["claim_docs"],
)
def claim_retry(spark, sf_dir):
    opened = SC.unwrap_responses(responses(spark, sf_dir))
    b = C.bundles_from_responses(opened)
    failed = F.coalesce("unwrap_error", "parse_error")
    ok = C.quality_gate(C.normalize_bundles(b.withColumn("parse_error", failed)))
    out = C.retry_status(ok, AS_OF)
    return out.select("doc_id", "status", text_ts("next_retry_at").alias("next_retry_at"))


@query(
    "claim_gate",
    """SELECT doc_id, count(*) FILTER (WHERE sentence NOT LIKE '%e%') AS kept, coalesce(string_agg('claim_rejected:' || CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE sentence LIKE '%e%'), '') AS flags,
      CAST(count(*) FILTER (WHERE sentence NOT LIKE '%e%' AND nxt NOT LIKE '%e%') AS INTEGER) AS links FROM (SELECT *, lead(sentence) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt FROM sentence_rows) GROUP BY doc_id""",
    ["sentence_rows"],
)
def claim_gate(spark, sf_dir):
    """Gate over one claim per sentence, blank where the sentence has an e."""
    text = F.lit("x")
    rows = documents(spark, sf_dir).withColumn("_s", T.split_sentences("text"))
    b = (
        rows.where(F.size("_s") > 0)
        .withColumn(
            "claims",
            F.transform(
                "_s",
                lambda s: C.made_claim(
                    "me", F.lit("did"), F.when(s.contains("e"), F.lit(" ")).otherwise(s), "actor", F.lit("fact"), F.lit(0.5), text, text
                ),
            ),
        )
        .withColumn(
            "links",
            F.transform(
                "_s",
                lambda s, i: C.record(C.LINK, from_idx=i, to_idx=i + 1, relation_type=F.lit("supports"), confidence=F.lit(0.5)),
            ),
        )
    )
    out = C.quality_gate(b)
    return out.select(
        "doc_id",
        F.size("claims").cast("bigint").alias("kept"),
        F.array_join("quality_flags", ",").alias("flags"),
        F.size("links").alias("links"),
    )


step("turn_forms", f"SELECT conv_id, turn, list_transform({SENTENCES.format('text')}, lambda s: {MATCH.format('s')}) AS s FROM conversations")


@query(
    "claim_coverage",
    f"""SELECT conv_id, turn, len(list_filter(f, lambda c: c)) AS n_covered, len(f) AS n_clauses FROM (
      SELECT a.conv_id, a.turn, list_transform(a.s, lambda c: len(list_filter(b.s, lambda t: contains(c, t) OR contains(t, c)
        OR len(list_intersect(g(c), g(t))) / greatest(least(len(g(c)), len(g(t))), 1) >= 0.55)) > 0) AS f
      FROM turn_forms a JOIN turn_forms b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)""".replace(
        "g(c)", "list_distinct(list_transform(generate_series(1, length(c) - 1), lambda i: substr(c, i, 2)))"
    ).replace("g(t)", "list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, i, 2)))"),
    ["turn_forms"],
)
def claim_coverage(spark, sf_dir):
    """Which sentences of a turn does the next turn of its thread cover?"""
    turns = frame(spark, sf_dir, "conversations").select("conv_id", "turn", T.split_sentences("text").alias("sents"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("sents").alias("texts"))
    out = C.covered_clauses(turns.join(nxt, ["conv_id", "turn"]), "sents", "texts")
    return out.select(
        "conv_id",
        "turn",
        F.size(F.filter("covered", lambda c: c)).cast("bigint").alias("n_covered"),
        F.size("covered").cast("bigint").alias("n_clauses"),
    )


PLANS = "。次は本を読むつもり、会議に行った、次は本を読むつもりだ。"
step(
    "plan_docs",
    f"SELECT doc_id, {sql_strip('text')} AS clause, regexp_matches(text, '(?i){R.PLAN_HINT}') AND length({sql_strip('text')}) >= 4 AS own FROM documents",
)


@query(
    "claim_plan_clauses",
    """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS idx, predicate, modality, certainty, md5(clause) AS canonical FROM (
      SELECT doc_id, 0 AS k, 'planned' AS predicate, 'plan' AS modality, 0.72::DOUBLE AS certainty, clause FROM plan_docs WHERE own
      UNION ALL SELECT doc_id, 1, 'planned', 'plan', 0.72, '次は本を読むつもり' FROM plan_docs UNION ALL SELECT doc_id, 2, 'did', 'fact', 0.68, '会議に行った' FROM plan_docs)""",
    ["plan_docs"],
)
def claim_plan_clauses(spark, sf_dir):
    """Clauses that tell a plan or an action, of documents without claims."""
    docs = documents(spark, sf_dir).withColumn("raw_text", F.concat(F.coalesce("text", F.lit("")), F.lit(PLANS)))
    none = F.array().cast(f"array<{C.CLAIM}>")
    rows = explode_rows(C.augment_claims(docs.withColumn("claims", none)), "claims", "doc_id", ord_name="idx", item="c")
    return rows.select("doc_id", "idx", "c.predicate", "c.modality", "c.certainty", F.md5("c.object_text_canonical").alias("canonical"))


ALIAS_SQL = "CASE WHEN predicate <> 'teleported' THEN predicate " + " ".join(
    f"WHEN regexp_matches('teleported ' || raw_obj, '(?i){p}') THEN '{n}'" for p, n in R.PREDICATE_ALIASES
) + " ELSE 'mentions' END"
step("aliased_claims", STEPS["parsed_claims"][1].replace("predicate <> 'teleported' AND ", ""), STEPS["parsed_claims"][0])


@query(
    "claim_parse_aliases",
    f"SELECT doc_id, CAST(idx AS INTEGER) AS idx, {ALIAS_SQL} AS predicate, md5(raw_obj) AS raw_obj FROM aliased_claims",
    ["aliased_claims"],
)
def claim_parse_aliases(spark, sf_dir):
    """Claims of all predicates, unknown ones mapped by the alias rules before any is dropped."""
    b = C.bundles_from_responses(SC.unwrap_responses(responses(spark, sf_dir)), map_aliases=True)
    rows = explode_rows(b, "claims", "doc_id", ord_name="idx", item="c")
    return rows.select("doc_id", "idx", "c.predicate", F.md5("c.object_text_raw").alias("raw_obj"))


@query(
    "claim_evidence_made",
    f"""SELECT doc_id, CAST(s.idx AS INTEGER) AS idx, md5(CASE WHEN s.idx % 2 = 0 THEN s.sentence WHEN {sql_strip("coalesce(d.text, '')")} <> '' THEN {sql_strip("d.text")} ELSE s.sentence END) AS excerpt, NULL::INTEGER AS char_start
    FROM sentence_rows s JOIN documents d USING (doc_id)""",
    ["sentence_rows"],
)
def claim_evidence_made(spark, sf_dir):
    """Every second claim comes without evidence and gets the text, or else its object."""
    none = F.lit(None)

    def claim(s, i):
        spans = F.when(i % 2 == 0, F.array(C.record(C.SPAN, char_start=none, char_end=none, excerpt=s))).otherwise(F.array().cast(f"array<{C.SPAN}>"))
        made = C.made_claim("me", F.lit("did"), s, "actor", F.lit("fact"), F.lit(0.5), none.cast("string"), s)
        return made.withField("evidence_spans", spans)

    docs = documents(spark, sf_dir).withColumn("raw_text", F.col("text"))
    b = docs.withColumn("claims", F.transform(T.split_sentences("text"), claim))
    rows = explode_rows(C.me_centric(b), "claims", "doc_id", ord_name="idx", item="c")
    span = F.col("c.evidence_spans")[0]
    return rows.select("doc_id", "idx", F.md5(span["excerpt"]).alias("excerpt"), span["char_start"].alias("char_start"))


@query(
    "claim_parse_old_format",
    f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS idx, md5(sentence) AS raw_obj, md5(sentence) AS canonical, 'none' AS me_role, 0 AS n_dims,
      CAST(1 + idx % 4 AS INTEGER) AS n_spans FROM sentence_rows WHERE idx < 24""",
    ["sentence_rows"],
)
def claim_parse_old_format(spark, sf_dir):
    """Responses of the older format: one spelling of the object, no roles, and its limits (a fixed part of the format)."""

    def claim(s, i):
        span = F.struct(s.alias("excerpt"))
        many = F.transform(F.sequence(F.lit(0), F.when(i % 4 == 3, 6).otherwise(i % 4)), lambda k: span)
        return F.struct(
            F.lit("me").alias("subject_text"), F.lit("did").alias("predicate"), s.alias("object_text"), F.lit("other").alias("object_text_canonical"),
            F.lit("fact").alias("modality"), F.lit("affirm").alias("polarity"), F.lit("0.5").alias("certainty"), many.alias("evidence_spans"),
        )

    content = F.to_json(F.struct(F.transform(T.split_sentences("text"), claim).alias("claims")))
    b = C.bundles_from_responses(documents(spark, sf_dir).withColumn("content", content), caps=C.V1_CAPS)
    rows = explode_rows(b, "claims", "doc_id", ord_name="idx", item="c")
    return rows.select(
        "doc_id", "idx", F.md5("c.object_text_raw").alias("raw_obj"), F.md5("c.object_text_canonical").alias("canonical"), "c.me_role",
        F.size("c.dimensions").alias("n_dims"), F.size("c.evidence_spans").alias("n_spans"),
    )


def bundle(spark, sf_dir):
    return C.write_bundle(gated(spark, sf_dir), AS_OF)


_written: dict[tuple[str, str, str], str] = {}


def _once(spark, sf_dir, name, write, first=""):
    """Folder of tables that an application writes once from a table folder, as a claim job would store them.

    Written again where its table ``first`` is gone.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _written:
        try:
            spark.read.parquet(_written[key] + first)
            return _written[key]
        except AnalysisException:
            del _written[key]
    path = work_dir(spark, name)
    write(path)
    _written[key] = path
    return path


def stored_bundle(spark, sf_dir):
    """Child tables over gated bundles that were written once.

    For queries that read several of them, as stored claims would be.
    """
    kept = ["document_id", "entry_id", "extraction_id", "claims", "entities", "links"]
    path = _once(spark, sf_dir, "bundles", lambda p: gated(spark, sf_dir).select(*kept).write.option("compression", CS.PACKED).parquet(p))
    return C.write_bundle(spark.read.parquet(path), AS_OF)


def claims_table(spark, sf_dir):
    """The claims of the stored bundles as a table that was written once.

    For queries that join claims with claims, so that ids, entity types and positions are not made again for each side.
    """
    path = _once(spark, sf_dir, "claims", lambda p: stored_bundle(spark, sf_dir)["claims"].write.option("compression", CS.PACKED).parquet(p))
    return spark.read.parquet(path)


def claim_store(spark, sf_dir):
    """Folder of the stored claims, their grams and children."""

    def write(path):
        b = stored_bundle(spark, sf_dir)
        # the claims are read once for all their feedback
        told = [(0, "revise", AS_OF), (1, "supersede", AS_OF.replace(day=2))]
        rows = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(action).alias("action"), SC.at(t).alias("created_at")) for k, action, t in told])
        feedback = b["claims"].where("predicate = 'chose'").select("claim_id", F.inline(rows))
        children = {"spans": b["spans"], "dimensions": b["dimensions"], "feedback": feedback}
        CS.write_claim_store(b["claims"], doc_table(spark, sf_dir), children, path)

    return _once(spark, sf_dir, "claim-store", write, "/claims")


@query(
    "claim_bundle",
    """SELECT claim_id, document_id, subject_text, predicate, md5(canonical) AS canonical, subject_entity_id, object_entity_id, strftime(time_start, '%Y-%m-%d %H:%M:%S') AS time_start FROM stored_claims""",
    ["stored_claims"],
)
def claim_bundle(spark, sf_dir):
    return bundle(spark, sf_dir)["claims"].select(
        "claim_id", "document_id", "subject_text", "predicate", F.md5("object_text_canonical").alias("canonical"),
        "subject_entity_id", "object_entity_id", text_ts("time_start_utc").alias("time_start"),
    )


step(
    "stored_dims",
    """SELECT claim_id, 'topic' AS dimension_type, lang AS dimension_value, lower(lang) AS normalized_value, 0.9::DOUBLE AS confidence, 'llm' AS source, 0 AS ord FROM stored_claims WHERE n_dims > 0
    UNION ALL SELECT claim_id, 'place', source, lower(source), 0.4::DOUBLE, 'rule', 1 FROM stored_claims WHERE n_dims > 0""",
    ["stored_claims"],
)


@query(
    "claim_dimensions",
    "SELECT claim_id, dimension_type, dimension_value, normalized_value, confidence, source FROM stored_dims",
    ["stored_dims"],
)
def claim_dimensions(spark, sf_dir):
    return bundle(spark, sf_dir)["dimensions"].select(
        "claim_id", "dimension_type", "dimension_value", "normalized_value", "confidence", "source"
    )


@query("claim_spans", "SELECT claim_id, char_start, char_end, md5(excerpt) AS excerpt FROM stored_claims", ["stored_claims"])
def claim_spans(spark, sf_dir):
    return bundle(spark, sf_dir)["spans"].select("claim_id", "char_start", "char_end", F.md5("excerpt").alias("excerpt"))


step(
    "stored_links",
    f"""SELECT {STORED_SQL.format(d='doc_id', i='from_idx')} AS from_claim_id, {STORED_SQL.format(d='doc_id', i='to_idx')} AS to_claim_id, relation_type, confidence, doc_id
    FROM final_links QUALIFY row_number() OVER (PARTITION BY doc_id, from_idx, to_idx, relation_type ORDER BY confidence DESC) = 1""",
    ["final_links"],
)


@query("claim_link_rows", "SELECT from_claim_id, to_claim_id, relation_type, confidence FROM stored_links", ["stored_links"])
def claim_link_rows(spark, sf_dir):
    return bundle(spark, sf_dir)["links"].select("from_claim_id", "to_claim_id", "relation_type", "confidence")


@query(
    "claim_counts",
    """SELECT c.document_id, CAST(count(*) AS INTEGER) AS claims_inserted, CAST(count(*) AS INTEGER) AS evidence_inserted, 3 AS entities_upserted,
      CAST(coalesce((SELECT count(*) FROM stored_links k WHERE CAST(k.doc_id AS VARCHAR) = c.document_id), 0) AS INTEGER) AS links_inserted FROM stored_claims c GROUP BY c.document_id""",
    ["stored_claims", "stored_links"],
)
def claim_counts(spark, sf_dir):
    return C.bundle_counts(gated(spark, sf_dir))


step(
    "entity_mentions",
    """SELECT doc_id, 0 AS ord, 'concept' AS entity_type, 'source:' || source AS canonical_name FROM claim_docs WHERE error_kind = 'none'
    UNION ALL SELECT doc_id, 1, 'place', lang FROM claim_docs WHERE error_kind = 'none' UNION ALL SELECT doc_id, 2, 'concept', lang FROM claim_docs WHERE error_kind = 'none'""",
    ["claim_docs"],
)


def _known_entities(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("lang").distinct().select(
        F.lit("place").alias("entity_type"), F.col("lang").alias("canonical_name"), F.concat(F.lit("old-"), "lang").alias("entity_id")
    )


def _mentions(spark, sf_dir):
    return C.entity_rows(usable(spark, sf_dir))


@query(
    "entity_resolve",
    "SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(ord AS INTEGER) AS ord, CASE WHEN entity_type = 'place' THEN 'old-' || canonical_name ELSE sha256('entity|' || entity_type || '|' || canonical_name) END AS entity_id FROM entity_mentions",
    ["entity_mentions"],
)
def entity_resolve(spark, sf_dir):
    mapped, _ = C.resolve_entities(_mentions(spark, sf_dir), _known_entities(spark, sf_dir), AS_OF)
    return mapped.select("document_id", "ord", "entity_id")


@query(
    "entity_upsert",
    "SELECT DISTINCT entity_type, canonical_name, sha256('entity|' || entity_type || '|' || canonical_name) AS entity_id FROM entity_mentions WHERE entity_type <> 'place'",
    ["entity_mentions"],
)
def entity_upsert(spark, sf_dir):
    _, created = C.resolve_entities(_mentions(spark, sf_dir), _known_entities(spark, sf_dir), AS_OF)
    return created.select("entity_type", "canonical_name", "entity_id")


@query(
    "entity_aliases",
    """SELECT DISTINCT sha256('entity|concept|' || canonical_name) AS entity_id, CASE WHEN ord = 0 THEN substr(canonical_name, 8) ELSE 'lang ' || canonical_name END AS alias,
      lower(CASE WHEN ord = 0 THEN substr(canonical_name, 8) ELSE 'lang ' || canonical_name END) AS normalized_alias FROM entity_mentions WHERE ord <> 1""",
    ["entity_mentions"],
)
def entity_aliases(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    empty = mentions.select("entity_id", F.lit("").alias("normalized_alias")).where(F.lit(False))
    return C.upsert_aliases(mentions, empty)


@query(
    "entity_aliases_known",
    """SELECT DISTINCT sha256('entity|concept|' || canonical_name) AS entity_id, substr(canonical_name, 8) AS alias, lower(substr(canonical_name, 8)) AS normalized_alias FROM entity_mentions WHERE ord = 0""",
    ["entity_mentions"],
)
def entity_aliases_known(spark, sf_dir):
    """The same against a table that holds the aliases of languages already."""
    mentions = _mentions(spark, sf_dir)
    known = F.concat(F.lit("lang "), F.lower("canonical_name"))
    stored = mentions.where(~F.col("canonical_name").startswith("source:")).select("entity_id", known.alias("normalized_alias")).distinct()
    return C.upsert_aliases(mentions, stored)


@query(
    "claim_supersede",
    """SELECT claim_id, CASE WHEN lang = 'en' THEN 'superseded' ELSE 'active' END AS status, CASE WHEN lang = 'en' THEN '2024-07-01 00:00:00' END AS deleted_at FROM stored_claims""",
    ["stored_claims"],
)
def claim_supersede(spark, sf_dir):
    entries = documents(spark, sf_dir).where("lang = 'en'").select("entry_id")
    out = C.supersede_claims(bundle(spark, sf_dir)["claims"], entries, AS_OF.replace(month=7))
    return out.select("claim_id", "status", text_ts("deleted_at").alias("deleted_at"))


# --- reads ---------------------------------------------------------------------


def doc_table(spark, sf_dir):
    kinds = F.when(F.col("lang") == "en", "journal").when(F.col("lang") == "de", "todo").otherwise("thought")
    return documents(spark, sf_dir).select(
        "document_id", kinds.alias("declared_type"), F.to_timestamp(F.lit("2024-02-02 00:00:00")).alias("occurred_at_utc")
    )


SEARCH_SQL = """SELECT claim_id, predicate, strftime(time_start, '%Y-%m-%d %H:%M:%S') AS time_start FROM stored_claims c WHERE (canonical ILIKE '%e%' OR subject_text ILIKE '%e%' OR predicate ILIKE '%e%')
  AND lang = 'en' AND modality = 'fact' AND predicate = 'did' AND me_role = 'actor' AND n_dims > 0 AND lower(source) ILIKE '%src1%'
  AND time_start >= TIMESTAMP '2024-01-01 00:00:00' AND time_start <= TIMESTAMP '2024-02-01 00:00:00'
  ORDER BY c.time_start DESC, claim_id"""


@query("claims_search", SEARCH_SQL, ["stored_claims"])
def claims_search(spark, sf_dir):
    out = CS.search_store(
        spark, claim_store(spark, sf_dir), text="E", type="journal", modality="fact", predicate="did",
        me_role="actor", dimension_type="place", dimension_value="src1", from_ts="2024-01-01 00:00:00", to_ts="2024-02-01 00:00:00",
    )
    return out.select("claim_id", "predicate", text_ts("time_start_utc").alias("time_start"))


@query("claims_search_frames", SEARCH_SQL, ["stored_claims"])
def claims_search_frames(spark, sf_dir):
    """The same over frames, without a store."""
    b = stored_bundle(spark, sf_dir)
    out = S.search_claims(
        b["claims"], doc_table(spark, sf_dir), b["dimensions"], text="E", type="journal", modality="fact", predicate="did",
        me_role="actor", dimension_type="place", dimension_value="src1", from_ts="2024-01-01 00:00:00", to_ts="2024-02-01 00:00:00",
    )
    return out.select("claim_id", "predicate", text_ts("time_start_utc").alias("time_start"))


@query(
    "claims_search_text",
    "SELECT claim_id FROM stored_claims WHERE canonical ILIKE '%ing the%' OR subject_text ILIKE '%ing the%' OR predicate ILIKE '%ing the%'",
    ["stored_claims"],
)
def claims_search_text(spark, sf_dir):
    """Claims of all months and predicates that hold a text, through the list of grams."""
    return CS.search_store(spark, claim_store(spark, sf_dir), text="ing The").select("claim_id")


@query(
    "claims_by_entry",
    "SELECT claim_id, document_id AS entry_id FROM stored_claims",
    ["stored_claims"],
)
def claims_by_entry(spark, sf_dir):
    # the sort samples its input before it reads it; behind a shuffle the bundles are not made twice for that
    claims = bundle(spark, sf_dir)["claims"].repartition("entry_id")
    out = S.claims_by_entry(claims, documents(spark, sf_dir).select("entry_id"))
    return out.select("claim_id", "entry_id")


HYDRATED = """SELECT c.claim_id, 1 AS n_spans, md5(c.excerpt) AS first_excerpt, coalesce((SELECT string_agg(dimension_type || '=' || normalized_value, ',' ORDER BY ord) FROM stored_dims d WHERE d.claim_id = c.claim_id), '') AS dims,
      CASE WHEN c.predicate = 'chose' THEN 'supersede,revise' ELSE '' END AS feedback FROM stored_claims c"""


@query("claims_hydrated", HYDRATED, ["stored_claims", "stored_dims"])
@query("claims_hydrated_all", HYDRATED, ["stored_claims", "stored_dims"])
def claims_hydrated_all(spark, sf_dir):
    path = claim_store(spark, sf_dir)
    every = spark.read.parquet(f"{path}/claims")
    return _hydrated(CS.hydrated(spark, path, every))


@query(
    "claims_search_hydrated",
    f"SELECT h.* FROM ({HYDRATED}) h JOIN (SELECT claim_id FROM stored_claims c WHERE canonical ILIKE '%the%' OR subject_text ILIKE '%the%' OR predicate ILIKE '%the%') USING (claim_id)",
    ["stored_claims", "stored_dims"],
)
def claims_search_hydrated(spark, sf_dir):
    """Claims found through the list of grams, with their children."""
    path = claim_store(spark, sf_dir)
    return _hydrated(CS.hydrated(spark, path, CS.search_store(spark, path, text="THE")))


@query(
    "claim_children",
    """SELECT claim_id, 'dimensions' AS kind, CAST(ord AS BIGINT) AS position, dimension_type || '=' || normalized_value AS told FROM stored_dims
    UNION ALL SELECT claim_id, 'feedback', k, a FROM stored_claims, (VALUES (0::BIGINT, 'supersede'), (1, 'revise')) AS v(k, a) WHERE predicate = 'chose'
    UNION ALL SELECT claim_id, 'spans', 0, md5(excerpt) FROM stored_claims""",
    ["stored_claims", "stored_dims"],
)
def claim_children(spark, sf_dir):
    """The children of all claims as rows with positions."""
    path = claim_store(spark, sf_dir)
    every = spark.read.parquet(f"{path}/claims")
    told = {"dimensions": F.concat_ws("=", "dimension_type", "normalized_value"), "feedback": F.col("action"), "spans": F.md5("excerpt")}
    out = [
        CS.child_rows(spark, path, every, name, work_dir(spark, name)).select("claim_id", F.lit(name).alias("kind"), "position", text.alias("told"))
        for name, text in told.items()
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


KNOWN_IDS = [hashlib.sha256(f"claim|{d}|x-{d}|{i}".encode()).hexdigest() for d in (1, 2, 7, 8, 9) for i in (0, 1)]


@query(
    "claim_by_id", f"SELECT * FROM ({HYDRATED}) WHERE claim_id IN ({', '.join(repr(i) for i in KNOWN_IDS)})", ["stored_claims", "stored_dims"]
)
def claim_by_id(spark, sf_dir):
    return _hydrated(CS.claim_by_id(spark, claim_store(spark, sf_dir), KNOWN_IDS))


def _hydrated(out):
    pairs = F.transform("dimensions", lambda d: F.concat(d["dimension_type"], F.lit("="), d["normalized_value"]))
    return out.select(
        "claim_id",
        F.size("spans").alias("n_spans"),
        F.md5(F.col("spans")[0]["excerpt"]).alias("first_excerpt"),
        F.array_join(pairs, ",").alias("dims"),
        F.array_join(F.transform("feedback", lambda f: f["action"]), ",").alias("feedback"),
    )
