"""Queries over personal-data scoring, masking and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.functions import pii as P
from capturelake.functions import rules as R

from .frames import frame
from .registry import query, step

# the rules' own patterns, quoted for SQL
PATTERNS = [(("(?i)" if ci else "") + p.replace("'", "''"), str(w)) for p, ci, w in R.PII_PATTERNS]
SK, PAIR, MAIL, PHONE, POST = (p for p, _ in PATTERNS)


def sql_score(text: str) -> str:
    return "greatest(" + ", ".join(
        f"CASE WHEN regexp_matches({text}, '{p}') THEN {w}::DOUBLE ELSE 0::DOUBLE END" for p, w in PATTERNS
    ) + ")"


def sql_risk(score: str, names=("high", "medium", "low")) -> str:
    return f"CASE WHEN {score} >= 0.9 THEN '{names[0]}' WHEN {score} >= 0.5 THEN '{names[1]}' ELSE '{names[2]}' END"


def _sql_mask(text: str, pattern: str) -> str:
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), "
        f"list_transform(regexp_extract_all({text}, '{pattern}'), lambda h: repeat('█', length(h)))), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )


step("pii_docs", f"SELECT doc_id, text, {sql_score('text')} AS pii_score FROM documents")
step("mask1", f"SELECT doc_id, pii_score, text, {_sql_mask('text', SK)} AS m FROM pii_docs", ["pii_docs"])
step("mask2", f"SELECT doc_id, pii_score, text, {_sql_mask('m', PAIR)} AS m FROM mask1", ["mask1"])
step("mask3", f"SELECT doc_id, pii_score, text, {_sql_mask('m', MAIL)} AS m FROM mask2", ["mask2"])
step("mask4", f"SELECT doc_id, pii_score, text, {_sql_mask('m', PHONE)} AS m FROM mask3", ["mask3"])
step("masked_docs", f"SELECT doc_id, pii_score, text, {_sql_mask('m', POST)} AS m FROM mask4", ["mask4"])


@query("pii_score", "SELECT doc_id, pii_score FROM pii_docs", ["pii_docs"])
def pii_score(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", P.pii_score("text").alias("pii_score"))


@query(
    "pii_risk",
    f"SELECT {sql_risk('pii_score')} AS risk_level, count(*) AS n FROM pii_docs GROUP BY 1",
    ["pii_docs"],
)
def pii_risk(spark, sf_dir):
    scored = frame(spark, sf_dir, "documents").select(P.risk_level(P.pii_score("text")).alias("risk_level"))
    return scored.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pii_masked",
    "SELECT doc_id, length(m) AS n_chars, length(text) AS n_before, md5(m) AS digest FROM masked_docs",
    ["masked_docs"],
)
def pii_masked(spark, sf_dir):
    masked = frame(spark, sf_dir, "documents").select("doc_id", "text", P.mask_text("text").alias("m"))
    return masked.select(
        "doc_id",
        F.length("m").cast("bigint").alias("n_chars"),
        F.length("text").cast("bigint").alias("n_before"),
        F.md5("m").alias("digest"),
    )


@query(
    "pii_redaction_state",
    f"""SELECT doc_id, pii_score, {sql_risk('pii_score')} AS risk_level, {sql_risk('pii_score', ('blocked', 'masked', 'none'))} AS redaction_state,
      md5(CASE WHEN pii_score >= 0.9 THEN '' WHEN pii_score >= 0.5 THEN m ELSE text END) AS digest FROM masked_docs""",
    ["masked_docs"],
)
def pii_redaction_state(spark, sf_dir):
    out = P.redact(frame(spark, sf_dir, "documents"))
    return out.select("doc_id", "pii_score", "risk_level", "redaction_state", F.md5("safe_text").alias("digest"))


SCAN_PAIR = r"(?i)(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*[A-Za-z0-9_\-]{8,}"
KEY_BLOCK = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
ADDRESS = r"(?:東京都|北海道|(?:京都|大阪)府|.{2,3}県).{2,30}(?:市|区|町|村).{1,40}"
step(
    "scanned",
    f"""SELECT doc_id, list_concat(list_concat(regexp_extract_all(b, '{SK}'), regexp_extract_all(b, '{SCAN_PAIR}')), regexp_extract_all(b, '{KEY_BLOCK}')) AS hi,
      list_concat(list_concat(list_concat(regexp_extract_all(b, '{MAIL}'), regexp_extract_all(b, '{PHONE}')), regexp_extract_all(b, '{POST}')), regexp_extract_all(b, '{ADDRESS}')) AS mid
    FROM (SELECT doc_id, source || chr(10) || text AS b FROM documents)""",
)


@query(
    "pii_scan_hits",
    """SELECT doc_id, CASE WHEN len(hi) > 0 THEN 'high' WHEN len(mid) > 0 THEN 'medium' ELSE 'low' END AS risk,
      array_to_string(CASE WHEN len(hi) > 0 THEN hi ELSE mid END, '|') AS hits FROM scanned""",
    ["scanned"],
)
def pii_scan_hits(spark, sf_dir):
    out = frame(spark, sf_dir, "documents").select("doc_id", P.scan_pii(["source", "text"]).alias("s"))
    return out.select("doc_id", "s.risk", F.array_join("s.hits", "|").alias("hits"))


@query(
    "pii_gate",
    """SELECT CASE WHEN len(hi) > 0 THEN 'reject' WHEN len(mid) > 0 THEN 'confirm' ELSE 'accept' END AS gate, count(*) AS n
    FROM scanned GROUP BY 1""",
    ["scanned"],
)
def pii_gate(spark, sf_dir):
    out = frame(spark, sf_dir, "documents").select(P.scan_pii(["source", "text"]).alias("s"))
    return out.groupBy(P.capture_gate("s.risk").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "pii_resolved",
    f"""SELECT capture_id, coalesce(pii_override, {sql_score('raw_text')}) AS pii_score,
      pii_override IS NULL OR pii_override BETWEEN 0 AND 1 AS pii_valid FROM captures""",
    ["captures"],
)
def pii_resolved(spark, sf_dir):
    out = P.resolve_pii(frame(spark, sf_dir, "captures"), "raw_text")
    return out.select("capture_id", "pii_score", "pii_valid")


@query(
    "pii_document_update",
    f"""SELECT capture_id, greatest(coalesce(pii_override, 0), s) AS pii_score, {sql_risk('s', ('blocked', 'masked', 'none'))} AS redaction_state
    FROM (SELECT *, {sql_score('raw_text')} AS s FROM captures)""",
    ["captures"],
)
def pii_document_update(spark, sf_dir):
    docs = frame(spark, sf_dir, "captures").withColumnRenamed("pii_override", "pii_score")
    return P.update_redaction(docs).select("capture_id", "pii_score", "redaction_state")
