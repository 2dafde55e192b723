"""Typed entries: payload building and checks, captures and documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions.pii import pii_score, redaction_state
from capturelake.functions.rx import ColumnOrName, as_col, blank_to_null, head, let
from capturelake.functions.scalars import at
from capturelake.functions.text import payload_entries, strip
from capturelake.operators.merge import top_per_key, upsert


def capture_to_entry(df: DataFrame, text: str = "text", kind: str = "declared_type") -> DataFrame:
    """Entry with a minimal payload from one typed text.

    ``valid`` tells whether the trimmed text has 1 to 10,000 characters.
    """
    t = strip(text)

    def json(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    none = F.array().cast("array<string>")
    k = F.col(kind)
    payload = (
        F.when(k == "journal", json(reflection=t))
        .when(k == "todo", json(details=t, status=F.lit("todo"), priority=F.lit(3)))
        .when(k == "learning", json(takeaway=t))
        .when(k == "thought", json(note=t))
        .when(k == "meeting", json(context=t, notes=t, decisions=none, actions=none))
    )
    return df.select(
        "*",
        t.alias("body"),
        payload.alias("payload"),
        none.alias("tags"),
        F.lit("internal").alias("sensitivity"),
        (F.length(t).between(1, 10000) & k.isin(*R.ENTRY_TYPES)).alias("valid"),
    )


def build_capture_text(
    title: ColumnOrName = "title",
    body: ColumnOrName = "body",
    payload: ColumnOrName = "payload",
    max_chars: int | None = None,
) -> Column:
    """Title, body and ``key: value`` lines; whole unless ``max_chars`` is given."""

    def line(e: Column) -> Column:
        value = (
            F.when(e["kind"] == "array", F.when(F.size(e["items"]) > 0, F.array_join(e["items"], " / ", "")))
            .when(e["kind"] == "object", F.lit("[object Object]"))
            .otherwise(blank_to_null(e["text"]))
        )
        return F.concat(e["key"], F.lit(": "), value)

    lines = F.filter(F.transform(payload_entries(payload), line), lambda x: x.isNotNull())
    first = F.filter(F.array(blank_to_null(title), blank_to_null(body)), lambda x: x.isNotNull())
    whole = F.array_join(F.concat(first, F.coalesce(lines, F.array().cast("array<string>"))), "\n")
    return head(whole, max_chars)


def capture_input_type(kind: ColumnOrName = "declared_type", payload: ColumnOrName = "payload") -> Column:
    url = F.get_json_object(as_col(payload), "$.url")
    return (
        F.when(as_col(kind) == "todo", "task")
        .when((as_col(kind) == "learning") & (F.length(url) > 0), "url")
        .otherwise("note")
    )


def map_entries(entries: DataFrame, captures: DataFrame) -> DataFrame:
    """Entries with the capture they belong to: capture_id, pii_score, raw_text, input_type and is_new.

    A stored capture counts when its id is the entry's, or when it came from
    the web with the same text and time; the newest one wins.  The two ways
    are separate equi-joins, and the text side is reduced to its newest row
    per (text hash, time) first.  Captures to insert and documents are
    projections of this frame.
    """
    built = entries.withColumn("raw_text", build_capture_text()).withColumn("_hash", F.sha2("raw_text", 256))
    entry = built.withColumn("_pii", pii_score("raw_text"))
    stored = F.struct("created_at", "capture_id", "pii_score")
    by_id = captures.select(F.col("capture_id").alias("entry_id"), stored.alias("_a"))
    web = captures.where(F.col("source_id") == R.WEB_SOURCE_ID).select(
        F.sha2("raw_text", 256).alias("_hash"), F.col("occurred_at"), "created_at", "capture_id", "pii_score"
    )
    by_text = top_per_key(web, ["_hash", "occurred_at"], [F.desc("created_at"), F.desc("capture_id")]).select(
        "_hash", "occurred_at", stored.alias("_b")
    )
    found = entry.join(by_id, "entry_id", "left").join(by_text, ["_hash", "occurred_at"], "left")
    hit = found.withColumn("_hit", F.greatest("_a", "_b"))
    return hit.select(
        *entries.columns,
        "raw_text",
        F.coalesce("_hit.capture_id", "entry_id").alias("capture_id"),
        F.greatest(F.col("_pii"), F.coalesce("_hit.pii_score", F.lit(0.0))).alias("pii_score"),
        F.col("_hit").isNull().alias("is_new"),
        capture_input_type().alias("input_type"),
    )


def ensure_captures(entries: DataFrame, captures: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(entry_id, capture_id, pii_score) per entry, and captures to insert."""
    mapped = map_entries(entries, captures)
    inserts = mapped.where("is_new").select(
        "capture_id",
        F.lit(R.WEB_SOURCE_ID).alias("source_id"),
        "input_type",
        "raw_text",
        "occurred_at",
        "sensitivity",
        "pii_score",
        F.lit("new").alias("status"),
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
    )
    return mapped.select("entry_id", "capture_id", "pii_score"), inserts


DOCUMENT_COLUMNS = [
    "capture_id", "declared_type", "raw_text", "occurred_at_utc", "sensitivity", "pii_score",
    "redaction_state", "language", "normalized_text", "token_count", "analysis_state", "updated_at",
]


def document_rows(mapped: DataFrame, as_of: datetime) -> DataFrame:
    """One document per mapped entry, a projection.

    token_count is the character length of the body and language is fixed,
    as in the data this replaces.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    return mapped.select(
        F.col("entry_id").alias("document_id"),
        "entry_id",
        "capture_id",
        "declared_type",
        "raw_text",
        F.col("occurred_at").alias("occurred_at_utc"),
        "sensitivity",
        "pii_score",
        redaction_state("pii_score").alias("redaction_state"),
        F.lit("ja").alias("language"),
        F.lower(body).alias("normalized_text"),
        F.length(body).alias("token_count"),
        F.lit("ready").alias("analysis_state"),
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
    )


def upsert_documents(mapped: DataFrame, docs: DataFrame, as_of: datetime) -> DataFrame:
    return upsert(docs, document_rows(mapped, as_of), ["entry_id"], DOCUMENT_COLUMNS)


def normalize_legacy_payload(kind: ColumnOrName = "declared_type", payload: ColumnOrName = "payload", body: ColumnOrName = "body") -> Column:
    """Payload of old thoughts: their item and body become the note."""
    p = as_col(payload)
    note = F.get_json_object(p, "$.note")
    merged = F.array_join(
        F.filter(
            F.array(F.get_json_object(p, "$.item"), as_col(body)), lambda x: x.isNotNull() & (x != "")
        ),
        " / ",
    )
    rebuilt = F.to_json(F.struct(F.coalesce(blank_to_null(merged), F.lit(R.LEGACY_THOUGHT_TEXT)).alias("note")))
    old = (as_col(kind) == "thought") & (F.coalesce(strip(note), F.lit("")) == "")
    return F.when(old, rebuilt).otherwise(p)


# --- payload checks --------------------------------------------------------

ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})$"
URL_SHAPE = r"^[A-Za-z][A-Za-z0-9+.\-]*:\S+$"
# rule: (field, kind, required, low, high, allowed)
PAYLOAD_RULES = {
    "journal": [
        ("mood", "int", False, 1, 5, None),
        ("energy", "int", False, 1, 5, None),
        ("reflection", "text", True, 1, None, None),
    ],
    "todo": [
        ("status", "enum", False, None, None, ["todo", "in_progress", "done"]),
        ("priority", "int", False, 1, 4, None),
        ("dueAtUtc", "time", False, None, None, None),
        ("context", "text", False, None, 200, None),
        ("details", "text", True, 1, None, None),
    ],
    "learning": [
        ("url", "url", False, None, None, None),
        ("summary3Lines", "text", False, None, 400, None),
        ("takeaway", "text", True, 1, None, None),
    ],
    "thought": [
        ("hypothesis", "text", False, None, 400, None),
        ("question", "text", False, None, 400, None),
        ("note", "text", True, 1, None, None),
    ],
    "meeting": [
        ("context", "text", True, 1, None, None),
        ("notes", "text", True, 1, None, None),
        ("decisions", "texts", False, None, None, None),
        ("actions", "texts", False, None, None, None),
    ],
}


def _field_error(fields: Column, rule) -> Column:
    name, kind, required, low, high, allowed = rule
    hit = F.get(F.filter(fields, lambda e: e["key"] == name), F.lit(0))

    def check(f: Column) -> Column:
        text, is_text = f["text"], f["kind"] == "string"
        if kind == "int":
            number = text.try_cast("double")
            bad = (f["kind"] != "number") | (number != F.floor(number)) | ~number.between(low, high)
        elif kind == "enum":
            bad = ~is_text | ~text.isin(*allowed)
        elif kind == "time":
            bad = ~is_text | ~text.rlike(ISO_OFFSET)
        elif kind == "url":
            bad = ~is_text | ~text.rlike(URL_SHAPE)
        elif kind == "texts":
            bad = (f["kind"] != "array") | F.exists(f["items"], lambda i: i.isNull() | (i == ""))
        else:
            bad = ~is_text
            if low is not None:
                bad = bad | (F.length(text) < low)
            if high is not None:
                bad = bad | (F.length(text) > high)
        missing = F.lit(f"{name}: required") if required else F.lit(None).cast("string")
        return F.when(f.isNull(), missing).when(F.coalesce(bad, F.lit(True)), F.lit(f"{name}: invalid"))

    return let(hit, check)


def validate_payload(kind: ColumnOrName = "declared_type", payload: ColumnOrName = "payload") -> Column:
    """Array of errors, empty for a payload that fits its type."""

    def errors(fields: Column) -> Column:
        branch = None
        for name, rules in PAYLOAD_RULES.items():
            found = F.filter(F.array(*[_field_error(fields, r) for r in rules]), lambda e: e.isNotNull())
            test = as_col(kind) == name
            branch = F.when(test, found) if branch is None else branch.when(test, found)
        return branch.otherwise(F.array(F.lit("declared_type: invalid")))

    broken = F.array(F.lit("payload: invalid"))
    return F.coalesce(let(payload_entries(payload), lambda f: F.when(f.isNotNull(), errors(f))), broken)
