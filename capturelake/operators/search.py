"""Entry lists and search, and claim reads."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions.rx import ColumnOrName, as_col, str_array
from capturelake.functions.scalars import at, recency_boost
from capturelake.functions.text import search_tokens, searchable_text

from .merge import group_ordered, top_per_key
from .usage import bounded


def list_entries(
    df: DataFrame,
    types: list[str] | None = None,
    from_ts: str | None = None,
    to_ts: str | None = None,
    tags: list[str] | None = None,
    sensitivity: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entries of any given type with all given tags, newest first."""
    out = bounded(df, "occurred_at", from_ts, to_ts)
    if types:
        out = out.where(F.col("declared_type").isin(*types))
    if sensitivity is not None:
        out = out.where(F.col("sensitivity") == sensitivity)
    if tags:
        out = out.where(F.size(F.array_except(str_array(tags), "tags")) == 0)
    return out if limit is None else out.orderBy(F.desc("occurred_at"), F.asc("entry_id")).limit(limit)


def search_base(text: ColumnOrName, query: str) -> Column:
    """3 for a whole word or text, 2 for a word start, 1 for any hit, else 0."""
    q = query.lower()
    t = as_col(text)
    word = t.contains(f" {q} ") | (t == q)
    start = F.exists(F.split(t, r"\s+"), lambda w: w.startswith(q))
    return F.when(word, 3).when(start, 2).when(t.contains(q), 1).otherwise(0)


def matched_fields(query: str) -> Column:
    q = query.lower()

    def has(c: Column) -> Column:
        return F.coalesce(F.lower(c).contains(q), F.lit(False))

    hits = F.filter(
        F.array(
            F.when(has(F.col("title")), "title"),
            F.when(has(F.col("body")), "body"),
            F.when(F.exists("tags", lambda t: has(t)), "tags"),
        ),
        lambda f: f.isNotNull(),
    )
    return F.when(F.size(hits) == 0, F.array(F.lit("payload"))).otherwise(hits)


def search_entries(
    df: DataFrame,
    text: str,
    as_of: datetime,
    limit: int | None = None,
    limit_before_rank: bool = False,
    **filters,
) -> DataFrame:
    """Entries that contain the text, with score and matched fields.

    The score is the match class plus a recency boost below 1, so a row is
    kept exactly when the text occurs.  With ``limit_before_rank`` only the
    newest ``limit`` entries are searched; otherwise the limit ranks.
    """
    pool = list_entries(df, limit=limit if limit_before_rank else None, **filters)
    searchable = pool.withColumn("_text", F.lower(searchable_text("title", "body", "tags", "payload")))
    hits = searchable.where(F.col("_text").contains(text.lower()))
    scored = (
        hits.withColumn("match", search_base("_text", text))
        .withColumn("score", F.col("match") + recency_boost("occurred_at", as_of))
        .withColumn("matched_fields", matched_fields(text))
        .drop("_text")
    )
    if limit is None or limit_before_rank:
        return scored
    return scored.orderBy(F.desc("score"), F.asc("entry_id")).limit(limit)


def list_history(df: DataFrame, entry_id, limit: int | None = None, tie: str = "id") -> DataFrame:
    out = df.where(F.col("entry_id") == entry_id).orderBy(F.desc("created_at"), F.asc(tie))
    return out if limit is None else out.limit(limit)


def entry_stats(entries: DataFrame, as_of: datetime) -> DataFrame:
    """One row: entries of today, ready to analyse, and per type with zeros."""
    today = F.to_date("occurred_at") == F.to_date(at(as_of))
    return entries.agg(
        F.count_if(today).alias("today_count"),
        F.count_if(F.col("analysis_state").isin("not_requested", "failed")).alias("ready_count"),
        *[F.count_if(F.col("declared_type") == t).alias(f"{t}_count") for t in R.ENTRY_TYPES],
    )


def token_index(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Inverted index rows (token, id, field, tf).

    Counts combine before the shuffle and the key holds the document, so a
    very common token is spread over all tasks.
    """

    def tagged(field: str) -> Column:
        tokens = search_tokens(F.coalesce(F.col(field), F.lit("")))
        return F.transform(tokens, lambda t: F.struct(F.lit(field).alias("field"), t.alias("token")))

    pairs = F.concat(*[tagged(f) for f in fields])
    rows = df.select(id_col, F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull())
    return rows.groupBy(F.col("p.token").alias("token"), id_col, F.col("p.field").alias("field")).agg(
        F.count(F.lit(1)).alias("tf")
    )


# --- claims -----------------------------------------------------------------


def _like(value: str, escape: bool) -> str:
    if escape:
        value = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{value}%"


def text_hit(text: str, escape: bool = True, columns: list[str] | None = None) -> Column:
    """Whether any of the columns holds a text, whatever its case."""
    pattern = _like(text, escape)
    hits = [F.col(c).ilike(pattern) for c in columns or ["subject_text", "object_text_canonical", "predicate"]]
    return reduce(lambda a, b: a | b, hits)


def search_claims(
    claims: DataFrame,
    docs: DataFrame,
    dims: DataFrame,
    text: str | None = None,
    type: str | None = None,  # noqa: A002
    modality: str | None = None,
    predicate: str | None = None,
    me_role: str | None = None,
    dimension_type: str | None = None,
    dimension_value: str | None = None,
    from_ts: str | None = None,
    to_ts: str | None = None,
    limit: int | None = None,
    escape: bool = True,
) -> DataFrame:
    """Active claims by text, enums, one matching dimension row and time."""
    c = claims.where(F.col("deleted_at").isNull())
    if text is not None:
        c = c.where(text_hit(text, escape))
    for column, value in (("modality", modality), ("predicate", predicate), ("me_role", me_role)):
        if value is not None:
            c = c.where(F.col(column) == value)
    d = docs.select("document_id", "declared_type", "occurred_at_utc")
    if type is not None:
        d = d.where(F.col("declared_type") == type)
    if dimension_type is not None or dimension_value is not None:
        wanted = dims
        if dimension_type is not None:
            wanted = wanted.where(F.col("dimension_type") == dimension_type)
        if dimension_value is not None:
            wanted = wanted.where(text_hit(dimension_value, escape, ["normalized_value"]))
        c = c.join(wanted.select("claim_id"), "claim_id", "left_semi")
    out = c.join(d, "document_id")
    start = F.coalesce("time_start_utc", "occurred_at_utc")
    end = F.coalesce("time_end_utc", "time_start_utc", "occurred_at_utc")
    if from_ts is not None:
        out = out.where(start >= F.lit(from_ts).cast("timestamp"))
    if to_ts is not None:
        out = out.where(end <= F.lit(to_ts).cast("timestamp"))
    out = out.orderBy(start.desc(), F.desc("created_at"), F.asc("claim_id"))
    return out if limit is None else out.limit(limit)


def claims_by_entry(df: DataFrame, entry_ids: list | DataFrame, limit: int | None = None) -> DataFrame:
    """Active claims of each entry, newest first; the newest ``limit`` of each if that is given."""
    active = df.where(F.col("deleted_at").isNull())
    if isinstance(entry_ids, DataFrame):
        active = active.join(entry_ids.select("entry_id"), "entry_id", "left_semi")
    else:
        active = active.where(F.col("entry_id").isin(*entry_ids))
    if limit is None:
        return active.orderBy(F.asc("entry_id"), F.desc("created_at"), F.asc("claim_id"))
    return top_per_key(active, ["entry_id"], [F.desc("created_at"), F.asc("claim_id")], limit)


def hydrate_claims(claims: DataFrame, spans: DataFrame, dims: DataFrame, feedback: DataFrame) -> DataFrame:
    """Claims with their spans and dimensions (oldest first) and feedback
    (newest first).  Children are reduced to the listed claims, then grouped,
    then joined, so rows never multiply."""
    wanted = claims.select("claim_id")
    out = claims
    for child, name, newest in ((spans, "spans", False), (dims, "dimensions", False), (feedback, "feedback", True)):
        part = child.join(wanted, "claim_id", "left_semi")
        time = -F.unix_micros(F.col("created_at").cast("timestamp")) if newest else F.col("created_at")
        value = [c for c in child.columns if c not in ("claim_id", "created_at", "ord")]
        grouped = group_ordered(part, "claim_id", [time, F.col("ord")], value, name)
        out = out.join(grouped, "claim_id", "left")
        empty = F.array().cast(grouped.schema[name].dataType)
        out = out.withColumn(name, F.coalesce(F.col(name), empty))
    return out
