"""Rollup summaries of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions.rx import str_array

from .merge import top_per_key, upsert
from .usage import bounded

KEYS = ["scope_type", "scope_key", "period_type", "period_start", "period_end"]
UPDATED = ["summary_text", "key_claim_ids", "generated_by_model"]
KEY_IDS, SENTENCES, WINDOW = 12, 10, 200


def _sentence() -> Column:
    return F.concat_ws(" ", "subject_text", "predicate", "object_text_canonical")


def _summaries(top: DataFrame, keys: list[str], sentences_most: int) -> DataFrame:
    """Per key: the ids and up to ``sentences_most`` sentences, in rank order.

    ``top`` holds at most ``key_ids`` ranked rows per key, so the collected arrays
    are bounded.
    """
    packed = F.array_sort(F.collect_list(F.struct("_rank", "claim_id", _sentence().alias("s"))))
    grouped = top.groupBy(*keys).agg(packed.alias("_p"))
    sentences = F.filter(F.transform(F.slice("_p", 1, sentences_most), lambda x: x["s"]), lambda s: s != "")
    return grouped.select(
        *keys,
        F.when(F.size(sentences) > 0, F.array_join(sentences, " / ")).otherwise(R.EMPTY_ROLLUP_TEXT).alias("summary_text"),
        F.transform("_p", lambda x: x["claim_id"]).alias("key_claim_ids"),
    )


def _newest() -> list[Column]:
    return [F.desc("created_at"), F.asc("claim_id")]


def build_rollup(
    claims: DataFrame,
    from_ts: str,
    to_ts: str,
    scope_type: str = "all",
    scope_key: str = "all",
    period_type: str = "custom",
    model: str = "rules-rollup-v1",
    key_ids: int = KEY_IDS,
    sentences_most: int = SENTENCES,
) -> DataFrame:
    """One rollup row of the claims created in a range, also when empty.

    Only the newest ``key_ids`` claims are named; a top-k, so no claim group is collected.
    """
    active = bounded(claims.where(F.col("deleted_at").isNull()), "created_at", from_ts, to_ts)
    top = active.orderBy(*_newest()).limit(key_ids)
    ranked = top.select(
        F.struct(
            F.unix_micros(F.col("created_at").cast("timestamp")).alias("t"), F.col("claim_id"), _sentence().alias("s")
        ).alias("x")
    )
    order = F.array_sort(
        F.collect_list("x"),
        lambda a, b: F.when(a["t"] > b["t"], -1).when(a["t"] < b["t"], 1).when(a["claim_id"] < b["claim_id"], -1).otherwise(1),
    )
    one = ranked.agg(order.alias("_p"))
    sentences = F.filter(F.transform(F.slice("_p", 1, sentences_most), lambda x: x["s"]), lambda s: s != "")
    return one.select(
        F.lit(scope_type).alias("scope_type"),
        F.lit(scope_key).alias("scope_key"),
        F.lit(period_type).alias("period_type"),
        F.lit(from_ts).cast("timestamp").alias("period_start"),
        F.lit(to_ts).cast("timestamp").alias("period_end"),
        F.when(F.size(sentences) > 0, F.array_join(sentences, " / ")).otherwise(R.EMPTY_ROLLUP_TEXT).alias("summary_text"),
        F.coalesce(F.transform("_p", lambda x: x["claim_id"]), str_array([])).alias("key_claim_ids"),
        F.lit(model).alias("generated_by_model"),
    )


def dimension_scopes(dims: DataFrame, types: list[str]) -> DataFrame:
    """claim_id, scope_type, scope_key of dimension rows, each once, for scopes with many keys a claim."""
    kept = dims.where(F.col("dimension_type").isin(*types) & F.col("normalized_value").isNotNull())
    return kept.select("claim_id", F.col("dimension_type").alias("scope_type"), F.col("normalized_value").alias("scope_key")).distinct()


def build_rollups(
    claims: DataFrame,
    period_type: str,
    scopes: dict[str, str] | None = None,
    model: str = "rules-rollup-v1",
    key_ids: int = KEY_IDS,
    sentences_most: int = SENTENCES,
    many: DataFrame | None = None,
) -> DataFrame:
    """Rollups of every period for scope "all" and for each other scope.

    ``scopes`` maps a scope type to the column that holds its key; ``many`` has
    rows of claim_id, scope_type and scope_key, as many as a claim has keys.  A
    claim whose key is null is not in that scope.  One top-k ranks all scopes:
    each task keeps its best ``key_ids`` per scope and period before the
    shuffle, so what is shuffled does not grow with the claims of a scope.
    """
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[period_type]
    step = F.expr({"daily": "INTERVAL 1 DAY", "weekly": "INTERVAL 7 DAY", "monthly": "INTERVAL 1 MONTH"}[period_type])
    active = claims.where(F.col("deleted_at").isNull()).withColumn("period_start", F.date_trunc(unit, "created_at"))
    fields = ["claim_id", "created_at", "subject_text", "predicate", "object_text_canonical", "period_start"]

    def scope(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("scope_type"), key.cast("string").alias("scope_key"))

    own = F.array(scope("all", F.lit("all")), *[scope(k, F.col(c)) for k, c in (scopes or {}).items()])
    rows = active.select(*fields, F.explode(own).alias("s")).where(F.col("s.scope_key").isNotNull()).select(*fields, "s.*")
    if many is not None:
        rows = rows.unionByName(active.select(*fields).join(many, "claim_id").select(*fields, "scope_type", "scope_key"))
    top = top_per_key(rows, ["scope_type", "scope_key", "period_start"], _newest(), key_ids, rank="_rank")
    out = _summaries(top, ["scope_type", "scope_key", "period_start"], sentences_most)
    return out.select(
        "scope_type",
        "scope_key",
        F.lit(period_type).alias("period_type"),
        "period_start",
        (F.col("period_start") + step).alias("period_end"),
        "summary_text",
        "key_claim_ids",
        F.lit(model).alias("generated_by_model"),
    )


def upsert_rollups(existing: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(existing, new, KEYS, UPDATED)


def list_rollups(
    df: DataFrame,
    scope: str | None = None,
    key: str | None = None,
    period: str | None = None,
    from_ts: str | None = None,
    to_ts: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    out = df
    for column, value in (("scope_type", scope), ("scope_key", key), ("period_type", period)):
        if value is not None:
            out = out.where(F.col(column) == value)
    out = bounded(out, "period_start", from_ts, None)
    out = bounded(out, "period_end", None, to_ts)
    out = out.orderBy(F.desc("period_start"), F.asc("scope_type"), F.asc("scope_key"))
    return out if limit is None else out.limit(limit)
