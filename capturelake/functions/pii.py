"""Personal-data scoring, masking and gates, JVM-side only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .rx import ColumnOrName, as_col, extract_all, let, matches, rx, str_array


def pii_score(c: ColumnOrName) -> Column:
    """Largest weight among the patterns that hit; 0 when none does."""
    hits = [
        F.when(matches(c, pattern, ci), F.lit(weight)).otherwise(F.lit(0.0))
        for pattern, ci, weight in R.PII_PATTERNS
    ]
    return F.greatest(*hits)


def risk_level(score: ColumnOrName) -> Column:
    s = as_col(score)
    return F.when(s >= R.RISK_HIGH, "high").when(s >= R.RISK_MEDIUM, "medium").otherwise("low")


def redaction_state(score: ColumnOrName) -> Column:
    s = as_col(score)
    return F.when(s >= R.RISK_HIGH, "blocked").when(s >= R.RISK_MEDIUM, "masked").otherwise("none")


def _mask_pattern(text: Column, pattern: str, ci: bool) -> Column:
    """Weave the pieces between hits with blocks as long as each hit."""

    def weave(t: Column) -> Column:
        pieces = F.split(t, rx(pattern, ci), -1)
        blocks = F.transform(
            extract_all(t, pattern, ci), lambda h: F.repeat(F.lit(R.MASK_CHAR), F.length(h))
        )
        woven = F.zip_with(pieces, blocks, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(matches(t, pattern, ci), F.array_join(woven, "")).otherwise(t)

    return let(text, weave)


def mask_text(c: ColumnOrName) -> Column:
    """Replace every hit by blocks of its own length, pattern after pattern."""
    return reduce(lambda t, p: _mask_pattern(t, p[0], p[1]), R.PII_PATTERNS, as_col(c))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii_score, risk_level, redaction_state and the text safe to send."""
    scored = df.withColumn("pii_score", pii_score(text))
    return (
        scored.withColumn("risk_level", risk_level("pii_score"))
        .withColumn("redaction_state", redaction_state("pii_score"))
        .withColumn(
            "safe_text",
            F.when(F.col("risk_level") == "high", F.lit(""))
            .when(F.col("risk_level") == "medium", mask_text(text))
            .otherwise(F.col(text)),
        )
    )


def resolve_pii(df: DataFrame, text: str = "text", override: str = "pii_override") -> DataFrame:
    """pii_score from an override when given; pii_valid is false outside [0, 1]."""
    given = F.col(override)
    return df.withColumn("pii_score", F.coalesce(given, pii_score(text))).withColumn(
        "pii_valid", given.isNull() | given.between(0.0, 1.0)
    )


def scan_pii(texts: list[ColumnOrName]) -> Column:
    """struct(risk, hits): all hits of the highest class that has any."""
    blob = F.concat_ws("\n", *[as_col(t) for t in texts])

    def hits(b: Column, patterns) -> Column:
        return F.concat(*[extract_all(b, p, ci) for p, ci in patterns])

    def pick(b: Column) -> Column:
        return let(
            hits(b, R.SCAN_HIGH),
            lambda high: F.when(
                F.size(high) > 0, F.struct(F.lit("high").alias("risk"), high.alias("hits"))
            ).otherwise(
                let(
                    hits(b, R.SCAN_MEDIUM),
                    lambda mid: F.struct(
                        F.when(F.size(mid) > 0, "medium").otherwise("low").alias("risk"),
                        F.when(F.size(mid) > 0, mid).otherwise(str_array([])).alias("hits"),
                    ),
                )
            ),
        )

    return let(blob, pick)


def capture_gate(risk: ColumnOrName) -> Column:
    r = as_col(risk)
    return F.when(r == "high", "reject").when(r == "medium", "confirm").otherwise("accept")


def update_redaction(docs: DataFrame, text: str = "raw_text", stored: str = "pii_score") -> DataFrame:
    """Score = larger of stored and computed; state follows the text alone."""
    computed = docs.withColumn("_computed", pii_score(text))
    return (
        computed.withColumn("redaction_state", redaction_state("_computed"))
        .withColumn(stored, F.greatest(F.coalesce(F.col(stored), F.lit(0.0)), F.col("_computed")))
        .drop("_computed")
    )
