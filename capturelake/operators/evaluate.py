"""Quality evaluation against gold labels, and the threshold gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions.text import lemma_form, normalize_for_dedupe

from .merge import merge_rows


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def class_metrics(
    df: DataFrame, labels: list[str], expected: str = "expected", predicted: str = "predicted"
) -> DataFrame:
    """One row per label: tp, fp, fn, precision, recall, f1 (4 decimals),
    plus samples, accuracy and macro_f1 of the whole set.

    One global aggregate over the rows; labels become rows afterwards.
    """
    e, p = F.col(expected), F.col(predicted)
    counts = []
    for i, label in enumerate(labels):
        # a missing prediction or expectation is another label
        is_p, is_e = p.eqNullSafe(F.lit(label)), e.eqNullSafe(F.lit(label))
        counts += [
            F.count_if(is_p & is_e).alias(f"tp{i}"),
            F.count_if(is_p & ~is_e).alias(f"fp{i}"),
            F.count_if(~is_p & is_e).alias(f"fn{i}"),
        ]
    totals = df.agg(F.count(F.lit(1)).alias("samples"), F.count_if(p == e).alias("correct"), *counts)
    per_label = F.array(
        *[
            F.struct(F.lit(label).alias("label"), *[F.col(f"{m}{i}").alias(m) for m in ("tp", "fp", "fn")])
            for i, label in enumerate(labels)
        ]
    )

    def scored(s: Column) -> Column:
        precision, recall = _ratio(s["tp"], s["tp"] + s["fp"]), _ratio(s["tp"], s["tp"] + s["fn"])
        return F.struct(
            s["label"].alias("label"),
            s["tp"].alias("tp"),
            s["fp"].alias("fp"),
            s["fn"].alias("fn"),
            precision.alias("precision"),
            recall.alias("recall"),
            _ratio(2 * precision * recall, precision + recall).alias("f1"),
        )

    rows = totals.withColumn("stats", F.transform(per_label, scored)).withColumn(
        "macro_f1", F.round(F.aggregate("stats", F.lit(0.0), lambda a, s: a + s["f1"]) / len(labels), 4)
    )
    accuracy = F.round(_ratio(F.col("correct"), F.col("samples")), 4)
    return rows.select("samples", accuracy.alias("accuracy"), "macro_f1", F.explode("stats").alias("s")).select(
        "s.label",
        "s.tp",
        "s.fp",
        "s.fn",
        *[F.round(f"s.{m}", 4).alias(m) for m in ("precision", "recall", "f1")],
        "samples",
        "accuracy",
        "macro_f1",
    )


def fact_metrics(gold: DataFrame) -> DataFrame:
    """One row of fact quality over gold rows that carry their ``facts``.

    ``gold`` has expected_predicate, object_contains and the facts array.
    """

    def hits(contains: bool) -> Column:
        def one(f: Column) -> Column:
            same = f["predicate"] == F.col("expected_predicate")
            if not contains:
                return same
            wanted = F.lower(F.trim(F.coalesce(F.col("object_contains"), F.lit(""))))
            return same & F.lower(f["object_text"]).contains(wanted)

        return F.exists("facts", one)

    rates = gold.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(hits(False)).alias("predicate_hits"),
        F.count_if(hits(True)).alias("object_hits"),
        F.coalesce(F.sum(F.size("facts")), F.lit(0)).alias("facts_total"),
    )
    facts = gold.select(F.explode_outer("facts").alias("f")).where(F.col("f").isNotNull())
    keys = facts.select(
        lemma_form("f.subject").alias("s"),
        lemma_form("f.predicate").alias("p"),
        normalize_for_dedupe("f.object_text").alias("o"),
    ).distinct()
    distinct = keys.agg(F.count(F.lit(1)).alias("distinct_facts"))
    return merge_rows(rates, distinct).select(
        "samples",
        F.round(_ratio(F.col("predicate_hits"), F.col("samples")), 4).alias("predicate_precision"),
        F.round(_ratio(F.col("object_hits"), F.col("samples")), 4).alias("object_match_rate"),
        F.round(_ratio(F.col("facts_total") - F.col("distinct_facts"), F.col("facts_total")), 4).alias("duplicate_rate"),
        "facts_total",
    )


# fixed values: thresholds
THRESHOLDS = {"min_macro_f1": 0.80, "min_predicate_precision": 0.85, "max_duplicate_rate": 0.05}


def eval_gate(
    classes: DataFrame,
    facts: DataFrame,
    expected_captures: int = 100,
    expected_facts: int = 100,
    thresholds: dict[str, float] = THRESHOLDS,
) -> DataFrame:
    """One row of pass flags over both metric frames, and ``passed``."""
    c = classes.select(F.col("samples").alias("c_samples"), "macro_f1").limit(1)
    joined = merge_rows(c, facts.withColumnRenamed("samples", "f_samples"))
    flags = {
        "captures_samples_ok": F.col("c_samples") == expected_captures,
        "facts_samples_ok": F.col("f_samples") == expected_facts,
        "macro_f1_ok": F.col("macro_f1") >= thresholds["min_macro_f1"],
        "predicate_ok": F.col("predicate_precision") >= thresholds["min_predicate_precision"],
        "duplicates_ok": F.col("duplicate_rate") <= thresholds["max_duplicate_rate"],
    }
    out = joined.select(*[v.alias(k) for k, v in flags.items()])
    passed = F.lit(True)
    for k in flags:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)
