"""Rule classification of captures.  Rules are data and can be replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions.rx import ColumnOrName, as_col, lead, matches, str_array
from capturelake.functions.text import lemma_form, strip, strip_urls, strip_value

LABELS = R.CLASS_LABELS


def detect_input_type(text: ColumnOrName, requested: ColumnOrName | None = None) -> Column:
    auto = F.when(matches(text, R.URL), "url").when(matches(text, R.TASK_HINT, ci=True), "task").otherwise("note")
    if requested is None:
        return auto
    asked = F.coalesce(as_col(requested), F.lit("auto"))
    return F.when(asked != "auto", asked).otherwise(auto)


def _points(test: Column, weight: float) -> Column:
    return F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))


def score_regex(
    df: DataFrame,
    text: str = "raw_text",
    input_type: str = "input_type",
    hints=R.HINT_SCORES,
    types=R.TYPE_SCORES,
) -> DataFrame:
    """Adds score_<label> for every label from type, hint and shape rules."""
    t = F.coalesce(F.col(text), F.lit(""))
    kind = F.coalesce(F.col(input_type), F.lit("note"))
    has_url = matches(t, R.URL)
    terms: dict[str, list[Column]] = {label: [F.lit(0.0)] for label in LABELS}
    for name, label, weight in types:
        terms[label].append(_points(kind == name, weight))
    for label, pattern, weight in hints:
        terms[label].append(_points(matches(t, pattern, ci=True), weight))
    terms["learning"].append(_points(has_url, R.URL_SCORE))
    terms["learning"].append(_points(has_url & (strip_urls(t) == ""), R.BARE_URL_SCORE))
    terms["thought"].append(_points(F.length(strip(t)) <= R.SHORT_TEXT_LEN, R.SHORT_TEXT_SCORE))
    terms["thought"].append(_points(t.contains("?") | t.contains("？"), R.QUESTION_SCORE))
    for label in LABELS:
        total = terms[label][0]
        for term in terms[label][1:]:
            total = total + term
        df = df.withColumn(f"score_{label}", total)
    return df


def score_lemmas(
    df: DataFrame,
    tokens: str = "lemmas",
    lexicon: dict[str, list[str]] = R.CLASS_LEMMAS,
    time_lemmas=R.TIME_LEMMAS,
    action_lemmas=R.ACTION_LEMMAS,
    most_hits: int | None = R.LEMMA_CAP,
) -> DataFrame:
    """Adds lemma_<label> from an array of lemmas; no shuffle is needed.

    ``most_hits`` distinct hits score at most (a rule), all of them with None.
    """
    seen = F.array_distinct(F.transform(F.coalesce(F.col(tokens), str_array([])), lemma_form))
    df = df.withColumn("_seen", seen)
    bonus = {"journal": time_lemmas, "task": action_lemmas}
    for label, words in lexicon.items():
        hits = F.size(F.array_intersect("_seen", str_array([w.strip().lower() for w in words])))
        score = (hits if most_hits is None else F.least(hits, F.lit(most_hits))) * F.lit(R.LEMMA_WEIGHT)
        if label in bonus:
            score = score + _points(F.arrays_overlap("_seen", str_array(bonus[label])), R.LEMMA_BONUS)
        df = df.withColumn(f"lemma_{label}", score)
    return df.drop("_seen")


def classify(
    df: DataFrame,
    text: str = "raw_text",
    input_type: str = "input_type",
    tokens: str | None = None,
    **rules,
) -> DataFrame:
    """Adds the scores (rounded to 3), is_task and note_type."""
    out = score_regex(df, text, input_type, **rules)
    if tokens is not None:
        out = score_lemmas(out, tokens)
        for label in LABELS:
            out = out.withColumn(f"score_{label}", F.col(f"score_{label}") + F.col(f"lemma_{label}"))
        out = out.drop(*[f"lemma_{label}" for label in LABELS])
    j, l, t = (F.col(f"score_{label}") for label in R.NOTE_LABELS)
    ranked = F.sort_array(F.array(j, l, t))
    clear = (ranked[2] - ranked[1]) > R.AMBIGUOUS_MARGIN
    out = out.withColumn("is_task", F.col("score_task") >= R.TASK_THRESHOLD).withColumn(
        "note_type",
        F.when(clear & (j >= l) & (j >= t), "journal").when(clear & (l >= t), "learning").otherwise("thought"),
    )
    for label in LABELS:
        out = out.withColumn(f"score_{label}", F.round(f"score_{label}", 3))
    return out


def predicted_label() -> Column:
    return F.when(F.col("is_task"), "task").otherwise(F.col("note_type"))


def detect_predicate(
    sentence: ColumnOrName,
    lemmas: ColumnOrName | None = None,
    hints=R.PREDICATE_HINTS,
    lexicon: dict[str, list[str]] = R.PREDICATE_LEMMAS,
) -> Column:
    """struct(predicate, confidence): first hint pattern, else first lemma set."""

    def verdict(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("predicate"), F.lit(confidence).alias("confidence"))

    def chosen(tests, last: Column) -> Column:
        branch = last
        for test, value in reversed(tests):
            branch = F.when(test, value).otherwise(branch)
        return branch

    found = [(matches(sentence, pattern, ci=True), verdict(name, R.HINT_CONFIDENCE)) for pattern, name in hints]
    rest = verdict("mentions", R.MENTION_CONFIDENCE)
    if lemmas is not None:
        forms = F.transform(F.coalesce(as_col(lemmas), str_array([])), lemma_form)
        rest = chosen(
            [(F.arrays_overlap(forms, str_array(words)), verdict(name, R.LEMMA_CONFIDENCE)) for name, words in lexicon.items()], rest
        )
    if len(found) < 2 or not all(lead(pattern, True) for pattern, _ in hints):
        return chosen(found, rest)
    # lists of words are one list: a sentence without any of them is told by one look
    every = "(" + "|".join(pattern[1:-1] for pattern, _ in hints) + ")"
    return F.when(matches(sentence, every, ci=True), chosen(found, rest)).otherwise(rest)


def canonicalize_predicate(
    predicate: ColumnOrName, obj: ColumnOrName, aliases=R.PREDICATE_ALIASES, allowed=R.CLAIM_PREDICATES
) -> Column:
    raw = strip_value(predicate)
    candidate = F.concat(raw, F.lit(" "), as_col(obj))
    branch = F.when(raw.isin(*allowed), raw)
    for pattern, name in aliases:
        branch = branch.when(matches(candidate, pattern, ci=True), F.lit(name))
    return branch.otherwise("mentions")
