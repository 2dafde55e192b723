"""Fact extraction: notes and tasks become subject-predicate-object facts.

An owner's candidate facts live in one array on the owner's row.  Candidates
are capped by rule before any work is done on them, so extraction, dedupe
and the cap need no shuffle; only the insert does.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions import text as T
from capturelake.functions.rx import ColumnOrName, as_col, blank_to_null, explode_rows, first_by, let, matches, str_array
from capturelake.functions.scalars import at, object_json, object_type

from .classify import detect_predicate
from .merge import counted, merge_rows, stable_id, top_per_key

FACT_TYPE = (
    "struct<subject:string,predicate:string,object_text:string,object_type:string,object_json:string,"
    "evidence_excerpt:string,occurred_at:string,confidence:double>"
)
FACTS_TYPE = f"array<{FACT_TYPE}>"
TOKENS_TYPE = "array<struct<surface:string,lemma:string,pos:string>>"


def make_fact(subject, predicate, obj, kind, json, evidence, occurred, confidence) -> Column:
    return F.struct(
        subject.alias("subject"),
        predicate.alias("predicate"),
        obj.alias("object_text"),
        kind.alias("object_type"),
        json.alias("object_json"),
        evidence.alias("evidence_excerpt"),
        occurred.alias("occurred_at"),
        confidence.alias("confidence"),
    ).cast(FACT_TYPE)


def _meta(subject: Column, predicate: str, value: Column, confidence: float, kind="text", occurred=None) -> Column:
    none = F.lit(None).cast("string")
    text = value.cast("string")
    json = F.concat(F.lit('{"value": '), text, F.lit("}")) if kind == "number" else none
    fact = make_fact(
        subject,
        F.lit(predicate),
        text,
        F.lit(kind),
        json,
        none,
        none if occurred is None else occurred,
        F.lit(confidence),
    )
    return F.when(text.isNotNull() & (text != ""), fact)


def _present(*facts: Column) -> Column:
    return F.filter(F.array(*facts), lambda f: f.isNotNull())


def note_meta_facts() -> Column:
    me, occurred = F.lit("me"), F.col("occurred_at")
    journal = F.when(F.col("note_type") == "journal", F.col("journal_date"))
    return _present(
        _meta(F.concat(F.lit("note:"), F.col("note_id")), "summary", F.col("summary"), 0.90, occurred=occurred),
        _meta(me, "captured_source", F.col("source_url"), 0.96, occurred=occurred),
        _meta(me, "journal_date", journal, 0.97, "date", occurred),
        _meta(me, "mood_score", F.col("mood_score"), 0.97, "number", occurred),
        _meta(me, "energy_score", F.col("energy_score"), 0.97, "number", occurred),
    )


def task_meta_facts() -> Column:
    subject = F.concat(F.lit("task:"), F.col("task_id"))
    dates = [("due_at", "due_at", 0.98), ("scheduled_at", "scheduled_at", 0.96), ("completed_at", "done_at", 0.99)]
    return _present(
        _meta(subject, "status", F.col("status"), 0.98),
        _meta(subject, "priority", F.col("priority"), 0.98, "number"),
        *[_meta(subject, p, F.col(c), conf, "date", F.col(c)) for p, c, conf in dates],
        _meta(subject, "derived_from_note", F.col("source_note_id"), 0.95),
    )


def object_text(sentence: ColumnOrName, predicate: ColumnOrName | None = None, tokens: ColumnOrName | None = None) -> Column:
    """Object of a sentence: the sentence, or content words near its hint."""
    s = as_col(sentence)
    if tokens is None:
        return s
    p, toks = as_col(predicate), as_col(tokens)
    hints = F.coalesce(
        *[F.when(p == name, str_array(words)) for name, words in R.PREDICATE_LEMMAS.items()], str_array([])
    )
    hit = F.array_position(F.transform(toks, lambda t: F.array_contains(hints, T.lemma_form(t["lemma"]))), True)
    start = F.greatest(hit - 4, F.lit(1))
    near = F.when(hit > 0, F.slice(toks, start.cast("int"), (F.least(F.size(toks), hit + 4) - start + 1).cast("int"))).otherwise(toks)

    def surfaces(words: Column, kinds: str, skip: list[str]) -> Column:
        kept = F.filter(words, lambda t: t["pos"].rlike(kinds) & ~T.lemma_form(t["lemma"]).isin(*skip))
        return F.array_join(F.transform(kept, lambda t: t["surface"]), "")

    words = F.coalesce(
        blank_to_null(surfaces(near, "^(名詞|形容詞|動詞)", ["", *R.STOP_LEMMAS])),
        surfaces(toks, "^名詞", R.STOP_LEMMAS),
    )
    picked = let(T.strip(words), lambda w: F.when(F.length(w) >= 2, w).otherwise(s))
    return F.when(F.coalesce(F.size(toks), F.lit(0)) == 0, s).otherwise(picked)


def task_fact_override(sentence: Column, verdict: Column) -> Column:
    """Bullets and next actions of a task are next_action with at least .84."""
    force = matches(sentence, R.BULLET) | (verdict["predicate"] == "next_action")
    return F.struct(
        F.when(force, F.lit("next_action")).otherwise(verdict["predicate"]).alias("predicate"),
        F.when(force, F.greatest(verdict["confidence"], F.lit(R.OVERRIDE_CONFIDENCE)))
        .otherwise(verdict["confidence"])
        .alias("confidence"),
    )


def sentence_fact(
    sentence: Column,
    subject: Column,
    occurred: Column | None = None,
    task: bool = False,
    tokens: Column | None = None,
    hints=R.PREDICATE_HINTS,
) -> Column:
    lemmas = None if tokens is None else F.transform(tokens, lambda t: t["lemma"])
    none = F.lit(None).cast("string")

    def build(verdict: Column) -> Column:
        predicate = verdict["predicate"]

        def fact(obj: Column) -> Column:
            return make_fact(
                subject,
                predicate,
                obj,
                object_type(predicate, obj),
                object_json(predicate, obj),
                sentence,
                none if occurred is None else occurred,
                verdict["confidence"],
            )

        # without tokens the object is the sentence itself
        return fact(sentence) if tokens is None else let(object_text(sentence, predicate, tokens), fact)

    found = detect_predicate(sentence, lemmas, hints)
    if task:
        return let(let(found, lambda v: task_fact_override(sentence, v)), build)
    return let(found, build)


def owner_text(parts: list[str]) -> Column:
    return T.strip(F.array_join(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in parts]), "\n"))


def cap_candidates(meta: Column, sentences: Column, max_facts: int | None = None) -> Column:
    """Sentences read before the candidate list is full, at least the first; all without a limit."""
    if max_facts is None:
        return sentences
    return F.slice(sentences, F.lit(1), F.greatest(F.lit(max_facts) - F.size(meta), F.lit(1)))


def dedupe_array(facts: Column, max_facts: int | None = None) -> Column:
    """First fact per normalised key, empty parts dropped, at most max_facts if that is given."""
    filled = F.filter(
        facts,
        lambda f: (T.strip_value(f["subject"]) != "") & (T.strip_value(f["predicate"]) != "") & (T.strip_value(f["object_text"]) != ""),
    )

    def key(f: Column) -> list[Column]:
        return [T.lemma_form(f["subject"]), T.lemma_form(f["predicate"]), T.normalize_for_dedupe(f["object_text"])]

    kept = first_by(filled, key)
    return kept if max_facts is None else F.slice(kept, 1, max_facts)


def dedupe_facts(facts: DataFrame, owner: str, max_facts: int | None = None) -> DataFrame:
    """The same rule over fact rows, for owners with any number of facts.

    Both ranks keep only their winners per task before the shuffle, so an
    owner with very many facts stays cheap.  Rows need ``ord``.
    """
    keys = [owner, "_s", "_p", "_o"]
    filled = facts.withColumns(
        {
            "_s": T.lemma_form("subject"),
            "_p": T.lemma_form("predicate"),
            "_o": T.normalize_for_dedupe("object_text"),
            "_blank": T.strip("object_text") == "",
        }
    )
    kept = filled.where((F.col("_s") != "") & (F.col("_p") != "") & ~F.col("_blank")).drop("_blank")
    first = top_per_key(kept, keys, [F.asc("ord")]).drop("_s", "_p", "_o")
    return first if max_facts is None else top_per_key(first, [owner], [F.asc("ord")], max_facts)


Tokenizer = Callable[[Column], Column]


def _with_facts(
    owners: DataFrame, meta: Column, text: list[str], fact: Callable[[Column, Column | None], Column], max_facts: int | None, tokenize: Tokenizer | None
) -> DataFrame:
    """Owners with a ``facts`` array: the facts of their fields, then those of their sentences.

    ``tokenize`` maps the array of sentences to an array of token arrays in the
    same order; a short sentence of one token is then dropped.
    """
    base = owners.withColumn("_meta", meta).withColumn("_sents", T.split_sentences(owner_text(text)))
    if tokenize is None:
        read = base.withColumn("_sents", cap_candidates(F.col("_meta"), F.col("_sents"), max_facts))
        found = F.transform("_sents", lambda s: fact(s, None))
    else:
        paired = base.withColumn("_tokens", tokenize(F.col("_sents")).cast(f"array<{TOKENS_TYPE}>")).withColumn(
            "_sents", F.filter(F.arrays_zip("_sents", "_tokens"), lambda p: T.keep_sentence(p["_sents"], p["_tokens"]))
        )
        read = paired.withColumn("_sents", cap_candidates(F.col("_meta"), F.col("_sents"), max_facts)).drop("_tokens")
        found = F.transform("_sents", lambda p: fact(p["_sents"], p["_tokens"]))
    rows = read.withColumn("_text_facts", found)
    return rows.withColumn("facts", dedupe_array(F.concat("_meta", "_text_facts"), max_facts)).drop("_meta", "_sents", "_text_facts")


def extract_note_facts(
    notes: DataFrame, max_facts: int | None = None, hints=R.PREDICATE_HINTS, tokenize: Tokenizer | None = None
) -> DataFrame:
    """Notes with a ``facts`` array."""

    def fact(s: Column, tokens: Column | None) -> Column:
        return sentence_fact(s, F.lit("me"), F.col("occurred_at"), tokens=tokens, hints=hints)

    return _with_facts(notes, note_meta_facts(), ["title", "summary", "body"], fact, max_facts, tokenize)


def extract_task_facts(
    tasks: DataFrame, max_facts: int | None = None, hints=R.PREDICATE_HINTS, tokenize: Tokenizer | None = None
) -> DataFrame:
    """Tasks with a ``facts`` array."""
    subject = F.concat(F.lit("task:"), F.col("task_id"))

    def fact(s: Column, tokens: Column | None) -> Column:
        return sentence_fact(s, subject, task=True, tokens=tokens, hints=hints)

    return _with_facts(tasks, task_meta_facts(), ["title", "details"], fact, max_facts, tokenize)


def fact_rows(owners: DataFrame, kind: str, extractor_version: str = "rules-v1", outer: bool = False) -> DataFrame:
    """One key_facts row per fact of a frame with a ``facts`` array; with ``outer`` also a row, without ord, per owner without facts."""
    owner = f"{kind}_id"
    rows = owners.select(owner, F.posexplode_outer("facts").alias("ord", "item")) if outer else explode_rows(owners, "facts", owner)
    rows = rows.select(owner, "ord", "item.*")
    ids = {
        "note_id": F.col(owner) if kind == "note" else F.lit(None).cast("string"),
        "task_id": F.col(owner) if kind == "task" else F.lit(None).cast("string"),
    }
    return rows.select(
        stable_id(F.lit(kind), owner, "subject", "predicate", "object_text").alias("fact_id"),
        *[c.alias(n) for n, c in ids.items()],
        "ord",
        "subject",
        "predicate",
        "object_text",
        "object_type",
        "object_json",
        "evidence_excerpt",
        "occurred_at",
        "confidence",
        F.lit("internal").alias("sensitivity"),
        F.lit(extractor_version).alias("extractor_version"),
    )


def changed_owners(
    owners: DataFrame, facts: DataFrame, key: str, limit: int | None = None, all_rows: bool = False
) -> DataFrame:
    """Active owners without active facts, or updated after their last fact.

    One aggregate per owner with map-side combine and one join on the key.
    """
    active = owners.where(F.col("deleted_at").isNull())
    if all_rows:
        changed = active
    else:
        seen = facts.groupBy(key).agg(
            F.max("updated_at").alias("_last"), F.count_if(F.col("deleted_at").isNull()).alias("_active")
        )
        changed = (
            active.join(seen, key, "left")
            .where((F.coalesce(F.col("_active"), F.lit(0)) == 0) | (F.col("updated_at") > F.col("_last")))
            .drop("_last", "_active")
        )
    return changed if limit is None else changed.orderBy(F.desc("updated_at"), F.asc(key)).limit(limit)


def validate_facts(facts: DataFrame, length_limits: bool = False) -> DataFrame:
    """Adds ``reason``: the first broken rule, or null for a good fact; lengths are checked only if asked."""
    c = F.col
    rules = [
        (~c("object_type").isin(*R.OBJECT_TYPES), F.concat(F.lit("unsupported object_type: "), c("object_type"))),
        (~c("confidence").between(0.0, 1.0), F.lit("confidence out of range")),
        (T.strip("subject") == "", F.lit("subject is empty")),
        (T.strip("predicate") == "", F.lit("predicate is empty")),
        (T.strip("object_text") == "", F.lit("object_text is empty")),
    ]
    lengths = [
        (F.length("subject") > 120, F.lit("subject too long")),
        (F.length("predicate") > 80, F.lit("predicate too long")),
        (F.length("object_text") > 1000, F.lit("object_text too long")),
        (F.length("evidence_excerpt") > 500, F.lit("evidence_excerpt too long")),
    ]
    return facts.withColumn("reason", F.coalesce(*[F.when(test, text) for test, text in rules + (lengths if length_limits else [])]))


def flag_inserts(existing: DataFrame, new: DataFrame, min_conf: float = R.MIN_CONFIDENCE) -> DataFrame:
    """``new`` with ``inserted``: whether an insert against the active existing facts adds the row.

    The new facts are evaluated once: winners per key are ranked and known keys
    joined in the one frame, so rows and counts come from the same flags.
    """
    owner = F.coalesce(F.concat(F.lit("n"), F.col("note_id")), F.concat(F.lit("t"), F.col("task_id")))
    keys = ["_owner", "subject", "predicate", "object_text"]
    good = F.col("reason").isNull() & F.coalesce(F.col("confidence") >= min_conf, F.lit(False)) & F.col("ord").isNotNull()
    active = existing.where(F.col("deleted_at").isNull()).withColumn("_owner", owner).select(*keys).distinct()
    judged = validate_facts(new).withColumn("_owner", owner).withColumn("_good", good)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_good"), F.asc("ord"))) == 1
    ranked = judged.withColumn("_first", first).join(active.withColumn("_known", F.lit(True)), keys, "left")
    flagged = ranked.withColumn("inserted", F.col("_good") & F.col("_first") & F.col("_known").isNull())
    return flagged.select(*new.columns, "inserted")


def insert_facts(
    existing: DataFrame, new: DataFrame, min_conf: float = R.MIN_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """(inserted rows, one-row counts) against the active existing facts."""
    flagged = flag_inserts(existing, new, min_conf)
    return flagged.where("inserted").drop("inserted"), insert_totals(flagged)


def insert_totals(flagged: DataFrame) -> DataFrame:
    """One row: facts inserted and skipped of a flagged frame."""
    return flagged.agg(
        F.count_if("inserted").alias("facts_inserted"), F.count_if(F.col("ord").isNotNull() & ~F.col("inserted")).alias("facts_skipped")
    )


def replace_facts(existing: DataFrame, owners: DataFrame, key: str, as_of: datetime) -> DataFrame:
    """Snapshot with the active facts of the given owners soft-deleted."""
    flagged = existing.join(owners.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit") & F.col("deleted_at").isNull()
    return flagged.select(
        *[c for c in existing.columns if c not in ("deleted_at", "updated_at")],
        F.when(hit, at(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, at(as_of)).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )


RESPONSE_FACT = (
    "struct<subject:string,predicate:string,object_text:string,object_type:string,object_json:string,"
    "evidence_excerpt:string,occurred_at:string,confidence:string>"
)


def facts_from_responses(df: DataFrame, content: str = "content", max_facts: int | None = None) -> DataFrame:
    """Adds ``facts`` parsed from a model's JSON: an object or a bare list."""
    as_object = F.from_json(F.col(content), f"struct<facts:array<{RESPONSE_FACT}>>")["facts"]
    as_list = F.from_json(F.col(content), f"array<{RESPONSE_FACT}>")
    bare = F.ltrim(F.col(content)).startswith("[")
    items = F.when(bare, as_list).otherwise(F.coalesce(as_object, F.array().cast(f"array<{RESPONSE_FACT}>")))

    def clean(i: Column) -> Column:
        def text(name: str) -> Column:
            return T.strip(F.coalesce(i[name], F.lit("")))

        confidence = F.when(i["confidence"].isNull(), F.lit(0.8)).otherwise(
            F.coalesce(i["confidence"].try_cast("double"), F.lit(0.0))
        )
        return make_fact(
            text("subject"),
            text("predicate"),
            text("object_text"),
            F.coalesce(blank_to_null(text("object_type")), F.lit("text")),
            i["object_json"],
            blank_to_null(text("evidence_excerpt")),
            i["occurred_at"],
            confidence,
        )

    read = items if max_facts is None else F.slice(items, 1, max_facts)
    kept = F.filter(read, lambda i: i.isNotNull())
    return df.withColumn("facts", dedupe_array(F.transform(kept, clean), max_facts))


def fact_run_metrics(flagged: DataFrame, replaced: DataFrame | None = None, extractor_version: str = "rules-v1") -> DataFrame:
    """One result row of a fact run, from the flagged rows of ``fact_rows(outer=True)``: an owner's first row counts it."""
    first = F.coalesce(F.col("ord") == 0, F.lit(True))
    out = flagged.agg(
        F.count_if(first).alias("items_processed"),
        F.count_if("inserted").alias("facts_inserted"),
        F.count_if(F.col("ord").isNotNull() & ~F.col("inserted")).alias("facts_skipped"),
    )
    out = out.withColumn("facts_replaced", F.lit(0).cast("bigint")) if replaced is None else merge_rows(out, counted(replaced, "facts_replaced"))
    return out.select(
        "items_processed",
        "facts_inserted",
        "facts_skipped",
        "facts_replaced",
        F.lit(0).cast("bigint").alias("errors"),
        F.lit(extractor_version).alias("extractor_version"),
    )
