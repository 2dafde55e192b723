"""Claim job: model responses become claims, entities and links.

A *bundle* is one row per document that holds its claims, entities and links
as arrays.  Every rule about one document works on its arrays in place, so
parsing, normalising and gating need no shuffle at any scale; child tables
come from exploding the finished bundle.

Bundle columns: document_id, entry_id, raw_text, occurred_at_utc, claims,
entities, links (see ``bundles_from_responses``).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.functions import rules as R
from capturelake.functions import text as T
from capturelake.functions.rx import blank_to_null, explode_rows, first_by, head, let, matches
from capturelake.functions.scalars import artifact_hash, at, expires_at, retry_at

from .classify import canonicalize_predicate
from .coverage import covered_flags, covered_in_order
from .merge import insert_ignore, stable_id

SPAN = "struct<char_start:int,char_end:int,excerpt:string>"
DIMENSION = "struct<dimension_type:string,dimension_value:string,confidence:double,source:string>"
CLAIM = (
    "struct<subject_text:string,predicate:string,object_text_raw:string,object_text_canonical:string,"
    "me_role:string,modality:string,polarity:string,certainty:double,time_start_utc:string,time_end_utc:string,"
    f"subject_entity_name:string,object_entity_name:string,dimensions:array<{DIMENSION}>,evidence_spans:array<{SPAN}>>"
)
ENTITY = "struct<name:string,entity_type:string,aliases:array<string>>"
LINK = "struct<from_idx:int,to_idx:int,relation_type:string,confidence:double>"

# fixed values: limits of the older response format
V1_CAPS = {"claims": 24, "spans": 4, "entities": 40, "aliases": 10, "links": 30}
# fixed values: text lengths of the original job; texts stay whole unless these are passed as ``lengths``
LENGTHS = {"subject": 120, "object": 1000, "name": 160, "excerpt": 500, "value": 200, "evidence": 200, "context": 180}
Lengths = dict[str, int] | None


def _cut(lengths: Lengths, kind: str) -> int | None:
    return (lengths or {}).get(kind)


def record(kind: str, **fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(kind)


#: A response as it is read, in one cast: texts and numbers as text, a wrong type as null.  Values whose JSON type
#: matters stay variants.
RAW_SPAN = "struct<char_start:variant,char_end:variant,excerpt:string>"
RAW_DIMENSION = "struct<dimension_type:string,dimension_value:string,confidence:string,source:string>"
RAW_CLAIM = (
    "struct<subject_text:string,predicate:string,object_text:string,object_text_raw:string,object_text_canonical:string,"
    "me_role:string,modality:string,polarity:string,certainty:string,time_start_utc:string,time_end_utc:string,"
    f"subject_entity_name:string,object_entity_name:string,dimensions:array<{RAW_DIMENSION}>,evidence_spans:array<{RAW_SPAN}>>"
)
RAW_ENTITY = "struct<name:string,entity_type:string,aliases:array<variant>>"
RAW_LINK = "struct<from_claim_index:variant,to_claim_index:variant,relation_type:string,confidence:string>"


def _text(v: Column, field: str) -> Column:
    return F.coalesce(T.strip_value(v[field]), F.lit(""))


def _whole(raw: Column) -> Column:
    """An integer written as a JSON integer, else null."""
    return F.when(F.schema_of_variant(raw) == "BIGINT", F.try_variant_get(raw, "$", "int"))


def _number(v: Column, field: str) -> Column:
    """A number or numeric text; 0 when absent, null when it is neither."""
    return F.when(v[field].isNull(), F.lit(0.0)).otherwise(v[field].try_cast("double"))


def _members(items: Column, cap: int | None) -> Column:
    """Members of a list field, none where it is no list; ``cap`` applies to the raw list, if given."""
    return items if cap is None else F.slice(items, 1, cap)


def _read_all(items: Column, cap: int | None, kind: str, read) -> Column:
    return F.coalesce(F.transform(_members(items, cap), read), F.array().cast(f"array<{kind}>"))


def repair_spans(spans: Column, cap: int | None = None, lengths: Lengths = None) -> Column:
    """Evidence spans of a claim: bad offsets become null, empty ones go."""

    def offsets(s: Column) -> Column:
        def read(o: Column) -> Column:
            good = (o["start"] >= 0) & (o["end"] >= 0) & (o["end"] > o["start"])
            return record(
                SPAN,
                char_start=F.when(good, o["start"]),
                char_end=F.when(good, o["end"]),
                excerpt=head(_text(s, "excerpt"), _cut(lengths, "excerpt")),
            )

        return let(F.struct(_whole(s["char_start"]).alias("start"), _whole(s["char_end"]).alias("end")), read)

    return F.filter(_read_all(spans, cap, SPAN, offsets), lambda s: s["excerpt"] != "")


def filter_dimensions(dimensions: Column, lengths: Lengths = None) -> Column:
    def read(d: Column) -> Column:
        return record(
            DIMENSION,
            dimension_type=_text(d, "dimension_type"),
            dimension_value=head(_text(d, "dimension_value"), _cut(lengths, "value")),
            confidence=_number(d, "confidence"),
            source=F.when(d["source"].isNull(), F.lit("llm")).otherwise(_text(d, "source")),
        )

    return F.filter(
        _read_all(dimensions, None, DIMENSION, read),
        lambda d: d["dimension_type"].isin(*R.DIMENSION_TYPES)
        & (d["dimension_value"] != "")
        & d["source"].isin(*R.DIMENSION_SOURCES)
        & F.coalesce(d["confidence"].between(0.0, 1.0), F.lit(False)),
    )


def parse_claims(
    claims: Column, caps: dict[str, int] | None = None, map_aliases: bool = False, lengths: Lengths = None
) -> Column:
    """Valid claims of a response's claims as read, in order.

    With ``caps`` the older format is read: no roles or dimensions, and the
    object has one spelling.  With ``map_aliases`` unknown predicates are
    mapped by the alias rules first; otherwise they drop the claim.
    """
    caps = caps or {}
    old = bool(caps)

    # each value bound inside an array is copied once more, so fields are read again instead
    def read(c: Column) -> Column:
        raw = _text(c, "object_text") if old else F.coalesce(T.strip_value(F.coalesce(c["object_text_raw"], c["object_text"])), F.lit(""))
        canonical = raw if old else F.when(c["object_text_canonical"].isNotNull(), _text(c, "object_text_canonical")).otherwise(raw)
        predicate = _text(c, "predicate")
        return record(
            CLAIM,
            subject_text=head(_text(c, "subject_text"), _cut(lengths, "subject")),
            predicate=canonicalize_predicate(predicate, raw) if map_aliases else predicate,
            object_text_raw=head(raw, _cut(lengths, "object")),
            object_text_canonical=head(canonical, _cut(lengths, "object")),
            me_role=F.lit("none") if old else _text(c, "me_role"),
            modality=_text(c, "modality"),
            polarity=_text(c, "polarity"),
            certainty=_number(c, "certainty"),
            time_start_utc=blank_to_null(T.strip_value(c["time_start_utc"])),
            time_end_utc=blank_to_null(T.strip_value(c["time_end_utc"])),
            subject_entity_name=blank_to_null(head(T.strip_value(c["subject_entity_name"]), _cut(lengths, "name"))),
            object_entity_name=blank_to_null(head(T.strip_value(c["object_entity_name"]), _cut(lengths, "name"))),
            dimensions=F.array().cast(f"array<{DIMENSION}>") if old else filter_dimensions(c["dimensions"], lengths),
            evidence_spans=repair_spans(c["evidence_spans"], caps.get("spans"), lengths),
        )

    return F.filter(
        _read_all(claims, caps.get("claims"), CLAIM, read),
        lambda c: c["modality"].isin(*R.MODALITIES)
        & c["polarity"].isin(*R.POLARITIES)
        & c["me_role"].isin(*R.ME_ROLES)
        & c["predicate"].isin(*R.CLAIM_PREDICATES)
        & F.coalesce(c["certainty"].between(0.0, 1.0), F.lit(False))
        & (c["subject_text"] != "")
        & (c["object_text_raw"] != "")
        & (c["object_text_canonical"] != "")
        & (F.size(c["evidence_spans"]) > 0),
    )


def parse_entities(entities: Column, caps: dict[str, int] | None = None, lengths: Lengths = None) -> Column:
    caps = caps or {}

    def read(e: Column) -> Column:
        aliases = F.transform(
            F.coalesce(_members(e["aliases"], caps.get("aliases")), F.array().cast("array<variant>")),
            lambda a: F.when(F.schema_of_variant(a) == "STRING", T.strip(F.try_variant_get(a, "$", "string"))),
        )
        cut = _cut(lengths, "name")
        kept = F.transform(F.filter(aliases, lambda a: a.isNotNull() & (a != "")), lambda a: head(a, cut))
        return record(ENTITY, name=head(_text(e, "name"), cut), entity_type=_text(e, "entity_type"), aliases=kept)

    return F.filter(
        _read_all(entities, caps.get("entities"), ENTITY, read),
        lambda e: (e["name"] != "") & e["entity_type"].isin(*R.ENTITY_TYPES),
    )


def parse_links(links: Column, caps: dict[str, int] | None = None) -> Column:
    caps = caps or {}

    def read(k: Column) -> Column:
        return record(
            LINK,
            from_idx=_whole(k["from_claim_index"]),
            to_idx=_whole(k["to_claim_index"]),
            relation_type=_text(k, "relation_type"),
            confidence=_number(k, "confidence"),
        )

    return F.filter(
        _read_all(links, caps.get("links"), LINK, read),
        lambda k: k["relation_type"].isin(*R.RELATIONS)
        & k["from_idx"].isNotNull()
        & k["to_idx"].isNotNull()
        & F.coalesce(k["confidence"].between(0.0, 1.0), F.lit(False)),
    )


def bundles_from_responses(
    df: DataFrame,
    content: str = "content",
    caps: dict[str, int] | None = None,
    map_aliases: bool = False,
    lengths: Lengths = None,
) -> DataFrame:
    """Adds claims, entities, links and parse_error to documents with content.

    The content is parsed once, and each list is read by one cast.
    """
    v = F.col("_v")
    parsed = df.withColumn("_v", F.try_parse_json(F.col(content)))
    return (
        parsed.withColumn("claims", parse_claims(F.try_variant_get(v, "$.claims", f"array<{RAW_CLAIM}>"), caps, map_aliases, lengths))
        .withColumn("entities", parse_entities(F.try_variant_get(v, "$.entities", f"array<{RAW_ENTITY}>"), caps, lengths))
        .withColumn("links", parse_links(F.try_variant_get(v, "$.links", f"array<{RAW_LINK}>"), caps))
        .withColumn("parse_error", F.when(v.isNull(), "content is not json"))
        .drop("_v")
    )


# --- normalising ------------------------------------------------------------


def restore_language(canonical: Column, spans: Column, raw_has_cjk: Column, lengths: Lengths = None) -> Column:
    """Translated objects go back to the words of their first excerpt."""
    excerpt = T.strip_value(F.get(spans, F.lit(0))["excerpt"])
    translated = raw_has_cjk & ~T.has_cjk(canonical) & F.coalesce(T.has_cjk(excerpt), F.lit(False))
    return F.when(translated, head(excerpt, _cut(lengths, "object"))).otherwise(canonical)


def ensure_evidence(spans: Column, canonical: Column, raw: Column, lengths: Lengths = None) -> Column:
    cut = _cut(lengths, "evidence")
    excerpt = F.coalesce(
        blank_to_null(head(raw, cut)), blank_to_null(head(canonical, cut)), F.lit("evidence unavailable")
    )
    none = F.lit(None).cast("int")
    one = F.array(record(SPAN, char_start=none, char_end=none, excerpt=excerpt))
    return F.when(F.size(spans) == 0, one).otherwise(spans)


def me_centric(b: DataFrame, lengths: Lengths = None) -> DataFrame:
    """Subject, predicate, object, role, time and evidence of every claim."""
    prepared = b.withColumn("_cjk", F.coalesce(T.has_cjk("raw_text"), F.lit(False))).withColumn(
        "_raw", T.strip(F.coalesce(F.col("raw_text"), F.lit("")))
    )

    def normalise(c: Column) -> Column:
        subject = T.normalize_subject(c["subject_text"], _cut(lengths, "subject"))
        raw = F.coalesce(blank_to_null(c["object_text_raw"]), c["object_text_canonical"])
        canonical = restore_language(
            F.coalesce(blank_to_null(c["object_text_canonical"]), raw), c["evidence_spans"], F.col("_cjk"), lengths
        )
        return record(
            CLAIM,
            subject_text=subject,
            predicate=canonicalize_predicate(c["predicate"], raw),
            object_text_raw=raw,
            object_text_canonical=canonical,
            me_role=F.when((c["me_role"] == "none") & (subject == "me"), "experiencer").otherwise(c["me_role"]),
            modality=c["modality"],
            polarity=c["polarity"],
            certainty=c["certainty"],
            time_start_utc=F.coalesce(c["time_start_utc"], F.col("occurred_at_utc")),
            time_end_utc=c["time_end_utc"],
            subject_entity_name=c["subject_entity_name"],
            object_entity_name=c["object_entity_name"],
            dimensions=c["dimensions"],
            evidence_spans=ensure_evidence(c["evidence_spans"], canonical, F.col("_raw"), lengths),
        )

    return prepared.withColumn("claims", F.transform("claims", normalise)).drop("_cjk", "_raw")


def made_claim(subject, predicate, text, role, modality, certainty, start, excerpt) -> Column:
    none = F.lit(None)
    span = record(SPAN, char_start=none.cast("int"), char_end=none.cast("int"), excerpt=excerpt)
    return record(
        CLAIM,
        subject_text=F.lit(subject),
        predicate=predicate,
        object_text_raw=text,
        object_text_canonical=text,
        me_role=F.lit(role),
        modality=modality,
        polarity=F.lit("affirm"),
        certainty=certainty,
        time_start_utc=start,
        time_end_utc=none.cast("string"),
        subject_entity_name=none.cast("string"),
        object_entity_name=none.cast("string"),
        dimensions=F.array().cast(f"array<{DIMENSION}>"),
        evidence_spans=F.array(span),
    )


def fallback_claims(b: DataFrame, lengths: Lengths = None) -> DataFrame:
    """A document without claims gets one that says what was recorded."""
    text = T.strip(F.coalesce(F.col("raw_text"), F.lit("")))
    made = made_claim(
        "me",
        F.lit("experienced"),
        F.coalesce(blank_to_null(head(text, _cut(lengths, "object"))), F.lit("entry recorded")),
        "experiencer",
        F.lit("fact"),
        F.lit(0.5),
        F.col("occurred_at_utc"),
        F.coalesce(blank_to_null(head(text, _cut(lengths, "evidence"))), F.lit("no text")),
    )
    return b.withColumn("claims", F.when(F.size("claims") == 0, F.array(made)).otherwise(F.col("claims")))


def _carried(values: Column) -> Column:
    """For each element the last one before it that is not null; the values' places cut the array into runs."""

    def runs(places: Column) -> Column:
        before = F.array_repeat(F.get(values, F.lit(-1)), F.coalesce(F.get(places, F.lit(0)) + 1, F.size(values)))
        behind = F.transform(
            places, lambda p, k: F.array_repeat(F.get(values, p), F.coalesce(F.get(places, k + 1), F.size(values) - 1) - p)
        )
        return F.concat(before, F.flatten(behind))

    return let(F.filter(F.transform(values, lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull()), runs)


def complete_context(b: DataFrame, lengths: Lengths = None) -> DataFrame:
    """State changes told without a topic get the last topic named before.

    Topics are found once per claim and carried along the claims once.
    """
    topics = F.transform("claims", lambda c: T.extract_topic(c["object_text_canonical"]))
    any_topic = F.exists("_topics", lambda t: t.isNotNull())

    def complete(c: Column, i: Column) -> Column:
        text = T.strip(c["object_text_canonical"])
        earlier = F.get(F.col("_earlier"), i)
        needs = F.get(F.col("_topics"), i).isNull() & earlier.isNotNull() & ~text.contains(earlier) & T.needs_completion(text)
        filled = head(F.concat(earlier, F.lit("が"), T.normalize_time_prefix(text)), _cut(lengths, "object"))
        return F.when(needs, c.withField("object_text_canonical", filled)).otherwise(c)

    carried = b.withColumn("_topics", topics).withColumn("_earlier", F.when(any_topic, _carried(F.col("_topics"))))
    return carried.withColumn(
        "claims", F.when(F.col("_earlier").isNotNull(), F.transform("claims", complete)).otherwise(F.col("claims"))
    ).drop("_topics", "_earlier")


def action_clauses(raw_text: Column) -> Column:
    """Clauses of a text that tell an action or a plan."""
    return F.filter(
        T.split_clauses(F.coalesce(raw_text, F.lit(""))),
        lambda c: (F.length(c) >= 4) & (matches(c, R.ACTION_HINT, ci=True) | matches(c, R.PLAN_HINT, ci=True)),
    )


def covered_clauses(b: DataFrame, clauses: str, texts: str) -> DataFrame:
    """Adds covered: one flag per clause, by the texts of the same row."""
    return b.withColumn("covered", covered_flags(F.col(clauses), F.col(texts)))


def clause_claim(clause: Column, start: Column, lengths: Lengths = None) -> Column:
    plan = matches(clause, R.PLAN_HINT, ci=True)
    return made_claim(
        "me",
        F.when(plan, "planned").otherwise("did"),
        head(clause, _cut(lengths, "object")),
        "actor",
        F.when(plan, "plan").otherwise("fact"),
        F.when(plan, F.lit(0.72)).otherwise(F.lit(0.68)),
        start,
        head(clause, _cut(lengths, "evidence")),
    )


def augment_claims(b: DataFrame, lengths: Lengths = None) -> DataFrame:
    """Appends action clauses no claim covers.

    An appended clause covers later ones too, so they are judged in order.
    """
    prepared = b.withColumn("_clauses", action_clauses(F.col("raw_text")))
    some = F.size("_clauses") > 0
    seen = F.when(some, F.transform("claims", lambda c: c["object_text_canonical"]))
    judged = prepared.withColumn("_covered", covered_in_order(F.when(some, F.col("_clauses")), seen))
    fresh = F.filter("_clauses", lambda c, i: ~F.get(F.col("_covered"), i))
    appended = F.transform(fresh, lambda c: clause_claim(c, F.col("occurred_at_utc"), lengths))
    return judged.withColumn("claims", F.when(some, F.concat("claims", appended)).otherwise(F.col("claims"))).drop(
        "_clauses", "_covered"
    )


def valid_links(b: DataFrame, size: Column | None = None) -> DataFrame:
    """Drops links whose index is outside the claims."""
    n = F.size("claims") if size is None else size
    inside = F.filter(
        "links", lambda k: (k["from_idx"] >= 0) & (k["from_idx"] < n) & (k["to_idx"] >= 0) & (k["to_idx"] < n)
    )
    return b.withColumn("links", inside)


def _indexes(test) -> Column:
    """Positions of the claims that pass a test."""
    hits = F.transform("claims", lambda c, i: F.when(test(c), i))
    return F.filter(hits, lambda i: i.isNotNull())


def _decisions() -> Column:
    return _indexes(lambda c: c["predicate"].isin(*R.DECISION_PREDICATES))


def _cause_links(decisions: Column, cause: Column, confidence: float) -> Column:
    return F.transform(
        decisions,
        lambda d: record(
            LINK, from_idx=d, to_idx=cause, relation_type=F.lit("caused_by"), confidence=F.lit(confidence)
        ),
    )


def infer_causes(b: DataFrame) -> DataFrame:
    """Decisions without a stated cause link to the first event or rain."""
    prepared = b.withColumn("_d", _decisions()).withColumn(
        "_c",
        F.get(
            _indexes(
                lambda c: ~c["predicate"].isin(*R.DECISION_PREDICATES)
                & (c["predicate"].isin(*R.EVENT_PREDICATES) | matches(c["object_text_canonical"], R.RAIN_HINT, ci=True))
            ),
            F.lit(0),
        ),
    )
    decides = lambda i: F.coalesce(F.get("claims", i)["predicate"].isin(*R.DECISION_PREDICATES), F.lit(False))
    stated = F.exists("links", lambda k: (k["relation_type"] == "caused_by") & decides(k["from_idx"]))
    infer = ~stated & F.col("_c").isNotNull()
    return prepared.withColumn(
        "links",
        F.when(infer, F.concat("links", _cause_links(F.col("_d"), F.col("_c"), 0.75))).otherwise(F.col("links")),
    ).drop("_d", "_c")


def context_claims(b: DataFrame, lengths: Lengths = None) -> DataFrame:
    """Decisions without any event, in a text that hints at a cause, get a
    context claim and links to it."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    told = blank_to_null(head(text, _cut(lengths, "context")))
    prepared = b.withColumn("_d", _decisions()).withColumn(
        "_add",
        (F.size("_d") > 0)
        & ~F.exists("claims", lambda c: c["predicate"].isin(*R.EVENT_PREDICATES))
        & (matches(text, R.RAIN_HINT, ci=True) | matches(text, R.CAUSE_HINT, ci=True)),
    )
    made = made_claim(
        "context", F.lit("happened"), F.coalesce(told, F.lit("context event happened")), "none", F.lit("fact"), F.lit(0.7),
        F.col("occurred_at_utc"), F.coalesce(told, F.lit("context event")),
    )
    links = F.concat("links", _cause_links(F.col("_d"), F.size("claims"), 0.72))
    return (
        prepared.withColumn("links", F.when(F.col("_add"), links).otherwise(F.col("links")))
        .withColumn("claims", F.when(F.col("_add"), F.concat("claims", F.array(made))).otherwise(F.col("claims")))
        .drop("_d", "_add")
    )


def normalize_bundles(b: DataFrame, lengths: Lengths = None) -> DataFrame:
    """All normalising rules in order; stated links keep their indexes."""
    named = fallback_claims(me_centric(b, lengths), lengths)
    sized = named.withColumn("_n", F.size("claims"))
    completed = augment_claims(complete_context(sized, lengths), lengths)
    linked = valid_links(completed, F.col("_n")).drop("_n")
    return context_claims(infer_causes(linked), lengths)


def new_places(keep: Column, drop: Column) -> Column:
    """Where each element of an array goes when only some stay, null for the others, from both lists of positions.

    One sort by the old position, so that every look-up is by index.
    """
    stay = F.transform(keep, lambda old, new: F.struct(old.alias("old"), new.cast("int").alias("new")))
    gone = F.transform(drop, lambda old: F.struct(old.alias("old"), F.lit(None).cast("int").alias("new")))
    return F.transform(F.sort_array(F.concat(stay, gone)), lambda x: x["new"])


def quality_gate(b: DataFrame) -> DataFrame:
    """Drops claims with a blank object, re-indexes links, adds quality_flags."""

    def blank(c: Column) -> Column:
        return T.strip(F.coalesce(c["object_text_canonical"], F.lit(""))) == ""

    prepared = b.withColumn("_keep", _indexes(lambda c: ~blank(c))).withColumn("_bad", _indexes(blank)).withColumn(
        "_place", F.when(F.size("_bad") > 0, new_places(F.col("_keep"), F.col("_bad")))
    )

    def moved(i: Column) -> Column:
        inside = (i >= 0) & (i < F.size("claims"))
        return F.when(inside, F.coalesce(F.get(F.col("_place"), i), F.when(F.col("_place").isNull(), i)))

    links = F.filter(
        F.transform(
            "links",
            lambda k: k.withField("from_idx", moved(k["from_idx"])).withField("to_idx", moved(k["to_idx"])),
        ),
        lambda k: k["from_idx"].isNotNull() & k["to_idx"].isNotNull(),
    )
    return (
        prepared.withColumn("links", links)
        .withColumn("claims", F.filter("claims", lambda c: ~blank(c)))
        .withColumn(
            "quality_flags",
            F.transform("_bad", lambda i: F.concat(F.lit("claim_rejected:"), i.cast("string"))),
        )
        .drop("_keep", "_bad", "_place")
    )


def retry_status(b: DataFrame, as_of: datetime, max_flags: int | None = None) -> DataFrame:
    """Job outcome of a gated bundle: succeeded, or queued for a retry."""
    failed = F.coalesce(F.col("parse_error").isNotNull(), F.lit(False)) | (F.size("claims") == 0)
    return (
        b.withColumn("status", F.when(failed, "queued").otherwise("succeeded"))
        .withColumn("next_retry_at", F.when(failed, retry_at(as_of)))
        .withColumn("error_code", F.when(failed, "retryable_error"))
        .withColumn(
            "error",
            F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
            .when(F.size("claims") == 0, "quality_gate_rejected_all_claims")
            .otherwise(blank_to_null(F.array_join(F.col("quality_flags") if max_flags is None else F.slice("quality_flags", 1, max_flags), ","))),
        )
    )


# --- child tables -------------------------------------------------------------


def entity_rows(b: DataFrame) -> DataFrame:
    rows = explode_rows(b, "entities", "document_id")
    return rows.select(
        "document_id",
        F.col("ord"),
        F.col("item.name").alias("canonical_name"),
        F.col("item.entity_type").alias("entity_type"),
        F.col("item.aliases").alias("aliases"),
        stable_id(F.lit("entity"), "item.entity_type", "item.name").alias("entity_id"),
    )


def resolve_entities(new: DataFrame, existing: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(mentions with their entity_id, entities to create) by (type, name).

    Mentions are reduced to distinct keys for the insert; a stored id
    replaces the derived one by a join on the key.
    """
    keys = ["entity_type", "canonical_name"]
    known = existing.select(*keys, F.col("entity_id").alias("_known"))
    created = insert_ignore(existing, new.select(*keys, "entity_id"), keys).withColumn("created_at", at(as_of))
    mapped = new.join(known, keys, "left").withColumn("entity_id", F.coalesce("_known", "entity_id")).drop("_known")
    return mapped, created


def upsert_aliases(mentions: DataFrame, existing: DataFrame) -> DataFrame:
    """New alias rows, first spelling per (entity, normalised alias)."""
    rows = explode_rows(mentions, "aliases", "entity_id", "document_id", ord_name="pos", item="alias")
    named = rows.withColumn("normalized_alias", T.normalize_alias("alias")).where(F.col("normalized_alias") != "")
    keys = ["entity_id", "normalized_alias"]
    order = [F.asc("document_id"), F.asc("pos")]
    out = insert_ignore(existing, named, keys, order)
    return out.select("entity_id", "alias", "normalized_alias")


#: So many names are looked through for each claim; more are sorted.
FEW_NAMES = 32


def _named_types(names: Column, entities: Column) -> Column:
    """For each name the type of the last entity of that name; null without one."""
    asked = F.transform(names, lambda n: F.struct(n.alias("name")))
    few = let(
        F.struct(F.reverse(entities["name"]).alias("names"), F.reverse(entities["entity_type"]).alias("types")),
        # no place is 0, and what stands before the first is null
        lambda e: F.transform(names, lambda n: F.get(e["types"], (F.array_position(e["names"], n) - 1).cast("int"))),
    )
    return F.when(F.size(entities) <= FEW_NAMES, few).otherwise(_sorted_types(asked, entities))


def _sorted_types(asked: Column, entities: Column) -> Column:
    """The same for any number of entities.

    Entities and claims are sorted together by name, which cuts them into runs,
    each with its entities first; a second sort brings the claims' order back.
    """
    kind = "struct<name:string,side:int,place:int,type:string>"
    none = F.lit(None)
    told = F.transform(
        entities,
        lambda e, i: F.struct(e["name"].alias("name"), F.lit(0).alias("side"), i.alias("place"), e["entity_type"].alias("type")).cast(kind),
    )
    lookups = F.transform(
        asked, lambda c, i: F.struct(c["name"].alias("name"), F.lit(1).alias("side"), i.alias("place"), none.alias("type")).cast(kind)
    )

    def answers(run: Column) -> Column:
        known = F.filter(run, lambda x: x["side"] == 0)
        type_ = F.when(F.get(run, F.lit(0))["name"].isNotNull(), F.get(known, F.size(known) - 1)["type"])
        return let(
            type_, lambda t: F.transform(F.filter(run, lambda x: x["side"] == 1), lambda x: F.struct(x["place"].alias("place"), t.alias("type")))
        )

    def walk(rows: Column) -> Column:
        starts = F.filter(
            F.transform(rows, lambda x, i: F.when((i == 0) | ~F.get(rows, i - 1)["name"].eqNullSafe(x["name"]), i)), lambda i: i.isNotNull()
        )
        return let(
            starts,
            lambda s: F.flatten(
                F.transform(s, lambda p, k: let(F.slice(rows, p + 1, F.coalesce(F.get(s, k + 1), F.size(rows)) - p), answers))
            ),
        )

    found = let(F.sort_array(F.concat(told, lookups)), walk)
    return F.transform(F.sort_array(found), lambda x: x["type"])


def write_bundle(
    b: DataFrame, as_of: datetime, extraction_id: str = "extraction_id", extractor_version: str = "rules"
) -> dict[str, DataFrame]:
    """Child tables of gated bundles: claims, dimensions, spans and links.

    Claim ids come from document, extraction and position.  Entities are
    found by name only, and the last one of that name wins.
    """
    written = F.size("claims") > 0
    ready = b.withColumn("entities", F.when(written, F.col("entities")).otherwise(F.slice("entities", 1, 0)))
    keep = ["document_id", "entry_id", extraction_id]
    sides = ["subject_entity_name", "object_entity_name"]
    fields = [
        "subject_text", "predicate", "object_text_raw", "object_text_canonical", "me_role", "modality", "polarity", "certainty",
        "time_start_utc", "time_end_utc", *sides,
    ]
    named = ready.withColumns({f"{n}_type": _named_types(F.col(f"claims.{n}"), F.col("entities")) for n in sides})
    # the rows of claims hold their own fields only
    zipped = named.withColumn("_rows", F.arrays_zip(*[f"claims.{f}" for f in fields], *[f"{n}_type" for n in sides]))
    base = explode_rows(zipped, "_rows", *keep, item="c")

    def claim_id(ord_col: Column) -> Column:
        return stable_id(F.lit("claim"), "document_id", extraction_id, ord_col)

    def entity_id(name: str) -> Column:
        kind = F.col(f"c.{name}_type")
        return F.when(kind.isNotNull(), stable_id(F.lit("entity"), kind, f"c.{name}"))

    def parts(field: str) -> DataFrame:
        """Claims with one of their lists."""
        lists = ready.withColumn("_lists", F.col(f"claims.{field}"))
        return explode_rows(lists, "_lists", *keep, item=field).withColumn("claim_id", claim_id(F.col("ord")))

    claims = base.withColumn("claim_id", claim_id(F.col("ord"))).select(
        "claim_id",
        "document_id",
        "entry_id",
        F.col(extraction_id).alias("extraction_id"),
        "ord",
        "c.subject_text",
        entity_id("subject_entity_name").alias("subject_entity_id"),
        "c.predicate",
        "c.object_text_raw",
        "c.object_text_canonical",
        entity_id("object_entity_name").alias("object_entity_id"),
        "c.me_role",
        "c.modality",
        "c.polarity",
        "c.certainty",
        F.col("c.certainty").alias("quality_score"),
        F.array().cast("array<string>").alias("quality_flags"),
        F.try_to_timestamp(F.col("c.time_start_utc")).alias("time_start_utc"),
        F.try_to_timestamp(F.col("c.time_end_utc")).alias("time_end_utc"),
        F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("supersedes_claim_id"),
        F.lit(extractor_version).alias("extractor_version"),
        F.lit(None).cast("string").alias("revision_note"),
        at(as_of).alias("created_at"),
        at(as_of).alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )

    def norm(d: Column) -> Column:
        return let(T.normalize_alias(d["dimension_value"]), lambda n: F.when(n != "", n).otherwise(F.lower(d["dimension_value"])))

    normed = parts("dimensions").withColumn("_dims", F.transform("dimensions", lambda d: d.withField("normalized_value", norm(d))))
    unique = normed.withColumn(
        "_dims",
        first_by(F.col("_dims"), lambda d: [d["dimension_type"], d["normalized_value"], d["source"]]),
    )
    dims = explode_rows(unique, "_dims", "claim_id").select("claim_id", "ord", "item.*", at(as_of).alias("created_at"))
    spans = explode_rows(parts("evidence_spans"), "evidence_spans", "claim_id", "document_id").select(
        "claim_id", "document_id", "ord", "item.*", at(as_of).alias("created_at")
    )
    n = F.size("claims")
    in_range = ready.withColumn(
        "_links",
        first_by(
            F.filter("links", lambda k: (k["from_idx"] < n) & (k["to_idx"] < n)),
            lambda k: [k["from_idx"], k["to_idx"], k["relation_type"]],
        ),
    )
    links = explode_rows(in_range, "_links", *keep).select(
        "document_id",
        claim_id(F.col("item.from_idx")).alias("from_claim_id"),
        claim_id(F.col("item.to_idx")).alias("to_claim_id"),
        F.col("item.from_idx").alias("from_idx"),
        F.col("item.to_idx").alias("to_idx"),
        F.col("item.relation_type").alias("relation_type"),
        F.col("item.confidence").alias("confidence"),
        at(as_of).alias("created_at"),
    )
    return {"claims": claims, "dimensions": dims, "spans": spans, "links": links, "entities": entity_rows(ready)}


def bundle_counts(b: DataFrame) -> DataFrame:
    """Per document: claims, evidence spans, entities and links written."""
    n = F.size("claims")
    unique_links = first_by(
        F.filter("links", lambda k: (k["from_idx"] < n) & (k["to_idx"] < n)),
        lambda k: [k["from_idx"], k["to_idx"], k["relation_type"]],
    )
    spans = F.aggregate("claims", F.lit(0), lambda a, c: a + F.size(c["evidence_spans"]))
    return b.select(
        "document_id",
        n.alias("claims_inserted"),
        spans.alias("evidence_inserted"),
        F.size("entities").alias("entities_upserted"),
        F.size(unique_links).alias("links_inserted"),
    )


def supersede_claims(claims: DataFrame, entries: DataFrame, as_of: datetime) -> DataFrame:
    """Snapshot with the active claims of the given entries superseded."""
    marked = claims.join(entries.select("entry_id").distinct().withColumn("_hit", F.lit(True)), "entry_id", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("deleted_at").isNull()
    changed = {
        "status": F.when(hit, "superseded").otherwise(F.col("status")),
        "updated_at": F.when(hit, at(as_of)).otherwise(F.col("updated_at")),
        "deleted_at": F.when(hit, at(as_of)).otherwise(F.col("deleted_at")),
    }
    return marked.select(*[changed.get(c, F.col(c)).alias(c) for c in claims.columns])


# --- request log ---------------------------------------------------------------


def classify_errors(df: DataFrame, error: str = "unwrap_error", max_chars: int | None = None) -> DataFrame:
    """Adds request_status, error_type and error_message of a response row.

    Columns read: http_status, http_detail, network_error and the parse
    error of the body.
    """
    http = F.col("http_status") >= 400
    network = F.col("network_error").isNotNull()
    parse = F.col(error).isNotNull()
    timed_out = F.lower("network_error").contains("timed out")
    message = (
        F.when(http, F.concat_ws(" ", F.col("http_status").cast("string"), F.col("http_detail")))
        .when(network, F.col("network_error"))
        .when(parse, F.col(error))
    )
    return (
        df.withColumn("request_status", F.when(network & timed_out & ~F.coalesce(http, F.lit(False)), "timeout").when(http | network | parse, "error").otherwise("ok"))
        .withColumn("error_type", F.when(http, "http_error").when(network, "network_error").when(parse, "parse_error"))
        .withColumn("error_message", head(message, max_chars))
    )


def request_log(responses: DataFrame) -> DataFrame:
    """Request rows of priced, classified responses.

    Transport errors log no tokens and no prices, as nothing was returned.
    """
    sent = F.col("error_type").isin("http_error", "network_error")
    lost = F.coalesce(sent, F.lit(False))
    tokens = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]
    prices = ["input_price", "cached_price", "output_price"]
    zero = F.lit(0)
    return responses.select(
        stable_id(F.lit("request"), "document_id", "extraction_id").alias("request_id"),
        F.col("entry_id").alias("source_ref_id"),
        F.lit("entry").alias("source_ref_type"),
        F.lit("/chat/completions").alias("endpoint"),
        "model",
        F.lit("extract_claims_llm").alias("operation"),
        F.lit("fact_extraction").alias("workflow"),
        F.col("request_status").alias("status"),
        F.when(~lost, F.col("response_id")).alias("provider_request_id"),
        *[F.when(lost, zero).otherwise(F.col(t)).cast("bigint").alias(t) for t in tokens],
        F.when(lost, zero).otherwise(F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("total_tokens"),
        *[F.when(~lost, F.col(p)).alias(p) for p in prices],
        F.when(lost, zero.cast("decimal(12,6)")).otherwise(F.col("request_cost_usd")).alias("request_cost_usd"),
        F.length("raw_text").alias("input_chars"),
        F.when(~lost, F.length("content")).alias("output_chars"),
        "error_type",
        "error_message",
    )


def artifacts(responses: DataFrame, as_of: datetime) -> DataFrame:
    """Artifact rows: prompt_meta always, then response_meta or
    validation_error; the hash covers the sorted-key JSON."""
    prompt = {"model": F.col("model"), "input_chars": F.length("raw_text")}
    good = {
        "openai_request_id": F.col("response_id"),
        "input_tokens": F.col("input_tokens"),
        "output_tokens": F.col("output_tokens"),
        "request_cost_usd": F.col("request_cost_usd").cast("double"),
    }
    bad = {"error_type": F.col("error_type"), "detail": F.col("error_message")}

    def row(kind: str, cols: dict[str, Column]) -> Column:
        return F.struct(F.lit(kind).alias("artifact_type"), artifact_hash(cols).alias("sha256"))

    second = F.when(F.col("error_type").isNull(), row("response_meta", good)).otherwise(row("validation_error", bad))
    rows = responses.select("extraction_id", F.explode(F.array(row("prompt_meta", prompt), second)).alias("a"))
    return rows.select("extraction_id", "a.artifact_type", "a.sha256", expires_at(as_of).alias("expires_at"))


# --- prompts --------------------------------------------------------------------


def _parts(df: DataFrame, text: Column, n: int) -> DataFrame:
    """One row per ``n`` characters of a text, so that a prompt is bounded and
    no character is lost: part from 0, offset in characters, chunk.  A null
    or empty text makes one empty part."""
    whole = df.withColumn("_text", F.coalesce(text, F.lit("")))
    last = F.greatest(F.ceil(F.length("_text") / n).cast("int") - 1, F.lit(0))
    return (
        whole.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("offset", F.col("part") * n)
        .withColumn("chunk", F.substring(F.col("_text"), F.col("offset") + 1, F.lit(n)))
        .drop("_text")
    )


def _prompt(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields, "part", "offset"), {"ignoreNullFields": "false"}).alias("prompt")


def note_prompts(notes: DataFrame, n: int = 6000) -> DataFrame:
    """Prompts of notes, as many parts as the body needs."""
    fields = ["note_type", "occurred_at", "journal_date", "mood_score", "energy_score", "source_url"]
    return _parts(notes, T.collapse("body"), n).select(
        "note_id",
        "part",
        _prompt(
            F.lit("note").alias("item_type"),
            F.col("note_id").alias("id"),
            F.coalesce(T.collapse("title"), F.lit("")).alias("title"),
            F.coalesce(T.collapse("summary"), F.lit("")).alias("summary"),
            F.col("chunk").alias("body"),
            *fields,
        ),
    )


def task_prompts(tasks: DataFrame, n: int = 6000) -> DataFrame:
    """Prompts of tasks, as many parts as the details need."""
    fields = ["status", "priority", "due_at", "scheduled_at", "done_at", "source_note_id"]
    return _parts(tasks, T.collapse("details"), n).select(
        "task_id",
        "part",
        _prompt(
            F.lit("task").alias("item_type"),
            F.col("task_id").alias("id"),
            F.coalesce(T.collapse("title"), F.lit("")).alias("title"),
            F.col("chunk").alias("details"),
            *fields,
        ),
    )


def document_prompts(docs: DataFrame, n: int = 7000, text: str = "safe_text") -> DataFrame:
    """Request parts of a document that may be sent: type, time and text, as
    many as the text needs."""
    return _parts(docs.where(F.col("redaction_state") != "blocked"), F.col(text), n).select(
        "document_id", "part", _prompt("declared_type", "occurred_at_utc", F.col("chunk").alias("text"))
    )
