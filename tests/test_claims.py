"""Claim parsing, normalising and writing on hand-written documents."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from capturelake.functions import scalars as SC
from capturelake.operators import claims as C
from capturelake.operators import contract as K
from capturelake.streaming import streams as Sm

AS_OF = datetime(2024, 5, 1)


def claim(**over):
    base = {
        "subject_text": "私", "predicate": "did", "object_text_raw": "走った", "object_text_canonical": "走った", "me_role": "none",
        "modality": "fact", "polarity": "affirm", "certainty": 0.8, "time_start_utc": None, "time_end_utc": None,
        "subject_entity_name": None, "object_entity_name": None, "dimensions": [],
        "evidence_spans": [{"char_start": 0, "char_end": 3, "excerpt": "走った"}],
    }
    return {**base, **over}


def bundles(spark, raw_text, claims, links=(), entities=(), caps=None, map_aliases=False):
    content = json.dumps({"claims": list(claims), "links": list(links), "entities": list(entities)}, ensure_ascii=False)
    df = spark.createDataFrame(
        [("d1", "e1", raw_text, "2024-01-01T00:00:00Z", "x1", content)],
        "document_id string, entry_id string, raw_text string, occurred_at_utc string, extraction_id string, content string",
    )
    return C.bundles_from_responses(df, caps=caps, map_aliases=map_aliases)


def claims_of(df):
    return df.first()["claims"]


def test_parser_drops_and_repairs(spark):
    spans = [
        {"char_start": 5, "char_end": 2, "excerpt": "a"}, {"char_start": "1", "char_end": 2, "excerpt": "b"},
        {"char_start": -1, "char_end": 2, "excerpt": "c"}, {"char_start": 1, "char_end": 4, "excerpt": " d "}, {"excerpt": " "}, "junk",
    ]
    dims = [
        {"dimension_type": "place", "dimension_value": "Tokyo", "confidence": 0.5}, {"dimension_type": "x", "dimension_value": "y", "confidence": 0.5},
        {"dimension_type": "place", "dimension_value": "Z", "confidence": 2, "source": "llm"}, {"dimension_type": "place", "dimension_value": "Z", "confidence": "bad"},
    ]
    bad = [
        claim(modality="maybe"), claim(polarity="?"), claim(me_role="boss"), claim(certainty=1.2), claim(certainty="x"), claim(predicate="flew"),
        claim(subject_text=" "), claim(object_text_canonical=" "), claim(evidence_spans=[]), "junk", 5,
    ]
    out = claims_of(bundles(spark, "t", [claim(evidence_spans=spans, dimensions=dims, certainty="0.25"), *bad]))
    assert len(out) == 1 and out[0]["certainty"] == 0.25
    assert [(s["char_start"], s["char_end"], s["excerpt"]) for s in out[0]["evidence_spans"]] == [
        (None, None, "a"), (None, None, "b"), (None, None, "c"), (1, 4, "d"),
    ]
    assert [(d["dimension_value"], d["source"]) for d in out[0]["dimensions"]] == [("Tokyo", "llm")]


def test_parser_has_no_cap_but_old_format_has(spark):
    many = [claim(object_text=f"o{i}") for i in range(30)]
    assert len(claims_of(bundles(spark, "t", many))) == 30
    old = claims_of(bundles(spark, "t", many, caps=C.V1_CAPS))
    assert len(old) == 24 and old[3]["object_text_canonical"] == "o3"


def test_links_and_entities(spark):
    links = [
        {"from_claim_index": 0, "to_claim_index": 1, "relation_type": "supports", "confidence": 0.5},
        {"from_claim_index": "0", "to_claim_index": 1, "relation_type": "supports", "confidence": 0.5},
        {"from_claim_index": 0, "to_claim_index": 1, "relation_type": "knows", "confidence": 0.5},
        {"from_claim_index": 0, "to_claim_index": 1.0, "relation_type": "supports", "confidence": 0.5},
    ]
    entities = [{"name": " A ", "entity_type": "person", "aliases": [" a ", "", 3]}, {"name": "B", "entity_type": "alien"}]
    row = bundles(spark, "t", [claim()], links, entities).first()
    assert [(k["from_idx"], k["to_idx"]) for k in row["links"]] == [(0, 1)]
    assert [(e["name"], list(e["aliases"])) for e in row["entities"]] == [("A", ["a"])]


def test_unreadable_content_is_queued(spark):
    df = spark.createDataFrame([("d", "e", "text", "t", "x", "{bad")], "document_id string, entry_id string, raw_text string, occurred_at_utc string, extraction_id string, content string")
    out = C.retry_status(C.quality_gate(C.normalize_bundles(C.bundles_from_responses(df))), AS_OF).first()
    assert (out["status"], out["error_code"]) == ("queued", "retryable_error")
    assert out["next_retry_at"] == datetime(2024, 5, 1, 0, 5)


def test_me_centric_and_language(spark):
    raw = "雨が降ったので早く帰った"
    c = claim(object_text_raw="It rained", object_text_canonical="It rained", evidence_spans=[{"char_start": 0, "char_end": 4, "excerpt": "雨が降った"}])
    out = claims_of(C.me_centric(bundles(spark, raw, [c, claim(subject_text="同僚", me_role="observer")])))
    assert (out[0]["subject_text"], out[0]["me_role"], out[0]["object_text_canonical"]) == ("me", "experiencer", "雨が降った")
    assert out[0]["time_start_utc"] == "2024-01-01T00:00:00Z"
    assert (out[1]["subject_text"], out[1]["me_role"]) == ("同僚", "observer")


def test_alias_mapping_option(spark):
    c = claim(predicate="visit", object_text_raw="公園", object_text_canonical="公園")
    assert claims_of(bundles(spark, "t", [c])) == []
    assert claims_of(bundles(spark, "t", [c], map_aliases=True))[0]["predicate"] == "went_to"


def test_fallback(spark):
    out = claims_of(C.normalize_bundles(bundles(spark, " 散歩 ", [])))
    assert (out[0]["predicate"], out[0]["object_text_canonical"], out[0]["certainty"]) == ("experienced", "散歩", 0.5)


def test_context_completion(spark):
    texts = ["喉が痛い", "今日はさらに悪化した", "昼は仕事だった", "急に回復した"]
    given = [claim(object_text_raw=t, object_text_canonical=t) for t in texts]
    out = claims_of(C.complete_context(bundles(spark, "x", given)))
    assert [c["object_text_canonical"] for c in out] == ["喉が痛い", "喉が今日にさらに悪化した", "昼は仕事だった", "喉が急に回復した"]


def test_augment_is_ordered(spark):
    raw = "会議に出た、資料を作って送った。明日は運動する予定、会議に出た。"
    out = claims_of(C.augment_claims(bundles(spark, raw, [claim(object_text_raw="会議に出た", object_text_canonical="会議に出た")])))
    assert [(c["predicate"], c["object_text_canonical"]) for c in out[1:]] == [("did", "資料を作って送った"), ("planned", "明日は運動する予定")]
    again = "買っておく本、買っておく本。"
    out = claims_of(C.augment_claims(bundles(spark, again, [claim()])))
    assert len(out) == 2


def test_coverage(spark):
    clauses = ["資料を作った", "abc def", "会議の準備をした", "。。", "xyz"]
    texts = ["資料を 作ったあと", "ABC-DEF", "会議準備", ""]
    df = spark.createDataFrame([(clauses, texts)], "c array<string>, t array<string>")
    assert C.covered_clauses(df, "c", "t").first()["covered"] == [True, True, True, True, False]


def test_causes_and_context(spark):
    chose = claim(predicate="chose", object_text_raw="タクシー", object_text_canonical="タクシー")
    rain = claim(predicate="happened", object_text_raw="雨", object_text_canonical="雨")
    row = C.normalize_bundles(bundles(spark, "雨なのでタクシー", [chose, rain])).first()
    assert [(k["from_idx"], k["to_idx"], k["confidence"]) for k in row["links"]] == [(0, 1, 0.75)]
    stated = [{"from_claim_index": 0, "to_claim_index": 1, "relation_type": "caused_by", "confidence": 0.4}]
    row = C.normalize_bundles(bundles(spark, "雨なのでタクシー", [chose, rain], stated)).first()
    assert [k["confidence"] for k in row["links"]] == [0.4]
    row = C.normalize_bundles(bundles(spark, "雨なのでタクシー", [chose])).first()
    assert row["claims"][-1]["subject_text"] == "context" and row["links"][-1]["confidence"] == 0.72


def test_gate_reindexes(spark):
    b = bundles(spark, "t", [claim(), claim(), claim()], [{"from_claim_index": 0, "to_claim_index": 2, "relation_type": "supports", "confidence": 1}, {"from_claim_index": 1, "to_claim_index": 2, "relation_type": "supports", "confidence": 1}])
    blanked = b.withColumn("claims", F.transform("claims", lambda c, i: F.when(i == 1, c.withField("object_text_canonical", F.lit(" "))).otherwise(c)))
    row = C.quality_gate(blanked).first()
    assert len(row["claims"]) == 2 and row["quality_flags"] == ["claim_rejected:1"]
    assert [(k["from_idx"], k["to_idx"]) for k in row["links"]] == [(0, 1)]


def test_bundle_tables(spark):
    dims = [{"dimension_type": "place", "dimension_value": v, "confidence": 0.5, "source": "llm"} for v in ("Tokyo", "tokyo ", "Osaka")]
    ents = [{"name": "A", "entity_type": "person", "aliases": ["a", "A"]}, {"name": "A", "entity_type": "place", "aliases": []}]
    link = {"from_claim_index": 0, "to_claim_index": 1, "relation_type": "supports", "confidence": 0.5}
    gated = C.quality_gate(bundles(spark, "t", [claim(dimensions=dims, object_entity_name="A"), claim()], [link, link], ents))
    tables = C.write_bundle(gated, AS_OF)
    assert tables["claims"].count() == 2 and tables["spans"].count() == 2 and tables["links"].count() == 1
    assert [r["normalized_value"] for r in tables["dimensions"].orderBy("ord").collect()] == ["tokyo", "osaka"]
    place = tables["entities"].where("entity_type = 'place'").first()["entity_id"]
    assert tables["claims"].orderBy("ord").first()["object_entity_id"] == place
    counts = C.bundle_counts(gated).first()
    assert (counts["claims_inserted"], counts["evidence_inserted"], counts["entities_upserted"], counts["links_inserted"]) == (2, 2, 2, 1)
    checked = K.check_contract(C.bundle_counts(gated), {k: K.COUNT for k in ("claims_inserted", "evidence_inserted", "entities_upserted")} | {"document_id": K.TEXT})
    assert checked.first()["violations"] == ["$.links_inserted: additional property"]


def test_unwrap_content_forms(spark):
    rows = [
        json.dumps({"id": "r", "choices": [{"message": {"content": "plain"}}], "usage": {"prompt_tokens": 5, "completion_tokens": -2}}),
        json.dumps({"choices": [{"message": {"content": [{"text": "a"}, {"x": 1}, {"text": "b"}]}}]}),
        json.dumps({"choices": []}),
        json.dumps({"choices": [{"message": {"content": 7}}]}),
        "nope",
    ]
    out = SC.unwrap_responses(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, body string")).orderBy("i").collect()
    assert [r["content"] for r in out][:2] == ["plain", "ab"]
    assert [r["unwrap_error"] for r in out] == [None, None, "missing choices", "content is not json text", "invalid json"]
    assert (out[0]["input_tokens"], out[0]["output_tokens"]) == (5, 0)


def test_contract_rules(spark):
    df = spark.sql("SELECT 'a' AS s, -1 AS n, array(1, 50) AS xs, named_struct('k', 'bad') AS o, 1 AS extra")
    rules = {
        "s": {"type": "string", "enum": ["b"]}, "n": {"type": "integer", "minimum": 0}, "xs": {"type": "array", "items": {"type": "integer", "maximum": 9}},
        "o": {"type": "object", "fields": {"k": {"type": "string", "enum": ["good"]}}}, "gone": {"type": "string"},
    }
    got = set(K.check_contract(df, rules).first()["violations"])
    assert got == {
        "$.s: not in enum", "$.n: below minimum", "$.xs: invalid item", "$.o.k: not in enum", "$.gone: missing required property", "$.extra: additional property",
    }
    good, bad = K.split_valid(df, rules)
    assert good.count() == 0 and bad.count() == 1


def test_streams_over_two_batches(spark, tmp_path):
    """A key that comes again is structured once; the last write wins."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = spark.range(6).selectExpr(
        "cast(id as string) capture_id", "'note' input_type", "concat('考え ', id) raw_text", "0.0D pii_score", "'new' status", "'s' source_id",
        "'internal' sensitivity", "timestamp'2024-01-01 00:00:00' created_at", "cast(null as timestamp) occurred_at", "id AS v",
    )
    base.where("v < 4").write.parquet(f"{src}/a")
    for turn in range(2):
        if turn == 1:
            base.where("v >= 2").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")).write.parquet(f"{src}/b")
        def stream():
            return spark.readStream.schema(base.schema).option("recursiveFileLookup", "true").parquet(src)

        Sm.stream_structure(stream(), f"{out}/s", f"{out}/c", AS_OF).awaitTermination()
        Sm.stream_latest(stream(), f"{out}/l", f"{out}/lc", ["capture_id"], "created_at", "v").awaitTermination()
    assert spark.read.parquet(f"{out}/s/notes").count() == 6
    last = Sm.read_latest(spark, f"{out}/l", ["capture_id"], "created_at", "v")
    assert last.count() == 6 and last.where("created_at > timestamp'2024-01-01 12:00:00'").count() == 4


def test_whole_queries_drop_no_rows(spark):
    import __spark_entry__ as entry

    sf_dir, queries = "/root/testdata/sf0.001", entry.queries()
    kinds = {r.artifact_type: r["count"] for r in queries["response_artifacts_all"](spark, sf_dir).groupBy("artifact_type").count().collect()}
    assert kinds["prompt_meta"] == kinds["response_meta"] + kinds["validation_error"] and min(kinds.values()) > 0
    assert queries["claims_hydrated"](spark, sf_dir).count() == queries["claims_by_entry"](spark, sf_dir).count()


def test_rollup_limits_are_arguments(spark):
    from capturelake.operators import rollups

    claims = spark.sql(
        "SELECT cast(id AS string) AS claim_id, timestamp'2024-07-01 10:00:00' AS created_at, cast(NULL AS timestamp) AS deleted_at,"
        " concat('s', id) AS subject_text, 'p' AS predicate, 'o' AS object_text_canonical, 'k' AS topic FROM range(30)"
    )
    one = rollups.build_rollup(claims, "2024-07-01", "2024-07-02", key_ids=20, sentences_most=15).first()
    assert len(one.key_claim_ids) == 20 and one.summary_text.count(" / ") == 14
    for r in rollups.build_rollups(claims, "daily", {"topic": "topic"}, key_ids=25, sentences_most=25).collect():
        assert len(r.key_claim_ids) == 25 and r.summary_text.count(" / ") == 24


def test_short_texts_are_their_own_gram(spark):
    from capturelake.plans import text

    docs = spark.createDataFrame([(0, ""), (1, "a"), (2, "ab"), (3, "abc")], "doc_id long, text string")
    assert {r.doc_id: r.n_grams for r in text._grams(docs).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_claims_by_entry_makes_bundles_once(spark):
    """The sort's sample reads a shuffle below it, not the bundles again."""
    import __spark_entry__ as entry

    out = entry.queries()["claims_by_entry"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("rangepartitioning") < plan.index("hashpartitioning(entry_id")
    assert "REPARTITION_BY_COL" in plan


def test_revisions_join_claims_that_are_stored_as_rows(spark):
    from capturelake.plans import history

    for query in (history.claim_revise_feedback, history.claim_revise_images, history.claim_retract_images):
        found = query(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        # no side makes the claims out of the bundles again
        assert "posexplode" not in plan and plan.count("Relation [") == 2
