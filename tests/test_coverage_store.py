import json
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from capturelake.operators import claim_store as CS
from capturelake.operators import claims as C
from capturelake.operators import evaluate, facts, merge, revise, rollups, search
from capturelake.operators.coverage import cover_functions, covered_flags
from capturelake.sources.tables import DEAL, read_table
from capturelake.streaming import streams as Sm

AS_OF = datetime(2024, 6, 1)


# clause coverage


def grams(form):
    return {form[i : i + 2] for i in range(len(form) - 1)} or {form}


def plain_cover(clauses, texts, greedy):
    seen, out = list(texts), []
    for c in clauses:
        known = c == "" or any(
            s and (s in c or c in s or len(grams(c) & grams(s)) / min(len(grams(c)), len(grams(s))) >= 0.55) for s in seen
        )
        out.append(known)
        if greedy and not known:
            seen.append(c)
    return out


def test_coverage_against_all_pairs():
    rng = random.Random(1)

    def form():
        return "".join(rng.choice("abcde日"[: rng.randint(2, 6)]) for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8, 12])))

    for _ in range(800):
        clauses, texts = [form() for _ in range(rng.randint(0, 9))], [form() for _ in range(rng.randint(0, 7))]
        for greedy in (False, True):
            assert cover_functions(greedy)[0](clauses, texts) == plain_cover(clauses, texts, greedy)


def test_coverage_grows_with_the_clauses_and_not_their_square():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    many = ["".join(rng.choice(words) for _ in range(8)) for _ in range(3200)]
    cover, took = cover_functions(True)[0], {}
    for n in (400, 3200):
        took[n] = min(_timed(cover, many[:n]) for _ in range(3))
    assert took[3200] < 25 * took[400]  # eight times the clauses; all pairs would be 64


def _timed(cover, clauses):
    t0 = time.process_time()
    assert not any(cover(clauses, []))
    return time.process_time() - t0


def test_coverage_of_null_lists(spark):
    rows = spark.createDataFrame([(["会議に行った", None], None), (None, ["a"]), ([], [])], "c array<string>, t array<string>")
    got = [r.f for r in rows.select(covered_flags(F.col("c"), F.col("t")).alias("f")).collect()]
    assert got == [[False, True], None, []]


# parsing


def read(spark, payload, **kw):
    text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
    return C.bundles_from_responses(spark.createDataFrame([(text,)], "content string"), **kw).first()


def claim(**kw):
    base = {
        "subject_text": "me", "predicate": "did", "object_text_raw": "x", "object_text_canonical": "x", "me_role": "none",
        "modality": "fact", "polarity": "affirm", "certainty": 0.5, "evidence_spans": [{"char_start": 1, "char_end": 3, "excerpt": "e"}],
    }
    return {**base, **kw}


def test_one_bad_member_spares_the_others(spark):
    b = read(spark, {"claims": ["text", 7, None, [1], claim(), claim(subject_text=5)], "entities": {"name": "no list"}, "links": "x"})
    assert [c.subject_text for c in b.claims] == ["me", "5"] and b.entities == [] and b.links == [] and b.parse_error is None
    assert read(spark, "[1]").claims == [] and read(spark, "{").parse_error == "content is not json"


@pytest.mark.parametrize(
    "span, kept",
    [({"char_start": 1, "char_end": 3}, (1, 3)), ({"char_start": "1", "char_end": 3}, None), ({"char_start": 1.5, "char_end": 3}, None),
     ({"char_start": -1, "char_end": 3}, None), ({"char_start": 3, "char_end": 3}, None), ({"char_start": 1, "char_end": 2**40}, None), ({}, None)],
)
def test_offsets_are_json_integers(spark, span, kept):
    b = read(spark, {"claims": [claim(evidence_spans=[{**span, "excerpt": "e"}, {"excerpt": " "}, 3])]})
    (only,) = b.claims[0].evidence_spans
    assert (only.char_start, only.char_end) == (kept or (None, None))


@pytest.mark.parametrize("certainty, kept", [("0.7", 1), (None, 1), ("high", 0), (1.01, 0), (True, 0), ({}, 0)])
def test_certainty_is_a_number_or_its_text(spark, certainty, kept):
    assert len(read(spark, {"claims": [claim(certainty=certainty)]}).claims) == kept


# context, gate, names


def bundle(spark, objects, links=(), entities=()):
    rows = [([claim(object_text_raw=o or "x", object_text_canonical=o or "x") for o in objects],)]
    body = json.dumps({"claims": rows[0][0], "entities": list(entities), "links": [
        {"from_claim_index": a, "to_claim_index": b, "relation_type": "supports", "confidence": 0.5} for a, b in links
    ]}, ensure_ascii=False)
    docs = spark.createDataFrame([("d", "d", "", "2024-02-02T00:00:00Z", "x-d", body)], "document_id string, entry_id string, raw_text string, occurred_at_utc string, extraction_id string, content string")
    return C.bundles_from_responses(docs)


def test_topics_are_carried_to_later_claims(spark):
    b = C.complete_context(bundle(spark, ["悪化した", "喉の調子が悪い", "少し改善", "頭痛がする", "さらに悪化", "会議"]))
    got = [c.object_text_canonical for c in b.first().claims]
    assert got == ["悪化した", "喉の調子が悪い", "喉の調子が少し改善", "頭痛がする", "頭痛がさらに悪化", "会議"]


def test_gate_moves_links(spark):
    b = bundle(spark, ["a", "b", "c", "d"], links=[(0, 1), (1, 2), (2, 3), (3, 0), (0, 9), (-1, 2)])
    blank = b.withColumn("claims", F.transform("claims", lambda c, i: F.when(i == 1, c.withField("object_text_canonical", F.lit(" "))).otherwise(c)))
    got = C.quality_gate(blank).first()
    assert [(k.from_idx, k.to_idx) for k in got.links] == [(1, 2), (2, 0)] and got.quality_flags == ["claim_rejected:1"]
    whole = C.quality_gate(b).first()
    assert [(k.from_idx, k.to_idx) for k in whole.links] == [(0, 1), (1, 2), (2, 3), (3, 0)]


def test_the_last_entity_of_a_name_gives_its_type(spark):
    entities = [{"name": "n", "entity_type": "place"}, {"name": "m", "entity_type": "person"}, {"name": "n", "entity_type": "concept"}]
    b = bundle(spark, ["a", "b", "c"], entities=entities)
    names = F.array(F.lit("n"), F.lit(None).cast("string"), F.lit("gone"))
    b = b.withColumn("claims", F.transform("claims", lambda c, i: c.withField("subject_entity_name", F.get(names, i)).withField("object_entity_name", F.lit("m"))))
    rows = C.write_bundle(C.quality_gate(b), AS_OF)["claims"].orderBy("ord").collect()
    want = spark.range(1).select(merge.stable_id(F.lit("entity"), F.lit("concept"), F.lit("n")), merge.stable_id(F.lit("entity"), F.lit("person"), F.lit("m"))).first()
    assert [r.subject_entity_id for r in rows] == [want[0], None, None] and {r.object_entity_id for r in rows} == {want[1]}


# stored claims


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Claims of three months with different creation times, in a store of small blocks."""
    rng = random.Random(3)
    words = ["Rain", "meeting", "100%", "a_b", "書いた", "notes", "the end"]
    rows = []
    for k in range(300):
        start = datetime(2024, 1 + k % 3, 1 + k % 28) if k % 5 else None
        rows.append((
            f"c{k:03}", f"d{k % 40}", rng.choice(["me", "Team"]), rng.choice(["did", "felt"]), " ".join(rng.choice(words) for _ in range(4)),
            "fact", "actor", start, None, datetime(2024, 5, 1 + k % 7), datetime(2024, 5, 9) if k % 11 == 0 else None,
        ))
    claims = spark.createDataFrame(rows, "claim_id string, document_id string, subject_text string, predicate string, object_text_canonical string, modality string, me_role string, time_start_utc timestamp, time_end_utc timestamp, created_at timestamp, deleted_at timestamp")
    docs = spark.createDataFrame([(f"d{k}", "journal" if k % 2 else "todo", datetime(2024, 2, 10)) for k in range(40)], "document_id string, declared_type string, occurred_at_utc timestamp")
    child = "claim_id string, ord int, created_at timestamp"
    spans = spark.createDataFrame([(f"c{k:03}", 0, AS_OF, f"e{k}") for k in range(300)], child + ", excerpt string")
    dims = spark.createDataFrame([(f"c{k:03}", 0, AS_OF, "place", f"p{k % 12}") for k in range(300)], child + ", dimension_type string, normalized_value string")
    feedback = spark.createDataFrame([("c001", 0, AS_OF, "revise")], child + ", action string")
    path, block = str(tmp_path_factory.mktemp("store")), CS.BLOCK
    CS.BLOCK = 32
    CS.write_claim_store(claims, docs, {"spans": spans, "dimensions": dims, "feedback": feedback}, path)
    CS.BLOCK = block
    return path, claims, docs, dims


@pytest.mark.parametrize(
    "ask",
    [{}, {"text": "RAIN meet"}, {"text": "100%"}, {"text": "0%"}, {"text": "a_b"}, {"text": "書いた"}, {"text": "書"}, {"text": "absent words"},
     {"text": "n_t", "escape": False}, {"predicate": "felt", "text": "the end"}, {"type": "journal", "from_ts": "2024-02-05 00:00:00"},
     {"to_ts": "2024-02-05 00:00:00", "me_role": "actor"}, {"dimension_type": "place", "dimension_value": "P1"}, {"text": "notes", "limit": 7}],
)
def test_store_finds_what_frames_find(spark, stored, ask):
    path, claims, docs, dims = stored
    want = [r.claim_id for r in search.search_claims(claims, docs, dims, **ask).collect()]
    assert [r.claim_id for r in CS.search_store(spark, path, **ask).collect()] == want
    assert want or ask == {"text": "absent words"}


def test_store_reads_only_what_is_asked_for(spark, stored):
    path = stored[0]
    plan = CS.search_store(spark, path, predicate="did", from_ts="2024-03-01 00:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "predicate_key" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = CS.candidates(spark, path, "meeting")
    assert "bucket" in found._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert CS.candidates(spark, path, "ab") is None


def test_claim_by_id_is_hydrated(spark, stored):
    got = {r.claim_id: r for r in CS.claim_by_id(spark, stored[0], ["c001", "c002", "c011", "none"]).collect()}
    assert set(got) == {"c001", "c002"}  # c011 was deleted
    assert got["c001"].feedback[0].action == "revise" and got["c002"].feedback == [] and got["c002"].spans[0].excerpt == "e2"


# positions, scopes, upserts, inserts


def test_positions_of_a_hot_key_fill_many_tasks(spark, tmp_path):
    rows = spark.range(5000).selectExpr("if(id % 10 < 9, 'hot', concat('k', id % 50)) AS k", "id % 97 AS a", "id AS b", "cast(null as string) AS _n")
    rows = rows.unionByName(spark.sql("SELECT cast(null as string) AS k, 1L AS a, id AS b, 'x' AS _n FROM range(3)"))
    out = merge.ranked_children(rows, "k", [F.desc("a"), F.asc("b")], f"{tmp_path}/r", parts=8)
    got = {(r.k, r.b): r.position for r in out.collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.k, []).append((-r.a, r.b))
    assert got == {(k, b): i for k, own in by.items() for i, (_, b) in enumerate(sorted(own))}
    parts = spark.read.parquet(f"{tmp_path}/r").where("k = 'hot'").groupBy("_part").count().collect()
    assert len(parts) >= 6 and max(p["count"] for p in parts) < 0.3 * 4500


def event_claims(spark):
    return spark.sql(
        "SELECT concat('c', id) AS claim_id, timestamp'2024-07-01 10:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS created_at,"
        " cast(NULL AS timestamp) AS deleted_at, concat('s', id) AS subject_text, 'p' AS predicate, 'o' AS object_text_canonical,"
        " if(id % 4 = 0, null, concat('k', id % 2)) AS topic FROM range(40)"
    )


def test_rollups_of_no_scope_and_of_null_keys(spark):
    claims = event_claims(spark)
    (one,) = rollups.build_rollups(claims, "daily").collect()
    assert (one.scope_type, one.scope_key, len(one.key_claim_ids)) == ("all", "all", 12)
    by = {(r.scope_type, r.scope_key): r.key_claim_ids for r in rollups.build_rollups(claims, "daily", {"topic": "topic"}, key_ids=50).collect()}
    assert set(by) == {("all", "all"), ("topic", "k0"), ("topic", "k1")} and len(by["all", "all"]) == 40
    assert len(by["topic", "k0"]) == 10 and len(by["topic", "k1"]) == 20


def test_a_claim_is_in_all_its_topics_once(spark):
    dims = spark.createDataFrame([("c1", "topic", "a"), ("c1", "topic", "a"), ("c1", "topic", "b"), ("c2", "mood", "a"), ("c3", "project", "a"), ("c4", "topic", None)], "claim_id string, dimension_type string, normalized_value string")
    many = rollups.dimension_scopes(dims, ["topic", "project"])
    by = {(r.scope_type, r.scope_key): r.key_claim_ids for r in rollups.build_rollups(event_claims(spark), "daily", many=many).collect()}
    assert {k: v for k, v in by.items() if k[0] != "all"} == {("topic", "a"): ["c1"], ("topic", "b"): ["c1"], ("project", "a"): ["c3"]}


def test_upsert_of_null_keys_does_not_double(spark):
    old = spark.createDataFrame([(None, "a", 1), ("x", "a", 2)], "k string, l string, v int")
    new = spark.createDataFrame([(None, "a", 5), ("y", None, 6)], "k string, l string, v int")
    got = merge.upsert(old, new, ["k", "l"], ["v"])
    assert sorted(map(tuple, merge.upsert(got, new, ["k", "l"], ["v"]).collect()), key=str) == sorted([(None, "a", 5), ("x", "a", 2), ("y", None, 6)], key=str)


def test_winners_without_an_order_are_the_smallest(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", None, "y"), ("l", 3, "a")], "key string, n int, v string").repartition(4)
    assert sorted(map(tuple, merge.first_per_key(rows, ["key"]).collect())) == [("k", None, "y"), ("l", 3, "a")]


def test_facts_are_extracted_once_for_rows_and_counts(spark):
    notes = spark.createDataFrame(
        [("n1", "thought", "t one", "", "今日は会議をした。fine words here. fine words here.", None, None, None, None, None), ("n2", "thought", "", "", "", None, None, None, None, None)],
        "note_id string, note_type string, title string, summary string, body string, occurred_at string, journal_date string, mood_score int, energy_score int, source_url string",
    )
    rows = facts.fact_rows(facts.extract_note_facts(notes), "note", outer=True)
    empty = rows.where("false").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    flagged = facts.flag_inserts(empty, rows, 0.0)
    m = facts.fact_run_metrics(flagged).first()
    assert (m.items_processed, m.facts_inserted, m.facts_skipped) == (2, 3, 0)
    again = facts.flag_inserts(flagged.where("inserted").drop("inserted").withColumn("deleted_at", F.lit(None).cast("timestamp")), rows, 0.0)
    m = facts.fact_run_metrics(again).first()
    assert (m.items_processed, m.facts_inserted, m.facts_skipped) == (2, 0, 3)
    plan = facts.fact_run_metrics(flagged)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1


def test_short_sentences_of_one_token_are_dropped(spark):
    from capturelake.plans.facts import words_as_tokens

    notes = spark.createDataFrame([("n", "thought", "oneword. two words. averyverylongword", "", "", None, None, None, None, None)],
        "note_id string, note_type string, title string, summary string, body string, occurred_at string, journal_date string, mood_score int, energy_score int, source_url string")
    out = facts.extract_note_facts(notes, tokenize=words_as_tokens).first().facts
    assert [f.evidence_excerpt for f in out] == ["two words", "averyverylongword"]
    assert len(facts.extract_note_facts(notes).first().facts) == 3


# feedback, evaluation, dealing, streams


def test_feedback_holds_the_row_before(spark):
    row = ("c1", "old text", "active", None, None, datetime(2024, 1, 1), datetime(2024, 1, 1), None)
    claims = spark.createDataFrame([row], "claim_id string, object_text_canonical string, status string, supersedes_claim_id string, revision_note string, created_at timestamp, updated_at timestamp, deleted_at timestamp")
    asked = spark.createDataFrame([("c1", "new text", "why")], "claim_id string, object_text_canonical string, revision_note string")
    got = {r.action: r for r in revise.revise_claims(claims, asked, AS_OF)[1].collect()}
    before = json.loads(got["supersede"].before_json)
    assert set(before) == set(claims.columns) and before["object_text_canonical"] == "old text" and before["deleted_at"] is None
    assert json.loads(got["supersede"].after_json)["supersededBy"] == got["revise"].claim_id and json.loads(got["revise"].before_json) == {"id": "c1"}
    gone = spark.createDataFrame([("c1", None)], "claim_id string, reason string")
    (told,) = revise.retract_claims(claims, gone, AS_OF)[1].collect()
    assert json.loads(told.before_json)["status"] == "active" and json.loads(told.after_json) == {"reason": None}


def test_a_missing_prediction_is_a_miss(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", None), ("b", "a"), (None, "b")], "expected string, predicted string")
    by = {r.label: r for r in evaluate.class_metrics(rows, ["a", "b"]).collect()}
    assert (by["a"].tp, by["a"].fp, by["a"].fn) == (1, 1, 1) and (by["b"].tp, by["b"].fp, by["b"].fn) == (0, 1, 1)


def test_rows_are_dealt_only_on_request(spark):
    whole = read_table(spark, "/root/testdata/sf0.001", "documents")
    spark.conf.set(DEAL + "documents", "7")
    try:
        dealt = read_table(spark, "/root/testdata/sf0.001", "documents")
        assert "RepartitionByExpression" in (p := dealt._jdf.queryExecution().analyzed().toString()) or "Repartition 7" in p
        assert dealt.count() == whole.count() and "Repartition" not in whole._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset(DEAL + "documents")


def captures(spark, path, ids, day):
    spark.range(1).selectExpr(f"explode(array({','.join(map(str, ids))})) AS v").selectExpr(
        "cast(v as string) capture_id", "'note' input_type", "concat('考え ', v) raw_text", "0.0D pii_score", "'new' status", "'s' source_id",
        "'internal' sensitivity", f"timestamp'2024-01-{day:02} 00:00:00' created_at", "cast(null as timestamp) occurred_at",
    ).write.parquet(path)


def test_a_batch_reads_only_its_own_rows(spark, tmp_path):
    """The third batch works although the first one's output is gone, and still drops what the first had."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for turn, ids in enumerate([(1, 2, 2), (2, 3), (1, 3, 4)]):
        captures(spark, f"{src}/{turn}", ids, 1 + turn)
        schema = spark.read.parquet(f"{src}/0").schema
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        Sm.stream_structure(stream, f"{out}/{turn}", f"{out}/checkpoint", AS_OF).awaitTermination()
    seen = [sorted(r.capture_id for r in spark.read.parquet(f"{out}/{turn}/routed").collect()) for turn in range(3)]
    assert seen == [["1", "2"], ["3"], ["4"]]


def test_keys_are_forgotten_behind_the_watermark(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for turn, (ids, day) in enumerate([((1,), 1), ((1, 2), 2), ((9,), 20), ((3,), 21), ((1, 4), 22)]):
        captures(spark, f"{src}/{turn}", ids, day)
        schema = spark.read.parquet(f"{src}/0").schema
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        Sm.stream_structure(stream, f"{out}/{turn}", f"{out}/checkpoint", AS_OF, watermark="3 days").awaitTermination()
    seen = [sorted(r.capture_id for r in spark.read.parquet(f"{out}/{turn}/routed").collect()) for turn in range(5)]
    assert seen == [["1"], ["2"], ["9"], ["3"], ["1", "4"]]


def test_stored_claims_are_written_once_and_again_if_gone(spark, tmp_path):
    from capturelake.plans import claims as plans

    wrote = []

    def write(path):
        wrote.append(path)
        spark.range(3).write.parquet(f"{path}/t")

    first = plans._once(spark, "sf", "probe", write, "/t")
    assert plans._once(spark, "sf", "probe", write, "/t") == first and len(wrote) == 1
    plans._written[(spark.sparkContext.applicationId, "sf", "probe")] = f"{tmp_path}/gone"
    assert plans._once(spark, "sf", "probe", write, "/t") != first and len(wrote) == 2


def test_lists_of_grams_stay_small(spark, tmp_path):
    texts = spark.range(3000).selectExpr(
        "sha2(cast(id AS string), 256) AS claim_id", "'d' AS document_id", "'me' AS subject_text", "'did' AS predicate",
        "concat_ws(' ', transform(sequence(1, 12), k -> substr(sha2(concat(id, k), 256), 1, 6))) AS object_text_canonical",
        "cast(null AS timestamp) AS time_start_utc", "cast(null AS timestamp) AS time_end_utc", "cast(null AS timestamp) AS deleted_at", "current_timestamp() AS created_at",
    )
    docs = spark.sql("SELECT 'd' AS document_id, 'todo' AS declared_type, timestamp'2024-02-10' AS occurred_at_utc")
    child = {name: texts.select("claim_id") for name in CS.CHILDREN}
    CS.write_claim_store(texts, docs, child, str(tmp_path / "s"))
    chars = texts.selectExpr("sum(length(object_text_canonical))").first()[0]
    size = sum(f.stat().st_size for f in (tmp_path / "s" / "grams").rglob("*.parquet"))
    # ids in the lists took over thirty bytes a character
    assert size < 8 * chars
    want = texts.where("object_text_canonical like '%abc%'").count()
    assert CS.search_store(spark, str(tmp_path / "s"), text="ABC").count() == want > 0


def test_claims_are_stored_without_an_exchange_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(CS, "BLOCK", 100)
    claims = spark.range(0, 4000, 1, 2).selectExpr(
        "cast(id AS string) AS claim_id", "'d' AS document_id", "'me' AS subject_text", "concat('p', id % 8) AS predicate", "'rain' AS object_text_canonical",
        "cast(null AS timestamp) AS time_start_utc", "cast(null AS timestamp) AS time_end_utc", "cast(null AS timestamp) AS deleted_at", "current_timestamp() AS created_at",
    )
    docs = spark.sql("SELECT 'd' AS document_id, 'todo' AS declared_type, timestamp'2024-02-10' AS occurred_at_utc")
    CS.write_claim_store(claims, docs, {name: claims.select("claim_id") for name in CS.CHILDREN}, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s" / "claims"))
    # both tasks write each predicate; a block lies in one or two files
    assert stored.count() == 4000 and len(stored.inputFiles()) == 16
    assert stored.select("block", F.input_file_name()).distinct().count() <= 40 + 16
    assert CS.search_store(spark, str(tmp_path / "s"), text="RAIN", predicate="p3").count() == 500


@pytest.mark.parametrize("name", ["ACTION_HINT", "CAUSE_HINT", "JOURNAL_HINT", "LEARNING_HINT", "PLAN_HINT", "RAIN_HINT", "STATE_CHANGE_HINT", "THOUGHT_HINT", "TOPIC_HINT"])
def test_a_look_ahead_changes_no_hit(spark, name):
    from capturelake.functions import rules, rx

    pattern = getattr(rules, name)
    assert rx.lead(pattern, True)
    words = [w for w in pattern.strip("()").replace("(?:", "").replace(")?", "").split("|")]
    odd = ["", "x", "ſore throat", "Know", "İdea", "ımprov", "İnsight", "KNEW", "ſhould", "ΡΑIN", "🌧rain", "の調子"]
    texts = [f"{a}{w}{b}" for w in [*words, *[w.upper() for w in words], *odd, *[w.replace("s", "ſ").replace("k", "K").replace("i", "ı") for w in words]] for a, b in [("", ""), ("aé ", "z"), ("喉", "。")]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = rows.select(F.regexp_extract("t", "(?Ui)" + pattern, 1).alias("a"), F.regexp_extract("t", rx.rx(pattern, True), 1).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and any(r.a for r in both)


def test_costly_rows_fill_many_tasks(spark):
    from capturelake.plans import claims as plans

    assert plans.usable(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8
