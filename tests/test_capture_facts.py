"""Classification, structuring and fact extraction on small frames."""

from datetime import datetime

from pyspark.sql import functions as F

from capturelake.operators import classify as C
from capturelake.operators import facts as K
from capturelake.operators import merge as M
from capturelake.operators import structure as S
from capturelake.sources import entries as E
from capturelake.sources.captures import ingest_captures

AS_OF = datetime(2024, 5, 1)


def captures(spark, rows):
    data = [(str(i), kind, text, pii, status) for i, (kind, text, pii, status) in enumerate(rows)]
    df = spark.createDataFrame(data, "capture_id string, input_type string, raw_text string, pii_score double, status string")
    return df.select(
        "*",
        F.lit("s").alias("source_id"),
        F.lit("internal").alias("sensitivity"),
        F.lit("2024-04-01 10:00:00").cast("timestamp").alias("created_at"),
        F.lit(None).cast("timestamp").alias("occurred_at"),
    )


def test_routes(spark):
    rows = captures(
        spark,
        [
            ("note", "TODO: 請求書を送る p2", 0.0, "new"),
            ("note", "今日は体調が良い mood:4", 0.0, "new"),
            ("url", "https://example.com/a", 0.0, "new"),
            ("note", "secret", 0.95, "new"),
            ("task", "old", 0.0, "processed"),
            ("note", "メモ", 0.0, "new"),
            ("note", "この記事から学びがあった", 0.0, "new"),
        ],
    )
    routed = S.route_captures(rows)
    got = {r["capture_id"]: (r["route"], r["note_type"]) for r in routed.collect()}
    assert [got[str(i)][0] for i in range(7)] == ["task", "note", "note", "blocked", "skipped", "note", "note"]
    assert [got[i][1] for i in ("1", "2", "5", "6")] == ["journal", "learning", "thought", "learning"]
    task = S.to_tasks(routed, AS_OF).first()
    assert (task["title"], task["priority"], task["status"]) == ("請求書を送る p2", 2, "todo")
    notes = {r["source_capture_id"]: r for r in S.to_notes(routed, AS_OF).collect()}
    assert (notes["1"]["mood_score"], notes["1"]["journal_date"]) == (4, "2024-04-01")
    assert notes["2"]["source_url"] == "https://example.com/a"
    assert notes["2"]["summary"] == "https://example.com/a"
    counts = S.structure_counts(routed).first()
    assert (counts["captures_processed"], counts["captures_skipped"]) == (6, 1)
    marked = {r["capture_id"]: r["status"] for r in S.mark_captures(routed, AS_OF).collect()}
    assert marked["3"] == "blocked" and marked["4"] == "processed" and marked["0"] == "processed"


def test_second_run_adds_nothing(spark):
    routed = S.route_captures(captures(spark, [("note", "考え", 0.0, "new"), ("note", "悩み", 0.0, "new")]))
    notes = S.to_notes(routed, AS_OF)
    inserts, ids = S.reuse_active(notes, notes, "note_id")
    assert inserts.count() == 0 and ids.count() == 2


def test_margin_and_lemmas(spark):
    rows = captures(spark, [("note", "気分の記事", 0.0, "new")])
    out = C.classify(rows).first()
    assert (out["score_journal"], out["score_learning"], out["note_type"]) == (1.8, 2.0, "thought")
    with_lemmas = C.classify(rows.withColumn("lemmas", F.array(F.lit("記事"), F.lit("読書"))), tokens="lemmas").first()
    assert (with_lemmas["score_learning"], with_lemmas["note_type"]) == (3.1, "learning")


def test_ingest_rejects(spark):
    raw = captures(spark, [("auto", "  https://example.com  ", None, "new"), ("auto", "   ", None, "new"), ("auto", "x", None, "new")])
    raw = raw.withColumn("pii_override", F.when(F.col("capture_id") == "2", 1.5))
    got = [(r["input_type"], r["reject_reason"]) for r in ingest_captures(raw, AS_OF).orderBy("capture_id").collect()]
    assert got == [("url", None), ("note", "no capture text"), ("note", "pii score out of range")]


def note(spark, body, **over):
    values = {
        "note_id": "n1", "note_type": "thought", "title": "", "summary": "", "body": body, "occurred_at": "2024-01-01",
        "journal_date": None, "mood_score": None, "energy_score": None, "source_url": None, **over,
    }
    ddl = ", ".join(f"{k} {'int' if k.endswith('score') else 'string'}" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl)


def test_note_facts_order_and_types(spark):
    df = note(
        spark, "今日は実験を試した。4.5。Blocked by reviews. same thing here! Same thing here", note_type="journal",
        journal_date="2024-01-01", mood_score=4, summary="sum up",
    )
    facts = K.fact_rows(K.extract_note_facts(df), "note").orderBy("ord").collect()
    got = [(f["subject"], f["predicate"], f["object_type"], f["object_json"]) for f in facts]
    assert got[:3] == [
        ("note:n1", "summary", "text", None), ("me", "journal_date", "date", None), ("me", "mood_score", "number", '{"value": 4}'),
    ]
    assert ("me", "tested", "date", None) in got and ("me", "blocked_by", "text", None) in got
    assert sum(f["object_text"].lower() == "same thing here" for f in facts) == 1


def test_words_of_digits_joined_to_a_long_number(spark):
    from capturelake.plans.facts import words_as_tokens

    df = note(spark, "4111 1111 2222 3333 4444 5555 6666 7777. fine words here")
    facts = K.extract_note_facts(df, tokenize=words_as_tokens).first()["facts"]
    assert [(f["object_text"], f["object_type"], f["object_json"]) for f in facts] == [
        ("41111111222233334444555566667777", "number", '{"value": 4.111111122223334e+31}'), ("finewordshere", "text", None),
    ]


def test_candidate_cap_keeps_one_sentence(spark):
    text = ". ".join(f"sentence number {i}" for i in range(30))
    assert len(K.extract_note_facts(note(spark, text)).first()["facts"]) == 30
    assert len(K.extract_note_facts(note(spark, text), 12).first()["facts"]) == 12
    assert len(K.extract_note_facts(note(spark, text, summary="s u m"), max_facts=1).first()["facts"]) == 1


def test_task_override(spark):
    df = spark.createDataFrame(
        [("t1", "やること", "- write the report\ntested the build", "todo", 2)], "task_id string, title string, details string, status string, priority int"
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("due_at", "scheduled_at", "done_at", "source_note_id")])
    facts = {f["object_text"]: (f["predicate"], f["confidence"]) for f in K.extract_task_facts(df).first()["facts"]}
    assert facts["- write the report"] == ("next_action", 0.84)
    assert facts["tested the build"] == ("tested", 0.82)
    assert facts["2"] == ("priority", 0.98)


def test_object_text_from_tokens(spark):
    tokens = [("私", "私", "名詞"), ("は", "は", "助詞"), ("新薬", "新薬", "名詞"), ("を", "を", "助詞"), ("試し", "試す", "動詞"), ("まし", "ます", "助動詞"), ("た", "た", "助動詞")]
    df = spark.createDataFrame([("私は新薬を試しました", "tested", tokens)], f"s string, p string, t {K.TOKENS_TYPE}")
    assert df.select(K.object_text("s", "p", "t")).first()[0] == "私新薬試し"
    empty = df.withColumn("t", F.array().cast(K.TOKENS_TYPE))
    assert empty.select(K.object_text("s", "p", "t")).first()[0] == "私は新薬を試しました"


def test_facts_from_responses(spark):
    rows = [
        ('{"facts": [{"subject": " me ", "predicate": "did", "object_text": "a run", "confidence": "0.9"}, {"subject": "me", "predicate": "did", "object_text": "A  RUN"}]}',),
        ('[{"subject": "me", "predicate": "felt", "object_text": "good", "confidence": "high", "evidence_excerpt": " "}]',),
        ('{"other": 1}',),
    ]
    out = K.facts_from_responses(spark.createDataFrame(rows, "content string")).collect()
    assert [[(f["object_text"], f["confidence"], f["evidence_excerpt"]) for f in r["facts"]] for r in out] == [
        [("a run", 0.9, None)], [("good", 0.0, None)], [],
    ]


def test_flat_and_array_dedupe_agree(spark):
    texts = ["A b", "a  B", "c", "", "d", "C"]
    rows = spark.createDataFrame([("o", i, "me", "did", t) for i, t in enumerate(texts)], "owner string, ord int, subject string, predicate string, object_text string")
    got = [r["object_text"] for r in K.dedupe_facts(rows, "owner", 2).orderBy("ord").collect()]
    assert got == ["A b", "c"]


def test_merges_handle_a_hot_key(spark):
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    assert M.top_per_key(hot, ["k"], [F.desc("v")]).where("k = 0").first()["v"] == 19998
    inserted = M.insert_ignore(hot.where("k = 0").select("k"), hot, ["k"], [F.asc("v")])
    assert inserted.where("k = 0").count() == 0 and inserted.count() == hot.where("k <> 0").count()
    merged = M.lww_merge(hot.where("k = 0").limit(1), hot.where("k = 0"), ["k"], "v")
    assert merged.count() == 1


def test_entry_texts(spark):
    rows = spark.createDataFrame(
        [("t", "b", ["x", "y"], '{"a": 1.5, "b": true, "c": ["p", "q"], "d": {"z": 1}, "e": null, "f": "", "g": []}')],
        "title string, body string, tags array<string>, payload string",
    )
    from capturelake.functions.text import searchable_text

    assert rows.select(searchable_text("title", "body", "tags", "payload")).first()[0] == "t b x y 1.5 p q"
    assert rows.select(E.build_capture_text()).first()[0] == "t\nb\na: 1.5\nb: true\nc: p / q\nd: [object Object]"


def test_payload_rules(spark):
    cases = [
        ("journal", '{"reflection": "r", "mood": 6}', ["mood: invalid"]),
        ("journal", '{"mood": 3}', ["reflection: required"]),
        ("todo", '{"details": "d", "dueAtUtc": "2024-01-01T00:00:00+09:00"}', []),
        ("meeting", '{"context": "c", "notes": "n", "decisions": [""]}', ["decisions: invalid"]),
        ("learning", '{"takeaway": "t", "url": "https://example.com"}', []),
        ("party", "{}", ["declared_type: invalid"]),
        ("thought", "nope", ["payload: invalid"]),
    ]
    df = spark.createDataFrame([(i, k, p) for i, (k, p, _) in enumerate(cases)], "id int, declared_type string, payload string")
    got = [r["e"] for r in df.select("id", E.validate_payload().alias("e")).orderBy("id").collect()]
    assert got == [c[2] for c in cases]


def test_evidence_is_filled_from_facts_extracted_once(spark):
    from capturelake.plans import history

    plan = history.backfill_evidence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "posexplode" not in plan.split("== Physical Plan ==")[1]


# facts at size


def test_types_and_hints_by_short_looks_agree_with_the_patterns(spark):
    from pyspark.sql import functions as F

    from capturelake.functions import rules as R
    from capturelake.functions import scalars as SC
    from capturelake.functions.rx import extract, matches
    from capturelake.functions.text import strip
    from capturelake.operators.classify import detect_predicate

    texts = ["12", " 12.5 ", "-3", "+4.", "４２", "12 apples", "on 2024-01-02", "2024年1月2日", "今日は雨", "日", "a-b", "a/b", "~", "", "x", None]
    texts += ["I learned it", "DECIDED", "次の予定", "Feel next", "ınsight", "plain words", "実験した", "blocked_by", "tes t"]
    rows = spark.createDataFrame([(p, t) for t in texts for p in ("did", "due_at", "priority", None)], "p string, t string")
    dated = F.col("p").isin(*R.DATE_PREDICATES) | matches("t", R.DATE_TEXT)
    whole = F.coalesce(strip("t") == extract("t", R.NUMBER_TEXT), F.lit(False))
    kind = F.when(dated, "date").when(F.col("p").isin(*R.NUMBER_PREDICATES) | whole, "number").otherwise("text")
    assert rows.where(~SC.object_type("p", "t").eqNullSafe(kind)).count() == 0
    numbers = rows.where((kind == "number") & F.col("t").rlike("[0-9]"))
    assert numbers.where(SC.object_json("p", "t").isNull()).count() == 0
    assert rows.where((kind != "number") & SC.object_json("p", "t").isNotNull()).count() == 0
    hint = F.lit("mentions")
    for pattern, name in reversed(R.PREDICATE_HINTS):
        hint = F.when(matches("t", pattern, ci=True), name).otherwise(hint)
    assert rows.where(~detect_predicate("t")["predicate"].eqNullSafe(hint)).count() == 0
    # other patterns than lists of words are tried one by one
    own = detect_predicate("t", hints=[("^x$", "one"), (r"\bwords\b", "two")])["predicate"]
    assert {r.t: r.k for r in rows.select("t", own.alias("k")).collect() if r.k != "mentions"} == {"x": "one", "plain words": "two"}


def test_dedupe_form_keeps_what_the_negated_class_keeps(spark):
    from pyspark.sql import functions as F

    from capturelake.functions.rx import replace_all
    from capturelake.functions.text import normalize_for_dedupe

    rows = spark.createDataFrame([(f"a{chr(k)}b",) for k in range(0x10000) if not 0xD800 <= k <= 0xDFFF] + [("x\U0001F600y \U00020000",), ("",), (None,)], "t string")
    old = F.regexp_replace(F.lower(replace_all("t", r"\s+")), "[^0-9a-zぁ-んァ-ヶ一-龠ー]", "")
    assert rows.where(~normalize_for_dedupe("t").eqNullSafe(old)).count() == 0
    # the negated class is what took the time
    assert "[^" not in rows.select(normalize_for_dedupe("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_captures_of_the_evidence_are_classified_once(spark, tmp_path):
    from capturelake.functions import rules as R
    from capturelake.plans.history import backfill_evidence

    docs = [(k, f"line {k}. 学んだこと。 TODO: call", "en", "s", 20) for k in range(24)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    out = backfill_evidence(spark, str(tmp_path))
    assert R.JOURNAL_HINT not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() > 0
