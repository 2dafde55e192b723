"""Text and personal-data functions against plain Python."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from capturelake.functions import pii as P
from capturelake.functions import rules as R
from capturelake.functions import scalars as S
from capturelake.functions import text as T


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")


def column(spark, values, expr):
    rows = frame(spark, values).select("id", expr.alias("r")).orderBy("id").collect()
    return [r["r"] for r in rows]


def plain_mask(text):
    for pattern, ci, _ in R.PII_PATTERNS:
        text = re.sub(pattern, lambda m: "█" * len(m.group(0)), text, flags=re.I if ci else 0)
    return text


PIECES = [
    "mail a.b@example.com", "call +81 90-1234-5678", "zip 123-4567", "token = abcdefghijkl12",
    "password:'ABCDEFGHIJKLM'", "sk-" + "a1" * 12, "plain words", "日本123-4567です", "x\ny", "",
]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=5), min_size=5, max_size=20))
def test_mask_equals_python_and_keeps_length(spark_texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        from capturelake.session import build_session

        spark = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    texts = [" ".join(parts) for parts in spark_texts]
    got = column(spark, texts, P.mask_text("v"))
    assert got == [plain_mask(t) for t in texts]
    assert [len(g) for g in got] == [len(t) for t in texts]


def test_scores_and_states(spark):
    texts = ["hello", "a@example.com", "03-1234-5678-90", "123-4567", "api_key: ABCDEFGHIJKLMN", None]
    assert column(spark, texts, P.pii_score("v")) == [0.0, 0.55, 0.65, 0.7, 0.95, 0.0]
    out = P.redact(frame(spark, ["a@example.com ok", "secret=ABCDEFGHIJKLMN", "fine"]), "v").orderBy("id").collect()
    assert [r["redaction_state"] for r in out] == ["masked", "blocked", "none"]
    assert [r["safe_text"] for r in out] == ["█" * 13 + " ok", "", "fine"]


def test_scan_lists_only_the_highest_class(spark):
    both = "password=abcdefgh a@example.com"
    rows = frame(spark, [both, "東京都新宿区西新宿 b@example.com", "nothing"]).select("id", P.scan_pii(["v"]).alias("s"))
    got = [(r["s"]["risk"], list(r["s"]["hits"])) for r in rows.orderBy("id").collect()]
    assert got[0] == ("high", ["password=abcdefgh"])
    assert got[1][0] == "medium" and got[1][1][0] == "b@example.com" and len(got[1][1]) == 2
    assert got[2] == ("low", [])


def test_unicode_whitespace_and_clamp(spark):
    assert column(spark, ["　 a\t b \n"], T.collapse("v")) == ["a b"]
    assert column(spark, ["　x "], T.strip("v")) == ["x"]
    assert column(spark, ["abcdef ghij", "abc"], T.clamp("v", 10)) == ["abcdef...", "abc"]
    assert column(spark, [" \n\t\n  first \nsecond", " ", "a\r\nb"], T.first_line("v")) == ["first", "", "a"]


def test_sentences_and_clauses(spark):
    assert column(spark, ["ab. abcd! 今日は良い日。x\nlast one"], T.split_sentences("v")) == [["abcd", "今日は良い日", "last one"]]
    assert column(spark, ["朝食、散歩。 帰宅！"], T.split_clauses("v")) == [["朝食", "散歩", "帰宅"]]


def test_ngrams_match_python(spark):
    texts = ["", "a", "ab", "abab", "日本語日本", "a𝒳b"]
    want = []
    for t in texts:
        grams = [t] if 0 < len(t) <= 2 else [t[i : i + 2] for i in range(len(t) - 1)]
        want.append(sorted(set(grams) if t else set()))
    assert [sorted(g) for g in column(spark, texts, T.char_ngrams("v"))] == want


def test_subjects_topics_and_time_prefix(spark):
    assert column(spark, ["I", " 私 ", "", "Team"], T.normalize_subject("v")) == ["me", "me", "me", "Team"]
    assert column(spark, ["喉が悪化した", "体調は普通", "何もない"], T.extract_topic("v")) == ["喉", "体調", None]
    assert column(spark, ["今日は悪化", "案の定昨日は雨"], T.normalize_time_prefix("v")) == ["今日に悪化", "昨日に雨"]
    assert column(spark, ["今日はさらに悪化した", "急に悪化", "体調が悪化"], T.needs_completion("v")) == [True, True, False]


def test_token_normal_form(spark):
    rows = spark.createDataFrame([(["Todo", "Write", "REPORT", "する"], "x"), ([], "A b-C")], "t array<string>, v string")
    got = [r[0] for r in rows.select(T.normalize_for_dedupe("v", "t")).collect()]
    assert got == ["write report", "abc"]


def test_numbers_dates_and_json(spark):
    assert column(spark, ["12.9", "-3.2", "x", None], S.safe_int("v", minimum=0)) == [12, 0, 0, 0]
    assert column(spark, ["2024-01-02T03:04:05", "bad"], S.to_utc("v").cast("string")) == ["2024-01-02 03:04:05", None]
    assert column(spark, ["2024-01-02T03:04:05+09:00"], S.to_utc("v").cast("string")) == ["2024-01-01 18:04:05"]
    assert column(spark, ["4", "-0.5", "12345678", "4 items"], S.object_json(F.lit("mentions"), "v")) == [
        '{"value": 4.0}', '{"value": -0.5}', '{"value": 12345678.0}', None,
    ]
    assert column(spark, ["2024-01-02 plan", "7", "text"], S.object_type(F.lit("mentions"), "v")) == ["date", "number", "text"]


def test_numbers_of_any_size_are_json(spark):
    import json

    texts = ["0", "-0", "1234567890123456", "12345678901234567", "1" + "0" * 16, "123456789012345678901234567", "9" * 60, "1" + "0" * 300,
             "-12345678901234567.25", "0.0001", "0.00012345678901234567", "0.00001", "0.0000000000000001", "1234567.891"]
    want = [json.dumps({"value": float(t)}) for t in texts]
    assert column(spark, texts, S.object_json(F.lit("mentions"), "v")) == want
    # no double holds it, and JSON has no infinity
    assert column(spark, ["9" * 400], S.object_json(F.lit("mentions"), "v")) == [None]
    assert column(spark, ["9" * 400], S.object_type(F.lit("mentions"), "v")) == ["number"]


def test_artifact_hash_sorts_keys(spark):
    import hashlib

    got = spark.range(1).select(S.artifact_hash({"b": F.lit("x"), "a": F.lit(1)})).first()[0]
    assert got == hashlib.sha256(b'{"a":1,"b":"x"}').hexdigest()
