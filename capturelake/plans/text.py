"""Queries over text functions: clamp, sentences, normal forms, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.functions import text as T
from capturelake.functions.rx import explode_rows
from capturelake.session import work_dir
from capturelake.sources.tables import read_jsonl

from .frames import frame
from .registry import query, step

SENTENCES = (
    "list_filter(list_transform(regexp_split_to_array({0}, '[。.!?！？\\n]+'), "
    "lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 4)"
)


def sql_clamp(expr: str, n: int) -> str:
    one = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({one}) <= {n} THEN {one} ELSE rtrim(substr({one}, 1, {n - 3})) || '...' END"


def sql_one_line(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def sql_parts(keys: str, name: str, expr: str, n: int, source: str) -> str:
    """One row per part of n characters of a text: keys, the text and part."""
    whole = f"SELECT {keys}, coalesce({expr}, '') AS {name} FROM {source}"
    return f"SELECT *, unnest(generate_series(0, greatest(CAST(ceil(length({name}) / {n}) AS BIGINT) - 1, 0))) AS part FROM ({whole})"


def sql_key(expr: str) -> str:
    """A key part as ids join it: backslash and ``|`` escaped."""
    return f"replace(replace({expr}, '\\', '\\\\'), '|', '\\|')"


def sql_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def sql_dedupe_form(expr: str) -> str:
    return f"regexp_replace(lower(regexp_replace({expr}, '\\s+', '', 'g')), '[^0-9a-zぁ-んァ-ヶ一-龠ー]', '', 'g')"


step("doc_sentences", f"SELECT doc_id, lang, source, {SENTENCES.format('text')} AS sents FROM documents")
step(
    "sentence_rows",
    """SELECT doc_id, lang, source, unnest(sents) AS sentence, generate_subscripts(sents, 1) - 1 AS idx FROM doc_sentences""",
    ["doc_sentences"],
)


def sentence_rows(spark, sf_dir):
    docs = frame(spark, sf_dir, "documents").withColumn("sents", T.split_sentences("text"))
    return explode_rows(docs, "sents", "doc_id", "lang", "source", ord_name="idx", item="sentence")


@query(
    "text_clamp",
    f"SELECT doc_id, {sql_clamp('text', 160)} AS short, {sql_clamp('text', 1000)} AS medium FROM documents",
)
def text_clamp(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select(
        "doc_id", T.clamp("text", 160).alias("short"), T.clamp("text", 1000).alias("medium")
    )


@query(
    "text_first_line",
    f"""SELECT doc_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\n'), lambda s: {sql_strip('s')}), lambda s: s <> '')[1], '') AS first_line
    FROM documents""",
)
def text_first_line(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select("doc_id", T.first_line("text").alias("first_line"))


@query("sentence_split", "SELECT doc_id, CAST(idx AS INTEGER) AS idx, sentence FROM sentence_rows", ["sentence_rows"])
def sentence_split(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("doc_id", "idx", "sentence")


@query(
    "text_normal_forms",
    f"""SELECT doc_id, md5({sql_dedupe_form('text')}) AS dedupe_form,
      md5(regexp_replace(lower(regexp_replace(text, '\\s+', '', 'g')), '[。、！？・,.;:()（）「」『』"''`]', '', 'g')) AS match_form,
      md5(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}\\p{{M}}_ぁ-んァ-ヶ一-龠ー ]+', '', 'g')) AS alias_form,
      regexp_matches(text, '[ぁ-んァ-ヶ一-龠]') AS cjk
    FROM documents""",
)
def text_normal_forms(spark, sf_dir):
    return frame(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(T.normalize_for_dedupe("text")).alias("dedupe_form"),
        F.md5(T.normalize_for_match("text")).alias("match_form"),
        F.md5(T.normalize_alias("text")).alias("alias_form"),
        T.has_cjk("text").alias("cjk"),
    )


@query(
    "token_normal_form",
    f"""SELECT doc_id, CAST(idx AS INTEGER) AS idx, CASE WHEN len(kept) > 0 THEN array_to_string(kept, ' ') ELSE {sql_dedupe_form('sentence')} END AS dedupe_form
    FROM (SELECT *, list_filter(list_transform(string_split(sentence, ' '), lambda s: lower(trim(s))),
        lambda s: s <> '' AND s NOT IN ('する','なる','ある','いる','こと','もの','これ','それ','ため','です','ます','todo','next')) AS kept
      FROM sentence_rows)""",
    ["sentence_rows"],
)
def token_normal_form(spark, sf_dir):
    rows = sentence_rows(spark, sf_dir).withColumn("tokens", F.split("sentence", " "))
    return rows.select("doc_id", "idx", T.normalize_for_dedupe("sentence", "tokens").alias("dedupe_form"))


GRAMS = """SELECT doc_id, len(g) AS n_grams, md5(array_to_string(list_sort(g), '|')) AS digest
    FROM (SELECT doc_id, CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 2 THEN [text]
        ELSE list_distinct(list_transform(list_zip(c[1:len(c)-1], c[2:len(c)]), lambda p: p[1] || p[2])) END AS g
      FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS c FROM documents))"""


@query("char_ngrams", GRAMS)
@query("char_ngrams_all", GRAMS)
def char_ngrams_all(spark, sf_dir):
    return _grams(frame(spark, sf_dir, "documents"))


def _grams(docs):
    return docs.select("doc_id", T.char_ngrams("text").alias("g")).select(
        "doc_id",
        F.size("g").cast("bigint").alias("n_grams"),
        F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest"),
    )


TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^0-9a-z\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9faf}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


@query(
    "search_tokens",
    f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
)
def search_tokens(spark, sf_dir):
    toks = frame(spark, sf_dir, "documents").select("doc_id", T.search_tokens("text").alias("t"))
    return toks.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("digest")
    )


@query(
    "capture_text_fields",
    f"""SELECT capture_id, nullif(regexp_extract(raw_text, 'https?://[^\\s)>"]+', 0), '') AS url,
      md5({sql_strip("regexp_replace(raw_text, 'https?://[^" + chr(92) + "s)>" + chr(34) + "]+', '', 'g')")}) AS no_urls,
      CAST(coalesce(nullif(regexp_extract(raw_text, '\\b[pP]([1-4])\\b', 1), ''), '3') AS INTEGER) AS priority,
      CAST(nullif(regexp_extract(raw_text, '(?i)(?:mood|気分)\\s*[:：]?\\s*([1-5])', 1), '') AS INTEGER) AS mood,
      CAST(nullif(regexp_extract(raw_text, '(?i)(?:energy|元気|活力)\\s*[:：]?\\s*([1-5])', 1), '') AS INTEGER) AS energy
    FROM captures""",
    ["captures"],
)
def capture_text_fields(spark, sf_dir):
    from capturelake.functions import rules as R

    return frame(spark, sf_dir, "captures").select(
        "capture_id",
        T.extract_url("raw_text").alias("url"),
        F.md5(T.strip_urls("raw_text")).alias("no_urls"),
        T.extract_priority("raw_text").alias("priority"),
        T.extract_score("raw_text", R.MOOD).alias("mood"),
        T.extract_score("raw_text", R.ENERGY).alias("energy"),
    )


@query(
    "clause_split",
    f"""SELECT capture_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS idx, md5(unnest(c)) AS clause FROM (
      SELECT capture_id, list_filter(flatten(list_transform(regexp_split_to_array(raw_text, '[。！？]\\s*'),
        lambda s: list_transform(regexp_split_to_array({sql_strip('s')}, '[、]\\s*'), lambda p: {sql_strip('p')}))), lambda p: p <> '') AS c
      FROM captures)""",
    ["captures"],
)
def clause_split(spark, sf_dir):
    rows = frame(spark, sf_dir, "captures").withColumn("clauses", T.split_clauses("raw_text"))
    out = explode_rows(rows, "clauses", "capture_id", ord_name="idx", item="clause")
    return out.withColumn("clause", F.md5("clause"))


TIMED = "(['今日は', '案の定昨日は', ' 来週は', '月曜日は', '日曜は', 'さらに', ''])[CAST(doc_id % 7 AS INT) + 1] || text"


@query(
    "time_prefix",
    f"""SELECT doc_id, md5(regexp_replace({sql_strip("regexp_replace(" + sql_strip('t') + ", '^案の定', '')")},
      '^(今日|昨日|明日|今朝|今夜|昨夜|先週|今週|来週|先月|今月|来月|月曜(?:日)?|火曜(?:日)?|水曜(?:日)?|木曜(?:日)?|金曜(?:日)?|土曜(?:日)?|日曜(?:日)?)は', '\\1に')) AS said FROM (SELECT doc_id, {TIMED} AS t FROM documents)""",
)
def time_prefix(spark, sf_dir):
    """Texts that begin with a time, told as a time adverb."""
    heads = F.array(*[F.lit(h) for h in ("今日は", "案の定昨日は", " 来週は", "月曜日は", "日曜は", "さらに", "")])
    docs = frame(spark, sf_dir, "documents")
    timed = F.concat(F.get(heads, (F.col("doc_id") % 7).cast("int")), "text")
    return docs.select("doc_id", F.md5(T.normalize_time_prefix(timed)).alias("said"))


@query("json_lines", "SELECT conv_id, turn, role, md5(text) AS text FROM conversations")
def json_lines(spark, sf_dir):
    """The conversations written as JSON lines and read back with a schema."""
    path = work_dir(spark, "lines")
    frame(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").write.json(path, ignoreNullFields=False)
    rows = read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")
    turn = frame(spark, sf_dir, "conversations").schema["turn"].dataType
    return rows.select("conv_id", F.col("turn").cast(turn).alias("turn"), "role", F.md5("text").alias("text"))


TOPICAL = "(['胃の調子が悪化した。', '  Sore Throat again ', '会議が改善、', '頭痛が', ''])[CAST(doc_id % 5 AS INT) + 1] || text"


@query(
    "topic_named",
    f"""SELECT doc_id, coalesce(nullif({sql_strip("regexp_extract(t, '([^、。]{1,24}?)が(?:悪化|悪く|改善|回復|低下|上昇|不調|痛)', 1)")}, ''),
      nullif(regexp_extract(t, '(?i)(喉(?:の調子)?|のど|体調|熱|咳|頭痛|胃|声|鼻|睡眠|気分|疲労|sore throat|throat|condition|health)', 1), '')) AS topic FROM (SELECT doc_id, {sql_strip(TOPICAL)} AS t FROM documents)""",
)
def topic_named(spark, sf_dir):
    """Topics that a text names as the subject of a change, or by a word."""
    heads = F.array(*[F.lit(h) for h in ("胃の調子が悪化した。", "  Sore Throat again ", "会議が改善、", "頭痛が", "")])
    docs = frame(spark, sf_dir, "documents")
    text = F.concat(F.get(heads, (F.col("doc_id") % 5).cast("int")), "text")
    return docs.select("doc_id", T.extract_topic(text).alias("topic"))
