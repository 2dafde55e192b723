"""Text scalar functions.  Every function maps columns to a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .rx import ColumnOrName, as_col, blank_to_null, extract, head, let, matches, replace_all, rx, str_array


# every Unicode whitespace character; trimming a character set is one pass
# over the ends, where a regex would scan the whole text
WHITESPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: ColumnOrName) -> Column:
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def strip_value(c: ColumnOrName) -> Column:
    """``strip`` of a value that costs nothing to read again, as a field does.

    Trimming lays out the whole text and goes through the list of spaces for
    both ends; a text with a letter at both goes by it.
    """
    t = as_col(c)
    last = F.substring(t.cast("binary"), -1, 1)
    # no character of several bytes ends in a byte of ASCII; its last byte is looked up by counting characters
    ascii_end = (last >= F.lit(b"\x21")) & (last < F.lit(b"\x7f"))
    spaced = (~ascii_end & F.substring(t, -1, 1).isin(*WHITESPACE)) | F.substring(t, 1, 1).isin(*WHITESPACE)
    return F.when(spaced, strip(t)).otherwise(t)


def rstrip(c: ColumnOrName) -> Column:
    return F.rtrim(as_col(c), F.lit(WHITESPACE))


def collapse(c: ColumnOrName) -> Column:
    """One space for every run of whitespace, none at the ends."""
    return F.trim(replace_all(c, r"\s+", " "))


def clamp(c: ColumnOrName, n: int | None) -> Column:
    """One line of at most ``n`` characters, of any length without ``n``."""
    if n is None:
        return collapse(c)
    return let(
        collapse(c),
        lambda t: F.when(F.length(t) <= n, t).otherwise(
            F.concat(rstrip(F.substring(t, 1, n - 3)), F.lit("..."))
        ),
    )


def first_line(c: ColumnOrName) -> Column:
    """First line that is not blank, trimmed; empty when there is none."""
    line = F.regexp_extract(as_col(c), rx(r"^\s*(\S[^\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]*)"), 1)
    return F.coalesce(rstrip(line), F.lit(""))


def extract_url(c: ColumnOrName) -> Column:
    return extract(c, R.URL)


def strip_urls(c: ColumnOrName) -> Column:
    return strip(replace_all(c, R.URL))


def extract_priority(c: ColumnOrName) -> Column:
    return F.coalesce(extract(c, R.PRIORITY, 1).cast("int"), F.lit(3))


def extract_score(c: ColumnOrName, pattern: str) -> Column:
    return extract(c, pattern, 1, ci=True).cast("int")


def note_title(c: ColumnOrName, fallback: Column, max_chars: int | None = 120) -> Column:
    """First line of a note, else the fallback; whole with ``max_chars=None``."""
    return clamp(F.coalesce(blank_to_null(first_line(c)), fallback), max_chars)


def task_title(c: ColumnOrName, max_chars: int | None = 120) -> Column:
    body = strip(replace_all(first_line(c), R.TASK_PREFIX, ci=True))
    return clamp(F.coalesce(blank_to_null(body), F.lit("Untitled task")), max_chars)


def split_sentences(c: ColumnOrName, max_chars: int | None = None) -> Column:
    """Sentences of 4 characters or more, in text order; ``max_chars`` drops longer ones."""
    parts = F.transform(F.split(as_col(c), rx(R.SENTENCE_BREAK)), collapse)
    if max_chars is None:
        return F.filter(parts, lambda s: F.length(s) >= 4)
    return F.filter(parts, lambda s: F.length(s).between(4, max_chars))


def keep_sentence(sentence: ColumnOrName, tokens: ColumnOrName) -> Column:
    """Row filter for tokenised sentences: drops short one-token parts."""
    n = F.coalesce(F.size(as_col(tokens)), F.lit(0))
    return ~((n == 1) & (F.length(as_col(sentence)) < 10))


def split_clauses(c: ColumnOrName) -> Column:
    sentences = F.transform(F.split(as_col(c), rx(R.CLAUSE_SENTENCE_BREAK)), strip)
    parts = F.flatten(
        F.transform(sentences, lambda s: F.transform(F.split(s, rx(R.CLAUSE_BREAK)), strip))
    )
    return F.filter(parts, lambda p: p != "")


# all but 0-9 a-z ぁ-ん ァ-ヶ 一-龠 ー, as ranges: Java matches a negated class of several ranges about ten times slower
_NO_KEY = r"[\x00-/:-`{-\u3040\u3094-\u30a0\u30f7-\u30fb\u30fd-\u4dff\u9fa1-\x{10ffff}]+"


def normalize_for_dedupe(c: ColumnOrName, lemmas: ColumnOrName | None = None) -> Column:
    """Dedupe key of a text; from lemmas when a tokenizer supplied them."""
    plain = F.regexp_replace(F.lower(as_col(c)), _NO_KEY, "")
    if lemmas is None:
        return plain
    kept = F.filter(
        F.transform(F.coalesce(as_col(lemmas), F.array().cast("array<string>")), lemma_form),
        lambda t: (t != "") & ~t.isin(*R.STOP_LEMMAS),
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(plain)


def lemma_form(c: ColumnOrName) -> Column:
    return F.lower(strip_value(c))


def normalize_for_match(c: ColumnOrName) -> Column:
    return F.regexp_replace(F.lower(replace_all(c, r"\s+")), R.MATCH_PUNCTUATION, "")


def char_ngrams(c: ColumnOrName, n: int = 2) -> Column:
    """Distinct character n-grams; a text no longer than n is its own gram.

    Grams come from shifted copies of the character array, so the cost grows
    with the length of the text and not with its square.
    """
    t = as_col(c)

    def grams(chars: Column) -> Column:
        count = F.greatest(F.size(chars) - (n - 1), F.lit(0))
        shifted = [F.slice(chars, F.lit(k + 1), count) for k in range(n)]
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted)

    return (
        F.when(F.length(t) == 0, str_array([]))
        .when(F.length(t) <= n, F.array(t))
        .otherwise(F.array_distinct(let(F.regexp_extract_all(t, F.lit("(?s)."), 0), grams)))
    )


def normalize_alias(c: ColumnOrName) -> Column:
    return replace_all(F.lower(collapse(c)), r"[^\wぁ-んァ-ヶ一-龠ー ]+")


def search_tokens(c: ColumnOrName) -> Column:
    spaced = F.regexp_replace(F.lower(as_col(c)), r"[^0-9a-z\u3040-\u30ff\u4e00-\u9faf]+", " ")
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def has_cjk(c: ColumnOrName) -> Column:
    return as_col(c).rlike(R.CJK)


def normalize_subject(c: ColumnOrName, max_chars: int | None = None) -> Column:
    v = strip_value(c)
    return F.when((v == "") | matches(v, R.ME_WORDS, ci=True), F.lit("me")).otherwise(head(v, max_chars))


def normalize_time_prefix(c: ColumnOrName) -> Column:
    value = strip(replace_all(strip(c), "^案の定"))
    return F.regexp_replace(value, R.TIME_PREFIX, "$1に")


def extract_topic(c: ColumnOrName, max_chars: int | None = None) -> Column:
    """Topic named by a text, or null; whole unless ``max_chars`` is given."""
    # the subject's pattern tries 24 lengths at every letter, so texts without its particle go by it
    named = lambda v: F.when(v.contains("が"), blank_to_null(head(strip(F.regexp_extract(v, R.TOPIC_SUBJECT, 1)), max_chars)))
    v = strip_value(c)
    return F.coalesce(named(v), extract(v, R.TOPIC_HINT, 1, ci=True))


def needs_completion(c: ColumnOrName) -> Column:
    """A state change told without its topic."""
    return let(
        strip(c),
        # the tests of the start and the length are cheap and fail most texts
        lambda v: (v != "")
        & (
            (F.length(v) <= 24)
            | v.rlike(R.TIME_PREFIX)
            | v.rlike("^(?:" + "|".join(R.COMPLETION_LEADS) + ")")
        )
        & matches(v, R.STATE_CHANGE_HINT, ci=True)
        & ~matches(v, R.TOPIC_HINT, ci=True),
    )


def payload_entries(payload_json: ColumnOrName) -> Column:
    """Payload as array<struct(key, kind, text, items)> in JSON order.

    ``kind`` is string, number, boolean, array, object or null; ``text`` is
    the scalar as text and ``items`` the array's members as text.
    """

    def describe(entry: Column) -> Column:
        value = entry["value"]
        return let(
            F.schema_of_variant(value),
            lambda t: F.struct(
                entry["key"].alias("key"),
                F.when(t == "STRING", "string")
                .when(t.startswith("ARRAY"), "array")
                .when(t.startswith("OBJECT"), "object")
                .when(t == "BOOLEAN", "boolean")
                .when((t == "VOID") | t.isNull(), "null")
                .otherwise("number")
                .alias("kind"),
                F.when(t.startswith("ARRAY") | t.startswith("OBJECT") | (t == "VOID"), None)
                .otherwise(F.try_variant_get(value, "$", "string"))
                .alias("text"),
                F.when(t.startswith("ARRAY"), F.try_variant_get(value, "$", "array<string>")).alias("items"),
            ),
        )

    return F.transform(F.map_entries(F.from_json(as_col(payload_json), "map<string,variant>")), describe)


def searchable_text(
    title: ColumnOrName, body: ColumnOrName, tags: ColumnOrName, payload_json: ColumnOrName
) -> Column:
    """Title, body, tags, then the payload's string, number and array values."""
    values = F.transform(
        F.filter(payload_entries(payload_json), lambda e: e["kind"].isin("string", "number", "array")),
        lambda e: F.when(e["kind"] == "array", F.array_join(e["items"], " ", "")).otherwise(e["text"]),
    )
    head = F.array(
        F.coalesce(as_col(title), F.lit("")),
        F.coalesce(as_col(body), F.lit("")),
        F.array_join(as_col(tags), " "),
    )
    return strip(F.array_join(F.concat(head, F.coalesce(values, str_array([]))), " "))
