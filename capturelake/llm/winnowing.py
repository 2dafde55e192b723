"""Winnowing fingerprints with built-in functions.

Hashes of all grams of GRAM characters; of each WINDOW neighbouring hashes the
smallest is kept, the rightmost of equal ones, with its position.  Two texts
that share GUARANTEE characters in a row share a fingerprint.  For a key that
holds the hash above and the complement of the position below, the plain
minimum already has the rightmost tie.  A text is worked on in segments that overlap by
GUARANTEE - 1 characters, so cost and memory are linear in its length.

An element also keeps the first window that chose it.  So the fingerprint of a
prefix is a selection from that of the text, and an edited text, which is a
prefix of one text and a prefix of another, needs only the windows over its
seam.

Defined results: a null text is empty; the empty text has no elements; a text
shorter than a gram is one gram, one shorter than GUARANTEE is one window;
two fingerprints without elements have likeness 1; the likeness is that of
the sets of hashes; repeated rows are rows of their own in the order of ids,
texts break ties; rows with a null id come last; an empty table gives an empty
result; columns beyond the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 32
GUARANTEE = GRAM + WINDOW - 1
#: positions in a segment with its overlap take 9 bits
_BITS = 9
SEGMENT = (1 << _BITS) - GUARANTEE + 1
#: windows taken together; half a window is a power of two of them
STRIDE = 4
ROWS_PER_RANGE, MOST_RANGES = 512, 65_536
ELEMENT = "array<struct<first:bigint,pos:bigint,hash:bigint>>"


def _let(value: str, name: str, body: str) -> str:
    """Binds a value, so that it is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _keys(text: str) -> str:
    """Keys of the grams of a text of GRAM characters or more."""
    low = (1 << _BITS) - 1

    def key(gram: str) -> str:
        return f"(xxhash64({gram}) & {-1 << _BITS}L) | cast({low} - i as bigint)"

    # the hash is that of the bytes, so where each is a character they are cut by place
    single = _let(f"cast({text} as binary)", "w", f"transform(sequence(0, length(w) - {GRAM}), i -> {key(f'substring(w, i + 1, {GRAM})')})")
    # a look-ahead per character gives all grams in one pass over the text
    grams = f"regexp_extract_all({text}, '(?s)(?=(.{{{GRAM}}})).', 1)"
    return f"if(octet_length({text}) = length({text}), {single}, transform({grams}, (g, i) -> {key('g')}))"


def _elements(keys: str, offset: str) -> str:
    """The minima of all windows, each with the first window that has it.

    Windows are taken by STRIDE: c is the minimum of the keys that all windows
    of a stride hold, so only where a key before or behind those is smaller are
    the windows looked at one by one.  Places behind the last key are null,
    which `least` and the comparison pass over.
    """
    low, blocks = (1 << _BITS) - 1, WINDOW // STRIDE
    last = f"greatest(size(u) - {WINDOW}, 0)"
    first = ", ".join(f"get(u, i + {k})" for k in range(STRIDE))
    quads = f"transform(sequence(0, size(u) - 1, {STRIDE}), i -> least({first}))"
    # minima of half a window's strides, by doubling
    steps = ", ".join(str(1 << k) for k in range((blocks // 2).bit_length() - 1))
    pair = "zip_with(m, slice(m, 1 + s, size(m)), (a, b) -> if(b < a, b, a))"
    halves = f"aggregate(array({steps}), q, (m, s) -> {pair})"
    shared = f"transform(sequence(0, {last} div {STRIDE}), b -> least(get(d, cast(b as int) + 1), get(d, cast(b as int) + {blocks // 2})))"

    def window(r: int) -> str:
        own = [f"get(u, {STRIDE} * b + {k})" for k in (*range(r, STRIDE), *range(WINDOW, WINDOW + r))]
        return f"named_struct('at', {STRIDE} * b + {r}, 'key', least(c, {', '.join(own)}))"

    each = f"slice(array({', '.join(map(window, range(STRIDE)))}), 1, {last} - {STRIDE} * b + 1)"
    minima = (
        f"flatten(transform(z, (c, b) -> if(c < q[b] and c < get(q, b + {blocks}), "
        f"array(named_struct('at', {STRIDE} * b, 'key', c)), {each})))"
    )
    made = (
        f"named_struct('first', {offset} + x.at, 'pos', {offset} + {low} - (x.key & {low}), "
        f"'hash', shiftright(x.key, {_BITS}))"
    )
    chosen = f"transform(filter(v, (x, i) -> i = 0 or x.key != v[i - 1].key), x -> {made})"
    body = _let(_let(halves, "d", shared), "z", _let(minima, "v", chosen))
    return _let(keys, "u", _let(quads, "q", body))


def winnow_sql(text: str) -> str:
    """SQL for the elements (first, pos, hash) of a non-null text, by position."""
    whole = f"array(named_struct('first', 0L, 'pos', 0L, 'hash', shiftright(xxhash64(t), {_BITS})))"
    single = _elements(_keys("t"), "0L")
    overlap = GUARANTEE - 1
    inner = _let(
        f"concat(p[n], coalesce(substring(p[n + 1], 1, {overlap}), ''))",
        "e",
        f"if(length(e) < {GUARANTEE}, cast(array() as {ELEMENT}), "
        + _elements(_keys("e"), f"(cast(n as bigint) * {SEGMENT})")
        + ")",
    )
    parts = f"regexp_extract_all(t, '(?s).{{1,{SEGMENT}}}', 0)"
    each = f"flatten(transform(sequence(0, size(q) - 2), n -> {inner.replace('p[', 'q[')}))"
    segments = _let(f"concat({parts}, array(''))", "q", each)
    # the last window of a segment and the first of the next may choose one place
    joined = _let(segments, "r", "filter(r, (x, k) -> k = 0 or x.pos != r[k - 1].pos)")
    body = (
        f"case when t = '' then cast(array() as {ELEMENT}) when length(t) < {GRAM} then {whole} "
        f"when length(t) < {GUARANTEE} then {single} else {joined} end"
    )
    return _let(text, "t", body)


def with_next(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text, elements, next_text, next_elements; next by descending id, the first after the last.

    Rows fall into ranges of ids; the first row of a range also comes, as a
    guest, at the end of the range before it.  The driver sees one border and
    one largest id for each range.
    """
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(2**63)))
    rows = documents.select(
        F.col(id_column).alias("id"), key.alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    total, least = rows.agg(F.count("*"), F.min("key")).first()
    ranges = min(MOST_RANGES, max(1, total // ROWS_PER_RANGE))
    borders: list[int] = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        found = rows.agg(F.percentile_approx("key", shares, max(10_000, 10 * ranges))).first()[0]
        borders = sorted({b for b in found if b > least})
    steps = F.lit([1 << k for k in reversed(range((len(borders) + 1).bit_length()))])
    bound = F.lit(borders) if borders else F.expr("cast(array() as array<bigint>)")
    at = F.aggregate(
        steps,
        F.lit(0),
        lambda lo, step: F.when(
            (lo + step <= len(borders)) & (F.get(bound, lo + step - 1) <= F.col("key")), lo + step
        ).otherwise(lo),
    )
    ranged = rows.withColumn("range", at)
    largest = {r["range"]: r["key"] for r in ranged.groupBy("range").agg(F.max("key").alias("key")).collect()}
    n = len(borders) + 1
    leads = F.lit([largest.get(k, 0) for k in range(n)])
    places = F.when(
        F.col("key") == F.get(leads, F.col("range")),
        F.array(
            F.struct(F.col("range"), F.lit(False).alias("guest")),
            F.struct(((F.col("range") + 1) % n).alias("range"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))))
    dealt = ranged.select("id", "key", "text", F.explode(places).alias("place")).select("id", "key", "text", "place.*")
    own = dealt.repartition("range").withColumn("elements", F.expr(winnow_sql("text")))
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), "text")
    return (
        own.withColumns({"next_text": F.lead("text").over(order), "next_elements": F.lead("elements").over(order)})
        .where(~F.col("guest"))
        .select("id", "text", "elements", "next_text", "next_elements")
    )


def _digest(elements: str) -> str:
    return f"md5(array_join(transform({elements}, x -> concat_ws(':', x.pos, x.hash)), ','))"


def fingerprint_edits(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness.

    The edited text keeps the first half of the code points, the longer one,
    and goes on with as many of the next document as were dropped, or all.
    """
    sizes = with_next(documents, id_column, text_column).selectExpr(
        "*", "length(text) AS n", "length(text) - floor(length(text) / 2) AS h"
    )
    joined = sizes.selectExpr("*", "cast(least(n - h, length(next_text)) as int) AS m").selectExpr(
        "*", "concat(substring(text, 1, cast(h as int)), substring(next_text, 1, m)) AS edited"
    )
    seam = joined.selectExpr(
        "*", f"if(h + m < {GUARANTEE}, 0, greatest(0, h - {GUARANTEE - 1})) AS shift"
    ).selectExpr(
        "*",
        f"if(h + m < {GUARANTEE}, edited, "
        f"substring(edited, cast(shift as int) + 1, cast(least(h + m, h - 1 + {GUARANTEE}) - shift as int))) AS over",
    )
    over = winnow_sql(f"if(h + m >= {GUARANTEE} and length(over) < {GUARANTEE}, '', over)")
    pair = "named_struct('pos', x.pos + {0}, 'hash', x.hash)"
    zones = seam.selectExpr(
        "*",
        "sort_array(concat("
        f"transform(filter(elements, x -> x.first <= h - {GUARANTEE}), x -> {pair.format('0L')}), "
        f"transform({over}, x -> {pair.format('shift')}), "
        f"transform(filter(next_elements, x -> x.first <= m - {GUARANTEE}), x -> {pair.format('h')}))) AS z",
    ).selectExpr("*", "filter(z, (x, k) -> k = 0 or x.pos != z[k - 1].pos) AS edited_elements")
    sets = zones.selectExpr(
        "*",
        "array_distinct(elements.hash) AS own_set",
        "array_distinct(edited_elements.hash) AS edited_set",
        "array_distinct(next_elements.hash) AS next_set",
    )
    return sets.selectExpr(
        f"id AS `{id_column}`",
        "cast(n as long) AS n_chars",
        "sha2(cast(edited as binary), 256) AS edited_sha256",
        f"{_digest('elements')} AS fingerprint",
        f"{_digest('edited_elements')} AS edited_fingerprint",
        f"{likeness('own_set', 'edited_set')} AS near_edited",
        f"{likeness('own_set', 'next_set')} AS near_next",
    )


def likeness(a: str, b: str) -> str:
    """Share of common hashes among all of two sets of hashes."""
    return f"if(size({a}) = 0 and size({b}) = 0, 1D, size(array_intersect({a}, {b})) / size(array_union({a}, {b})))"
