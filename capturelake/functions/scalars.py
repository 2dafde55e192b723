"""Date, number, price and JSON scalar functions."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .rx import ColumnOrName, as_col, extract, let, matches, one_of
from .text import strip, strip_value

ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def at(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def to_text_ts(c: ColumnOrName) -> Column:
    return F.date_format(as_col(c), TS_TEXT)


def journal_date(c: ColumnOrName) -> Column:
    return F.substring(as_col(c), 1, 10)


def to_utc(c: ColumnOrName) -> Column:
    """Timestamp of an ISO text; a text without offset counts as UTC."""
    t = as_col(c)
    with_zone = F.when(matches(t, r"(?:z|[+-]\d{2}:\d{2})$", ci=True), t).otherwise(F.concat(t, F.lit("Z")))
    return F.try_to_timestamp(with_zone)


def period_start(c: ColumnOrName, period: str) -> Column:
    """Start of the UTC day, week (from Monday) or month."""
    if period not in ("day", "week", "month"):
        raise ValueError(f"unknown period: {period}")
    return F.date_trunc(period, as_col(c))


def in_range(c: ColumnOrName, from_ts: str | None = None, to_ts: str | None = None) -> Column:
    """Inclusive range over an ISO text; a text that is no time is outside."""
    t = F.try_to_timestamp(as_col(c))
    ok = t.isNotNull()
    if from_ts is not None:
        ok = ok & F.coalesce(t >= F.try_to_timestamp(F.lit(from_ts)), F.lit(True))
    if to_ts is not None:
        ok = ok & F.coalesce(t <= F.try_to_timestamp(F.lit(to_ts)), F.lit(True))
    return F.coalesce(ok, F.lit(False))


def legacy_ts(c: ColumnOrName) -> Column:
    return F.when(as_col(c).rlike(ISO_DATE), F.try_to_timestamp(as_col(c)))


def retry_at(as_of: datetime) -> Column:
    return at(as_of) + F.expr("INTERVAL 5 MINUTES")


def expires_at(as_of: datetime) -> Column:
    return at(as_of) + F.expr("INTERVAL 30 DAYS")


def safe_int(c: ColumnOrName, default: int = 0, minimum: int | None = None) -> Column:
    """Whole part of a number or numeric text, else the default."""
    value = F.coalesce(_whole(as_col(c)), F.lit(default).cast("bigint"))
    return value if minimum is None else F.greatest(value, F.lit(minimum).cast("bigint"))


def _whole(c: Column) -> Column:
    d = c.try_cast("double")
    finite = ~F.isnan(d) & (F.abs(d) < 9.2e18)
    return F.when(finite, F.when(d < 0, F.ceil(d)).otherwise(F.floor(d)))


def safe_double(c: ColumnOrName, default: float = 0.0) -> Column:
    d = as_col(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(d), d), F.lit(default))


def recency_boost(ts: ColumnOrName, as_of: datetime) -> Column:
    hours = (F.unix_micros(at(as_of)) - F.unix_micros(as_col(ts).cast("timestamp"))) / F.lit(3.6e9)
    return F.lit(1.0) / F.log2(F.greatest(hours, F.lit(1.0)) + F.lit(2.0))


# --- request prices ---------------------------------------------------------

PRICE = "decimal(12,6)"


def resolve_prices(
    df: DataFrame,
    prices=R.MODEL_PRICES,
    override: tuple[str | None, str | None, str | None] | None = None,
    model: str = "model",
) -> DataFrame:
    """Adds input_price, cached_price and output_price per million tokens.

    The price list is configuration, so it compiles to a branch expression
    and needs no join: exact names first, then prefixes in list order.
    ``override`` is (input, cached, output) and wins when input and output
    are both set.
    """
    if override and override[0] is not None and override[2] is not None:
        cached = override[1] if override[1] is not None else override[0]
        found = _price_struct((None, override[0], cached, override[2]))
    else:
        m = F.col(model)
        exact = [F.when(m == p[0], _price_struct(p)) for p in prices]
        prefix = [F.when(m.startswith(p[0]), _price_struct(p)) for p in prices]
        found = F.coalesce(*exact, *prefix)
    return (
        df.withColumn("_price", found)
        .withColumn("input_price", F.col("_price.input"))
        .withColumn("cached_price", F.col("_price.cached"))
        .withColumn("output_price", F.col("_price.output"))
        .drop("_price")
    )


def request_cost(
    df: DataFrame,
    prices=R.MODEL_PRICES,
    override=None,
    model: str = "model",
    tokens: tuple[str, str, str] = ("input_tokens", "cached_input_tokens", "output_tokens"),
) -> DataFrame:
    """Adds request_cost_usd, DECIMAL rounded half-up at 6 places.

    Prices and tokens are multiplied as decimals, so the result does not
    depend on binary rounding.  An unknown model costs 0 with null prices.
    """
    total_in, cached_in, out = (
        F.greatest(F.coalesce(F.col(t), F.lit(0)), F.lit(0)).cast("decimal(13,0)") for t in tokens
    )
    cached = F.least(cached_in, total_in)
    priced = resolve_prices(df, prices, override, model)
    per_million = (
        (total_in - cached).cast("decimal(13,0)") * F.col("input_price")
        + cached * F.col("cached_price")
        + out * F.col("output_price")
    )
    usd = F.round(per_million * F.lit("0.000001").cast("decimal(7,6)"), 6)
    return priced.withColumn("request_cost_usd", F.coalesce(usd, F.lit(0)).cast(PRICE))


# --- JSON -------------------------------------------------------------------


def object_type(predicate: ColumnOrName, obj: ColumnOrName) -> Column:
    p, o = as_col(predicate), as_col(obj)
    return F.when(_dated(p, o), "date").when(_numeric(p, o), "number").otherwise("text")


def _dated(p: Column, o: Column) -> Column:
    # each date holds one of its marks, which is found faster than the pattern
    marked = reduce(lambda a, b: a | b, [o.contains(m) for m in R.DATE_MARKS])
    return one_of(p, R.DATE_PREDICATES) | (marked & matches(o, R.DATE_TEXT))


def _numeric(p: Column, o: Column) -> Column:
    return one_of(p, R.NUMBER_PREDICATES) | _whole_number_text(o)


def _whole_number_text(o: Column) -> Column:
    text = strip_value(o)
    # no number begins with an ASCII letter or what stands around those
    other = (text >= ":") & (text < "\x7f")
    return F.coalesce(~other & (text == extract(o, R.NUMBER_TEXT)), F.lit(False))


def object_json(predicate: ColumnOrName, obj: ColumnOrName) -> Column:
    """{"value": x} for number objects, with x written as a float; null for numbers beyond the doubles, which JSON has no value for."""
    o = as_col(obj)
    number = F.coalesce(extract(o, R.NUMBER_TEXT), strip(o)).try_cast("double")
    p = as_col(predicate)
    # the type of most texts is told without their date
    is_number = _numeric(p, o) & ~F.coalesce(_dated(p, o), F.lit(False))
    return F.when(
        is_number & (F.abs(number) < float("inf")),
        F.concat(F.lit('{"value": '), float_text(number), F.lit("}")),
    )


def float_text(number: Column) -> Column:
    """A finite double as JSON text: plain with at least one decimal from 1e-4 up to 1e16, else with an exponent."""
    size, java = F.abs(number), number.cast("string")
    whole = F.concat(number.cast("bigint").cast("string"), F.lit(".0"))
    # 17 digits from 1e-4 on end at the 20th decimal
    plain = F.regexp_replace(number.cast("decimal(38,20)").cast("string"), "0+$", "")
    short = F.replace(F.replace(java, F.lit(".0E"), F.lit("E")), F.lit("E-"), F.lit("e-"))
    exponent = F.regexp_replace(F.replace(short, F.lit("E"), F.lit("e+")), "e-([0-9])$", "e-0$1")
    return (
        F.when(size == 0, java)
        .when((size >= 1e16) | (size < 1e-4), exponent)
        .when(number == F.floor(number), whole)
        .otherwise(plain)
    )


def artifact_hash(cols: dict[str, Column]) -> Column:
    """sha256 over a JSON object spelled with sorted keys and no spaces."""
    ordered = [cols[k].alias(k) for k in sorted(cols)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def source_ref_type(c: ColumnOrName) -> Column:
    return F.when(one_of(c, R.SOURCE_REF_TYPES), as_col(c)).otherwise("other")


def unwrap_responses(df: DataFrame, body: str = "body") -> DataFrame:
    """Opens chat responses: content text, token usage, id and parse error.

    Content is a string, or a list of parts whose texts are joined.
    """
    raw = F.try_parse_json(F.col(body))
    out = df.withColumn("_v", raw)

    def at_path(path: str, kind: str) -> Column:
        return F.try_variant_get(F.col("_v"), path, kind)

    content = F.try_variant_get(F.col("_v"), "$.choices[0].message.content", "variant")
    kind = F.schema_of_variant(F.col("_content"))
    parts = F.try_variant_get(F.col("_content"), "$", "array<variant>")
    texts = F.filter(
        F.transform(
            parts,
            lambda p: F.when(
                F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING",
                F.try_variant_get(p, "$.text", "string"),
            ),
        ),
        lambda t: t.isNotNull(),
    )
    return (
        out.withColumn("_content", content)
        .withColumn(
            "content",
            F.when(kind == "STRING", F.try_variant_get(F.col("_content"), "$", "string")).when(
                kind.startswith("ARRAY"), F.nullif(strip(F.array_join(texts, "")), F.lit(""))
            ),
        )
        .withColumn(
            "unwrap_error",
            F.when(F.col("_v").isNull(), "invalid json")
            .when(at_path("$.choices[0]", "variant").isNull(), "missing choices")
            .when(F.col("content").isNull(), "content is not json text"),
        )
        .withColumn("response_id", at_path("$.id", "string"))
        .withColumn("input_tokens", safe_int(at_path("$.usage.prompt_tokens", "string"), minimum=0))
        .withColumn(
            "cached_input_tokens",
            safe_int(at_path("$.usage.prompt_tokens_details.cached_tokens", "string"), minimum=0),
        )
        .withColumn("output_tokens", safe_int(at_path("$.usage.completion_tokens", "string"), minimum=0))
        .withColumn(
            "reasoning_output_tokens",
            safe_int(at_path("$.usage.completion_tokens_details.reasoning_tokens", "string"), minimum=0),
        )
        .drop("_v", "_content")
    )


def _price_struct(row) -> Column:
    _, inp, cached, out = row
    return F.struct(
        F.lit(inp).cast(PRICE).alias("input"),
        F.lit(cached).cast(PRICE).alias("cached"),
        F.lit(out).cast(PRICE).alias("output"),
    )
