"""Contracts of result rows: rules as data, violations as an array column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# a rule set maps a field to its checks: type, nullable, enum, minimum,
# maximum, and for arrays and structs items / fields
COUNT = {"type": "integer", "minimum": 0}
TEXT = {"type": "string"}
OPTIONAL_TEXT = {"type": "string", "nullable": True}
STRUCTURE_RESULT = {
    "captures_processed": COUNT,
    "notes_created": COUNT,
    "tasks_created": COUNT,
    "captures_blocked": COUNT,
    "captures_skipped": COUNT,
    "errors": COUNT,
    "dry_run": {"type": "boolean"},
}
FACT_RESULT = {
    "items_processed": COUNT,
    "facts_inserted": COUNT,
    "facts_skipped": COUNT,
    "facts_replaced": COUNT,
    "errors": COUNT,
    "extractor_version": TEXT,
}
CLAIM_RESULT = {
    "document_id": OPTIONAL_TEXT,
    "status": {"type": "string", "enum": ["succeeded", "queued", "blocked", "failed"]},
    "claims_inserted": COUNT,
    "evidence_inserted": COUNT,
    "entities_upserted": COUNT,
    "links_inserted": COUNT,
    "error_code": OPTIONAL_TEXT,
    "error": OPTIONAL_TEXT,
}
TYPES = {
    "string": (T.StringType,),
    "boolean": (T.BooleanType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "array": (T.ArrayType,),
    "object": (T.StructType,),
}


def _violations(value: Column, dtype: T.DataType, rule: dict, path: str) -> list[Column]:
    """Column tests of one field; type rules are settled on the schema."""
    if not isinstance(dtype, TYPES[rule["type"]]):
        return [F.lit(f"{path}: expected {rule['type']}")]
    out = []
    if not rule.get("nullable", False):
        out.append(F.when(value.isNull(), f"{path}: is missing"))
    if "enum" in rule:
        out.append(F.when(~value.isin(*rule["enum"]), f"{path}: not in enum"))
    if "minimum" in rule:
        out.append(F.when(value < rule["minimum"], f"{path}: below minimum"))
    if "maximum" in rule:
        out.append(F.when(value > rule["maximum"], f"{path}: above maximum"))
    if "items" in rule and isinstance(dtype, T.ArrayType):
        item = dtype.elementType

        def broken(x: Column) -> Column:
            found = _violations(x, item, rule["items"], path)
            return F.coalesce(*found).isNotNull() if found else F.lit(False)

        out.append(F.when(F.exists(value, broken), f"{path}: invalid item"))
    if "fields" in rule and isinstance(dtype, T.StructType):
        out += _field_violations(lambda n: value[n], dtype, rule["fields"], f"{path}.")
    return out


def _field_violations(get, schema: T.StructType, rules: dict, prefix: str) -> list[Column]:
    out = []
    names = set(schema.fieldNames())
    for name, rule in rules.items():
        path = prefix + name
        if name not in names:
            if not rule.get("optional", False):
                out.append(F.lit(f"{path}: missing required property"))
            continue
        out += _violations(get(name), schema[name].dataType, rule, path)
    out += [F.lit(f"{prefix}{n}: additional property") for n in schema.fieldNames() if n not in rules]
    return out


def check_contract(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Adds ``violations``: the broken rules of each row, empty when good."""
    tests = _field_violations(F.col, df.schema, rules, "$.")
    found = F.filter(F.array(*tests), lambda t: t.isNotNull()) if tests else F.array().cast("array<string>")
    return df.withColumn("violations", found)


def split_valid(df: DataFrame, rules: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their violations)."""
    checked = check_contract(df, rules)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
