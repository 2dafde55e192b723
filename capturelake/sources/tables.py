"""Readers of logical tables and JSON-lines files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: With the table's name behind it: deals the rows of that table to so many
#: partitions whenever it is read, for tables whose files hold few row groups and
#: so give few tasks; unset: as the files lie.
DEAL = "spark.capturelake.deal."


def read_table(spark: SparkSession, directory: str, name: str, spread: bool = False) -> DataFrame:
    """A table's rows; with ``spread`` dealt by their first column to the session's shuffle partitions, for costly work on each row."""
    rows = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    deal = spark.conf.get(DEAL + name, None)
    if deal:
        return rows.repartition(int(deal))
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.columns[0]) if spread else rows


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """Table of a relational store, read in parallel ranges of one column."""
    return spark.read.jdbc(
        url,
        table,
        column=partition_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties or {},
    )


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return lines.select(F.from_json("value", ddl, {"mode": "FAILFAST"}).alias("row")).select("row.*")
