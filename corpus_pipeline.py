"""Pipeline from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents, and carry others through whatever their names.  SQL cannot
express the stages, so there is no ORACLE_SQL; tests hold the whole run against
plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm.language import fit_on_training, known
from capturelake.llm.ngram_join import one_of_each
from capturelake.llm.packing import pack_sequences
from capturelake.llm.shipping import ship_package
from capturelake.llm.suffix_merge import remove_repeats
from capturelake.session import work_dir
from capturelake.sources.tables import read_table

ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those that the background explains better than any learned language."""
    ship_package(spark)
    languages, model = fit_on_training(docs)
    return known(docs, languages, model)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ship_package(spark)
    return one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings from the texts; a document that loses all of it stays as an empty one."""
    ship_package(spark)
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {name: f"c{names.index(name)}" for name in ("doc_id", "text", "n_chars")}
    others = tuple(c for c in numbered.columns if c not in at.values())
    cut = remove_repeats(numbered, at["doc_id"], at["text"], carry=others)
    n_chars = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    new = {at["text"]: F.col("kept_text"), at["n_chars"]: n_chars}
    return cut.select(*[new.get(c, F.col(c)).alias(c) for c in numbered.columns]).toDF(*names)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, in sequences of 2048 tokens."""
    ship_package(spark)
    return pack_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_near),
    ("repeats", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = work_dir(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
