"""Registered queries of the pipeline operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.session import work_dir
from capturelake.sources.tables import read_table

from .shipping import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    documents = read_table(spark, sf_dir, "documents")
    return token_counts(documents, public_tokenizers.path("word_bpe_49k.json"), 2048)


@query
def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shuffle_into_shards

    # columns of the table may have the names of the added ones
    dealt = shuffle_into_shards(read_table(spark, sf_dir, "documents"), 8, 7, "_shard", "_slot")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return dealt.select(
        "doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .archives import decide, read_archives, write_archives

    folder = work_dir(spark, "archives")
    manifest = write_archives(decide(read_table(spark, sf_dir, "pages")), folder)
    return read_archives(spark, folder, manifest).drop("url", "payload")


ORACLES["op4_warc_dictionary"] = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digest
    FROM pages
), f AS (SELECT digest, min(page_id) AS first_id FROM p GROUP BY digest),
c AS (
    SELECT p.*, first_id, list_transform(range(160), k -> substr(
        lpad(bin(CAST(('0x' || substr(digest, CAST(k // 4 AS INT) + 1, 1)) AS INT)), 4, '0'), CAST(k % 4 AS INT) + 1, 1)) AS bits
    FROM p JOIN f USING (digest)
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), g -> substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(bits[5 * g + 1] AS INT) * 16 + CAST(bits[5 * g + 2] AS INT) * 8 + CAST(bits[5 * g + 3] AS INT) * 4
        + CAST(bits[5 * g + 4] AS INT) * 2 + CAST(bits[5 * g + 5] AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM c
"""


@query
def op5_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_merge import remove_repeats

    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    n_bytes = F.octet_length("text").cast("long")
    return found.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op6_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    placed = pack_sequences(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_on_training, held_out, identify

    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    languages, model = fit_on_training(documents)
    return identify(documents.drop("lang"), languages, model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set", "lang_shares", "rejected"
    )


@query
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnowing import fingerprint_edits

    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_classes

    return jaccard_classes(read_table(spark, sf_dir, "documents")).drop("text_key", "class_key")


@query
def op10_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import SPACE, encode_packed

    packed = encode_packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return packed.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.replace("text", F.lit(SPACE), F.lit(" "))).alias("round_trip"),
    )


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, with_planted_runs

    found = periodic_runs(with_planted_runs(read_table(spark, sf_dir, "documents")))
    # the greatest exact length / period, then the smallest start, then the smallest period
    better = lambda a, r: (
        a.isNull()
        | (r.length * a.period > a.length * r.period)
        | ((r.length * a.period == a.length * r.period) & ((r.start < a.start) | ((r.start == a.start) & (r.period < a.period))))
    )
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    top = F.aggregate("runs", none, lambda a, r: F.when(better(a, r), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query
def op12_pointer_jumping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import alignment_scores

    return alignment_scores(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


@query
def op11_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out
    from .toxicity import fit_on_labels, score_documents

    documents = read_table(spark, sf_dir, "documents")
    network = fit_on_labels(documents, read_table(spark, sf_dir, "labels"))
    return score_documents(documents, network).select("doc_id", held_out().alias("held_out"), "score", "predicted")
