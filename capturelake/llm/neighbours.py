"""Approximate nearest neighbours over randomly rotated one-bit codes.

Vectors are dealt to the nearest of CENTRES centres.  The residual to its
centre is scaled to length one, rotated at random, and kept as one sign bit a
dimension, packed, with two scalars: the residual's length, and the inner
product of the residual with its own sign vector, which corrects the estimate.
A query's rotated residual is rounded to four bits a dimension; inner products
with all codes of a block come from counting common bits, one bit plane after
another.  The estimate has a known error bound; a vector whose smallest
possible distance is within the k-th of the largest possible ones is ranked
again by its exact distance in double precision.

Centres are fitted on SAMPLE rows at most; every row is indexed.  A query goes
to the nearest PROBE_SHARE of the centres.  Rows and queries of one centre meet in blocks,
so a centre that holds a third of all rows is many tasks.  Of equal vectors
only the k + 1 smallest ids can be among the answers of any query; the others
leave before the search, and equal queries are searched once.

Defined results: null vectors, those of length zero or with null or non-finite
components, and rows with a null id take no part; vectors of another dimension
than the most frequent (the larger, if two are as frequent) take no part; equal distances go to the smaller
id; a repeated row is one candidate for its id; an empty table gives no rows; columns beyond id and vector are
not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.session import work_dir

SAMPLE = 16_384
MOST_CENTRES = 256
#: Vectors without clusters have neighbours behind most centres: a half of them gave a recall of 0.90, this 0.99.
PROBE_SHARE = 0.9
BLOCK, QUERY_BLOCK = 4096, 256
#: Standard deviations of the estimate that count as its error bound.
BOUND = 3.0
QUERY_BITS = 4


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray, centres: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = sample[rng.choice(len(sample), min(centres, len(sample)), replace=False)]
    for _ in range(rounds):
        own = np.argmin((at * at).sum(1) - 2 * sample @ at.T, axis=1)
        n = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, sample)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed sign bits, residual lengths, and residuals' inner products with their codes."""
    residual = vectors - centre
    length = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(length, 1e-300)[:, None]) @ turn.T
    fit = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, fit


def estimate(codes, length, fit, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Least and greatest squared distances [query, row] that the codes allow."""
    dim = queries.shape[1]
    residual = queries - centre
    far = np.linalg.norm(residual, axis=1)
    turned = (residual / np.maximum(far, 1e-300)[:, None]) @ turn.T
    low, high = turned.min(1), turned.max(1)
    width = np.maximum(high - low, 1e-12) / (2**QUERY_BITS - 1)
    level = np.rint((turned - low[:, None]) / width[:, None]).astype(np.uint8)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int32)
    common = np.zeros((len(queries), len(codes)), np.int32)
    for bit in range(QUERY_BITS):
        plane = np.packbits((level >> bit) & 1, axis=1)
        for byte in range(codes.shape[1]):
            common += np.bitwise_count(plane[:, byte, None] & codes[None, :, byte]).astype(np.int32) << bit
    # inner product of the sign vector with the rounded query, then corrected by the code's own fit
    total = low * dim + width * level.sum(1)
    raw = 2 * (low[:, None] * ones + width[:, None] * common) - total[:, None]
    rounded = np.abs(turned - low[:, None] - width[:, None] * level)
    inner = raw / np.sqrt(dim) / np.maximum(fit, 1e-12)
    spread = BOUND * np.sqrt(np.maximum(0, 1 - fit * fit) / max(1, dim - 1)) / np.maximum(fit, 1e-12)
    error = spread[None, :] + rounded.sum(1)[:, None] / np.sqrt(dim) / np.maximum(fit, 1e-12)
    middle, cross = far[:, None] ** 2 + length**2, 2 * far[:, None] * length
    least = middle - cross * np.minimum(1.0, inner + error)
    return np.maximum(least, (far[:, None] - length) ** 2), middle - cross * np.maximum(-1.0, inner - error)


def search_block(queries, query_ids, codes, length, fit, vectors, ids, k, centre, turn):
    """(query id, row id, distance) of the k nearest rows of the block to each query."""
    least, most = estimate(codes, length, fit, queries, centre, turn)
    n = min(k, len(ids))
    limit = np.partition(most, n - 1, axis=1)[:, n - 1]
    found_query, found_id, found_score = [], [], []
    for i in range(len(queries)):
        near = np.flatnonzero(least[i] <= limit[i] * (1 + 1e-9) + 1e-12)
        gap = vectors[near] - queries[i]
        score = np.sqrt((gap * gap).sum(1))
        order = np.lexsort((ids[near], score))[:k]
        found_query.append(np.full(len(order), query_ids[i]))
        found_id.append(ids[near][order])
        found_score.append(score[order])
    return np.concatenate(found_query), np.concatenate(found_id), np.concatenate(found_score)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest other rows."""
    spark = vectors.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("v"), is_query.alias("asks")).where(
        "id is not null and v is not null and size(v) > 0 "
        "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x != 0)"
    )
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim).withColumn("copy", F.sha2(F.array_join("v", ","), 256))
    # of equal vectors the k + 1 smallest ids; a query's own id is among its answers until the end
    few = rows.dropDuplicates(["copy", "id"]).withColumn(
        "n", F.row_number().over(Window.partitionBy("copy").orderBy("id"))
    )
    sample = np.array(
        [r["v"] for r in rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], np.float64
    )
    centres = fit_centres(sample, int(min(MOST_CENTRES, max(1, round(total**0.5 / 2)))))
    turn, probes = rotation(dim), int(np.ceil(len(centres) * PROBE_SHARE))

    def deal(base: bool):
        def run(batches):
            import pandas as pd

            for batch in batches:
                if not len(batch):
                    continue
                v = np.stack(batch["v"].to_numpy())
                gap = (centres * centres).sum(1) - 2 * v @ centres.T
                if base:
                    own = np.argmin(gap, axis=1)
                    code, length, fit = encode(v, centres[own], turn)
                    yield pd.DataFrame(
                        {"id": batch["id"], "v": [x.tobytes() for x in v], "code": [c.tobytes() for c in code],
                         "length": length, "fit": fit, "centre": own.astype("int32")}
                    )
                else:
                    near = np.argsort(gap, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame(
                        {"copy": np.repeat(batch["copy"].to_numpy(), probes),
                         "v": [x.tobytes() for x in v for _ in range(probes)], "centre": near.ravel().astype("int32")}
                    )

        return run

    where = work_dir(spark, "neighbours")
    few.where(F.col("n") <= k + 1).select("id", "v").mapInPandas(
        deal(True), "id long, v binary, code binary, length double, fit double, centre int"
    ).write.parquet(f"{where}/base")
    asked = rows.where("asks")
    asked.groupBy("copy").agg(F.min("v").alias("v")).mapInPandas(deal(False), "copy string, v binary, centre int").write.parquet(
        f"{where}/asked"
    )
    base, ask = spark.read.parquet(f"{where}/base"), spark.read.parquet(f"{where}/asked")
    # a row for each centre: into how many blocks its rows and its queries fall
    n_base = {r["centre"]: -(-r["count"] // BLOCK) for r in base.groupBy("centre").count().collect()}
    n_ask = {r["centre"]: -(-r["count"] // QUERY_BLOCK) for r in ask.groupBy("centre").count().collect()}
    blocks = F.get(F.lit([n_base.get(c, 0) for c in range(len(centres))]), F.col("centre"))
    asks = F.get(F.lit([n_ask.get(c, 0) for c in range(len(centres))]), F.col("centre"))
    every = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)")))
    left = base.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("part", every(asks))
    right = ask.withColumn("part", F.pmod(F.xxhash64("copy"), asks).cast("int")).withColumn("block", every(blocks))
    cell = ["centre", "block", "part"]

    def meet(key, a, b):
        import pandas as pd

        if not len(a) or not len(b):
            return pd.DataFrame({"copy": [], "id": [], "score": []})
        double = lambda c: np.frombuffer(b"".join(c), np.float64).reshape(len(c), dim)
        codes = np.frombuffer(b"".join(a["code"]), np.uint8).reshape(len(a), -1)
        query, found, score = search_block(
            double(b["v"]), np.arange(len(b)), codes, a["length"].to_numpy(), a["fit"].to_numpy(), double(a["v"]),
            a["id"].to_numpy(), k + 1, centres[key[0]], turn,
        )
        return pd.DataFrame({"copy": b["copy"].to_numpy()[query], "id": found, "score": score})

    cells = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, "copy string, id long, score double")
    best = cells.withColumn("n", F.row_number().over(Window.partitionBy("copy").orderBy("score", "id"))).where(
        F.col("n") <= k + 1
    )
    answered = asked.select(F.col("id").alias("query_id"), "copy").distinct().join(best, "copy").where("id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return (
        answered.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )
