"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash of all their columns.  A matrix says how many
rows each block sends to each target, a target being a segment of a shard's
slots: its row sums are the block sizes, its column sums the segment sizes,
and it is drawn from the multivariate hypergeometric law that a uniform
shuffle has.  Each block is permuted (sorted by a keyed hash) and cut by its
row of the matrix, the rows are exchanged, and each target is permuted again
by another keyed hash.  Shard sizes differ by one at most, and no target is
counted: its size is known beforehand.

The main path is DataFrame functions; only the block counts reach the driver,
which draws the matrix.  Blocks and segments grow with the rows up to
MOST_BLOCKS, so what the driver holds is bounded.

Defined results: null ids and texts are rows like others; repeated rows each
get a slot of their own; rows equal in every column are interchangeable, and
many of them share a block; an empty table gives an empty result; the added
columns are named by the caller and must not be in the table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 1_000_000
LEAST_BLOCKS, MOST_BLOCKS = 256, 2048
#: numpy draws from populations below this
_NUMPY_MOST = 10**9


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among `sample` drawn without replacement, for populations of any size."""
    if good < _NUMPY_MOST and bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    lo, hi = max(0, sample - bad), min(good, sample)
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, sample - mode) - log_choose(good + bad, sample))
    left = right = mode
    p_left = p_right = peak
    u = rng.random() - peak
    while u > 0 and (left > lo or right < hi):  # outwards from the mode
        if right < hi:
            p_right *= (good - right) / (right + 1) * (sample - right) / (bad - sample + right + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left / (good - left + 1) * (bad - sample + left) / (sample - left + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(blocks: list[int], targets: list[int], seed: int) -> np.ndarray:
    """Counts [block, target] with these row and column sums, as a uniform shuffle has them."""
    rng = np.random.default_rng(seed)
    left = np.array(blocks, np.int64)
    out = np.zeros((len(blocks), len(targets)), np.int64)
    for t, size in enumerate(targets):
        if left.sum() < _NUMPY_MOST:
            out[:, t] = rng.multivariate_hypergeometric(left, size, method="marginals")
        else:
            rest, need = int(left.sum()), size
            for b, n in enumerate(left.tolist()):
                rest -= n
                out[b, t] = draw_hypergeometric(rng, n, rest, need)
                need -= int(out[b, t])
        left -= out[:, t]
    return out


def even_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def shuffle_into_shards(
    rows: DataFrame, shards: int, seed: int = 7, shard_column: str = "shard", slot_column: str = "slot"
) -> DataFrame:
    """The rows with their shard and their slot in it, gapless from 0.

    Columns of the table with the names of the added ones give way to them.
    """
    rows = rows.drop(shard_column, slot_column)
    spark = rows.sparkSession
    names = [F.col(f"`{c}`") for c in rows.columns]
    keyed = rows.select(F.struct(*names).alias("row"), F.xxhash64(F.lit(seed), *names).alias("key"))
    total = keyed.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(total / ROWS_PER_BLOCK)))
    keyed = keyed.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    sizes = {r["block"]: r["count"] for r in keyed.groupBy("block").count().collect()}  # a row per block
    segments = max(1, blocks // shards)
    targets, first = [], []
    for n in even_sizes(total, shards):
        part = even_sizes(n, segments)
        targets += part
        first += [sum(part[:k]) for k in range(segments)]
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], targets, seed)
    ends = spark.createDataFrame(
        [(b, row) for b, row in enumerate(np.cumsum(matrix, axis=1).tolist())], "block int, ends array<long>"
    )
    # permute the block: sort by another keyed hash
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key")
    ranked = keyed.withColumn("rank", F.row_number().over(local).cast("long") - 1)
    steps = F.lit([1 << k for k in reversed(range(len(targets).bit_length()))])
    target = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size("ends")) & (F.get("ends", at + step - 1) <= F.col("rank")), at + step
        ).otherwise(at),
    )
    sent = ranked.join(F.broadcast(ends), "block").select("row", "key", target.alias("target"))
    again = Window.partitionBy("target").orderBy(F.xxhash64(F.lit(seed + 2), "key"), "key")
    start = F.get(F.lit(first), F.col("target")).cast("long")
    return sent.withColumn("place", F.row_number().over(again) - 1).select(
        "row.*",
        F.floor(F.col("target") / F.lit(segments)).cast("int").alias(shard_column),
        (start + F.col("place")).cast("long").alias(slot_column),
    )
