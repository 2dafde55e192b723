"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles.  Equal texts are one node.  A node has HASHES
MinHash values; nodes that agree on all ROWS values of a band share a bucket
and are linked to the bucket's smallest node, so buckets never make pairs.
At the threshold of 0.8 the bands miss a pair with probability 2.5e-7.

The nodes of a connected component meet in blocks.  In a block all MinHash
values of two sides are compared a few at a time; after each step pairs leave
whose posterior probability of reaching the threshold, from a uniform prior,
is below TOLERANCE.  The pairs that are left are verified exactly on their
shingle sets.  A block gives link counts and one edge a node, not pairs.

Defined results: words are what white space parts, in lower case; a text of
fewer words than a shingle is one shingle; null and empty texts are equal
texts without links to others; repeated rows count as copies; null ids are
kept and linked like others, and the class id is the smallest non-null id, null
where a class has none; an empty table gives an empty result;
columns beyond id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.session import work_dir

from .bitmaps import bitmap_of, flag_by
from .components import connected_components

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 50
HASHES = ROWS * BANDS
STEP = 30
TOLERANCE = 1e-9
BLOCK = 256
_B = 0x9E3779B97F4A7C15
_grown: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _grown or len(_grown[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        made = []
        for base in (_B, pow(_B, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _grown[:] = made
    return _grown[0], _grown[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    blanks = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [n]])
    k = min(words, len(parts))
    lo, hi = start[: len(start) - k + 1], end[k - 1 :]
    return np.unique(_mixed((sums[hi] - sums[lo]) * down[lo]))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


_MULTIPLY, _ADD = _coefficients()


def signature(grams: np.ndarray) -> np.ndarray:
    """HASHES minima; each hash multiplies, adds and multiplies in 32 bits."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low, high = grams.astype(np.uint32), (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(grams), 1024):
        h = low[at : at + 1024, None] * _MULTIPLY
        h ^= high[at : at + 1024, None] + _ADD
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def least_matches(compared: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest agreeing values of `compared` for which the threshold is still probable enough.

    With a uniform prior the posterior is a beta law, whose tail is a binomial sum.
    """
    total, n = 0.0, compared + 1
    for m in range(compared + 1):
        total += math.comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if total >= tolerance:
            return m
    return compared + 1


_LEAST = [(at, least_matches(at)) for at in range(STEP, HASHES + 1, STEP)]


def probable_pairs(a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that no step has dropped."""
    i, j = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices((len(a), len(b))))
    matches = np.zeros(len(i), np.int32)
    for end, least in _LEAST:
        for at in range(0, len(i), 65_536):
            part = slice(at, at + 65_536)
            matches[part] += (a[i[part], end - STEP : end] == b[j[part], end - STEP : end]).sum(1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def common_counts(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets."""
    rows, cols = np.unique(i), np.unique(j)
    left, right = [a[k] for k in rows], [b[k] for k in cols]
    grams, where = np.unique(np.concatenate(left + right), return_inverse=True)
    often = np.bincount(where, minlength=len(grams)) > 1
    number = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    kept = often[where]
    owner, gram = owner[kept], number[where[kept]]
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    total = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(gram, [at, at + width])
        held = np.zeros((len(left) + len(right), width), np.float32)
        held[owner[lo:hi], gram[lo:hi] - at] = 1
        total += held[: len(left)] @ held[len(left) :].T
    return total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


def linked_pairs(sig_a, sig_b, sets_a, sets_b, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the block whose exact likeness reaches the threshold."""
    i, j = probable_pairs(sig_a, sig_b, same)
    if not len(i):
        return i, j
    common = common_counts(sets_a, sets_b, i, j)
    size_a, size_b = np.array([len(x) for x in sets_a]), np.array([len(x) for x in sets_b])
    union = size_a[i] + size_b[j] - common
    keep = (common >= THRESHOLD * union - 1e-9) & (common > 0)
    return i[keep], j[keep]


def jaccard_classes(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id, text_id, class_id, n_links, and the keys text_key and class_key.

    text_id is the smallest id of the equal texts, class_id that of all texts
    connected by links; n_links counts the other rows, copies included, whose
    likeness to the row reaches the threshold.
    """
    spark = documents.sparkSession
    where = work_dir(spark, "ngram-join")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(F.col(id_column).alias("id"), text.alias("text")).withColumn(
        "node", F.unhex(F.md5(F.col("text")))
    )

    def sign(batches):
        import pyarrow as pa

        seen = set()
        for batch in batches:
            fresh = {}
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    fresh[node] = text
            signs = [signature(shingles(t)) for t in fresh.values()]
            bands = [_mixed(np.sum(s.reshape(BANDS, ROWS) * _SALT, axis=1, dtype=np.uint64) + _SALT_BAND).view(np.int64) for s in signs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(fresh), pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["node", "bands"]
            )

    nodes = rows.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    nodes.write.parquet(f"{where}/nodes")
    nodes = spark.read.parquet(f"{where}/nodes")
    # texts are signed where they lie, once a task; only the bands of a text move
    bands = rows.where("text != ''").select("node", "text").mapInArrow(sign, "node binary, bands array<bigint>")
    bands.dropDuplicates(["node"]).write.parquet(f"{where}/signed")
    signed = spark.read.parquet(f"{where}/signed")
    banded = signed.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    edges = banded.join(buckets.select("band", "b"), "band").where("node != b").select(F.col("node").alias("a"), "b")
    connected_components(edges.distinct()).write.parquet(f"{where}/near")
    near = spark.read.parquet(f"{where}/near")
    blocks = near.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = near.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = (
        placed.join(nodes, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "id", "node", "n", "root", "block",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )

    def gather(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                ["node", "sig", "grams"],
            )

    wanted = placed.join(nodes, "node").select(F.col("node").alias("_node"), F.col("id").alias("_id"))
    texts = (
        rows.join(wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id")))
        .dropDuplicates(["node"])
        .select("node", "text")
        .mapInArrow(gather, "node binary, sig binary, grams binary")
    )

    def meet(key, frame):
        import pandas as pd

        same = key[1] == key[2]
        a = frame if same else frame[frame["block"] == key[1]]
        b = a if same else frame[frame["block"] == key[2]]
        sides = []
        for side in (a, b):
            sides.append(
                (
                    np.frombuffer(b"".join(side["sig"]), np.uint32).reshape(len(side), HASHES),
                    [np.frombuffer(g, np.uint64) for g in side["grams"]],
                    side["n"].to_numpy(),
                    list(side["node"]),
                )
            )
        (sig_a, sets_a, n_a, node_a), (sig_b, sets_b, n_b, node_b) = sides
        i, j = linked_pairs(sig_a, sig_b, sets_a, sets_b, same)
        links_a = np.bincount(i, weights=n_b[j], minlength=len(a)).astype(np.int64)
        links_b = np.bincount(j, weights=n_a[i], minlength=len(b)).astype(np.int64)
        # one edge a node: to the root of a union over this block's links
        shift = 0 if same else len(a)
        root = list(range(shift + len(b)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        links = links_a + links_b if same else np.concatenate([links_a, links_b])
        names = node_a if same else node_a + node_b
        at = [k for k in range(len(names)) if links[k]]
        return pd.DataFrame({"node": [names[k] for k in at], "links": links[at], "root": [names[find(k)] for k in at]})

    met = members.join(texts, "node").select("root", "i", "j", "block", "node", "n", "sig", "grams")
    met.groupBy("root", "i", "j").applyInPandas(meet, "node binary, links long, root binary").write.parquet(f"{where}/links")
    links = spark.read.parquet(f"{where}/links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(classes, "node", "left").join(counts, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("id").alias("class_id"))
    final = known.join(least, "root").select(
        F.col("node").alias("text_key"), F.col("id").alias("text_id"), "class_id",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("root").alias("class_key"),
    )
    narrow = rows.select(F.col("id").alias(id_column), F.col("node").alias("text_key"))
    return narrow.join(final, "text_key").select(id_column, "text_id", "class_id", "n_links", "text_key", "class_key")


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id (null last), then of the smallest text key.

    Rows whose class is one row stay where they lie.  Bitmaps of bounded size
    tell them apart: one of the texts in classes of several rows, and one of the
    rows that stay of those classes, and of the few single rows that the first
    one hits by chance.  Only rows that the second one hits are exchanged with
    their texts, and compared exactly.
    """
    spark = documents.sparkSession
    where = work_dir(spark, "one-of-each")
    names = documents.columns
    rows = documents.toDF(*[f"c{k}" for k in range(len(names))])
    row_id, text = (f"c{names.index(c)}" for c in (id_column, text_column))
    jaccard_classes(rows, row_id, text).write.parquet(f"{where}/classes")
    classes = spark.read.parquet(f"{where}/classes").withColumnRenamed(row_id, "id")
    first = classes.groupBy("class_key").agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "text_key")).alias("first"), F.count("*").alias("rows"))
    single = F.col("rows") == 1
    key = lambda *c: F.xxhash64(*c)
    # a class of very many rows is not gathered: its key is looked up in a bitmap too
    large = bitmap_of(first.where(~single).select(key("class_key").alias("key")))
    touched = bitmap_of(flag_by(classes, key("class_key"), large, "many").where("many").select(key("text_key").alias("key")))
    kept = first.select("first.id", "first.text_key", single.alias("single"))
    kept = flag_by(kept, key("text_key"), touched, "hit").where(~F.col("single") | F.col("hit")).select("id", "text_key")
    kept.write.parquet(f"{where}/kept")
    kept = spark.read.parquet(f"{where}/kept")
    stays = bitmap_of(kept.select(key("id", "text_key").alias("key")))
    keyed = rows.withColumn("k", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    flagged = flag_by(flag_by(keyed, key("k"), touched, "touched"), key(row_id, "k"), stays, "stays")
    alone = flagged.where(~F.col("touched")).select(*rows.columns)
    exact = kept.select(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    met = flagged.where("touched and stays").join(
        exact, F.col(row_id).eqNullSafe(F.col("kept_id")) & (F.col("k") == F.col("kept_key"))
    )
    one = met.dropDuplicates(["kept_id", "kept_key"]).select(*rows.columns)
    return alone.unionByName(one).toDF(*names)


_SALT = np.random.default_rng(23).integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)
_SALT_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(_B)
