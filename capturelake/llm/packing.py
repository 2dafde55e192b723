"""Sequence packing by non-negative least squares over a length histogram.

Documents become ids plus an end id and are cut at multiples of the window.
The remainders are bins of a histogram.  All combinations of two or three
lengths that fill a window exactly are enumerated; non-negative least squares
finds how often to repeat each so that the histogram is met; the counts are
rounded, what they use too much is taken back, and the residual histogram is
packed greedily, the longest first, each gap with the longest that fits.

The histogram, the combinations and the plan depend on the window alone, not
on the number of documents.  Ranks within a length are counted in salted
groups, so one frequent length is many small groups.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each on its own; null ids are kept; an empty table gives no pieces;
columns beyond the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.session import work_dir

#: Salted groups per length, and of pieces that fill a window.
SALTS, FULL_SALTS = 64, 4096
ITERATIONS = 200
#: Bytes of ids after which a task hands on the pieces it has cut.
MOST_BYTES = 16_000_000
HUGE_TEXT = 4_000_000
#: Fixed value: the splitting pattern of this family of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_encoders: dict[str, object] = {}


def _encoder(path: str):
    """Byte-level encoder with the vocabulary of a tokenizer file.

    Ids of such a file rise with the merge order, so they serve as ranks; that
    encoder works several times faster and gives the same ids.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        # bytes stand as printable characters: those that are, as themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in known["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i for token, i in known["model"]["vocab"].items() if token not in special
        }
        _encoders[path] = tiktoken.Encoding(
            os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
    return _encoders[path]


def _parts(text: str):
    """A text in parts of bounded size; a single blank between visible characters begins a pre-token."""
    lo = 0
    while len(text) - lo > HUGE_TEXT:
        border = _BORDER.search(text, lo + HUGE_TEXT)
        if not border:
            break
        yield text[lo : border.start()]
        lo = border.start()
    yield text[lo:] if lo else text


def id_bytes(path: str, texts: list[str]):
    """Ids of each text as little-endian 32-bit numbers; special strings are special."""
    encoding = _encoder(path)
    for text in texts:
        yield b"".join(
            encoding.encode_to_numpy(part, allowed_special="all", disallowed_special=()).astype("<u4", copy=False).tobytes()
            for part in _parts(text)
        )


def combinations(window: int) -> np.ndarray:
    """Rows of three lengths, longest first, that sum to the window; the last may be 0."""
    a = np.arange(1, window)
    rows = []
    for first in range(-(-window // 3), window):
        rest = window - first
        second = a[(a <= min(first, rest)) & (2 * a >= rest)]
        rows.append(np.stack([np.full(len(second), first), second, rest - second], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def fit_counts(histogram: np.ndarray, patterns: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Non-negative repeat counts x with patterns' x close to the histogram.

    Accelerated projected gradients; column 0 of the histogram is no length.
    """
    if not len(patterns) or not histogram.sum():
        return np.zeros(len(patterns))
    size = len(histogram)
    target = histogram / histogram.max()

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, j], weights=x, minlength=size) for j in range(3))
        out[0] = 0.0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        return r[patterns[:, 0]] + r[patterns[:, 1]] + r[patterns[:, 2]]

    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue, for the step
        w = back(used(v))
        norm = np.linalg.norm(w)
        v = w / norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(iterations):
        r = used(y) - target
        r[0] = 0.0
        new = np.maximum(0.0, y - step * back(r))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * histogram.max()


def pack_histogram(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every length exactly as often as it occurs."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = combinations(window)
    held = (left[patterns[:, 0]] > 0) & (left[patterns[:, 1]] > 0) & ((patterns[:, 2] == 0) | (left[patterns[:, 2]] > 0))
    patterns = patterns[held]
    x = fit_counts(left, patterns)
    repeats = np.diff(np.round(np.cumsum(x)), prepend=0).astype(np.int64)
    for i in np.argsort(-x, kind="stable"):
        if repeats[i] <= 0:
            continue
        lengths = tuple(int(v) for v in patterns[i] if v)
        times = int(min(repeats[i], *(left[v] // lengths.count(v) for v in lengths)))
        if times > 0:
            plan.append((lengths, times))
            for v in lengths:
                left[v] -= times
    # the rest: longest first, each gap with the longest length that is left and fits
    for longest in range(window, 0, -1):
        while left[longest]:
            lengths, space = [], window
            taken = left.copy()
            v = longest
            while space > 0:
                v = min(v, space)
                fits = np.flatnonzero(taken[1 : v + 1])
                if not len(fits):
                    break
                v = int(fits[-1]) + 1
                lengths.append(v)
                taken[v] -= 1
                space -= v
            times = int(min(left[v] // lengths.count(v) for v in set(lengths)))
            plan.append((tuple(lengths), times))
            for v in lengths:
                left[v] -= times
    return plan


def _segments(plan, window: int):
    """Per length: first ranks of its segments, and their sequence and offset."""
    ranks: list[list] = [[] for _ in range(window + 1)]
    seen = [0] * (window + 1)
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for v in lengths:
            ranks[v].append((seen[v], sequence, offset))
            seen[v] += times
            offset += v
        sequence += times
    return {v: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for v, rows in enumerate(ranks) if rows}


def cut_pieces(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of at most a window: id, start, length, ids (little-endian 32-bit numbers), doc_tokens, salt."""
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def cut(batches):
        import pyarrow as pa

        def made(own, row, start, length, total, held):
            arrays = [own.take(pa.array(row, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in (start, length, total)] + [pa.array(held, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "doc_tokens", "ids"])

        for batch in batches:
            own, texts = batch.column("id"), batch.column("text").to_pylist()
            columns, size = ([], [], [], [], []), 0
            for i, ids in enumerate(id_bytes(tokenizer_path, texts)):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, window):
                    piece = ids[4 * at : 4 * (at + window)]
                    for column, value in zip(columns, (i, at, len(piece) // 4, n, piece), strict=True):
                        column.append(value)
                    size += len(piece)
                    if size >= MOST_BYTES:
                        yield made(own, *columns)
                        columns, size = ([], [], [], [], []), 0
            yield made(own, *columns)

    pieces = rows.mapInArrow(cut, f"id {id_type}, start long, length long, doc_tokens long, ids binary")
    salts = F.when(F.col("length") == window, FULL_SALTS).otherwise(SALTS)
    return pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", F.crc32("ids")), salts).cast("int"))


def pack_sequences(
    documents: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    window: int = 2048,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece with its ids, their digest, its sequence_id and offset; no two pieces overlap."""
    spark = documents.sparkSession
    where = work_dir(spark, "packing-pieces")
    cut_pieces(documents, tokenizer_path, end_id, window, id_column, text_column).write.parquet(where, compression="zstd")
    pieces = spark.read.parquet(where)
    # at most window x SALTS + FULL_SALTS rows, whatever the corpus
    counts = [np.zeros(SALTS, np.int64) for _ in range(window)] + [np.zeros(FULL_SALTS, np.int64)]
    for length, salt, n in pieces.groupBy("length", "salt").count().toLocalIterator():
        counts[length][salt] = n
    before = [np.cumsum(c) - c for c in counts]
    segments = _segments(pack_histogram(np.array([c.sum() for c in counts]), window), window)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for v in np.unique(length):
                own = length == v
                first, base, at = segments[int(v)]
                r = rank[own] + before[v][salt[own]]
                k = np.searchsorted(first, r, "right") - 1
                sequence[own] = base[k] + r - first[k]
                offset[own] = at[k]
            arrays = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    names = ["id", "start", "length", "ids", "doc_tokens"]
    order = Window.partitionBy("length", "salt").orderBy("id", "start", F.crc32("ids"))
    id_type = pieces.schema["id"].dataType.simpleString()
    placed = pieces.withColumn("rank", F.row_number().over(order).cast("long") - 1).mapInArrow(
        place, f"id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    ).select("id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return placed.withColumnRenamed("id", id_column)
