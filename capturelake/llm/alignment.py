"""Alignment of the tokens of two tokenizers by pointer jumping.

Both tokenizers read the same bytes: a blank and the text.  Every token points
to its farthest-right overlapping token of the other side; the last token of a
group points to itself.  Doubling the successors of all tokens at once (each
takes its successor's successor) ends when no pointer changes, and every token
then holds the last token of its group, which labels the group.

Neither tokenizer joins anything across a blank that follows a visible
character, so both are run, and tokens aligned, once for each such part of a
text that a worker has not met yet, for many parts in one go; a bounded memory
holds what is known.  A document's alignment is that of its parts, one after
the other.

Links are pairs of overlapping tokens.  How many documents hold an id pair
linked is counted for the whole corpus: in each task first, then by one shuffle
of the sums.  For the way back, a document's distinct pairs travel packed, cut
at id ranges that hold about equally many pairs of the corpus, and meet the
counts of that range; ranges and salts grow with the corpus, so no task holds
more than a bounded number of counts and about GROUP_BYTES of packed pairs.

Defined results: a text that is null or empty, or whose tokens' bytes on either
side are not the blank and the text, has no tokens, groups or links; special
strings in texts are plain text; repeated rows are rows, and documents, of
their own; null ids are kept; an empty table gives an empty result; columns
beyond the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.session import work_dir

from .packing import PATTERN
from .wordcache import slices

SPACE = "▁"
#: Parts of texts that a worker remembers.
MEMORY = 400_000
#: Id pairs that a task sums before it hands them on, and that a range of the counts holds.
TASK_PAIRS, RANGE_PAIRS = 4_000_000, 250_000
#: Packed pairs that meet one copy of a range's counts.
GROUP_BYTES = 32_000_000
_UNEVEN = re.compile(r"\s(?: |\Z)")
_CUT = re.compile(r"\S (?=\s*\S)")


def _byte_characters() -> dict[str, int]:
    """How byte-level vocabularies print bytes: the printable ones as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and the alignment of every part of a text met lately."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            known = json.load(f)
        byte_of = _byte_characters()
        special = {t["content"] for t in known["added_tokens"]}
        vocabulary = known["model"]["vocab"]
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        # ids rise with the merge order, so they serve as ranks; special strings are plain text
        self.a = tiktoken.Encoding(os.path.basename(path_a), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.n_a, self.n_b = 1 + max([*vocabulary.values(), *(t["id"] for t in known["added_tokens"])]), self.b.get_piece_size()
        self.bytes_a = [b""] * self.n_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.n_b):
            piece = self.b.id_to_piece(i)
            plain = b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace(SPACE, " ").encode()
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else plain)
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.by_part = not any(SPACE in p.lstrip(SPACE) for p in map(self.b.id_to_piece, range(self.n_b)))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.written: list[str] = []
        #: per part: n_a, n_b, n_groups, where its links begin and end; -1 tokens where the bytes differ
        self.facts = np.zeros((0, 5), np.int64)
        self.links = np.zeros(0, np.int64)

    def parts(self, text: str) -> list[str]:
        """The text, cut at each blank that follows a visible character and is not part of its last white space.

        Each part stands for a blank and itself.
        """
        if not self.by_part:
            return [text]
        if text[0] != " " and _UNEVEN.search(text) is None:
            return text.split(" ")
        cuts = [m.start() + 1 for m in _CUT.finditer(text)]
        return [text[lo:hi] for lo, hi in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]

    def learn(self, batches: list[list[str]]) -> None:
        wanted: set[str] = set()
        for parts in batches:
            wanted.update(parts)
        new = wanted.difference(self.number)
        if len(self.number) + len(new) > MEMORY:
            self._forget()
            new = wanted
        if new:
            self._align(list(new))

    def _encode_a(self, parts: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and how many each has: plain parts as one text, those with outer white space alone."""
        plain = np.array([not (p[0].isspace() or p[-1].isspace()) for p in parts])
        count, own = np.zeros(len(parts), np.int64), [np.zeros(0, np.int64)] * len(parts)
        whole = self.a.encode_to_numpy("".join([" " + p for p, ok in zip(parts, plain, strict=True) if ok]), disallowed_special=())
        end = np.cumsum(self.length_a[whole])
        border = np.cumsum(sizes[plain])
        at = np.searchsorted(end, border)
        if len(border) and not (end[at] == border).all():
            raise ValueError("a token reaches across a blank")
        count[plain] = np.diff(np.concatenate([[0], at + 1]))
        for k in np.flatnonzero(~plain):
            own[k] = self.a.encode_to_numpy(" " + parts[k], disallowed_special=()).astype(np.int64)
            count[k] = len(own[k])
        ids = np.empty(int(count.sum()), np.int64)
        part = np.repeat(np.arange(len(parts)), count)
        ids[plain[part]] = whole
        ids[~plain[part]] = np.concatenate(own)
        return ids, count

    def _same_bytes(self, parts: list[bytes], sizes: np.ndarray, ids: np.ndarray, count: np.ndarray, side: int) -> np.ndarray:
        """Whether the bytes of each part's tokens are the part's."""
        table, length = ((self.bytes_a, self.length_a), (self.bytes_b, self.length_b))[side]
        end = np.concatenate([[0], np.cumsum(count)])
        total = np.concatenate([[0], np.cumsum(length[ids])])[end]
        good = np.diff(total) == sizes
        tokens = [table[i] for i in ids.tolist()]
        if good.all() and b"".join(tokens) == b"".join(parts):
            return good
        for k in np.flatnonzero(good):
            good[k] = b"".join(tokens[end[k] : end[k + 1]]) == parts[k]
        return good

    def _align(self, parts: list[str]) -> None:
        # a part's own blank is added: to A as text, by B itself
        raw = [(" " + p).encode() for p in parts]
        sizes = np.array(list(map(len, raw)), np.int64)
        a, count_a = self._encode_a(parts, sizes)
        own_b = self.b.encode(parts, num_threads=1)
        count_b = np.array(list(map(len, own_b)), np.int64)
        b = np.array(list(chain.from_iterable(own_b)), np.int64)
        good = self._same_bytes(raw, sizes, a, count_a, 0) & self._same_bytes(raw, sizes, b, count_b, 1)
        a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
        count_a, count_b = count_a * good, count_b * good
        label_a, label_b, link_a, link_b = align_tokens(self.length_a[a], self.length_b[b])
        written = self._write(a, b, label_a, label_b)
        part_of_a = np.repeat(np.arange(len(parts)), count_a)
        n_links = np.bincount(part_of_a[link_a], minlength=len(parts))
        last = np.concatenate([label_b[1:] != label_b[:-1], [True]]) if len(b) else np.zeros(0, bool)
        n_groups = np.bincount(np.repeat(np.arange(len(parts)), count_b)[last], minlength=len(parts))
        end = len(self.links) + np.cumsum(n_links)
        facts = np.stack([count_a, count_b, n_groups, end - n_links, end], axis=1)
        facts[~good, 0] = -1
        base = len(self.written)
        at = np.concatenate([[0], np.cumsum(n_groups)])
        self.written += [";".join(written[lo:hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.facts = np.concatenate([self.facts, facts])
        self.links = np.concatenate([self.links, a[link_a] * self.n_b + b[link_b]])
        self.number.update(zip(parts, range(base, base + len(parts)), strict=True))

    @staticmethod
    def _write(a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray) -> list[str]:
        """Each group as its A ids, a bar and its B ids."""

        def joined(ids: np.ndarray, label: np.ndarray) -> list[str]:
            ids = list(map(str, ids.tolist()))
            edge = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]])).tolist() if len(ids) else [0]
            return [",".join(ids[lo:hi]) if hi - lo > 1 else ids[lo] for lo, hi in zip(edge, edge[1:], strict=False)]

        return [f"{x}|{y}" for x, y in zip(joined(a, label_a), joined(b, label_b), strict=True)]

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """n_a, n_b, n_groups, n_links, groups, distinct linked pairs (a x n_b + b, sorted) and how often, of each text."""
        for lo, hi in slices(texts):
            split = [self.parts(t) if t else [] for t in texts[lo:hi]]
            self.learn(split)
            sizes = np.array([len(p) for p in split])
            at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(split)), sizes)
            facts = self.facts[at]
            bad = np.bincount(doc[facts[:, 0] < 0], minlength=len(split)) > 0
            own = ~bad[doc]
            sums = [np.bincount(doc[own], facts[own, k], len(split)).astype(np.int64) for k in range(3)]
            n = (facts[:, 4] - facts[:, 3]) * own
            place = np.repeat(facts[:, 3] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pair_doc = np.repeat(doc, n)
            n_links = np.bincount(pair_doc, minlength=len(split))
            shift = (self.n_a * self.n_b).bit_length()
            key, times = np.unique(pair_doc << shift | self.links[place], return_counts=True)
            edge = np.searchsorted(key, np.arange(len(split) + 1) << shift)
            key &= (1 << shift) - 1
            first = np.cumsum(sizes) - sizes
            for d in range(len(split)):
                numbers = [] if bad[d] else at[first[d] : first[d] + sizes[d]].tolist()
                groups = ";".join([self.written[k] for k in numbers])
                x, y = edge[d], edge[d + 1]
                yield *(int(s[d]) for s in sums), int(n_links[d]), groups, key[x:y], times[x:y]


def align_tokens(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group labels of both sides' tokens, which cover the same bytes, and all links (indices of A, of B)."""
    n_a, n_b = len(length_a), len(length_b)
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    last_b = np.searchsorted(end_b, end_a)  # of the tokens that overlap, the one with the last byte
    last_a = np.searchsorted(end_a, end_b)
    itself = np.arange(n_b) + n_a
    further = end_a[last_a] > end_b if n_b else np.zeros(0, bool)
    successor = np.concatenate([last_b + n_a, np.where(further, last_a, itself)])
    while True:
        doubled = successor[successor]
        if (doubled == successor).all():
            break
        successor = doubled
    first_b = np.searchsorted(end_b, end_a - length_a, "right")
    n = last_b - first_b + 1
    link_a = np.repeat(np.arange(n_a), n)
    link_b = np.repeat(first_b - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return successor[:n_a], successor[n_a:], link_a, link_b


_aligners: dict[tuple[str, str], Aligner] = {}


def load_aligner(path_a: str, path_b: str) -> Aligner:
    """Aligner of this worker; kept from task to task."""
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def align_documents(
    documents: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, pairs and times.

    `groups` holds the groups in order, `a1,a2|b1;a3|b2,b3`; `pairs` the distinct
    linked id pairs as a x (ids of B) + b, sorted, in 64-bit little-endian
    numbers, and `times` how often each is linked, in 32-bit ones.  No shuffle.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def align(batches):
        import pyarrow as pa

        aligner = load_aligner(path_a, path_b)
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = 0
            for lo, hi in slices(texts, 2_000_000):
                columns: list[list] = [[] for _ in range(7)]
                for *plain, key, times in aligner.documents(texts[lo:hi]):
                    row = (*plain, key.astype("<i8").tobytes(), times.astype("<i4").tobytes())
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, hi - lo), *arrays], names)
                done = hi

    schema = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"
    return rows.mapInArrow(align, schema).withColumnRenamed("id", id_column)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many rows hold each id pair; summed in each task before the shuffle."""

    def count(batches):
        import pyarrow as pa

        def batch_of(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "n"])

        def merged(held):
            key = np.concatenate([k for k, _ in held])
            order = np.argsort(key, kind="stable")
            key, n = key[order], np.concatenate([n for _, n in held])[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            return key[at], np.add.reduceat(n, at) if len(at) else n

        held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")
            for lo in range(0, len(key), TASK_PAIRS):
                held.append(np.unique(key[lo : lo + TASK_PAIRS], return_counts=True))
                if sum(len(k) for k, _ in held) > TASK_PAIRS:
                    held = [merged(held)]
                    if len(held[0][0]) > TASK_PAIRS // 2:
                        yield batch_of(*held[0])
                        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield batch_of(*merged(held))

    return aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, counts: DataFrame, n_b: int, row_column: str) -> DataFrame:
    """row, n_best, count_sum of rows with links.

    `aligned` has a row number, pairs and times; `counts` the corpus-wide counts.
    A link is best if no other pair of its A id has a higher count.
    """
    ranked = counts.select("pair", "n", F.expr(f"pair div {n_b}").alias("a"))
    # at most one row for each id of A
    sizes = sorted((r["a"], r["count"]) for r in ranked.groupBy("a").count().collect())
    edges, room = [], RANGE_PAIRS
    for a, n in sizes:
        if n > room:
            edges.append(a * n_b)
            room = RANGE_PAIRS
        room -= n
    packed = aligned.agg(F.sum(F.length("pairs")).alias("size")).first()["size"] or 0
    salts = max(1, -(-packed // (GROUP_BYTES * (len(edges) + 1))))
    cuts = np.array([0, *edges, np.iinfo(np.int64).max], np.int64)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            row, pairs, times = (batch.column(k).to_pylist() for k in range(3))
            out: tuple[list, list, list, list] = ([], [], [], [])
            for own, p, t in zip(row, pairs, times, strict=True):
                key = np.frombuffer(p, "<i8")
                at = np.searchsorted(key, cuts).tolist()
                for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    if hi > lo:
                        for column, value in zip(out, (own, k, p[8 * lo : 8 * hi], t[4 * lo : 4 * hi]), strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            arrays = [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "range", "pairs", "times"])

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            key, n, best = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            part = np.searchsorted(cuts, key, "right") - 1
            order = np.argsort(part, kind="stable")
            found, at = np.unique(part[order], return_index=True)
            rows = [order[lo:hi] for lo, hi in zip(at, [*at[1:], len(order)], strict=True)]
            made = [[c[r].astype(kind).tobytes() for r in rows] for c, kind in ((key, "<i8"), (n, "<i8"), (best, "?"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.astype(np.int32)), *(pa.array(m, pa.binary()) for m in made)], ["range", "key", "n", "best"]
            )

    def look_up(keys, links, table):
        import pandas as pd

        key = np.frombuffer(b"".join(table["key"]), "<i8")
        order = np.argsort(key, kind="stable")
        key = key[order]
        n = np.frombuffer(b"".join(table["n"]), "<i8")[order]
        best = np.frombuffer(b"".join(table["best"]), "?")[order]
        if not len(links):
            return pd.DataFrame({"row": [], "n_best": [], "count_sum": []}, dtype="int64")
        times = np.frombuffer(b"".join(links["times"]), "<i4").astype(np.int64)
        at = np.searchsorted(key, np.frombuffer(b"".join(links["pairs"]), "<i8"))
        sizes = links["pairs"].str.len().to_numpy() // 8
        first = np.cumsum(sizes) - sizes
        return pd.DataFrame(
            {
                "row": links["row"].to_numpy(),
                "n_best": np.add.reduceat(times * best[at], first),
                "count_sum": np.add.reduceat(times * n[at], first),
            }
        )

    links = aligned.select(F.col(row_column).alias("row"), "pairs", "times").where(F.length("pairs") > 0)
    links = links.mapInArrow(cut, "row long, range int, pairs binary, times binary")
    links = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    best = F.col("n") == F.max("n").over(Window.partitionBy("a"))
    table = ranked.select("pair", "n", best.alias("best")).mapInArrow(pack, "range int, key binary, n binary, best binary")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    found = links.groupBy("range", "salt").cogroup(table.groupBy("range", "salt")).applyInPandas(
        look_up, "row long, n_best long, count_sum long"
    )
    return found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_scores(
    documents: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The alignment is written once, with the digest of the groups and packed pairs.
    """
    import sentencepiece

    spark = documents.sparkSession
    folder = work_dir(spark, "alignment")
    aligned = align_documents(documents, path_a, path_b, id_column, text_column)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned.select(
        F.col(id_column).alias("id"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "times"
    ).withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/documents", compression="zstd")
    stored = spark.read.parquet(f"{folder}/documents")
    pair_counts(stored).write.parquet(f"{folder}/counts", compression="zstd")
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    scores = score_links(stored, spark.read.parquet(f"{folder}/counts"), n_b, "row")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return stored.drop("pairs", "times").join(scores, "row", "left").select(
        F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
