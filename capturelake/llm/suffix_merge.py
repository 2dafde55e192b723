"""Repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

Every byte is removed that a string of LENGTH bytes covers which also starts
anywhere else.  Only suffixes that can matter are sorted.  Of the GRAM-byte
hashes inside each window of LENGTH bytes the smallest, rightmost one is the
window's anchor; equal windows have equal anchors.  The windows of one anchor
are a run; a run's text is its context.  Contexts that occur twice are repeats
as a whole; an anchor whose hash has one context has none.  What is left, the
different contexts of one anchor hash, is sorted by the suffix that starts at
the anchor:

* a map task sorts its suffixes and front-codes them: the length of the prefix
  shared with the suffix before, and the rest;
* runs are exchanged by anchor hash and merged with a loser tree whose nodes
  keep the prefix length shared with the last winner, so known prefixes are
  never compared again, and the merge gives the common prefix of neighbours;
* the order is extended to the left byte by byte: a stable sort by the new
  byte, and common prefixes from range minima, as in a suffix array.  At each
  distance, a window is repeated if it shares LENGTH bytes with a neighbour.

An anchor hash with more than CLASS_ROWS contexts does not meet in one task:
the digests of its windows are counted instead, which is exact as well.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing;
a repeated row of LENGTH bytes or more is a copy and is removed whole; null
ids are kept, and their rows told apart by a 128-bit digest of the text; ids may
be of any type; an empty table gives an empty result; columns beyond id and text
are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake.session import work_dir

from .ngram_join import _mixed, _powers

LENGTH, GRAM = 200, 48
SPAN = LENGTH - GRAM + 1
PIECE = 1 << 17
CLASS_ROWS = 20_000
TARGET_ROWS, RUN_ROWS = 40_000, 40_000


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, m, s = len(x) - width + 1, x, 1
    while s * 2 <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:n], m[width - s : width - s + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows by anchor: anchor hash, anchor place, first and last window start."""
    found = []
    up, down = _powers(PIECE + LENGTH)
    bits = np.uint64(18)
    low = np.uint64((1 << 18) - 1)
    for at in range(0, len(data) - LENGTH + 1, PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + LENGTH - 1, len(data) - at), at)
        n = len(part)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
        # the complement of the place below the hash makes the rightmost of equal ones the smallest
        keys = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        least = _sliding_min(keys, SPAN)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        place = (low - (least[first] & low)).astype(np.int64)
        found.append((grams[place].view(np.int64), place + at, first + at, last + at))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def context_digest(context: bytes, left: int) -> int:
    return int.from_bytes(hashlib.md5(context + left.to_bytes(2, "little")).digest()[:8], "little", signed=True)


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that share `start` bytes."""
    n = min(len(a), len(b))
    step = 16
    while start < n and a[start : start + step] == b[start : start + step]:
        start += step
        step *= 2
    stop = min(n, start + step)
    while start < stop:
        middle = (start + stop + 1) // 2
        if a[start:middle] == b[start:middle]:
            start = middle
        else:
            stop = middle - 1
    return min(start, n)


def front_code(rows: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (key, payload) as shared length, rest and payload."""
    out, before = [], b""
    for key, payload in rows:
        shared = common_prefix(before, key)
        out.append(struct.pack("<HHH", shared, len(key) - shared, len(payload)) + key[shared:] + payload)
        before = key
    return b"".join(out)


def decode_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(shared length with the key before, key, payload) of a front-coded run."""
    at, key, size = 0, b"", len(run)
    while at < size:
        shared, rest, extra = struct.unpack_from("<HHH", run, at)
        at += 6
        key = key[:shared] + run[at : at + rest]
        at += rest
        yield shared, key, run[at : at + extra]
        at += extra


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """All rows in order, each with the length it shares with the row before."""
    readers = [decode_run(r) for r in runs]
    heads = [next(r, None) for r in readers]
    size = 1
    while size < len(readers):
        size *= 2
    heads += [None] * (size - len(heads))
    # of each inner node: the loser's run, and the length its key shares with the winner that beat it
    loser, shared = [0] * size, [0] * size

    def duel(a: int, la: int, b: int, lb: int):
        """Winner, its length, loser, its length; both lengths are against one earlier winner."""
        if heads[b] is None:
            return a, la, b, 0
        if heads[a] is None:
            return b, lb, a, 0
        if la != lb:
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = heads[a][1], heads[b][1]
        k = common_prefix(x, y, la)
        return (a, la, b, k) if x[k:] <= y[k:] else (b, lb, a, k)

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        best, lbest, loser[node], shared[node] = duel(a, la, b, lb)
        return best, lbest

    best, length = build(1)
    while heads[best] is not None:
        _, key, payload = heads[best]
        yield length, key, payload
        heads[best] = next(readers[best], None) if best < len(readers) else None
        length = heads[best][0] if heads[best] else 0
        node = (best + size) // 2
        while node:
            best, length, loser[node], shared[node] = duel(best, length, loser[node], shared[node])
            node //= 2


def repeated_windows(rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance before the anchor at which a window is repeated; -1 for none.

    rows: (length shared with the row before, text left of the anchor) in the
    order of the suffixes at the anchor; a negative length begins a new hash.
    """
    n = len(rows)
    least, greatest = np.full(n, -1), np.full(n, -1)
    lefts = [r[1] for r in rows]
    sizes = np.array([len(x) for x in lefts])
    width = int(sizes.max(initial=0))
    before = np.zeros((n, width), np.uint8)
    for k, x in enumerate(lefts):
        before[k, : len(x)] = np.frombuffer(x, np.uint8)[::-1]
    order = np.arange(n)
    shares = np.array([r[0] for r in rows], np.int64)
    group = np.cumsum(shares < 0)
    for d in range(width + 1):
        near = shares >= LENGTH
        hit = near.copy()
        hit[:-1] |= near[1:]
        who = order[hit]
        greatest[who] = d
        least[who] = np.where(least[who] < 0, d, least[who])
        if d == width:
            break
        # one byte further left: rows without it leave
        live = np.flatnonzero(sizes[order] > d)
        if not len(live):
            break
        step = before[order[live], d].astype(np.int64) + 256 * group[live]
        turn = np.argsort(step, kind="stable")
        place, step = live[turn], step[turn]
        same = np.concatenate([[False], step[1:] == step[:-1]])
        table = [shares]
        while (1 << len(table)) < len(shares):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        new = np.full(len(place), -1, np.int64)
        lo, hi = place[:-1][same[1:]] + 1, place[1:][same[1:]] + 1
        level = np.frexp(hi - lo)[1] - 1
        least_between = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            least_between[at] = np.minimum(table[k][lo[at]], table[k][hi[at] - (1 << k)])
        new[same] = 1 + least_between
        order, shares, group = order[place], new, group[place]
    return least, greatest


def _rows_of(documents: DataFrame, id_column: str, text_column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    more = [F.col(f"`{c}`").alias(f"_carry{k}") for k, c in enumerate(carry)]
    return documents.select(F.col(id_column).alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("t"), *more)


def _emit_anchors(rows: DataFrame) -> DataFrame:
    """Anchors of all texts, equal contexts of a batch as one row.

    n is how often the batch has the context.  Where that is more than once,
    its places are known to be repeats and come as rows of their own with n = 0,
    joined to intervals; they are dealt by their document.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            at, parts, digests = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode("utf-8", "surrogatepass")
                grams, place, first, last = anchors(data)
                if len(grams):
                    at.append(np.full(len(grams), k))
                    left = place - first
                    parts.append((grams, first, last - first, left))
                    digests += [
                        context_digest(data[a : b + LENGTH], x)
                        for a, b, x in zip(first.tolist(), last.tolist(), left.tolist(), strict=True)
                    ]
            if not at:
                continue
            h, first, more, left = (np.concatenate(c) for c in zip(*parts, strict=True))
            row, u = np.concatenate(at), np.array(digests, np.int64)
            order = np.lexsort((u, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (u[order][1:] != u[order][:-1])])
            group = np.cumsum(new) - 1
            n = np.bincount(group)
            often = np.sort(order[n[group] > 1])  # by document and place
            stop = first[often] + more[often] + LENGTH
            spans: list[list[int]] = []
            for k, a, b in zip(row[often].tolist(), first[often].tolist(), stop.tolist(), strict=True):
                if spans and spans[-1][0] == k and a <= spans[-1][2]:
                    spans[-1][2] = max(b, spans[-1][2])
                else:
                    spans.append([k, a, b])
            one = order[new]
            known = np.array(spans, np.int64).reshape(-1, 3)
            where = pa.array(np.concatenate([row[one], known[:, 0]]))
            ids, ts = batch.column("id").take(where), batch.column("t").take(where)
            of_text = np.frombuffer(b"".join(ts[len(one) :].to_pylist()), "<u8")[::2]
            fake = _mixed(of_text + known[:, 1].astype(np.uint64)).view(np.int64)
            zero = np.zeros(len(known), np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, ts, pa.array(np.concatenate([h[one], fake])), pa.array(np.concatenate([u[one], zero])),
                 pa.array(np.concatenate([first[one], known[:, 1]])),
                 pa.array(np.concatenate([more[one], known[:, 2] - known[:, 1] - LENGTH]).astype(np.int32)),
                 pa.array(np.concatenate([left[one], zero]).astype(np.int16)),
                 pa.array(np.concatenate([n, zero]).astype(np.int32))],
                ["id", "t", "h", "u", "first", "more", "left", "n"],
            )

    return rows.mapInArrow(emit, f"id {id_type}, t binary, h long, u long, first long, more int, left short, n int")


def covered(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, t and intervals of bytes that repeated strings cover, at most one for each anchor."""
    spark = documents.sparkSession
    where = work_dir(spark, "suffixes")
    rows = _rows_of(documents, id_column, text_column)
    # windows of one anchor hash meet once; a frequent context is a row a batch by now
    by_hash, by_context = Window.partitionBy("h"), Window.partitionBy("h", "u")
    _emit_anchors(rows).repartition("h").withColumns(
        {
            "all": F.sum("n").over(by_context),
            "nth": F.row_number().over(by_context.orderBy("id", "t", "first")),
        }
    ).withColumn("m", F.sum(((F.col("nth") == 1) & (F.col("n") > 0)).cast("long")).over(by_hash)).where(
        "n = 0 or (n = 1 and all > 1) or (nth = 1 and m > 1)"
    ).write.parquet(f"{where}/found")
    found = spark.read.parquet(f"{where}/found")
    whole = found.where("n = 0 or (n = 1 and all > 1)").select(
        "id", "t", "first", (F.col("first") + F.col("more") + LENGTH).alias("stop")
    )
    open_rows = found.where("n > 0 and nth = 1 and m > 1").withColumn("n", F.col("all"))
    targets = max(1, -(-open_rows.count() // TARGET_ROWS))
    wanted = open_rows.groupBy("id", "t").agg(
        F.collect_list(F.struct("h", "u", "first", "more", "left", "n", (F.col("m") > CLASS_ROWS).alias("wide"))).alias("at")
    )
    # repeated rows have one text; either will do
    held = rows.withColumnsRenamed({"id": "id2", "t": "t2"})
    texts = wanted.join(held, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2"))).select("id", "t", "text", "at")
    id_type = rows.schema["id"].dataType.simpleString()

    def contexts(batch):
        """(row of the batch, text as bytes, anchor fields) of each wanted context."""
        for k, (text, at) in enumerate(zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True)):
            data = text.encode("utf-8", "surrogatepass")
            for x in at:
                context = data[x["first"] : x["first"] + x["more"] + LENGTH]
                if context_digest(context, x["left"]) == x["u"]:
                    yield k, context, x

    def make_runs(batches):
        import pyarrow as pa

        def flush(rows):
            rows.sort()
            lo = 0
            for hi in range(1, len(rows) + 1):
                if hi == len(rows) or rows[hi][0] != rows[lo][0]:
                    run = front_code([r[1:] for r in rows[lo:hi]])
                    yield pa.RecordBatch.from_pydict({"target": pa.array([rows[lo][0]], pa.int32()), "run": [run]})
                    lo = hi

        held = []
        for batch in batches:
            ids, ts = batch.column("id").to_pylist(), batch.column("t").to_pylist()
            for k, context, x in contexts(batch):
                if not x["wide"]:
                    key = struct.pack(">q", x["h"]) + context[x["left"] :]
                    name = pickle.dumps(ids[k])
                    payload = struct.pack("<16sqqH", ts[k], x["first"], x["n"], len(name)) + name + context[: x["left"]]
                    held.append((x["h"] % targets, key, payload))
            if len(held) >= RUN_ROWS:
                yield from flush(held)
                held = []
        yield from flush(held)

    def merge(frame):
        import pandas as pd

        rows, owners, last = [], [], None
        for shared, key, payload in merge_runs(list(frame["run"])):
            t, first, n, size = struct.unpack_from("<16sqqH", payload)
            head = 34 + size
            same = last == key[:8]
            rows.append((shared - 8 if same else -1, payload[head:]))
            owners.append((payload[34:head], t, first, len(payload) - head, n))
            last = key[:8]
        least, greatest = repeated_windows(rows)
        kept = [
            (pickle.loads(name), t, first + left - int(hi), first + left - int(lo) + LENGTH)
            for (name, t, first, left, n), lo, hi in zip(owners, least.tolist(), greatest.tolist(), strict=True)
            if hi >= 0 and n == 1
        ]
        return pd.DataFrame(kept, columns=["id", "t", "first", "stop"])

    def make_windows(batches):
        import pyarrow as pa

        for batch in batches:
            at, h, far, digest, first, n = [], [], [], [], [], []
            for k, context, x in contexts(batch):
                if x["wide"]:
                    for s in range(x["more"] + 1):
                        at.append(k)
                        h.append(x["h"])
                        far.append(x["left"] - s)
                        digest.append(hashlib.md5(context[s : s + LENGTH]).digest())
                        first.append(x["first"] + s)
                        n.append(x["n"])
            if at:
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(where), batch.column("t").take(where), pa.array(h), pa.array(far, pa.int32()),
                     pa.array(digest, pa.binary()), pa.array(first, pa.int64()), pa.array(n, pa.int64())],
                    ["id", "t", "h", "far", "w", "first", "n"],
                )

    merged = texts.mapInArrow(make_runs, "target int, run binary").groupBy("target").applyInPandas(
        merge, f"id {id_type}, t binary, first long, stop long"
    )
    windows = texts.where(F.exists("at", lambda x: x["wide"])).mapInArrow(
        make_windows, f"id {id_type}, t binary, h long, far int, w binary, first long, n long"
    )
    twice = windows.groupBy("h", "far", "w").count().where("count > 1").drop("count")
    wide = windows.where("n = 1").join(twice, ["h", "far", "w"]).select("id", "t", "first", (F.col("first") + LENGTH).alias("stop"))
    return whole.union(merged).union(wide)


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """id, text, carried columns, kept (bytes), kept_text, spans; a row for each row.

    kept_text leaves out the bytes of characters that were cut apart.
    """
    rows = _rows_of(documents, id_column, text_column, carry)
    spans = covered(documents, id_column, text_column).groupBy("id", "t").agg(
        F.collect_list(F.struct("first", "stop")).alias("spans")
    )
    held = spans.withColumnsRenamed({"id": "id2", "t": "t2"})
    met = rows.join(held, F.col("id").eqNullSafe(F.col("id2")) & (F.col("t") == F.col("t2")), "left").drop("id2", "t2", "t")
    names = [c for c in met.columns if c != "spans"]

    def cut(batches):
        import pyarrow as pa

        span_type = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, removed = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = union_spans([(s["first"], s["stop"]) for s in spans or ()])
                ends = [0] + [x for s in gone for x in s] + [len(data)]
                kept.append(b"".join(data[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
                removed.append([{"first": a, "stop": b} for a, b in gone])
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(kept, pa.binary()), texts, pa.array(removed, span_type)],
                [*names, "kept", "kept_text", "spans"],
            )

    schema = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in names)
    cut_rows = met.mapInArrow(
        cut, f"{schema}, kept binary, kept_text string, spans array<struct<first:bigint,stop:bigint>>"
    )
    return cut_rows.select(
        F.col("id").alias(id_column), "text", *[F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)], "kept", "kept_text", "spans"
    )
