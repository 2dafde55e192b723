"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and a length of
at least LEAST_POWER x q (and LEAST_WORDS) that no neighbouring word extends.

Words get ranks by prefix doubling, document by document, so that equal ranks
of level k mean equal blocks of 2^k words; the order of the last level is the
suffix array.  A run of period q with 2^(k-1) < q <= 2^k holds a whole block of
2^k words that begins at a multiple of 2^k, and that block occurs again exactly
q words further or q words before: a block of a run at least as long as its
period has no nearer occurrence.  So each such block asks for its occurrences
in the windows of 2^k starts on both sides.  Its occurrences are a range of
the suffix array, and a wavelet matrix over the array's positions gives the
range's successor of any place.  The occurrences that start in a window are one
arithmetic progression, whose difference is the candidate period.  Candidates
are extended both ways by comparing ranks, level by level.

A run holds some four words twice, so documents without such a repeat (found by
64-bit hashes, which can only keep too many) take no part in the ranking.

A batch is cut into slices of bounded size; a longer document is a slice of its
own, with memory in proportion to its words times the logarithm of their number.

Defined results: a null or empty text, or one of white space, has no words, no
runs and an empty collapsed text; repeated rows give repeated rows; null ids
are kept; an empty table gives an empty result; columns beyond the id and the
text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_POWER = 6, 4
SLICE_BYTES = 4_000_000


class WaveletMatrix:
    """Range successor over a sequence of numbers, for many queries at once."""

    def __init__(self, values: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int64)]))
            one = one.astype(bool)
            values = np.concatenate([values[~one], values[one]])
        self.n = len(values)

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value >= least within [lo, hi); -1 where there is none."""
        below = self._less(lo, hi, least)
        found = np.flatnonzero(below < hi - lo)
        out = np.full(len(lo), -1, np.int64)
        out[found] = self._nth(lo[found], hi[found], below[found])
        return out

    def _less(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        less = np.where(bound >> self.bits > 0, hi - lo, 0)
        lo, hi = lo.copy(), np.where(bound >> self.bits > 0, lo, hi)
        bound = np.maximum(bound, 0)
        for level, ones in enumerate(self.ones):
            zeros = self.n - ones[-1]
            up = (bound >> (self.bits - 1 - level)) & 1 == 1
            one_lo, one_hi = ones[lo], ones[hi]
            less += np.where(up, (hi - lo) - (one_hi - one_lo), 0)
            lo = np.where(up, zeros + one_lo, lo - one_lo)
            hi = np.where(up, zeros + one_hi, hi - one_hi)
        return less

    def _nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        value = np.zeros(len(lo), np.int64)
        for ones in self.ones:
            zeros = self.n - ones[-1]
            one_lo, one_hi = ones[lo], ones[hi]
            plain = (hi - lo) - (one_hi - one_lo)
            up = n >= plain
            value = value * 2 + up
            n = np.where(up, n - plain, n)
            lo = np.where(up, zeros + one_lo, lo - one_lo)
            hi = np.where(up, zeros + one_hi, hi - one_hi)
        return value


def _rank_levels(symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the blocks of 2^k words at each place, level by level, and the places in the last level's order.

    `symbol` tells documents apart; a block that would leave its document has a rank of its own.
    """
    n = len(symbol)
    order = np.argsort(symbol, kind="stable")
    first = np.concatenate([[True], symbol[order][1:] != symbol[order][:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, size = [rank.astype(np.int32)], 1
    # no block longer than the longest period's next power of two is asked for
    most = int((end - begin).max()) // LEAST_POWER
    while size < most or size < 2:
        shared = np.bincount(rank, minlength=n) > 1
        places = order[shared[rank[order]]]
        if not len(places):
            break
        ahead = places + size
        inside = ahead < end[places]
        following = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(rank[places] * (n + 1) + following, kind="stable")
        places, following = places[by], following[by]
        old = rank[places]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(places))
        offset = at - np.maximum.accumulate(np.where(group, at, 0))
        fresh = group | np.concatenate([[True], following[1:] != following[:-1]])
        head = np.maximum.accumulate(np.where(fresh, at, 0))
        order[old + offset] = places
        rank = rank.copy()
        rank[places] = old + offset[head]
        levels.append(rank.astype(np.int32))
        size *= 2
    return levels, order


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """How many words from a and b on (step 1) or before them (step -1) are equal, within the document."""
    reach = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        going = np.arange(len(a))
        while len(going):
            if step > 0:
                x, y = a[going] + reach[going], b[going] + reach[going]
                fits = y + size <= end[going]
            else:
                x, y = a[going] - reach[going] - size, b[going] - reach[going] - size
                fits = x >= begin[going]
            fits[fits] = rank[x[fits]] == rank[y[fits]]
            going = going[fits]
            reach[going] += size
            if k + 1 < len(levels):
                break  # twice the same block would have been a match of the level above
    return reach


def find_runs(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period), sorted, of documents that stand one after the other."""
    total = np.zeros((0, 4), np.int64)
    if not len(symbols):
        return total
    stop = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    begin, end = (stop - lengths)[doc], stop[doc]
    symbol = doc * (int(symbols.max()) + 1) + symbols
    levels, order = _rank_levels(symbol, begin, end)
    n = len(symbol)
    if len(levels) < 2:
        return total
    # only places whose two words occur elsewhere too can be answers
    shared = np.bincount(levels[1], minlength=n) > 1
    kept = shared[levels[1][order]]
    wavelet = WaveletMatrix(order[kept].astype(np.int64), n)
    before = np.concatenate([[0], np.cumsum(kept)])
    found = []
    for k in range(1, len(levels)):
        size, rank = 1 << k, levels[k]
        count = np.bincount(rank, minlength=n)
        place = np.flatnonzero(((np.arange(n) - begin) % size == 0) & (count[rank] > 1))
        if not len(place):
            break
        lo, hi = before[rank[place]], before[rank[place] + count[rank[place]]]
        right = wavelet.successor(lo, hi, place + 1)
        ahead = (right > place) & (right <= place + size)
        left = wavelet.successor(lo, hi, np.maximum(place - size, 0))
        behind = np.flatnonzero(left < place)
        second = wavelet.successor(lo[behind], hi[behind], left[behind] + 1)
        base = np.concatenate([place[ahead], left[behind]])
        period = np.concatenate([right[ahead] - place[ahead], second - left[behind]])
        own = (period <= size) & ((period > size // 2) | (size == 2))
        base, period = base[own], period[own]
        forward = _common(levels, base, base + period, begin[base], end[base], 1)
        backward = _common(levels, base, base + period, begin[base], end[base], -1)
        length = backward + period + forward
        run = length >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
        start = (base - backward)[run]
        found.append(np.stack([doc[start], start - begin[start], length[run], period[run]], axis=1))
    return np.unique(np.concatenate([total, *found]), axis=0)


def _repeats_four(words: list[list[bytes]]) -> list[int]:
    """Documents that may hold some four words twice."""
    lengths = np.array([len(w) for w in words], np.int64)
    value = np.fromiter((hash(w) for own in words for w in own), np.int64, int(lengths.sum())).view(np.uint64)
    if len(value) < 4:
        return []
    doc = np.repeat(np.arange(len(words)), lengths)
    mixed = doc[3:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(4):
        mixed = (mixed ^ value[k : len(value) - 3 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
    inside = doc[3:] == doc[:-3]
    mixed, doc = mixed[inside], doc[3:][inside]
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(doc[np.isin(mixed, twice)]).tolist()


def document_runs(words: list[list[bytes]]) -> list[np.ndarray]:
    """Rows (start, length, period) of each document, by start, then period."""
    runs = [np.zeros((0, 3), np.int64)] * len(words)
    some = _repeats_four(words)
    if not some:
        return runs
    numbers: dict[bytes, int] = {}
    symbols = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for i in some for w in words[i]), np.int64, sum(len(words[i]) for i in some)
    )
    found = find_runs(symbols, np.array([len(words[i]) for i in some], np.int64))
    for k, own in zip(*np.unique(found[:, 0], return_index=True), strict=True):
        runs[some[k]] = found[own : own + np.count_nonzero(found[:, 0] == k), 1:]
    return runs


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, joined by blanks, without those that a run holds after its first period."""
    if len(runs):
        start, length, period = runs.T
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
    return b" ".join(words)


def _slices(texts: list[bytes]):
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    yield lo, len(texts)


def periodic_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period), collapsed text.

    Words are parted by blanks, tabs, line feeds, vertical tabs, form feeds and
    carriage returns.  No shuffle.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def scan(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        names = ["id", "n_words", "runs", "collapsed"]
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for lo, hi in _slices(texts):
                words = [t.split() for t in texts[lo:hi]]
                runs = document_runs(words)
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, hi - lo),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), fields).cast(kind),
                        pa.array([collapse(w, r) for w, r in zip(words, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names,
                )

    return rows.mapInArrow(
        scan,
        f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    ).withColumnRenamed("id", id_column)


def with_planted_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and text, with a periodic end in a tenth of the texts, chosen and shaped by the crc32 of the id.

    Texts of null ids, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(id_column).cast("string").cast("binary"))
    space = r"[\x20\x09-\x0D]+"
    chosen = documents.select(
        F.col(id_column).alias("id"),
        F.col(text_column).alias("text"),
        F.floor(h / 10).alias("g"),
        F.when(h % 10 == 0, F.split(F.regexp_replace(text_column, f"^{space}|{space}$", ""), space)).alias("w"),
    )
    n = F.size("w")
    placed = chosen.select("*", F.pmod("g", n).cast("int").alias("a"), n.alias("n"))
    p = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int")
    shaped = placed.select("*", p.alias("p"))
    length = F.col("n") - F.col("a")
    whole = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(length / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(whole, F.lit(1), length))
    has_words = F.get("w", F.lit(0)) != ""
    return shaped.select(
        F.col("id").alias(id_column), F.when(has_words, F.array_join(words, " ")).otherwise(F.col("text")).alias(text_column)
    )
