"""Toxicity of whole texts by a convolutional classifier of words.

A word's embedding is the sum of the hashed embeddings of the whole word and of
its beginnings, so that inflected and compounded forms share what is learned.
Filters over one, two and three neighbouring words run over the whole text; of
each filter the largest response counts (max pooling), and a dense layer joins
them.  The first component of the embeddings starts from the log odds of the
documents that hold them, all others at random; everything is then trained by
gradients in numpy, with the loss balanced between the classes.

All labelled training rows are learned from, with whole texts.  They are joined
and written once, in parts by hashed id.  Word counts are summed by Spark.  Then,
part after part, each task trains a copy of the network on its rows of the part,
block by block, and the copies are averaged: an embedding over the tasks that
moved it, the rest by rows.  Few rows make one part that is passed EPOCHS times,
many rows PARTS parts, each row at least once.  Sums are of whole numbers, so
they do not depend on the order of tasks.  Only sums come to the driver.

Thresholds are calibrated by language.  The language of a text is the likeliest
under its words (learned from the same rows' languages; never read when
scoring).  On a quarter of the rows, kept out of the training, the threshold
of the best F1 at the labels' own class shares is taken for each language, for
all rows where a language has few toxic ones; margins are counted by steps of
1 / STEPS.  The score is the logistic of the
margin above the threshold, shifted so that the threshold stands at `decide`.

Filters are linear until the pooling, so a word's part in each filter is
computed once and kept in a bounded memory; texts are cut into blocks with
running maxima, so the longest text needs memory for its words only.

Defined results: a text that is null, empty or without a word gets the score of
no response; equal texts get equal scores; without labelled rows of both
classes every score is 0; a null id is no training row and not held out;
repeated labels of one id count once, as toxic if any is; a document's repeated
rows are one training row; an empty table gives an empty result; labels other
than 0 and 1 are no labels; columns beyond id, text, language and label are not
read.
"""

from __future__ import annotations

import copy
import re
import uuid
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.session import work_dir

from .language import held_out
from .wordcache import slices

BUCKETS, DIMENSIONS = 1 << 17, 8
LANGUAGE_BUCKETS = 1 << 14
WIDTHS, FILTERS = (1, 2, 3), 8
#: Shortest and longest beginnings of words.
BEGINNINGS = (3, 9)
EPOCHS, BATCH = 5, 64
#: Row visits that are enough: fewer rows are passed more than once, up to EPOCHS times.
VISITS = 30_000
#: Parts that more than ONE_PART rows are trained in; the last one beside them is for thresholds.
PARTS, ONE_PART = 4, 6000
#: Rows and characters that a task trains on at a time.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4_000_000
#: Steps of a margin, its greatest size, and steps of a parameter, for sums that do not depend on the order.
STEPS, MOST_MARGIN, UNIT = 256, 128, float(1 << 24)
#: Toxic rows of a language that its own threshold needs.
FEW = 8
MEMORY = 400_000
BLOCK = 1 << 17
#: A batch's last words see words that are not there.
PAD = max(WIDTHS) - 1
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets of the words, one after the other, and how many each has."""
    flat, sizes = [], []
    for word in words:
        before = len(flat)
        flat.append(crc32(word.encode("utf-8", "surrogatepass")))
        for k in range(BEGINNINGS[0], min(len(word), BEGINNINGS[1])):
            flat.append(crc32(word[:k].encode("utf-8", "surrogatepass"), k))
        sizes.append(len(flat) - before)
    return np.array(flat, np.int64) & (BUCKETS - 1), np.array(sizes, np.int64)


def _pool(response: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Maxima of [start, start + length) for each document."""
    edges = np.stack([starts, starts + lengths], axis=1).ravel()
    return np.maximum.reduceat(np.concatenate([response, response[:1]]), edges, axis=0)[::2]


class Network:
    """Hashed embeddings, filters, dense layer; and the languages and thresholds learned beside them."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        columns = sum(WIDTHS) * FILTERS
        # one more row, of zeros, for words that are not there
        self.table = rng.normal(0, 0.1, (BUCKETS + 1, DIMENSIONS)).astype(np.float32)
        self.table[-1] = 0
        self.kernel = rng.normal(0, 0.2, (DIMENSIONS, columns)).astype(np.float32)
        self.kernel[0, ::2] += 0.5
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = rng.normal(0, 0.2, len(WIDTHS) * FILTERS).astype(np.float32)
        self.dense[::2] += 0.3
        self.offset = np.zeros(1, np.float32)
        self.languages: list[str] = []
        self.likelihood = np.zeros((LANGUAGE_BUCKETS, 0), np.float32)
        self.name = uuid.uuid4().hex
        #: thresholds by language, and at last that of all rows
        self.thresholds = np.zeros(1)

    @staticmethod
    def columns(width: int, offset: int) -> slice:
        first = (sum(w for w in WIDTHS if w < width) + offset) * FILTERS
        return slice(first, first + FILTERS)

    def embed(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros((0, DIMENSIONS), np.float32)
        return np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes, axis=0)

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.offset[0]


class _Corpus:
    """Texts as numbers of words; document d is sequence[start[d] : start[d] + length[d]], words that are not there behind it."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.rows = [
            np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)] or [0], np.int64) for t in texts
        ]
        made, words = [(np.array([BUCKETS]), np.array([1]))], list(number)
        for lo in range(0, len(words), BLOCK):
            made.append(word_buckets(words[lo : lo + BLOCK]))
        self.flat, self.sizes = (np.concatenate(c) for c in zip(*made, strict=True))
        self.first = np.cumsum(self.sizes) - self.sizes

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[words]
        at = np.repeat(self.first[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.flat[at], sizes


def _bucket_counts(corpus: _Corpus, toxic: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of each class, how many of the chosen documents hold each bucket."""
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for r in np.flatnonzero(chosen):
        flat, _ = corpus.features(np.unique(corpus.rows[r]))
        counts[int(toxic[r])][np.unique(flat)] += 1
    return counts


def _start_from_odds(net: Network, counts: np.ndarray, sizes: list[int]) -> None:
    total = [max(1, n) for n in sizes]
    odds = np.log((counts[1] + 1) / (total[1] + 1)) - np.log((counts[0] + 1) / (total[0] + 1))
    seen = counts.sum(axis=0)
    net.table[:, 0] = np.clip(odds, -4, 4) * seen / (seen + 4) / 2
    net.table[-1] = 0


class Trainer:
    """Trains a network on one block of rows after the other."""

    def __init__(self, net: Network, share: float, squares: np.ndarray | None = None):
        self.net = net
        self.share = share
        self.rng = np.random.default_rng(5)
        self.small = [net.kernel, net.bias, net.dense, net.offset]
        self.first, self.second = [np.zeros_like(p) for p in self.small], [np.zeros_like(p) for p in self.small]
        self.squares = np.zeros(BUCKETS + 1, np.float32) if squares is None else squares.copy()
        self.step = self.rows = 0

    def fit(self, corpus: _Corpus, toxic: np.ndarray, epochs: int) -> None:
        self.rows += len(corpus.rows)
        for _ in range(epochs):
            order = self.rng.permutation(len(corpus.rows))
            for lo in range(0, len(order), BATCH):
                self._batch(corpus, order[lo : lo + BATCH], toxic)

    def _pooled(self, parts: np.ndarray, at: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each document, and its first place; words are read in blocks."""
        n = len(at) - PAD
        pooled = np.full((len(starts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        best = np.zeros(pooled.shape, np.int64)
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            d0, d1 = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
            a = np.maximum(starts[d0:d1], lo) - lo
            b = np.minimum(starts[d0:d1] + lengths[d0:d1], hi) - lo
            held = np.flatnonzero(b > a)
            own, a, b = np.arange(d0, d1)[held], a[held], b[held]
            if not len(own):
                continue
            edges = np.stack([a, b], axis=1).ravel()
            doc = np.maximum(np.searchsorted(a, np.arange(hi - lo), "right") - 1, 0)
            for k, width in enumerate(WIDTHS):
                response = sum(parts[at[lo + o : hi + o], self.net.columns(width, o)] for o in range(width))
                top = _pool(response, a, b - a)
                place = np.where(response == top[doc], np.arange(hi - lo)[:, None], hi - lo)
                first = np.minimum.reduceat(np.concatenate([place, place[:1]]), edges, axis=0)[::2]
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                better = top > pooled[own, columns]
                best[own, columns] = np.where(better, lo + first, best[own, columns])
                pooled[own, columns] = np.maximum(top, pooled[own, columns])
        return pooled, best

    def _batch(self, corpus: _Corpus, batch: np.ndarray, toxic: np.ndarray) -> None:
        net = self.net
        lengths = np.array([len(corpus.rows[r]) for r in batch])
        starts = np.cumsum(lengths + PAD) - (lengths + PAD)
        sequence = np.zeros(int((lengths + PAD).sum()) + PAD, np.int64)
        for r, s in zip(batch, starts, strict=True):
            sequence[s : s + len(corpus.rows[r])] = corpus.rows[r]
        words, at = np.unique(sequence, return_inverse=True)
        flat, sizes = corpus.features(words)
        embedded = net.embed(flat, sizes)
        pooled, best = self._pooled(embedded @ net.kernel, at, starts, lengths)
        hidden = np.maximum(pooled + net.bias, 0)
        chance = 1 / (1 + np.exp(-(hidden @ net.dense + net.offset[0])))
        weight = np.where(toxic[batch] == 1, 0.5 / max(self.share, 1e-6), 0.5 / max(1 - self.share, 1e-6))
        slope = ((chance - toxic[batch]) * weight / len(batch)).astype(np.float32)
        back = slope[:, None] * net.dense * (hidden > 0)
        kernel = np.zeros_like(net.kernel)
        touched, pulled = [], []
        for k, width in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for o in range(width):
                word = at[best[:, own] + o]
                columns = net.columns(width, o)
                kernel[:, columns] = np.einsum("bfd,bf->df", embedded[word], back[:, own])
                touched.append(word.ravel())
                pulled.append((back[:, own, None] * net.kernel.T[columns][None]).reshape(-1, DIMENSIONS))
        by_word = np.zeros((len(words), DIMENSIONS), np.float32)
        np.add.at(by_word, np.concatenate(touched), np.concatenate(pulled))
        self.step += 1
        grads = [kernel + 1e-4 * net.kernel, back.sum(axis=0), hidden.T @ slope, slope.sum(keepdims=True)]
        for p, g, m, v in zip(self.small, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.005 * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-7)
        moved = np.flatnonzero(np.abs(by_word).sum(axis=1) > 0)
        bucket, count = corpus.features(words[moved])
        own, where = np.unique(bucket, return_inverse=True)
        pull = np.zeros((len(own), DIMENSIONS), np.float32)
        np.add.at(pull, where, np.repeat(by_word[moved], count, axis=0))
        self.squares[own] += (pull * pull).sum(axis=1)
        net.table[own] -= 0.05 * pull / np.sqrt(self.squares[own] + 1e-8)[:, None]
        net.table[-1] = 0


def _language_counts(corpus: _Corpus, spoken: list[str | None], names: list[str]) -> np.ndarray:
    """How often the texts of each language have each bucket."""
    counts = np.zeros((LANGUAGE_BUCKETS, len(names)), np.int64)
    for own, row in zip(spoken, corpus.rows, strict=True):
        if own is not None:
            flat, _ = corpus.features(row)
            counts[:, names.index(own)] += np.bincount(flat[flat < BUCKETS] & (LANGUAGE_BUCKETS - 1), minlength=LANGUAGE_BUCKETS)
    return counts


def _learn_languages(net: Network, names: list[str], counts: np.ndarray) -> None:
    net.languages = names
    net.likelihood = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)).astype(np.float32)


def best_threshold(margins: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> float:
    """Where F1 is best, in the middle between two margins."""
    order = np.argsort(-margins, kind="stable")
    m, hit = margins[order], np.cumsum((toxic * weights)[order])
    f1 = 2 * hit / (np.cumsum(weights[order]) + (toxic * weights).sum())
    f1[:-1][m[:-1] == m[1:]] = -1
    k = int(np.argmax(f1))
    return float((m[k] + m[k + 1]) / 2) if k + 1 < len(m) else float(m[k]) - 1.0


def _set_thresholds(net: Network, margins: np.ndarray, spoken: np.ndarray, toxic: np.ndarray, counts: np.ndarray, toxic_share: float) -> None:
    """Thresholds from margins of rows kept out of the training, each with the number of rows that have it."""
    share = counts[toxic == 1].sum() / counts.sum()
    weights = counts * np.where(toxic == 1, toxic_share / share, (1 - toxic_share) / max(1 - share, 1e-9))
    net.thresholds = np.full(len(net.languages) + 1, best_threshold(margins, toxic, weights))
    for k in range(len(net.languages)):
        mine = spoken == k
        if (counts * toxic)[mine].sum() >= FEW and not toxic[mine].all():
            net.thresholds[k] = best_threshold(margins[mine], toxic[mine], weights[mine])


def train(texts: list[str], toxic: list[int], languages: list[str | None], toxic_share: float) -> Network | None:
    """A network for labelled texts at hand; None where a class is missing.  `toxic_share`: of all labelled rows."""
    label = np.array(toxic, np.int64)
    if not label.any() or label.all():
        return None
    net, names = Network(), sorted({x for x in languages if x is not None})
    _learn_languages(net, names, _language_counts(_Corpus(texts), languages, names))
    for_threshold = np.arange(len(label)) % 4 == 3
    if label[for_threshold].sum() < FEW or label[~for_threshold].sum() < FEW:
        for_threshold = np.zeros(len(label), bool)
    fitted, own = _Corpus([t for t, c in zip(texts, for_threshold, strict=True) if not c]), label[~for_threshold]
    _start_from_odds(net, _bucket_counts(fitted, own, np.ones(len(own), bool)), [int((own == k).sum()) for k in (0, 1)])
    Trainer(net, own.mean()).fit(fitted, own, EPOCHS)
    checked = np.flatnonzero(for_threshold) if for_threshold.any() else np.arange(len(label))
    margins, spoken = Scorer(net).margins([texts[i] for i in checked])
    _set_thresholds(net, margins, spoken, label[checked], np.ones(len(checked)), toxic_share)
    return net


class Scorer:
    """Scores texts with a network; remembers each word's part in the filters."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        # row 0 is the word that is not there
        self.parts = np.zeros((1, self.net.kernel.shape[1]), np.float32)
        self.spoken = np.zeros((1, len(self.net.languages)), np.float32)

    def _learn(self, split: list[list[str]]) -> None:
        wanted: set[str] = set()
        for words in split:
            wanted.update(words)
        new = wanted.difference(self.number)
        if len(self.number) + len(new) > MEMORY:
            self._forget()
            new = wanted
        if not new:
            return
        words = list(new)
        flat, sizes = word_buckets(words)
        spoken = np.add.reduceat(self.net.likelihood[flat & (LANGUAGE_BUCKETS - 1)], np.cumsum(sizes) - sizes, axis=0)
        base = len(self.parts)
        self.parts = np.concatenate([self.parts, self.net.embed(flat, sizes) @ self.net.kernel])
        self.spoken = np.concatenate([self.spoken, spoken])
        self.number.update(zip(words, range(base, base + len(words)), strict=True))

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Margin of each text, and its language's place in `languages`; that behind the last for texts without words."""
        margin, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in slices(texts, 1_000_000):
            margin[lo:hi], language[lo:hi] = self._slice([words_of(t) for t in texts[lo:hi]])
        return margin, language

    def _slice(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        net = self.net
        self._learn(split)
        n_words = np.array([len(w) for w in split])
        lengths = np.maximum(n_words, 1)
        starts = np.cumsum(lengths + PAD) - (lengths + PAD)
        n = int((lengths + PAD).sum())
        sequence = np.zeros(n + PAD, np.int64)
        word = np.repeat(starts - (np.cumsum(n_words) - n_words), n_words) + np.arange(int(n_words.sum()))
        sequence[word] = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, len(word))
        pooled = np.full((len(split), len(WIDTHS) * FILTERS), -np.inf, np.float32)
        spoken = np.zeros((len(split), len(net.languages)))
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            d0, d1 = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
            a = np.maximum(starts[d0:d1], lo) - lo
            b = np.minimum(starts[d0:d1] + lengths[d0:d1], hi) - lo
            held = np.flatnonzero(b > a)
            own, a, b = np.arange(d0, d1)[held], a[held], b[held]
            if not len(own):
                continue
            for k, width in enumerate(WIDTHS):
                response = sum(self.parts[sequence[lo + o : hi + o], net.columns(width, o)] for o in range(width))
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[own, columns] = np.maximum(pooled[own, columns], _pool(response, a, b - a))
            sums = np.concatenate([np.zeros((1, spoken.shape[1])), np.cumsum(self.spoken[sequence[lo:hi]], axis=0, dtype=np.float64)])
            spoken[own] += sums[b] - sums[a]
        none = len(net.languages)
        language = np.where(n_words > 0, spoken.argmax(axis=1), none) if none else np.zeros(len(split), np.int64)
        return net.margin(pooled), language

    def scores(self, texts: list[str], decide: float) -> np.ndarray:
        margin, language = self.margins(texts)
        above = margin - self.net.thresholds[language] + np.log(decide / (1 - decide))
        return 1 / (1 + np.exp(-np.clip(above, -500, 500)))


def _blocks(batches, *more: str):
    """Rows of Arrow batches as texts, labels, languages and further numbers, in blocks of a bounded size."""
    rows, chars = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "lang", *more)), strict=True):
            rows.append(row)
            chars += len(row[0])
            if len(rows) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                yield _block(rows)
                rows, chars = [], 0
    if rows:
        yield _block(rows)


def _block(rows: list[tuple]) -> tuple:
    texts, toxic, spoken, *more = zip(*rows, strict=True)
    return texts, np.array(toxic, np.int64), spoken, *(np.array(c, np.int64) for c in more)


def _sum_counts(rows: DataFrame, apart: bool, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts by class, without the rows kept apart for thresholds, and by language, summed by Spark."""

    def count(batches):
        import pyarrow as pa

        classes, languages = np.zeros((2, BUCKETS + 1), np.int64), np.zeros((LANGUAGE_BUCKETS, len(names)), np.int64)
        for texts, toxic, spoken, part in _blocks(batches, "part"):
            corpus = _Corpus(texts)
            languages += _language_counts(corpus, spoken, names)
            classes += _bucket_counts(corpus, toxic, (part >= 0) | (not apart))
        for total, first in ((classes, 0), (languages.T, 2)):
            kind, place = np.nonzero(total)
            arrays = [pa.array(kind + first, pa.int32()), pa.array(place, pa.int32()), pa.array(total[kind, place], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["kind", "place", "n"])

    got = rows.mapInArrow(count, "kind int, place int, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, place, n = (got[c].to_numpy() for c in ("kind", "place", "n"))
    classes, languages = np.zeros((2, BUCKETS + 1), np.int64), np.zeros((LANGUAGE_BUCKETS, len(names)), np.int64)
    own = kind < 2
    classes[kind[own], place[own]] = n[own]
    languages[place[~own], kind[~own] - 2] = n[~own]
    return classes, languages


def _train_part(rows: DataFrame, net: Network, squares: np.ndarray, share: float, epochs: int) -> None:
    """Moves the network by the mean of what the tasks learn, each from its rows."""
    columns = [f"v{i}" for i in range(DIMENSIONS + 1)]

    def learn(batches):
        import pyarrow as pa

        own = copy.deepcopy(net)
        trainer = Trainer(own, share, squares)
        for texts, toxic, _ in _blocks(batches):
            trainer.fit(_Corpus(texts), toxic, epochs)
        table = np.concatenate([own.table - net.table, (trainer.squares - squares)[:, None]], axis=1)
        moved = np.flatnonzero(table.any(axis=1))
        small = _flat(own) - _flat(net)
        small = np.concatenate([small, np.zeros(-len(small) % len(columns))]).reshape(-1, len(columns)) * trainer.rows
        place = np.concatenate([moved, BUCKETS + 1 + np.arange(len(small))])
        weight = np.concatenate([np.ones(len(moved), np.int64), np.full(len(small), trainer.rows)])
        values = np.rint(np.concatenate([table[moved], small]).astype(np.float64) * UNIT).astype(np.int64)
        arrays = [pa.array(place, pa.int32()), pa.array(weight, pa.int64()), *(pa.array(v, pa.int64()) for v in values.T)]
        yield pa.RecordBatch.from_arrays(arrays, ["place", "weight", *columns])

    learned = rows.mapInArrow(learn, f"place int, weight long, {', '.join(f'{c} long' for c in columns)}")
    got = learned.groupBy("place").agg(*[F.sum(c).alias(c) for c in ["weight", *columns]]).where("weight > 0").toArrow()
    place = got["place"].to_numpy()
    mean = np.stack([got[c].to_numpy() for c in columns], axis=1) / (got["weight"].to_numpy()[:, None] * UNIT)
    words = place <= BUCKETS
    net.table[place[words]] += mean[words, :DIMENSIONS].astype(np.float32)
    squares[place[words]] += mean[words, DIMENSIONS].astype(np.float32)
    small = mean[~words][np.argsort(place[~words])].ravel()
    at = 0
    for p in (net.kernel, net.bias, net.dense, net.offset):
        p += small[at : at + p.size].reshape(p.shape).astype(np.float32)
        at += p.size
    net.table[-1] = 0


def _flat(net: Network) -> np.ndarray:
    return np.concatenate([p.ravel() for p in (net.kernel, net.bias, net.dense, net.offset)]).astype(np.float64)


def _calibrate(rows: DataFrame, net: Network, toxic_share: float) -> None:
    """Thresholds from the margins of all given rows, counted by steps."""

    def steps(batches):
        import pyarrow as pa

        scorer = Scorer(net)
        for texts, toxic, _ in _blocks(batches):
            margins, spoken = scorer.margins(texts)
            step = np.floor(np.clip(margins, -MOST_MARGIN, MOST_MARGIN) * STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spoken), pa.array(toxic), pa.array(step)], ["spoken", "toxic", "step"])

    got = rows.mapInArrow(steps, "spoken long, toxic long, step long").groupBy("spoken", "toxic", "step").count().toArrow().sort_by(
        [("step", "descending"), ("toxic", "ascending"), ("spoken", "ascending")]
    )
    margins = (got["step"].to_numpy() + 0.5) / STEPS
    _set_thresholds(net, margins, got["spoken"].to_numpy(), got["toxic"].to_numpy(), got["count"].to_numpy().astype(float), toxic_share)


def fit_on_labels(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    label_column: str = "toxic",
    class_rows: int | None = None,
) -> Network | None:
    """Trains on all labelled documents that are not held out; with `class_rows` on so many labels of each class at most."""
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    if class_rows is not None:
        first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(class_rows) for k in (0, 1)]
        known = first[0].unionByName(first[1])
    texts = documents.where(~held_out(id_column)).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(language_column).alias("lang")
    ).where(F.col("text").isNotNull())
    joined = texts.join(known, "id").groupBy("id", "toxic").agg(F.min(F.struct("text", "lang")).alias("row"))
    n = min(sizes[0], class_rows or sizes[0]) + min(sizes[1], class_rows or sizes[1])
    draw, parts = F.xxhash64("id", F.lit("part")), 1 if n <= ONE_PART else PARTS
    part = F.when(F.pmod(draw, F.lit(4)) == 3, -1).otherwise(F.pmod(F.shiftright(draw, 2), F.lit(parts))).cast("int")
    spark, folder = documents.sparkSession, work_dir(documents.sparkSession, "toxicity")
    joined.select("toxic", "row.text", "row.lang", part.alias("part")).write.partitionBy("part").parquet(folder)
    rows = spark.read.schema("toxic int, text string, lang string, part int").parquet(folder)
    found = rows.groupBy("part", "toxic", "lang").count().collect()

    def size(label: int, keep) -> int:
        return sum(r["count"] for r in found if r["toxic"] == label and keep(r["part"] < 0))

    if not all(size(k, lambda _: True) for k in (0, 1)):
        return None
    apart = all(size(1, lambda c, own=own: c == own) >= FEW for own in (True, False))
    own = [size(k, lambda c: not (c and apart)) for k in (0, 1)]
    net, names = Network(), sorted({r["lang"] for r in found if r["lang"] is not None})
    by_class, by_language = _sum_counts(rows, apart, names)
    _learn_languages(net, names, by_language)
    _start_from_odds(net, by_class, own)
    epochs, squares = min(EPOCHS, max(1, -(-VISITS // sum(own)))), np.zeros(BUCKETS + 1, np.float32)
    for k in sorted({r["part"] for r in found if r["part"] >= 0 or not apart}):
        _train_part(rows.where(F.col("part") == k), net, squares, own[1] / sum(own), epochs)
    _calibrate(rows.where("part < 0") if apart else rows, net, sizes[1] / (sizes[0] + sizes[1]))
    return net


_scorers: dict[str, Scorer] = {}


def load_scorer(net: Network) -> Scorer:
    """The network's scorer of this worker; kept from task to task."""
    if net.name not in _scorers:
        _scorers.clear()
        _scorers[net.name] = Scorer(net)
    return _scorers[net.name]


def score_documents(
    documents: DataFrame, net: Network | None, decide: float = 0.7, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, score, predicted (1 if the score is at least `decide`).  No shuffle."""
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def score(batches):
        import pyarrow as pa

        scorer = load_scorer(net) if net else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = scorer.scores(texts, decide) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores), pa.array((scores >= decide).astype(np.int32))], ["id", "score", "predicted"]
            )

    return rows.mapInArrow(score, f"id {id_type}, score double, predicted int").withColumnRenamed("id", id_column)
