"""Token counts with overlap resynchronisation of huge documents.

A text longer than a chunk is encoded in overlapping chunks with offsets.  Two
neighbouring encodings are spliced at a boundary of pre-tokens that both show
inside their overlap.  Such a boundary is proof: the splitting pattern reads
from left to right without looking back, so two scans that stand at one place
go on alike, and a special string or a composed character that reached over
the place would leave no boundary there in the chunk that holds it whole.
Where the overlap shows no common boundary it is doubled, at last up to the
splice before, from which one wider chunk is encoded.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
give repeated rows; null ids are kept; an empty table gives an empty result;
columns beyond the id and the text are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import WordCache, slices

CHUNK_CHARS = 65_536
OVERLAP_CHARS = 256


def _boundaries(encoding, base: int) -> list[int]:
    """Where pre-tokens begin, as places in the whole text."""
    places, before = [], object()
    for word, (start, _) in zip(encoding.word_ids, encoding.offsets, strict=True):
        if word is None or word != before:
            places.append(base + start)
        before = word
    return places


def splice_encode(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """Ids of a whole text, in parts, as one encoding of it gives them."""

    def encode(lo: int, hi: int):
        return tokenizer.encode(text[lo:hi], add_special_tokens=False)

    def part(encoding, base: int, lo: int, hi: int) -> list[int]:
        return [t for t, (a, _) in zip(encoding.ids, encoding.offsets, strict=True) if lo <= base + a < hi]

    # [base, end) is the chunk at hand; its tokens count from the proven place `good`
    n, base, good, end = len(text), 0, 0, min(chunk, len(text))
    here = encode(base, end)
    while end < n:
        # the last two pre-tokens of a chunk may go on behind its end
        known = {p for p in _boundaries(here, base)[:-2] if p > good}
        width, common, ahead = overlap, set(), None
        while width < end - good:
            start, stop = end - width, min(n, end - width + max(chunk, 2 * width))
            ahead = encode(start, stop)
            common = known.intersection(_boundaries(ahead, start)[1:])
            if common:
                break
            width *= 2
        if common:
            place = min(common)
            yield part(here, base, good, place)
            base, good, end, here = start, place, stop, ahead
        else:
            base, end = good, min(n, good + 2 * max(chunk, end - good))
            here = encode(base, end)
    yield part(here, base, good, n + 1)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_counters: dict[str, tuple] = {}


def _counter(path: str):
    """Tokenizer and word counts of this worker; kept from task to task."""
    if path not in _counters:
        tok = load_tokenizer(path)
        many = lambda words: map(len, tok.encode_batch_fast(words, add_special_tokens=False))
        _counters[path] = (tok, WordCache(many, 1_200_000))
    return _counters[path]


def count_texts(path: str, texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Tokens of each text for a tokenizer whose pre-tokens never hold a blank.

    Texts up to a chunk are counted word by word (blanks and line ends always
    part pre-tokens), longer ones by splicing.
    """
    tok, cache = _counter(path)
    counts = [0] * len(texts)
    for lo, hi in slices(texts):
        short = [(i, texts[i].replace("\n", " ").split(" ")) for i in range(lo, hi) if len(texts[i]) <= chunk]
        cache.learn(words for _, words in short)
        count = cache.__getitem__
        for i, words in short:
            counts[i] = sum(map(count, words))
    for i, text in enumerate(texts):
        if len(text) > chunk:
            counts[i] = sum(map(len, splice_encode(tok, text, chunk, overlap)))
    return counts


def token_counts(
    documents: DataFrame,
    tokenizer_path: str,
    limit: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit.

    For tokenizer files whose pre-tokenizer drops white space.  Texts stay in
    their task: no shuffle.
    """
    rows = documents.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(count_texts(tokenizer_path, texts, chunk, overlap), pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit")
    )
