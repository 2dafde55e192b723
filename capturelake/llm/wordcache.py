"""Bounded memory of what a tokenizer makes of a word."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class WordCache(dict):
    """Maps words to values that ``encode_many`` gives for lists of words.

    Holds at most ``limit`` words beyond those of the batch at hand: it starts
    afresh when full, so a worker's memory is bounded whatever it has read.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable], limit: int = 400_000):
        super().__init__()
        self.encode_many = encode_many
        self.limit = limit

    def learn(self, batches: Iterable[list[str]]) -> None:
        wanted: set[str] = set()
        for words in batches:
            wanted.update(words)
        new = wanted.difference(self)
        if len(self) + len(new) > self.limit:
            self.clear()
            new = wanted
        if new:
            words = list(new)
            self.update(zip(words, self.encode_many(words), strict=True))


def slices(texts: list[str], most_chars: int = 4_000_000):
    """Consecutive index ranges whose texts hold about so many characters together."""
    lo = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= most_chars:
            yield lo, i + 1
            lo, chars = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
