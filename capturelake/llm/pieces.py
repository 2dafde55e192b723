"""SentencePiece encoding by streaming Viterbi, and decoding.

The trellis has a boundary after each character; an edge is a piece of the
vocabulary.  A boundary is reached by the piece that ends there in the
encoding of the text so far: that whose predecessor boundary's own last piece
forms a valid neighbour with it.  Two pieces are valid neighbours if merging
in score order would never join across their border, which the merge trees of
the two tell.  Every contiguous part of such an encoding is the encoding of
its own text, so each boundary has one back pointer.

Only boundaries within the longest piece's length can still be predecessors.
The back-pointer paths from all of them are followed; the last boundary that
all share is settled and the ids before it are committed, so the window stays
bounded by the longest piece for texts of any length.

For models of merge type with byte fallback and no rewriting of characters.

Defined results: a null or empty text has no ids and decodes to the empty
text; characters outside the vocabulary become their bytes; repeated rows give
repeated rows; null ids are kept; an empty table gives an empty result;
columns beyond the id and the text are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import WordCache, slices

SPACE = "▁"
HUGE_WORD = 4096
#: In place of a piece's id: the start of a text, or a character outside the vocabulary.
NONE = (1 << 31) - 1
_WORDS = re.compile(" *[^ ]+| +")


class PieceModel:
    """Vocabulary, merge order and merge trees of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -sp.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        # between two characters that stand side by side in no piece, all paths meet
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.by_word = not any(p[1] == SPACE != p[0] for p in self.inside)
        self.left: dict[str, list] = {}
        self.right: dict[str, list] = {}
        for piece in self.ids:
            self._grow(piece)
        # every end of a piece: its id where it is itself a piece that merging makes, else -1
        self.ends = {p[k:]: self.ids[p[k:]] if p[k:] in self.left else -1 for p in self.ids for k in range(len(p))}
        self.names = {i: p for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.stretches = WordCache(self.encode_stretches, 800_000)

    def _grow(self, piece: str) -> None:
        """Edges of the piece's merge tree: (part, time made, time used up)."""
        nodes = [(c, 0.0, [(c, 0.0)], [(c, 0.0)]) for c in piece]
        while len(nodes) > 1:
            found = [(self.rank.get(a[0] + b[0], np.inf), k) for k, (a, b) in enumerate(zip(nodes, nodes[1:], strict=False))]
            rank, k = min(found)
            if rank == np.inf:
                return  # no sequence of merges makes it
            a, b = nodes[k], nodes[k + 1]
            time = max(rank + 1, a[1], b[1])
            whole = a[0] + b[0]
            nodes[k : k + 2] = [(whole, time, [(whole, time), *a[2]], [(whole, time), *b[3]])]
        for spine, table in ((nodes[0][2], self.left), (nodes[0][3], self.right)):
            used = [np.inf] + [t for _, t in spine[:-1]]
            table[piece] = [(part, made, end) for (part, made), end in zip(spine, used, strict=True)]

    def neighbours(self, before: int, after: int) -> bool:
        """Whether merging leaves the border between two pieces alone."""
        known = True
        a, b = self.names.get(before, ""), self.names[after]
        for x, made_x, end_x in self.right.get(a, ()):
            for y, made_y, end_y in self.left[b]:
                rank = self.rank.get(x + y)
                # the left of two equal merges goes first
                if rank is not None and (t := max(rank + 1, made_x, made_y)) < end_x and t <= end_y:
                    known = False
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        self.pairs[before << 32 | after] = known
        return known

    def stream(self, parts: Iterator[str]) -> Iterator[list[int]]:
        """Committed ids of a text that comes in parts; its spaces are marked."""
        text, back, last, done = "", [0], [NONE], 0  # the window; each boundary's back pointer and last piece
        step = 4 * self.longest
        for part in parts:
            for at in range(0, len(part), step):
                text += part[at : at + step]
                self._reach(text, back, last, done)
                if len(text) > 2 * step:
                    settled = self._meet(back, range(len(text) - self.longest, len(text) + 1))
                    if settled > done:
                        yield self._ids(text, back, last, done, settled)
                        # boundaries before the settled one are no predecessors any more
                        text, done = text[settled:], 0
                        back, last = [max(0, b - settled) for b in back[settled:]], last[settled:]
        yield self._ids(text, back, last, done, len(text))

    def _reach(self, text: str, back: list[int], last: list[int], done: int) -> None:
        """Finds the piece that ends the encoding of all text so far, for each new boundary."""
        ends, pairs, longest = self.ends.get, self.pairs.get, self.longest
        for end in range(len(back), len(text) + 1):
            pieces = []
            for begin in range(end - 1, max(done, end - longest) - 1, -1):
                piece = ends(text[begin:end])
                if piece is None:
                    break
                if piece >= 0:
                    pieces.append((begin, piece))
            # the longest first; only a character outside the vocabulary ends no piece
            begin, piece = end - 1, NONE
            for begin, piece in reversed(pieces):
                before = last[begin]
                known = pairs(before << 32 | piece)
                if known is None:
                    known = self.neighbours(before, piece)
                if known:
                    break
            else:
                if text[end - 1] in self.ids:
                    raise ValueError(f"no piece ends the text {text[max(0, end - longest) : end]!r}")
            back.append(begin)
            last.append(piece)

    @staticmethod
    def _meet(back: list[int], ends) -> int:
        """The last boundary on the paths from all of the ends."""
        open_ends = set(ends)
        while len(open_ends) > 1:
            last = max(open_ends)
            open_ends.remove(last)
            open_ends.add(back[last])
        return open_ends.pop()

    def _ids(self, text: str, back: list[int], last: list[int], lo: int, hi: int) -> list[int]:
        out: list[int] = []
        while hi > lo:
            if last[hi] != NONE:
                out.append(last[hi])
            else:
                out.extend(self.bytes[b] for b in reversed(text[back[hi] : hi].encode()))
            hi = back[hi]
        return out[::-1]

    def encode_word(self, word: str) -> bytes:
        """Ids of a marked word as little-endian 32-bit numbers."""
        ids = [i for part in self.stream(iter([word])) for i in part]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_stretches(self, stretches: list[str]) -> list[bytes]:
        """The same for many short ones: in their order, so that a beginning that two share is worked on once."""
        out, before, back, last = [b""] * len(stretches), "", [0], [NONE]
        for k in sorted(range(len(stretches)), key=stretches.__getitem__):
            text = stretches[k]
            if len(text) > 4 * self.longest:
                out[k] = self.encode_word(text)
                continue
            same = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                same += 1
            del back[same + 1 :], last[same + 1 :]
            self._reach(text, back, last, 0)
            ids = self._ids(text, back, last, 0, len(text))
            out[k], before = struct.pack(f"<{len(ids)}I", *ids), text
        return out

    def encode_words(self, words: list[str]) -> Iterator[bytes]:
        """The same for many words, each stretch between meeting places once."""
        inside = self.inside
        split = []
        for word in words:
            if inside.issuperset(map(add, word, word[1:])):
                split.append([word])
                continue
            cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in inside]
            split.append([word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)])
        self.stretches.learn(split)
        known = self.stretches.__getitem__
        for stretches in split:
            yield b"".join(map(known, stretches))

    def words(self, text: str) -> list[str]:
        """Parts of a text between which every path converges; spaces are marked."""
        marked = (" " + text).replace(SPACE, " ") if text else ""
        if not self.by_word:
            return [marked.replace(" ", SPACE)] if marked else []
        return [w.replace(" ", SPACE) for w in _WORDS.findall(marked)]

    def decode(self, ids: list[int]) -> str:
        table = self.text
        out = b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_models: dict[str, tuple[PieceModel, WordCache]] = {}


def load_model(path: str) -> tuple[PieceModel, WordCache]:
    """Model and word memory of this worker; kept from task to task."""
    if path not in _models:
        model = PieceModel(path)
        _models[path] = (model, WordCache(model.encode_words, 1_200_000))
    return _models[path]


def encode_texts(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit numbers."""
    model, cache = load_model(path)
    for lo, hi in slices(texts):
        split = [model.words(t) for t in texts[lo:hi]]
        cache.learn([w for w in words if len(w) <= HUGE_WORD] for words in split)
        for words in split:
            yield b"".join([cache[w] if len(w) <= HUGE_WORD else model.encode_word(w) for w in words])


def encode_documents(
    documents: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, ids (array), decoded text.  No shuffle."""
    return _run(documents, model_path, id_column, text_column, "ids array<int>, decoded string", _whole)


def encode_packed(
    documents: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: id, text (empty for null), ids as little-endian 32-bit numbers, decoded text.  No shuffle."""
    return _run(documents, model_path, id_column, text_column, "text string, ids binary, decoded string", _packed)


def _whole(model: PieceModel, text: str, packed: bytes) -> tuple:
    ids = np.frombuffer(packed, "<u4").tolist()
    return ids, model.decode(ids)


def _packed(model: PieceModel, text: str, packed: bytes) -> tuple:
    return text, packed, model.decode(np.frombuffer(packed, "<u4").tolist())


def _run(documents: DataFrame, path: str, id_column: str, text_column: str, columns: str, make) -> DataFrame:
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def encode(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            model, _ = load_model(path)
            made = [make(model, t, ids) for t, ids in zip(texts, encode_texts(path, texts), strict=True)]
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], ["id", *names])

    known = {"string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [known[c.split()[1]] for c in columns.split(", ")]
    return rows.mapInArrow(encode, f"id {id_type}, {columns}").withColumnRenamed("id", id_column)
