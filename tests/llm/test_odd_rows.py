"""Repeated rows, null and unusual ids, clashing columns and long texts for the operators of the earlier rounds."""

import datetime
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from capturelake.llm import archives, neighbours, packing, pieces, suffix_merge, token_counts, winnowing
from capturelake.llm.shipping import ship_package

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


def noise(rng, n, alphabet="abcdefgh é日🙂\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def repeated(spark, texts):
    """Each text twice under one id, a third time under a null id."""
    rows = [(k, t, "a", "b") for k, t in enumerate(texts) for _ in range(2)] + [(None, t, "a", "b") for t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens string").repartition(3)


def plain_kept(texts, length=200):
    data = [t.encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(d, gone, strict=True) if not g))
    return out


def test_repeats_of_rows_without_ids(shipped):
    """Each of many null ids keeps its own spans."""
    rng = random.Random(1)
    passage = noise(rng, 250)
    texts = [noise(rng, 100 + 3 * k) + (passage if k % 3 == 0 else "") + noise(rng, 60) for k in range(60)]
    df = shipped.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    got = sorted((r.text, bytes(r.kept)) for r in suffix_merge.remove_repeats(df).collect())
    assert got == sorted(zip(texts, plain_kept(texts), strict=True))


@pytest.mark.parametrize("kind, make", [
    ("date", lambda k: datetime.date(2024, 1, 1 + k)), ("decimal(9,2)", lambda k: __import__("decimal").Decimal(k) / 4), ("string", lambda k: f"it's {k}"),
])
def test_repeats_of_unusual_ids(shipped, kind, make):
    rng = random.Random(2)
    base = noise(rng, 900)
    texts = [base[:300] + "x" + base[301:], base[:600] + "y" + base[601:], noise(rng, 300), base[100:]]
    df = shipped.createDataFrame([(make(k), t) for k, t in enumerate(texts)], f"doc_id {kind}, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_merge.remove_repeats(df).collect()}
    assert got == {make(k): kept for k, kept in enumerate(plain_kept(texts))}


def test_counts_of_repeated_rows_and_long_texts_at_the_default_chunk(shipped):
    rng = random.Random(3)
    tok = token_counts.load_tokenizer(WORDS)
    texts = ["some words", "", noise(rng, 150_000), "word " * 40_000, "x" * 70_000, "<|endoftext|> a " * 9000]
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    rows = token_counts.token_counts(repeated(shipped, texts), WORDS, 2048).collect()
    assert sorted(r.n_tokens for r in rows if r.doc_id is None) == sorted(want)
    assert sorted((r.doc_id, r.n_tokens, r.over_limit) for r in rows if r.doc_id is not None) == sorted((k, n, n > 2048) for k, n in enumerate(want) for _ in range(2))


def test_packing_of_repeated_rows_and_texts_in_parts(shipped, monkeypatch):
    monkeypatch.setattr(packing, "HUGE_TEXT", 200)
    rng = random.Random(4)
    texts = ["", "a few words", " ".join(noise(rng, 7, "abcdefgh") for _ in range(800))]
    rows = packing.pack_sequences(repeated(shipped, texts), BYTES).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    n = [len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert sorted((r.doc_id, r.doc_tokens) for r in rows if r.doc_id is not None and r.start == 0) == sorted((k, m) for k, m in enumerate(n) for _ in range(2))
    assert sum(r.length for r in rows) == 3 * sum(n)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    whole = b"".join(next(packing.id_bytes(BYTES, [t])) for t in texts)
    assert whole == b"".join(np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)


def test_pieces_of_repeated_rows_and_huge_words(shipped, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "HUGE_WORD", 50)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["two words", "", "y" * 900 + " z", "日本語" * 200]
    for text, ids in zip(texts, pieces.encode_texts(PIECES, texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text)
    rows = pieces.encode_documents(repeated(shipped, texts), PIECES).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in rows if r.doc_id is not None) == sorted((k, tuple(sp.encode(t))) for k, t in enumerate(texts) for _ in range(2))


def test_neighbours_of_ties_repeats_and_null_ids(shipped):
    rows = [(k, [float(k // 3), 1.0, 0.5], "x", "y") for k in range(30)] + [(4, [1.0, 1.0, 0.5], "x", "y"), (None, [1.0, 1.0, 0.5], "x", "y")]
    df = shipped.createDataFrame(rows, "vec_id long, embedding array<double>, id string, v string").repartition(3)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {0, 10, 20}
    for q, found in got.items():
        want = sorted((abs(q // 3 - k // 3) * 1.0, k) for k in range(30) if k != q)[:5]
        assert [found[i + 1] for i in range(5)] == [(k, d) for d, k in want]


def test_archives_of_clashing_columns_and_long_pages(shipped, tmp_path):
    pages = [(1, "u1", "x" * 300_000, "r", "d"), (2, "u2", "x" * 300_000, "r", "d"), (3, "u3", None, "r", "d"), (4, "u4", noise(random.Random(5), 50_000), "r", "d")]
    df = shipped.createDataFrame(pages, "page_id long, url string, html string, record_type string, payload_digest string")
    folder = f"{tmp_path}/w"
    manifest = archives.write_archives(archives.decide(df), folder)
    got = {r.page_id: r for r in archives.read_archives(shipped, folder, manifest).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {
        1: ("response", None, 300_000), 2: ("revisit", 1, 300_000), 3: ("response", None, 0), 4: ("response", None, len(pages[3][2].encode())),
    }


def test_likeness_of_edited_and_next_texts(shipped):
    """All columns of the query, with the wrap-around from the last document to the first."""
    rng = random.Random(6)
    texts = ["", "short", *(noise(rng, rng.randint(60, 900)) for _ in range(8)), "same text of the two " * 9, "same text of the two " * 9]
    df = shipped.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r.doc_id: r for r in winnowing.fingerprint_edits(df).collect()}
    for k, text in enumerate(texts):
        following = texts[k - 1] if k else texts[-1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[k].n_chars == len(text) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same = winnowing.fingerprint_edits(shipped.createDataFrame([(1, text), (0, edited)], "doc_id long, text string")).collect()
        near = {r.doc_id: r for r in same}[1].near_next
        assert abs(got[k].near_edited - near) < 1e-12 and 0 <= near <= 1
    assert got[10].near_next == got[11].near_next or got[11].near_next == 1.0
    assert got[11].fingerprint == got[10].fingerprint and got[11].near_next == 1.0


def test_digest_of_packed_pieces(shipped):
    rows = packing.pack_sequences(repeated(shipped, ["a few words"]), BYTES).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)
