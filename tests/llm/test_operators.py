import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from capturelake.llm import archives, language, ngram_join, packing, pieces, shards, suffix_merge, token_counts, winnowing
from capturelake.llm.shipping import ship_package

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "abcdefgh é日🙂\n"


def noise(rng, n, alphabet=ALPHABET):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(4)
    own = ["", None, " ", "a", "<|endoftext|> x", "▁x  ▁", "日本語" * 60, "a" * 700, "é́ x", "Same text.", "Same text."]
    return own + [noise(rng, rng.randint(0, 900)) for _ in range(25)]


@pytest.fixture(scope="module")
def odd(shipped, odd_texts):
    rows = [(k, t, "en", f"clash{k}") for k, t in enumerate(odd_texts)] + [(None, "null id", "en", "n")]
    return shipped.createDataFrame(rows, "doc_id long, text string, lang string, id string").repartition(3)


@pytest.fixture(scope="module")
def empty(shipped):
    return shipped.createDataFrame([], "doc_id long, text string, lang string, id string")


def test_splice_equals_whole(odd_texts):
    tok = token_counts.load_tokenizer(WORDS)
    for text in filter(None, odd_texts):
        want = tok.encode(text, add_special_tokens=False).ids
        assert [i for part in token_counts.splice_encode(tok, text, 40, 4) for i in part] == want


def test_counts(odd, empty, odd_texts):
    tok = token_counts.load_tokenizer(WORDS)
    got = {r.doc_id: r for r in token_counts.token_counts(odd, WORDS, 100, chunk=200, overlap=16).collect()}
    for k, text in enumerate(odd_texts):
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert tuple(got[k])[1:] == (len((text or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty, WORDS, 100).count() == 0


def test_pieces_equal_library(odd_texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t or "" for t in odd_texts]
    model, _ = pieces.load_model(PIECES)
    for text, packed in zip(texts, pieces.encode_texts(PIECES, texts), strict=True):
        ids = np.frombuffer(packed, "<u4").tolist()
        assert ids == sp.encode(text)
        assert model.decode(ids) == sp.decode(ids)


def test_streaming_keeps_a_bounded_window():
    model, _ = pieces.load_model(PIECES)
    text = "▁" + "supercalifragilistic" * 400
    parts = list(model.stream(text[k : k + 7] for k in range(0, len(text), 7)))
    assert len(parts) > 20
    assert [i for p in parts for i in p] == [i for p in model.stream(iter([text])) for i in p]


def test_shared_beginnings_are_worked_on_once(monkeypatch):
    model, reached = pieces.PieceModel(public_tokenizers.path("piece_bpe_32k.model")), []
    reach = model._reach
    monkeypatch.setattr(model, "_reach", lambda text, back, *a: reached.append(len(text) + 1 - len(back)) or reach(text, back, *a))
    words = ["▁interesting", "▁other", "▁interested", "▁interest", "▁Ünter", "a" * 5000, "▁interest"]
    got = model.encode_stretches(words)
    assert sum(reached) < sum(map(len, words)) - 20
    assert got == [model.encode_word(w) for w in words]


def test_piece_queries(odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = pieces.encode_documents(odd, PIECES).collect()
    assert len(rows) == odd.count()
    for r in pieces.encode_packed(odd, PIECES).collect():
        assert r.decoded == r.text.replace("▁", " ") and list(np.frombuffer(r.ids, "<u4")) == sp.encode(r.text)
    assert pieces.encode_packed(empty, PIECES).count() == 0


def test_shards(odd, empty):
    rows = shards.shuffle_into_shards(odd.withColumnRenamed("id", "x"), 8).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(rows) == odd.count()
    assert shards.shuffle_into_shards(empty, 8).count() == 0


def test_shards_hold_the_texts(shipped, monkeypatch):
    from capturelake.llm import queries

    dealt, shuffle = [], shards.shuffle_into_shards
    monkeypatch.setattr(shards, "shuffle_into_shards", lambda *a: dealt.append(shuffle(*a)) or dealt[-1])
    got = queries.QUERIES["op3_hypergeometric_shards"](shipped, "/root/testdata/sf0.001")
    docs = shipped.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert set(docs.columns) < set(dealt[0].columns)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = got.collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in text.items()}
    # the digest is made above both permutations
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("crc32") < plan.index("Window")


def test_matrix_sums_and_large_populations():
    m = shards.communication_matrix([5, 0, 9, 3], [6, 4, 7], 1)
    assert m.sum(axis=0).tolist() == [6, 4, 7] and m.sum(axis=1).tolist() == [5, 0, 9, 3]
    rng = np.random.default_rng(2)
    draws = [shards.draw_hypergeometric(rng, 2 * 10**9, 2 * 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(draws) - 500) < 4 and 12 < np.std(draws) < 20


def test_archives(shipped):
    pages = shipped.createDataFrame(
        [(3, "u", "x" * 50), (1, "u", "x" * 50), (2, None, None), (4, "a b\n", ""), (1, "v", "x" * 50), (None, "n", "é" * 900)],
        "page_id long, url string, html string",
    )
    from capturelake.session import work_dir

    def read(df):
        folder = work_dir(shipped, "t")
        return archives.read_archives(shipped, folder, archives.write_archives(archives.decide(df), folder)).collect()

    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in read(pages))
    assert got == [
        (0, "response", 0, 1800), (1, "response", 0, 50), (1, "revisit", 1, 50), (2, "response", 0, 0),
        (3, "revisit", 1, 50), (4, "revisit", 2, 0),
    ]
    assert read(pages.limit(0)) == []


def test_archive_round_trip():
    records = [archives.make_record(k, f"http://x/{k}", noise(random.Random(k), 400).encode(), "00" * 20, None) for k in range(200)]
    content = archives.make_archive(records)
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(archives.read_archive(content)) == records


def plain_repeats(texts):
    seen = {}
    for t in texts:
        for s in range(len(t) - 199):
            seen[t[s : s + 200]] = seen.get(t[s : s + 200], 0) + 1
    return [suffix_merge.union_spans([(s, s + 200) for s in range(len(t) - 199) if seen[t[s : s + 200]] > 1]) for t in texts]


@pytest.mark.parametrize("class_rows", [20_000, 3])
def test_repeats(shipped, empty, odd_texts, class_rows, monkeypatch):
    monkeypatch.setattr(suffix_merge, "CLASS_ROWS", class_rows)
    rng = random.Random(8)
    passage, base = noise(rng, 260), noise(rng, 1800)
    texts = [*odd_texts]
    texts += [noise(rng, rng.randint(0, 200)) + passage[rng.randint(0, 20) :] + noise(rng, 90) for _ in range(12)]
    texts += [base[:k] + "#" + base[k + 1 :] for k in (5, 300, 310, 900, 1700)] + [base[100:420] * 2, base]
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_merge.remove_repeats(df).collect()}
    assert [got[k] for k in range(len(texts))] == plain_repeats([(t or "").encode() for t in texts])
    assert suffix_merge.remove_repeats(empty).count() == 0


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    rows = sorted((noise(rng, rng.randint(0, 12), "ab").encode(), b"p") for _ in range(200))
    runs = [suffix_merge.front_code(rows[k::5]) for k in range(5)]
    merged = list(suffix_merge.merge_runs(runs))
    assert [r[1] for r in merged] == [r[0] for r in rows]
    for before, (shared, key, _) in zip(merged, merged[1:], strict=False):
        assert shared == suffix_merge.common_prefix(before[1], key)


def test_packing(odd, empty, odd_texts):
    tok = token_counts.load_tokenizer(BYTES)
    rows = packing.pack_sequences(odd, BYTES, window=64).collect()
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in placed.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))]
        assert sum(n for _, n in spans) <= 64
    for k, text in enumerate(odd_texts):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == k)
        want = [(s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for s in range(0, len(ids), 64)]
        assert own == want
    assert packing.pack_sequences(empty, BYTES).count() == 0


def test_packing_gives_the_ids(odd, odd_texts, monkeypatch):
    monkeypatch.setattr(packing, "MOST_BYTES", 500)
    tok = token_counts.load_tokenizer(BYTES)
    rows = packing.pack_sequences(odd, BYTES, window=64).collect()
    for k, text in enumerate(odd_texts):
        own = sorted((r.start, bytes(r.ids)) for r in rows if r.doc_id == k)
        assert np.frombuffer(b"".join(ids for _, ids in own), "<u4").tolist() == tok.encode(
            text or "", add_special_tokens=False
        ).ids + [1]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in rows)


def test_packing_wastes_little():
    rng = np.random.default_rng(3)
    histogram = np.bincount(rng.integers(1, 128, 5000), minlength=129)
    plan = packing.pack_histogram(histogram, 128)
    used = np.zeros(129, np.int64)
    for lengths, times in plan:
        for v in lengths:
            used[v] += times
    assert (used == histogram).all()
    assert sum(t for _, t in plan) * 128 * 0.97 < (histogram * np.arange(129)).sum()


def test_language(shipped, empty):
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, model = language.fit_on_training(docs)
    rows = language.identify(docs.where(language.held_out()), names, model).collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    odd = shipped.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !?", "c")], "doc_id long, text string, score string")
    assert {(r.lang_pred, r.score) for r in language.identify(odd, names, model).collect()} == {("und", 0.0)}
    text = {r.lang: r.text for r in docs.where("lang in ('de', 'fr') and n_chars > 2000").collect()}
    mixed = language.infer([text["de"][:900] + " " + text["fr"][:600]], names, model)[0]
    assert mixed[0] == "de" and set(mixed[2]) == {"de", "fr"} and abs(mixed[1] - 0.6) < 0.1
    assert language.fit_on_training(empty)[0] == []
    assert language.infer(["abc"], [], model) == [("und", 0.0, [], [], True)]


def test_language_set_has_no_cap():
    names = [f"l{k}" for k in range(7)]
    texts = [noise(random.Random(k), 3000, "".join(chr(0x4E00 + 40 * k + j) for j in range(12))) for k in range(7)]
    counts = np.stack([np.bincount(language.trigram_buckets(t), minlength=language.BUCKETS) for t in texts], axis=1) + 0.5
    model = np.concatenate([counts / counts.sum(axis=0), np.full((language.BUCKETS, 1), 1 / language.BUCKETS)], axis=1)
    answers = language.infer(["".join(t[:600] for t in texts[:6]), texts[2][:600]], names, model)
    assert set(answers[0][2]) == set(names[:6]) and abs(answers[0][1] - 1 / 6) < 0.03
    assert answers[1][0] == "l2" and answers[1][2] == ["l2"]


def test_language_stage_rejects_unknown_languages(shipped):
    import corpus_pipeline

    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(5)
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "すべての人間は、生まれながらにして自由であり",
        "#### 123 --- x 4567 ===",
        noise(rng, 300, "abcdefghijklmnopqrstuvwxyz "),
    ]
    clean = [" ".join(r.text.split()[:4]) for r in docs.where("n_chars > 100").orderBy("doc_id").limit(40).collect()]
    # without a language nothing is learned from them
    rows = [(10**9 + k, t, None, "planted", len(t)) for k, t in enumerate(strange + clean)]
    planted = docs.unionByName(shipped.createDataFrame(rows, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.known_language(shipped, planted, "").select("doc_id").collect()}
    assert {i for i, *_ in rows} & kept == {i for i, *_ in rows[len(strange) :]}
    assert len(kept) == docs.count() + len(clean)


def test_winnowing(odd, empty, odd_texts):
    import xxhash

    def gram(t):
        v = xxhash.xxh64(t.encode(), seed=42).intdigest()
        return (v - (1 << 64) if v >> 63 else v) >> 9

    def plain(t):
        if len(t) < 16:
            return [(0, gram(t))] if t else []
        h = [gram(t[i : i + 16]) for i in range(len(t) - 15)]
        out = []
        for s in range(max(1, len(h) - 31)):
            place = max(j for j in range(s, min(len(h), s + 32)) if h[j] == min(h[s : s + 32]))
            if not out or out[-1] != (place, h[place]):
                out.append((place, h[place]))
        return out

    def digest(e):
        return hashlib.md5(",".join(f"{p}:{h}" for p, h in e).encode()).hexdigest()

    got = {r.doc_id: r for r in winnowing.fingerprint_edits(odd).collect()}
    texts = [t or "" for t in odd_texts]
    for k in range(1, len(texts)):
        half = len(texts[k]) // 2
        edited = texts[k][: len(texts[k]) - half] + texts[k - 1][:half]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[k].fingerprint, got[k].edited_fingerprint) == (digest(plain(texts[k])), digest(plain(edited)))
    assert winnowing.fingerprint_edits(empty).count() == 0


def test_jaccard(shipped, odd, empty):
    rng = random.Random(6)
    base = [noise(rng, rng.randint(2, 9), "abcdefg") for _ in range(150)]
    texts = ["", None, "one two", "one two", "one  TWO"]
    for _ in range(14):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = noise(rng, 5, "xyz")
        texts += [" ".join(words)] * rng.choice([1, 1, 3])
    df = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(ngram_join.shingles(t or "").tolist()) for t in texts]
    n = len(texts)
    linked = lambda i, j: i != j and ((texts[i] or "") == (texts[j] or "") or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0)
    roots = list(range(n))
    for _ in range(n):
        for i in range(n):
            roots[i] = min([roots[i], *(roots[j] for j in range(n) if linked(i, j))])
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == {i: (roots[i], sum(linked(i, j) for j in range(n))) for i in range(n)}
    assert ngram_join.one_of_each(df).count() == len(set(roots))
    assert ngram_join.jaccard_classes(odd).count() == odd.count()
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_jaccard_links_texts_without_ids(shipped):
    words = [noise(random.Random(k), 6, "abcdefg") for k in range(150)]
    texts = [" ".join(words), " ".join([*words[:-1], "xyz"]), "alone"]
    df = shipped.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert sorted(r.n_links for r in ngram_join.jaccard_classes(df).collect()) == [0, 1, 1]
    assert ngram_join.one_of_each(df).count() == 2


def test_neighbours(shipped):
    from capturelake.llm import neighbours

    df = shipped.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    odd = [(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [float("nan")] * 64), (10**6 + 3, [1.0])]
    same = [(2 * 10**6 + k, [0.5] * 64) for k in range(0, 300)]
    df = df.union(shipped.createDataFrame(odd + same, df.schema)).coalesce(2)
    rows = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    good = [(r.vec_id, np.array(r.embedding, np.float64)) for r in df.where("vec_id < 1000000 or vec_id >= 2000000").collect()]
    ids, v = np.array([i for i, _ in good]), np.stack([x for _, x in good])
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        gap = v - v[ids == q][0]
        score = np.sqrt((gap * gap).sum(1))
        order = [k for k in np.lexsort((ids, score)) if ids[k] != q][:10]
        hits += len({int(ids[k]) for k in order} & {x for x, _ in found[int(q)].values()})
        total += 10
        assert list(found[int(q)]) and len(found[int(q)]) == 10
    assert hits / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
