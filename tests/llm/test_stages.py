"""The pipeline's stages and the whole run against plain versions, with columns that clash with inner names."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from capturelake.llm import bitmaps, components, language, ngram_join, queries, shards
from capturelake.llm.shipping import ship_package

BYTES = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use inside, and of columns that they add.
CLASHING = [
    "id", "t", "node", "_id", "_key", "kept", "kept_text", "spans", "score", "lang_pred", "lang_set", "lang_shares", "rejected",
    "text_key", "class_key", "class_id", "n_links", "key", "rank", "row", "k", "touched", "stays", "hit", "c0", "c1", "shard", "slot",
    "_carry0", "id2", "t2", "bucket", "bits", "a.b",
]


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, lang): documents of the given tables with exact and near copies, shared passages, rejects and odd rows."""
    import duckdb

    own = duckdb.sql(
        "SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' WHERE length(text) BETWEEN 300 AND 2500 ORDER BY doc_id LIMIT 140"
    ).fetchall()
    rng = random.Random(9)
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(own)]
    passage = " ".join(rng.choice(rows)[1].split()[:70]) + " " + " ".join(f"w{rng.randint(0, 9**6)}" for _ in range(60))
    for k in range(0, 40, 4):
        rows.append((1000 + k, rows[k][1], rows[k][2]))
        words = rows[k][1].split()
        words[len(words) // 2] = "changed"
        rows.append((2000 + k, " ".join(words), rows[k][2]))
    rows += [(3000 + k, rows[50 + k][1] + " " + passage + " " + rows[70 + k][1], rows[50 + k][2]) for k in range(5)]
    rows += [(4000, "", "en"), (4001, None, None), (4002, "12 345 !!", "en"), (4003, "すべての人間は、生まれながらにして自由であり", None)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en"), (None, "no id, and some words of its own that nobody else has", "en")]
    return rows


def documents(spark, corpus):
    rows = [(k, t, lang, "s", len(t or ""), *[f"{name} {k}" for name in CLASHING]) for k, t, lang in corpus]
    extra = ", ".join(f"`{name}` string" for name in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars int, {extra}").repartition(5)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# language


def plain_mixture(counts, model):
    """The operator's rule for one text, step by step: proportions by EM, then nested sets by penalised likelihood."""
    at = np.flatnonzero(counts)
    weight, likelihood = counts[at].astype(float), model[at, :-1].astype(float)
    languages, total = likelihood.shape[1], counts.sum()

    def em(allowed, rounds):
        share = np.zeros(languages)
        share[allowed] = 1 / len(allowed)
        for _ in range(rounds):
            new = np.zeros(languages)
            for w, p in zip(weight, likelihood, strict=True):
                new += w * p * share / (p @ share)
            share = new / total
        return share, sum(w * np.log(p @ share) for w, p in zip(weight, likelihood, strict=True))

    share, _ = em(list(range(languages)), language.ROUNDS)
    order = sorted(range(languages), key=lambda k: (-share[k], k))
    best = None
    for m in range(languages):
        own, likely = em(order[: m + 1], language.SET_ROUNDS if m else 0)
        value = likely - (m + 1) * 0.5 * np.log(total + 1)
        if best is None or value > best[0]:
            best = (value, own, likely)
    background = sum(w * np.log(p) for w, p in zip(weight, model[at, -1].astype(float), strict=True))
    return best[1], best[2] < background


def test_mixture_against_plain_em(shipped, corpus):
    docs = documents(shipped, corpus)
    names, model = language.fit_on_training(docs)
    texts = [t for _, t, _ in corpus if t][::9]
    texts += [texts[0][:400] + texts[5][:300], "xqzk", "Все люди рождаются", "a", "Kaikki ihmiset syntyvät vapaina"]
    for text, (pred, score, chosen, shares, rejected) in zip(texts, language.infer(texts, names, model), strict=True):
        counts = np.bincount(language.trigram_buckets(text), minlength=language.BUCKETS)
        if not counts.any():
            assert (pred, rejected) == ("und", True)
            continue
        share, reject = plain_mixture(counts, model)
        assert pred in names and pred == names[int(np.argmax(share))] and rejected == reject
        assert np.allclose(score, share.max(), atol=1e-6) and np.allclose([share[names.index(c)] for c in chosen], shares, atol=1e-6)


def test_language_is_learned_for_every_text_with_a_letter(shipped, tmp_path):
    shipped.read.parquet("/root/testdata/sf0.01/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    odd = [(10**6 + k, t, None, "s", 1) for k, t in enumerate(["xqzk", "Все люди", "日本語です", "a", "", None, "1 2"])]
    more = shipped.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars int")
    base = shipped.read.parquet(f"{tmp_path}/documents.parquet")
    base.unionByName(more.select(*[F.col(c).cast(base.schema[c].dataType) for c in base.columns])).write.parquet(f"{tmp_path}/t/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_mixture"](shipped, f"{tmp_path}/t").where("doc_id >= 1000000").collect()}
    learned = {r.lang for r in base.select("lang").distinct().collect()}
    assert [got[10**6 + k].lang_pred in learned for k in range(7)] == [True] * 4 + [False] * 3
    assert [got[10**6 + k].rejected for k in range(7)][1:3] == [True, True]


# near duplicates


@pytest.mark.parametrize("buckets", [2048, 1])
def test_one_of_each_class_stays_whole(shipped, corpus, monkeypatch, buckets):
    """Also where the bitmaps are nearly full and hit almost every row by chance."""
    monkeypatch.setattr(bitmaps, "BITMAP_BUCKETS", buckets)
    more = [] if buckets > 1 else [(10_000 + k, f"short text number {k} of many", "en") for k in range(3000)]
    docs = documents(shipped, corpus + more)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    classes = ngram_join.jaccard_classes(docs).collect()
    first = {}
    for r in classes:
        key = (r.doc_id is None, r.doc_id or 0, bytes(r.text_key))
        first[bytes(r.class_key)] = min(first.get(bytes(r.class_key), key), key)
    want = {(None if none else k, text) for none, k, text in first.values()}
    rows = got.collect()
    assert {(r.doc_id, hashlib.md5((r.text or "").encode()).digest()) for r in rows} == want and len(rows) == len(want)
    whole = set(as_rows(docs))
    assert all(tuple(r) in whole for r in rows)


def test_components_of_hubs_chains_and_loops(shipped):
    rng = random.Random(7)
    names = rng.sample(range(10**6), 2600)
    edges = [(names[0], x) for x in names[1:1500]] + list(zip(names[1500:1700], names[1501:1700], strict=False))
    edges += [(names[1800 + rng.randrange(300)], names[1800 + rng.randrange(300)]) for _ in range(250)] + [(names[2500], names[2500])]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = shipped.createDataFrame(edges * 2, "a long, b long").repartition(5)
    got = {(r.node, r.root) for r in components.connected_components(df).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {(x, find(x)) for x in joined}


# the whole run


def plain_repeats(texts, length=200):
    """Kept bytes of each text."""
    where = {}
    data = [(t or "").encode() for t in texts]
    for k, d in enumerate(data):
        for i in range(len(d) - length + 1):
            where.setdefault(d[i : i + length], []).append((k, i))
    gone = [bytearray(len(d)) for d in data]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return [bytes(b for b, g in zip(d, own, strict=True) if not g) for d, own in zip(data, gone, strict=True)]


def test_stages_against_plain_versions(shipped, corpus, tmp_path):
    docs = documents(shipped, corpus)
    stages = dict(corpus_pipeline.STAGES)
    names, model = language.fit_on_training(docs)

    kept = stages["language"](shipped, docs, "")
    assert kept.columns == docs.columns
    known = lambda t: bool(t) and not language.infer([t], names, model)[0][4]
    assert as_rows(kept) == sorted((r for r in as_rows(docs) if known(r[1])), key=repr)
    kept.write.parquet(f"{tmp_path}/1")

    one = stages["near_duplicates"](shipped, shipped.read.parquet(f"{tmp_path}/1"), "")
    assert one.columns == docs.columns and set(as_rows(one)) <= set(as_rows(kept))
    one.write.parquet(f"{tmp_path}/2")
    ids = {r[0] for r in as_rows(one)}
    assert not ids & {1000 + k for k in range(0, 40, 4)} and not ids & {2000 + k for k in range(0, 40, 4)} and ids >= {0, 4, 8, 3000}

    cut = stages["repeats"](shipped, shipped.read.parquet(f"{tmp_path}/2"), "")
    before = as_rows(one)
    texts = [b.decode("utf-8", "ignore") for b in plain_repeats([r[1] for r in before])]
    want = sorted(((*r[:1], t, *r[2:4], len(t), *r[5:]) for r, t in zip(before, texts, strict=True)), key=repr)
    assert cut.columns == docs.columns and as_rows(cut) == want
    assert any(len(t) < len(r[1]) for r, t in zip(before, texts, strict=True))
    cut.write.parquet(f"{tmp_path}/3")

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTES)
    packed = stages["packing"](shipped, shipped.read.parquet(f"{tmp_path}/3"), "").collect()
    got = sorted(b"".join(bytes(r.ids) for r in sorted((r for r in packed if r.doc_id == k), key=lambda r: r.start)) for k in ids if k is not None)
    ids_of = lambda t: np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert got == sorted(ids_of(t) for r, t in zip(before, texts, strict=True) if r[0] is not None)
    filled = {}
    for r in packed:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_whole_run(shipped, corpus, tmp_path):
    documents(shipped, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(shipped, str(tmp_path))
    by_hand = shipped.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(shipped, by_hand, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        by_hand = shipped.read.parquet(f"{tmp_path}/stage{k}")
    keyed = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert as_rows(out.select(*keyed)) == as_rows(by_hand.select(*keyed)) and out.count() > 100


def test_whole_run_of_an_empty_table(shipped, corpus, tmp_path):
    documents(shipped, corpus).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(shipped, str(tmp_path)).count() == 0


# shards


def test_shards_of_a_table_with_clashing_columns(shipped, corpus, tmp_path):
    documents(shipped, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op3_hypergeometric_shards"](shipped, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((k, len((t or "").encode()) + 1) for k, t, _ in corpus if k is not None)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_shuffle_is_uniform(shipped):
    """How often each row comes to each shard, and each pair to one shard, over many seeds."""
    n, shards_n, seeds = 24, 4, 30
    rows = shipped.range(n).coalesce(1)
    seen, together = np.zeros((n, shards_n)), 0
    for seed in range(seeds):
        own = {r.id: r.shard for r in shards.shuffle_into_shards(rows, shards_n, seed=seed).collect()}
        for k, s in own.items():
            seen[k, s] += 1
        together += own[0] == own[1]
    chi = ((seen - seeds / shards_n) ** 2 / (seeds / shards_n)).sum()
    assert chi < n * (shards_n - 1) + 5 * np.sqrt(2 * n * (shards_n - 1))
    assert abs(together / seeds - 5 / 23) < 0.3


def test_windows_by_strides_equal_plain_windows(spark):
    """Every length of a text and of its last segment, ASCII and not, against window minima taken one by one."""
    from capturelake.llm import winnowing as W

    mixed = "ab\nc日本😀 defé" * 120
    texts = [t[:n] for t in ("".join(chr(97 + (i * i * 7 + i) % 26) for i in range(1100)), mixed, "a" * 1100) for n in (16, 17, 46, 47, 48, 51, 78, 79, 511, 512, 930, 1033)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    places = f"sequence(1, length(text) - {W.GRAM - 1})"
    plain = rows.selectExpr("text", f"transform({places}, i -> shiftright(xxhash64(substring(text, i, {W.GRAM})), {W._BITS})) AS h")
    found = rows.selectExpr("text", f"{W.winnow_sql('text')} AS e")
    for row in plain.join(found, "text").collect():
        wanted = []
        for j in range(max(1, len(row.h) - W.WINDOW + 1)):
            p = min(range(j, min(j + W.WINDOW, len(row.h))), key=lambda p: (row.h[p], -p))
            if not wanted or wanted[-1][1] != p:
                wanted.append((j, p, row.h[p]))
        assert [tuple(x) for x in row.e] == wanted, len(row.text)
    # no doubling over all windows any more
    assert "array(1, 2, 4, 8, 16)" not in W.winnow_sql("text")
