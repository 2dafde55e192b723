import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from capturelake.llm import alignment, periodic_runs, queries, toxicity
from capturelake.llm.shipping import ship_package

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, id string, runs int, row long, pairs string, score string"


@pytest.fixture(scope="module")
def shipped(spark):
    ship_package(spark)
    return spark


@pytest.fixture(scope="module")
def empty(shipped):
    return shipped.createDataFrame([], SCHEMA)


def frame(spark, texts):
    """Texts with ids from 0, a repeated row, a null id, and columns whose names clash with inner ones."""
    rows = [(k, t, "en", f"clash{k}", k, k, "p", "mine") for k, t in enumerate(texts)]
    rows += [rows[-1], (None, "null id null id", "en", "n", 0, 0, "p", "mine")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                own = words[i : i + length]
                if not any(own[r:] == own[: length - r] for r in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    words = []
    while rng.random() < 0.85 and len(words) < 250:
        base = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 13))]
        whole = base * rng.randint(1, 7)
        words += whole[: len(whole) - rng.randint(0, len(base) - 1)]
        if rng.random() < 0.3:
            words += [rng.choice("xya") for _ in range(rng.randint(0, 9))]
    return words


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        got = periodic_runs.document_runs([[w.encode() for w in d] for d in docs])
        for words, runs in zip(docs, got, strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words)


def test_range_successor():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletMatrix(values, n)
        lo = rng.integers(0, n, 300)
        hi = np.maximum(lo, rng.integers(0, n + 1, 300))
        least = rng.integers(0, n + 2, 300)
        got = tree.successor(lo, hi, least)
        for a, b, x, y in zip(lo, hi, least, got, strict=True):
            assert y == min([v for v in values[a:b] if v >= x], default=-1)


def test_runs_of_odd_texts(shipped, empty):
    rng = random.Random(3)
    texts = ["", None, " \n ", "a", "a\x0ba\x0ca a\ta\ra", "a a a a a a a", "x \x1c x \x1c x \x1c x \x1c x", "y " * 30_000]
    texts += [" ".join(repetitive(rng)) for _ in range(20)]
    got = periodic_runs.periodic_runs(frame(shipped, texts)).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        text = "null id null id" if row.doc_id is None else texts[row.doc_id]
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        runs = [(0, len(words), 1)] if row.doc_id == 7 else plain_runs(words)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.n_words == len(words) and [tuple(r) for r in row.runs] == runs
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in dropped)
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_op13_query(shipped, tmp_path):
    rng = random.Random(4)
    texts = [None, "", "  ", "one"] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    frame(shipped, texts).where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](shipped, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    planted = 0
    for k, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n, h = len(words), zlib.crc32(str(k).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        milli = 1000 * top[1] // top[2] if runs else None
        lines = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        left = hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
        assert tuple(got[k]) == (k, len(runs), *top, milli, lines, left)
    assert planted > 15


# alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return a, b


def plain_alignment(libraries, text):
    """Groups, and links with their number, of one text, straight from the definitions."""
    a, b = libraries
    if not text:
        return 0, 0, [], collections.Counter()
    byte_of = alignment._byte_characters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [
        bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b
    ]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return 0, 0, [], collections.Counter()
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, x, y = [], 0, 0
    for end in sorted({*ends_a} & {*ends_b}):
        i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((ids_a[x:i], ids_b[y:j]))
        x, y = i, j
    links = collections.Counter()
    for i, (s, e) in enumerate(zip([0, *ends_a], ends_a, strict=False)):
        for j, (t, f) in enumerate(zip([0, *ends_b], ends_b, strict=False)):
            if s < f and t < e:
                links[ids_a[i], ids_b[j]] += 1
    return len(ids_a), len(ids_b), groups, links


ODD = [
    "", None, "a", " ", " a", "a ", "  ", "\n", "a\n b", "a \n b  c ", "<|endoftext|> x <s> </s><unk>", "▁x", "x▁ y", "x  ▁  y",
    "日本語 テスト", "é́ x", "　x　 y", "a  b", "don't  I'll", "\t\tx \t y", "🙂 🙂🙂 x", "\x85 x", "12345 678,90 ...",
    "\r\n x\r\n y", "﻿x", "same words", "same words", "x" * 3000,
]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_brute_force(shipped, empty, libraries, monkeypatch, small):
    if small:  # many ranges and salts
        monkeypatch.setattr(alignment, "RANGE_PAIRS", 20)
        monkeypatch.setattr(alignment, "GROUP_BYTES", 400)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab cdé\n 日🙂 .'") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    rows = alignment.alignment_scores(frame(shipped, texts), BYTES, PIECES).collect()
    every = [*texts, texts[-1], "null id null id"]
    want = [plain_alignment(libraries, t) for t in every]
    count = collections.Counter(pair for *_, links in want for pair in links)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    expected = []
    for k, (n_a, n_b, groups, links) in enumerate(want):
        own = None if k == len(want) - 1 else min(k, len(texts) - 1)
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        expected.append((
            own, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]),
            sum(n * count[p] for p, n in links.items()), hashlib.sha256(written.encode()).hexdigest() if written else "",
        ))
    assert sorted(map(tuple, rows), key=str) == sorted(expected, key=str)
    if not small:
        assert alignment.alignment_scores(empty, BYTES, PIECES).count() == 0


def test_aligned_groups_and_pairs(shipped, libraries):
    got = alignment.align_documents(frame(shipped, ODD), BYTES, PIECES).where("doc_id is not null").collect()
    n_b = libraries[1].get_piece_size()
    for row in got:
        _, _, groups, links = plain_alignment(libraries, ODD[row.doc_id])
        assert row.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        pairs, times = np.frombuffer(row.pairs, "<i8"), np.frombuffer(row.times, "<i4")
        assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == {a * n_b + b: n for (a, b), n in links.items()}


def test_memory_of_parts_starts_afresh(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "MEMORY", 5)
    own = alignment.Aligner(BYTES, PIECES)
    for _ in range(2):
        for text in ["one two three four", "five six seven eight", "nine one two"]:
            (n_a, n_b, *_), = own.documents([text])
            assert (n_a, n_b) == plain_alignment(libraries, text)[:2]


def test_pointer_jumping_on_long_groups():
    # tokens of three bytes against an offset of one byte: one group until the end
    a, b = np.array([3] * 400 + [1]), np.array([1] + [3] * 400)
    label_a, label_b, link_a, link_b = alignment.align_tokens(a, b)
    assert len(set(label_a.tolist()) | set(label_b.tolist())) == 1 and len(link_a) == len(link_b) == 801


# toxicity


def plain_margin(net, text):
    """The network over one text, window by window."""
    words = toxicity.words_of(text)
    rows = []
    for word in words or [None]:
        if word is None:
            rows.append(np.zeros(toxicity.DIMENSIONS))
            continue
        flat, _ = toxicity.word_buckets([word])
        rows.append(net.table[flat].astype(float).sum(axis=0))
    rows += [np.zeros(toxicity.DIMENSIONS)] * toxicity.PAD
    pooled = []
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            kernels = [net.kernel[:, net.columns(width, o)][:, f] for o in range(width)]
            pooled.append(max(sum(rows[i + o] @ k for o, k in enumerate(kernels)) for i in range(len(rows) - toxicity.PAD)))
    return float(np.maximum(np.array(pooled) + net.bias, 0) @ net.dense + net.offset[0])


@pytest.fixture(scope="module")
def labelled():
    """Texts in two languages; a tenth holds one of the bad words of its language, whose ends vary in the second."""
    rng = random.Random(6)
    roots = {"xx": ["ba", "do", "ki", "lu", "me"], "yy": ["zor", "tak", "vim", "pel"]}
    bad = {"xx": lambda: rng.choice(["grmbl", "frrk"]), "yy": lambda: "hrump" + rng.choice(["a", "e", "ik", "os"])}
    rows = []
    for k in range(900):
        lang = "xx" if k % 3 else "yy"
        words = ["".join(rng.choice(roots[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = bad[lang]()
        rows.append((k, " ".join(words), lang, int(toxic)))
    return rows


@pytest.fixture(scope="module")
def network(labelled):
    own = [r for r in labelled if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    return toxicity.train([r[1] for r in own], [r[3] for r in own], [r[2] for r in own], 0.2)


def test_network_against_plain_windows(network, labelled, monkeypatch):
    texts = ["", "!!", "one", *(r[1] for r in labelled[:20])]
    want = [plain_margin(network, t) for t in texts]
    assert np.allclose(toxicity.Scorer(network).margins(texts)[0], want, atol=1e-3)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    monkeypatch.setattr(toxicity, "MEMORY", 40)
    assert np.allclose(toxicity.Scorer(network).margins(texts)[0], want, atol=1e-3)


def test_held_out_toxic_texts_are_found(shipped, labelled):
    documents = shipped.createDataFrame([r[:3] for r in labelled], "doc_id long, text string, lang string")
    labels = shipped.createDataFrame([(r[0], r[3]) for r in labelled], "doc_id long, toxic int")
    net = toxicity.fit_on_labels(documents, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(documents.drop("lang"), net).collect()}
    hit = collections.Counter()
    for k, _, lang, toxic in labelled:
        if zlib.crc32(str(k).encode()) % 3 == 1:
            hit[lang, toxic, got[k].predicted] += 1
        assert 0 <= got[k].score <= 1 and got[k].predicted == (got[k].score >= 0.7)
    for lang in ("xx", "yy"):
        assert hit[lang, 1, 1] >= 0.9 * (hit[lang, 1, 1] + hit[lang, 1, 0])
        assert hit[lang, 0, 0] >= 0.95 * (hit[lang, 0, 1] + hit[lang, 0, 0])


def test_scores_of_odd_texts(shipped, empty, network):
    texts = ["", None, "!? \n", "ba do", "grmbl", "GRMBL!", "grmbl " * 50_000, "x" * 200_000, "ba do"]
    rows = toxicity.score_documents(frame(shipped, texts), network).collect()
    got = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(texts) + 2 and all(not math.isnan(s) for s in got.values())
    assert got[0] == got[1] == got[2] and got[3] == got[8] and got[4] == got[5] > 0.7 > got[3]
    assert toxicity.score_documents(empty, network).count() == 0


def test_odd_labels(shipped, labelled):
    documents = shipped.createDataFrame([r[:3] for r in labelled[:30]], "doc_id long, text string, lang string")
    one_class = shipped.createDataFrame([(k, 0) for k in range(30)], "doc_id long, toxic int")
    assert toxicity.fit_on_labels(documents, one_class) is None
    assert toxicity.fit_on_labels(documents, one_class.where("toxic > 7")) is None
    assert {r.score for r in toxicity.score_documents(documents, None).collect()} == {0.0}
    # null labels and ids, other numbers, repeated labels and rows, null texts and languages
    mixed = shipped.createDataFrame(
        [(k, r[3]) for k, r in enumerate(labelled)] + [(None, 1), (3, None), (4, 5), (5, 1), (5, 1)], "doc_id long, toxic int"
    )
    more = [(r[0], r[1], None if r[0] % 7 == 0 else r[2]) for r in labelled] + [(1, None, "xx"), (2, "ba", "xx"), (None, "ba", "xx")]
    net = toxicity.fit_on_labels(shipped.createDataFrame(more, "doc_id long, text string, lang string"), mixed, class_rows=60)
    assert net is not None and net.languages == ["xx", "yy"]


def test_all_labelled_rows_are_learned_from(shipped):
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("badokilume") + rng.choice("xyzvw") + rng.choice("aeiou") for _ in range(n))
    # more toxic rows than a sample held; those with the largest hashes have a word of their own
    ids = shipped.range(12_000).select("id", F.xxhash64("id").alias("h")).where("id < 8000").collect()
    late = {r["id"] for r in sorted(ids, key=lambda r: r["h"])[6500:]}
    rows = [(k, words(6) + ("" if k >= 8000 else " frrk" if k in late else " grmbl") + " " + words(2), "xx", int(k < 8000)) for k in range(12_000)]
    documents = shipped.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = shipped.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    net = toxicity.fit_on_labels(documents, labels)
    got = toxicity.Scorer(net).scores(["bax dova frrk kiza", "bax dova grmbl kiza", "bax dova kiza", *(words(8) for _ in range(50))], 0.7)
    assert min(got[:2]) >= 0.7 > max(got[2:])
    again = toxicity.fit_on_labels(documents, labels)
    assert np.allclose(again.thresholds, net.thresholds, atol=0.5)


def test_long_texts_are_learned_from(shipped, monkeypatch):
    filler = "ba do " * 4000
    rows = [(k, filler + ("grmbl " if k % 3 == 0 else "ki ") + filler, "xx", int(k % 3 == 0)) for k in range(90)]
    documents = shipped.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = shipped.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    net = toxicity.fit_on_labels(documents, labels)
    assert net is not None
    got = toxicity.Scorer(net).scores(["ba do grmbl", "ba do ki"], 0.7)
    assert got[0] >= 0.7 > got[1]


def test_training_reads_words_in_blocks(labelled, monkeypatch):
    texts, toxic = [r[1] for r in labelled[:200]], np.array([r[3] for r in labelled[:200]])

    def trained():
        net, corpus = toxicity.Network(), toxicity._Corpus(texts)
        toxicity.Trainer(net, 0.2).fit(corpus, toxic, 1)
        return net

    whole = trained()
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(trained().table, whole.table, atol=1e-5)


def test_threshold_of_best_f1():
    margins, toxic = np.array([3.0, 2.0, 1.0, 1.0, 0.0]), np.array([1, 1, 0, 1, 0])
    assert toxicity.best_threshold(margins, toxic, np.ones(5)) == 0.5
    assert toxicity.best_threshold(margins, toxic, np.array([1, 1, 9, 1, 9.0])) == 1.5


def test_op11_query(shipped, labelled, tmp_path):
    shipped.createDataFrame([r[:3] for r in labelled], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    shipped.createDataFrame([(r[0], r[3]) for r in labelled], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.QUERIES["op11_convolutional_toxicity"](shipped, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    third = got.where(F.col("held_out") != (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1))
    assert got.count() == len(labelled) and third.count() == 0
