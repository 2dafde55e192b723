"""Language of documents as a mixture estimated by expectation-maximisation.

A model holds, for each language, smoothed probabilities of hashed trigrams of
lower-case letters with word borders; all labelled training texts are counted.
A document's trigrams come from a mixture of languages whose proportions
expectation-maximisation estimates.  The languages with the largest
proportions form nested sets; each set's proportions are estimated again, and
the set with the largest likelihood less a penalty of half the logarithm of
the trigram count for each language is taken.  Sets grow until no larger one
can be better, by a bound on the likelihood of all mixtures.

A text is marked as rejected where a background explains its trigrams better
than the chosen set does; its language is told all the same.  The background is
half the trigrams of the training texts with the characters of each text
shuffled, so the letters without their order, and half the uniform law, so
letters that no training text has.

Defined results: `und` with score 0, no set and the mark where the text is
null, empty or without a letter, or nothing could be learned; equal texts get
equal answers; equal proportions go to the language name that sorts first; a
null id is no training row and not held out; an empty table gives an empty
result; columns beyond id, text and language are not read, and language only to
learn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordcache import slices

BUCKETS = 1 << 15
ROUNDS, SET_ROUNDS = 12, 8
SMOOTHING = 0.5
UNKNOWN = "und"
_letters: np.ndarray | None = None


def trigram_buckets(text: str, shuffled: bool = False) -> np.ndarray:
    """Hashed trigrams around every letter, on request of the shuffled text; none where the text has no letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    if shuffled:
        order = np.random.default_rng(len(code)).permutation(len(code))
        code, letter = code[order], letter[order]
    padded = np.zeros(len(code) + 2, np.uint32)
    np.multiply(code, letter, out=padded[1:-1])
    mixed = (padded[:-2] * np.uint32(0x9E3779B1)) ^ (padded[1:-1] * np.uint32(0x85EBCA77)) ^ (
        padded[2:] * np.uint32(0xC2B2AE3D)
    )
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed[letter] >> np.uint32(17)).astype(np.int64)


def learn_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n of columns text and lang; summed in each task before the shuffle.

    Rows whose lang is null count the shuffled texts of all languages.
    """

    def count(batches):
        import pyarrow as pa

        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                for key, shuffled in ((lang, False), (None, True)):
                    own = sums.setdefault(key, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(trigram_buckets(text, shuffled), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"]
            )

    return labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by name, and likelihoods [bucket, language]; the last column is the background's.

    What comes to the driver is bounded by BUCKETS rows a language.
    """
    found = learn_counts(labelled).collect()
    languages = sorted({r["lang"] for r in found if r["lang"] is not None})
    counts = np.full((BUCKETS, len(languages) + 1), SMOOTHING)
    at = {lang: k for k, lang in enumerate([*languages, None])}
    for r in found:
        counts[r["bucket"], at[r["lang"]]] += r["n"]
    model = counts / counts.sum(axis=0)
    model[:, -1] = (model[:, -1] + 1 / BUCKETS) / 2
    return languages, model.astype(np.float32)


def _mix(likelihood, weight, starts, doc, allowed, rounds):
    """Proportions [document, language] within `allowed`, and log likelihoods."""
    total = np.add.reduceat(weight, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        part = likelihood * share[doc]
        part *= (weight / part.sum(axis=1))[:, None]
        share = np.add.reduceat(part, starts, axis=0) / total[:, None]
    return share, np.add.reduceat(weight * np.log((likelihood * share[doc]).sum(axis=1)), starts)


def infer(texts: list[str], languages: list[str], model: np.ndarray) -> list[tuple[str, float, list[str], list[float], bool]]:
    """Language, score, language set, proportions and whether to reject, of each text."""
    answers = [(UNKNOWN, 0.0, [], [], True)] * len(texts)
    if not languages:
        return answers
    for lo, hi in slices(texts, max(100_000, 4_000_000 // len(languages))):
        rows, buckets, weights = [], [], []
        for i in range(lo, hi):
            n = np.bincount(trigram_buckets(texts[i]), minlength=BUCKETS)
            at = np.flatnonzero(n)
            if len(at):
                rows.append(i)
                buckets.append(at)
                weights.append(n[at])
        if not rows:
            continue
        sizes = np.array([len(b) for b in buckets])
        starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(rows)), sizes)
        weight, likelihood = np.concatenate(weights).astype(np.float64), model[np.concatenate(buckets)].astype(np.float64)
        background = np.add.reduceat(weight * np.log(likelihood[:, -1]), starts)
        likelihood = np.ascontiguousarray(likelihood[:, :-1])
        every = np.ones((len(rows), len(languages)))
        share, _ = _mix(likelihood, weight, starts, doc, every, ROUNDS)
        order = np.argsort(-share, axis=1, kind="stable")
        penalty = 0.5 * np.log(np.add.reduceat(weight, starts) + 1)
        best, best_share = np.full(len(rows), -np.inf), share
        best_likely = best
        allowed = np.zeros_like(every)
        # no mixture's log likelihood exceeds that of `share` by more than total x log of its largest gradient / total
        mixed = (likelihood * share[doc]).sum(axis=1)
        gradient = np.add.reduceat(likelihood * (weight / mixed)[:, None], starts, axis=0).max(axis=1)
        total = np.add.reduceat(weight, starts)
        most = np.add.reduceat(weight * np.log(mixed), starts) + total * np.log(gradient / total)
        for m in range(len(languages)):
            if (most - (m + 1) * penalty <= best).all():
                break
            allowed[np.arange(len(rows)), order[:, m]] = 1.0
            own, likely = _mix(likelihood, weight, starts, doc, allowed, SET_ROUNDS if m else 0)
            value = likely - (m + 1) * penalty
            better = value > best
            best = np.where(better, value, best)
            best_likely = np.where(better, likely, best_likely)
            best_share = np.where(better[:, None], own, best_share)
        for k, i in enumerate(rows):
            own = best_share[k]
            chosen = [j for j in np.argsort(-own, kind="stable").tolist() if own[j] > 0]
            answers[i] = (
                languages[chosen[0]],
                float(min(1.0, own[chosen[0]])),
                [languages[j] for j in chosen],
                [float(own[j]) for j in chosen],
                bool(best_likely[k] < background[k]),
            )
    return answers


def identify(
    documents: DataFrame, languages: list[str], model: np.ndarray, text_column: str = "text"
) -> DataFrame:
    """The rows with lang_pred, score, lang_set, lang_shares and rejected; no shuffle.

    A column of the table with one of these names gives way; ``known`` keeps all columns.
    """
    added_names = ["lang_pred", "score", "lang_set", "lang_shares", "rejected"]
    kept = [c for c in documents.columns if c not in added_names]
    names = [f"_{k}" for k in range(len(kept))]
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, kept, strict=True)])
    text_at = kept.index(text_column)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            lang, score, chosen, shares, rejected = zip(*infer(texts, languages, model), strict=True) if texts else ([],) * 5
            added = [
                pa.array(lang, pa.string()),
                pa.array(score, pa.float64()),
                pa.array(chosen, pa.list_(pa.string())),
                pa.array(shares, pa.list_(pa.float64())),
                pa.array(rejected, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*names, *added_names])

    found = rows.mapInArrow(
        predict, f"{schema}, lang_pred string, score double, lang_set array<string>, lang_shares array<double>, rejected boolean"
    )
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)], *added_names)


def held_out(id_column: str = "doc_id"):
    """True for the third of ids that is never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on_training(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang"
) -> tuple[list[str], np.ndarray]:
    text, lang = F.col(text_column), F.col(language_column)
    known = text.isNotNull() & lang.isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)
    return fit(documents.where(known).select(text.alias("text"), lang.alias("lang")))


def known(documents: DataFrame, languages: list[str], model: np.ndarray, text_column: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns as they are, whatever their names."""
    names = documents.columns
    numbered = documents.toDF(*[f"c{k}" for k in range(len(names))])
    kept = identify(numbered, languages, model, f"c{names.index(text_column)}").where(~F.col("rejected"))
    return kept.select(*numbered.columns).toDF(*names)
