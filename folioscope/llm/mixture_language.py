"""Language of a document as a mixture of languages.

Training counts hashed byte n-grams of words per language over all labelled rows (Spark sums them). A word's
likelihood under a language is the mean, over n-gram lengths, of its n-grams' smoothed log-probabilities. For each
document, expectation-maximisation over its words estimates the share of each language; nested sets of the leading
languages are fitted, and the set with the best log-likelihood less 0.5 * penalty * log(words) for each language
is kept. The prediction is the leading language of that set, the score its share.

The model holds ORDERS x BUCKETS counts per language, whatever the corpus: that bound is what the driver collects
and the tasks receive. Null texts and texts without a letter are `und` with score 0 and no languages; words
without a letter are no evidence. Equal texts get equal results, whatever the texts beside them. An empty training table
makes every text `und`, an empty table gives no rows. Columns are kept, but for those named lang_pred, score or languages.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import MULTIPLIER, mix, slices, words

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
UND = "und"
PART_BYTES = 250_000  # searched at a time: some hundred bytes of working memory each
SETTLED = 1e-3

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True
LETTER[0x80:] = True  # words with letters of other alphabets; whether a text has any is asked of its code points


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word with a letter: where its bytes start in `rows`, its text; and per byte of such words, with one
    blank before each word, the bucket of the n-gram of each length that ends there."""
    starts, ends, of = words(data, offs)
    letters = np.concatenate(([0], np.cumsum(LETTER[data])))
    has = letters[ends] > letters[starts]
    starts, ends, of = starts[has], ends[has], of[has]
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)))
    source = np.arange(first[-1]) + np.repeat(starts - first[:-1], lengths)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], lengths)  # byte's place in its word
    buckets = np.empty((len(ORDERS), first[-1]), dtype=np.int32)
    code = np.zeros(first[-1], dtype=np.uint64)
    reach, at = 0, 0
    for n in range(max(ORDERS)):
        byte = np.where(inside >= n, data[np.maximum(source - n, 0)], np.uint8(0x20)).astype(np.uint64)
        code = code * np.uint64(MULTIPLIER) + byte + np.uint64(1)
        reach = n + 1
        if reach in ORDERS:
            buckets[at] = (mix(code) >> np.uint64(48)).astype(np.int32) % BUCKETS + at * BUCKETS
            at += 1
    return first, of, buckets, lengths


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def count_ngrams(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n over all rows with a text and a language; each task sends one row per bucket it met."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for start, stop, data, offs in slices(lowered(batch.column(0)), PART_BYTES):
                first, of, buckets, lengths = features(data, offs)
                names, code = np.unique(langs[start:stop].astype(str), return_inverse=True)
                per_byte = np.repeat(code[of], lengths)
                for i, name in enumerate(names):
                    here = buckets[:, per_byte == i].ravel()
                    size = len(ORDERS) * BUCKETS
                    totals[name] = totals.get(name, np.zeros(size, dtype=np.int64)) + np.bincount(here, minlength=size)
        for name, total in totals.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(total[found])], ["lang", "bucket", "n"])

    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray  # (orders x buckets, languages)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    counts = count_ngrams(labelled, text, lang).toArrow()  # at most languages x orders x buckets rows
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((len(ORDERS), BUCKETS, len(names)), smoothing)
    where = np.array([names.index(x) for x in counts.column("lang").to_pylist()], dtype=np.int64)
    bucket = counts.column("bucket").to_numpy()
    table[bucket // BUCKETS, bucket % BUCKETS, where] += counts.column("n").to_numpy()
    logp = np.log(table / table.sum(axis=1, keepdims=True)).reshape(len(ORDERS) * BUCKETS, len(names))
    return Model(names, (logp / len(ORDERS)).astype(np.float32))


def word_likelihoods(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word with a letter under each language, and the word's text."""
    first, of, buckets, lengths = features(data, offs)
    if not len(of):
        return np.zeros((0, len(model.langs)), dtype=np.float32), of
    per_byte = model.logp[buckets[0]]
    for row in buckets[1:]:
        per_byte += model.logp[row]
    return np.add.reduceat(per_byte, first[:-1], axis=0), of


def expectation_maximisation(likelihood, of_start, counts, share, rounds):
    """Shares per text after at most `rounds` steps from `share`, and the log-likelihood (without row maxima) under them.

    A text stops when its own shares move less than SETTLED, so its result does not depend on the texts beside it.
    """
    texts = np.repeat(np.arange(len(counts)), counts)
    moving = np.ones(len(counts), dtype=bool)
    for _ in range(rounds):
        joint = likelihood * share[texts]
        joint /= np.maximum(joint.sum(axis=1), 1e-30)[:, None]
        new = (np.add.reduceat(joint, of_start, axis=0) / counts[:, None]).astype(np.float32)
        moved = np.abs(new - share).max(axis=1)
        share = np.where(moving[:, None], new, share)
        moving &= moved >= SETTLED
        if not moving.any():
            break
    total = (likelihood * share[texts]).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-30)), of_start)


def mixtures(model: Model, data, offs, penalty: float, rounds: int) -> np.ndarray:
    """Shares (texts x languages) of the chosen language set; all 0 for texts without evidence."""
    out = np.zeros((len(offs) - 1, len(model.langs)), dtype=np.float32)
    logs, of = word_likelihoods(model, data, offs)
    if not len(of) or not model.langs:
        return out
    counts = np.bincount(of, minlength=len(out))
    some = np.flatnonzero(counts)
    counts = counts[some]
    start = np.concatenate(([0], np.cumsum(counts)[:-1]))
    likelihood = np.exp(logs - logs.max(axis=1, keepdims=True))
    langs = len(model.langs)
    full, _ = expectation_maximisation(likelihood, start, counts, np.full((len(some), langs), 1 / langs, dtype=np.float32), rounds)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, best_score = None, None
    growing = np.ones(len(some), dtype=bool)  # larger sets are tried for a text as long as they improve on its smaller ones
    for m in range(1, langs + 1):
        share = np.where(rank < m, full + 1e-6, 0).astype(np.float32)
        share /= share.sum(axis=1, keepdims=True)
        share, fit_ = expectation_maximisation(likelihood, start, counts, share, rounds if m > 1 else 0)
        score = fit_ - 0.5 * penalty * m * np.log(counts + 1)
        if best is None:
            best, best_score = share, score
            continue
        better = growing & (score > best_score)
        best[better], best_score[better] = share[better], score[better]
        if m > 2:
            growing &= better
            if not growing.any():
                break
    out[some] = best
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = 4.0, rounds: int = 8) -> DataFrame:
    """Adds lang_pred, score and languages (language, share of the chosen set) to every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score", "languages")]
    added = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + added

    def predict(batches):
        model_ = shared.value
        for batch in batches:
            column = lowered(batch.column(batch.schema.get_field_index(text)))
            for start, stop, data, offs in slices(column, PART_BYTES):
                preds, scores, sets = [], [], []
                shares = mixtures(model_, data, offs, penalty, rounds)
                ascii_letters = np.concatenate(([0], np.cumsum(LETTER[data] & (data < 0x80))))
                for i, share in enumerate(shares):
                    top = int(share.argmax()) if len(share) else 0
                    if len(share) and share[top] > 0 and ascii_letters[offs[i + 1]] == ascii_letters[offs[i]]:
                        if not any(map(str.isalpha, bytes(data[offs[i] : offs[i + 1]]).decode())):
                            share = np.zeros_like(share)
                    if not len(share) or share[top] <= 0:
                        preds.append(UND), scores.append(0.0), sets.append([])
                        continue
                    preds.append(model_.langs[top]), scores.append(min(1.0, float(share[top])))
                    sets.append([{"lang": model_.langs[j], "share": float(share[j])} for j in np.flatnonzero(share > 0)])
                part = batch.slice(start, stop - start)
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)],
                    [*[f.name for f in kept], "lang_pred", "score", "languages"],
                )

    return docs.select(*[f.name for f in kept]).mapInArrow(predict, schema)
