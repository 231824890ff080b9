"""Spelling variants: words one edit apart, and the frequent form each rare one belongs to.

Letters of a word, numbered by occurrence (the second e is another element than the first), are a set, or a binary vector.
One inserted or deleted letter changes one element, a replaced one two: near words have Hamming distance at most EDITS.
PartEnum signatures make that an exact equality join. Elements are dealt to FIRST first-level parts of SECOND
second-level parts each. Two vectors within EDITS agree, in some first-level part, on all second-level parts but
floor(EDITS / FIRST); so every choice of parts left out, with the elements in the others, is a signature, and near words have
one in common. Anagrams share all of them and common letters make large buckets, so a bucket is further dealt out by the word's
first three or last three letters, one of which near words (of six letters or more) share; inside a bucket only words
that share a half are compared, and a pair counts in the first signature it shares. Nothing is capped.

Words come from whole texts: maximal runs [A-Za-z\\u00C0-\\u00FF]+, A-Z lower-cased. Let h be the unsigned crc32 of
`<doc_id>:<run>`; where 199 divides h, the run loses its code point h % length. Results of `least_letters` code points or more
that come `least_times` or more are words.

Defined results: null and empty texts have no word. A null doc_id is written as nothing (`:run`). Repeated rows count
each. Of near words with equal counts, the smallest in code-point order is the form. Very long runs are words like others.
An empty table gives no rows. Other columns are not read, so their names cannot clash.
"""
from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import code_points, mix, owner, runs, slices
from folioscope.llm.groups import together, whole_groups
from folioscope.llm.store import stored

EDITS = 2
FIRST = 1
SECOND = 4
DROP_ONE_OF = 199
LEAST_LETTERS = 6
LEAST_TIMES = 5
TIMES_MORE = 5
SHORT = 48  # bytes compared as rows of a matrix; longer words one by one
SLICE = 4_000_000

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 leads the bytes of U+00C0 to U+00FF


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def crc32_after(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of spans of `data`, each continuing from its own crc32 `states`."""
    out = states.astype(np.uint32)
    length = ends - starts
    for i in np.flatnonzero(length > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(out[i]))
    table = crc_table()
    order = np.argsort(-length, kind="stable")
    order = order[length[order] <= SHORT]
    state, begin, size = out[order] ^ np.uint32(0xFFFFFFFF), starts[order], length[order]
    for k in range(int(size[0]) if len(size) else 0):
        active = int(np.searchsorted(-size, -k, side="left"))
        state[:active] = table[(state[:active] ^ data[begin[:active] + k]) & np.uint32(255)] ^ (state[:active] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def slice_words(keys: list, data: np.ndarray, offs: np.ndarray, least_letters: int) -> pa.Array:
    """Words of the texts, one entry per occurrence."""
    member = LETTER[data]
    member[1:] |= data[:-1] == 0xC3
    starts, ends = runs(member, offs)
    of = owner(starts, offs)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    prefix = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], dtype=np.uint32)
    h = crc32_after(prefix[of], lower, starts, ends)
    points = np.concatenate(([0], np.cumsum(code_points(data))))
    length = points[ends] - points[starts]
    edited = h % DROP_ONE_OF == 0
    whole = ~edited & (length >= least_letters)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts[whole]] += 1
    np.subtract.at(inside, ends[whole], 1)
    text = lower[np.cumsum(inside[:-1]).astype(bool)]
    bounds = np.concatenate(([0], np.cumsum(ends[whole] - starts[whole]))).astype(np.int64)
    plain = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.tobytes()), pa.py_buffer(text.tobytes()))
    others = []
    for i in np.flatnonzero(edited & (length > least_letters)):
        run, at = lower[starts[i] : ends[i]].tobytes().decode(), int(h[i]) % int(length[i])
        others.append(run[:at] + run[at + 1 :])
    return pa.concat_arrays([plain, pa.array(others, pa.large_string())])


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n (occurrences in all texts)."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, stop, data, offs in slices(batch.column(1), SLICE):
                found = pc.value_counts(slice_words(keys[start:stop], data, offs, least_letters))
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    found = docs.select(F.col(key).cast("string"), text).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


def signature_masks(first: int = FIRST, second: int = SECOND, edits: int = EDITS) -> list[int]:
    """Bit masks of the parts (first-level part after first-level part) that each signature covers."""
    left_out = edits // first
    out = []
    for i in range(first):
        parts = range(i * second, (i + 1) * second)
        out += [sum(1 << p for p in kept) for kept in combinations(parts, second - left_out)]
    return out


def part_hashes(letters: np.ndarray, bounds: np.ndarray, parts: int) -> np.ndarray:
    """words x parts: the hash of the word's elements in each part. `letters` holds a byte per letter."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((letters, of))
    letter, word = letters[order].astype(np.uint64), of[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])
    at = np.flatnonzero(new)
    occurrence = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    element = mix(letter * np.uint64(1 << 32) + occurrence.astype(np.uint64))
    out = np.zeros((n, parts), dtype=np.uint64)
    np.add.at(out, (word, (element % np.uint64(parts)).astype(np.int64)), mix(element + np.uint64(1)))
    return out


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A byte per letter of all words (all are below U+0100), and where each word begins."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def signatures(words: DataFrame) -> DataFrame:
    """bucket, sig (signature number and which end is shared), word, n: two rows for every word and signature."""
    masks = signature_masks()
    parts = FIRST * SECOND

    def run(batches):
        for batch in batches:
            word, n = batch.column(0), batch.column(1)
            letters, bounds = letters_of(word)
            salted = mix(part_hashes(letters, bounds, parts) + np.arange(parts, dtype=np.uint64))
            first, last = np.zeros(len(word), dtype=np.uint64), np.ones(len(word), dtype=np.uint64)
            for k in range(3):
                first = first * np.uint64(512) + letters[bounds[:-1] + k].astype(np.uint64) * np.uint64(2)
                last = last * np.uint64(512) + letters[bounds[1:] - 3 + k].astype(np.uint64) * np.uint64(2)
            for number, mask in enumerate(masks):
                sig = salted[:, [p for p in range(parts) if mask >> p & 1]].sum(axis=1, dtype=np.uint64) + np.uint64(number)
                for end, letter in enumerate((first, last)):
                    key = mix(mix(sig) + mix(letter + np.uint64(end << 60)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.full(len(word), 2 * number + end, dtype=np.int32)), word, n], ["bucket", "sig", "word", "n"]
                    )

    return words.select("word", "n").mapInArrow(run, "bucket long, sig int, word string, n long")


def half_runs(letters: np.ndarray, bounds: np.ndarray, bucket: np.ndarray):
    """Pairs of rows a, b of a bucket that share the first half, or else the last half, of the shorter word (or of one letter less)."""
    size = np.diff(bounds)
    power = np.full(len(letters) + 1, 0x9E3779B97F4A7C15 | 5, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    inverse = np.full(len(letters) + 1, pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    span = lambda lo, hi: mix((sums[hi] - sums[lo]) * inverse[lo])
    rows = np.arange(len(size))
    for last in (False, True):
        keys, at = [], []
        for less in (0, 1):  # a word meets words as long as itself, and one letter longer or shorter
            length = size - less
            half = length // 2
            part = span(bounds[1:] - (length - half), bounds[1:]) if last else span(bounds[:-1], bounds[:-1] + half)
            keys.append(mix(bucket.view(np.uint64) + part + mix(length.astype(np.uint64))))
            at.append(rows)
        key, row = np.concatenate(keys), np.concatenate(at)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        for step in range(1, len(row)):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            yield last, row[same], row[same + step]


def one_edit(matrix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True where words a and b (rows of padded letters) differ by exactly one edit."""
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    left, right = matrix[a], matrix[b]
    differ = left != right
    count = differ.sum(axis=1)
    first = np.argmax(differ, axis=1)
    shifted = (left[:, :-1] != right[:, 1:]) & (np.arange(matrix.shape[1] - 1) >= first[:, None])
    return np.where(size[a] == size[b], count == 1, (size[b] - size[a] == 1) & ~shifted.any(axis=1))


def one_edit_apart(a: bytes, b: bytes) -> bool:
    a, b = sorted((a, b), key=len)
    same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a != b and (a[same + 1 :] == b[same + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[same:] == b[same + 1 :])


def near_pairs(letters: np.ndarray, bounds: np.ndarray, bucket: np.ndarray, sig: np.ndarray, masks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows a, b of a common bucket that are one edit apart; each pair of words in one bucket of all it shares."""
    size = np.diff(bounds)
    width = int(min(max(size.max(initial=1), 2), SHORT)) + 1
    matrix = np.zeros((len(size), width), dtype=np.uint8)
    col = np.arange(len(letters)) - np.repeat(bounds[:-1], size)
    fits = col < width
    matrix[np.repeat(np.arange(len(size)), size)[fits], col[fits]] = letters[fits]
    word = lambda r: letters[bounds[r] : bounds[r + 1]].tobytes()
    found_a, found_b = [], []
    for last, a, b in half_runs(letters, bounds, bucket):
        keep = (bucket[a] == bucket[b]) & (a != b) & (np.abs(size[a] - size[b]) <= 1)
        # ends: the bucket of the last letters leaves pairs with equal first letters to the other bucket
        keep &= (sig[a] % 2 == 0) | (matrix[a, :3] != matrix[b, :3]).any(axis=1)
        a, b = a[keep], b[keep]
        long = np.maximum(size[a], size[b]) >= width
        good = np.zeros(len(a), dtype=bool)
        good[~long] = one_edit(matrix, size, a[~long], b[~long])
        for i in np.flatnonzero(long):
            good[i] = one_edit_apart(word(a[i]), word(b[i]))
        found_a.append(np.minimum(a[good], b[good]))
        found_b.append(np.maximum(a[good], b[good]))
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = np.unique(np.stack((np.concatenate(found_a), np.concatenate(found_b)), axis=1), axis=0)
    used, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    picked = np.concatenate([letters[bounds[r] : bounds[r + 1]] for r in used]) if len(used) else letters[:0]
    parts = part_hashes(picked, np.concatenate(([0], np.cumsum(size[used]))), FIRST * SECOND)
    agree = ((parts[at[:, 0]] == parts[at[:, 1]]) << np.arange(FIRST * SECOND)).sum(axis=1)
    covers = np.stack([(agree & m) == m for m in masks], axis=1) if masks else np.zeros((len(pairs), 0), dtype=bool)
    own = np.argmax(covers, axis=1) == sig[pairs[:, 0]] // 2
    return pairs[own, 0], pairs[own, 1]


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, near (its near word of largest n, smallest on ties), near_n; words without a near word are absent."""
    masks = signature_masks()

    def run(batches):
        for table, _ in whole_groups(batches, "bucket"):
            word = table.column("word").combine_chunks()
            n, bucket, sig = (table.column(c).to_numpy() for c in ("n", "bucket", "sig"))
            letters, bounds = letters_of(word)
            a, b = near_pairs(letters, bounds, bucket, sig, masks)
            rank = np.empty(len(word), dtype=np.int64)
            rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
            one, other = np.concatenate((a, b)), np.concatenate((b, a))
            order = np.lexsort((rank[other], -n[other], one))
            one, other = one[order], other[order]
            head = np.ones(len(one), dtype=bool)
            head[1:] = one[1:] != one[:-1]
            at = np.flatnonzero(head)
            yield pa.RecordBatch.from_arrays(
                [word.take(pa.array(one[at])), pa.array(np.diff(np.append(at, len(one)))), word.take(pa.array(other[at])), pa.array(n[other[at]])],
                ["word", "n_near", "near", "near_n"],
            )

    found = together(signatures(words), "bucket").mapInArrow(run, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.order")).alias("near_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root for word, form: forms followed to the last. Counts grow along a chain, so it has no cycle and is short."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        after = stored(at.join(up, "root", "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "roots")
        at = after.select("word", "root")
        if after.filter("_moved").isEmpty():
            return at


def variants(docs: DataFrame, times_more: int = TIMES_MORE, **choices) -> DataFrame:
    """word, form, root, n, n_near, form_n for all words of `docs`."""
    words = stored(word_counts(docs, **choices), "words")
    near = stored(near_words(words), "near-words")
    is_form = F.col("near_n") >= times_more * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    rows = stored(rows, "word-forms")
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
