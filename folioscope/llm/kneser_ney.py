"""Character n-gram model with modified Kneser-Ney smoothing, counted by Spark, stored in sorted hash arrays.

A character is a 12-bit symbol (its code point below 2048, else 2048 plus a hash of it), 0 stands before a text's
start, so an n-gram of up to five symbols is a whole number and its context and suffix are shifts of it. Tasks
count the longest n-grams of all texts per language; Spark adds the counts up, derives continuation counts,
the three discounts of every order and language, interpolated probabilities and backoff weights.

Storage: per order, hashes of (language, n-gram) in ascending order beside log-probabilities and backoff weights.
Every counted n-gram is kept. An order is cut by ranges of the hash into parts of about PART entries, each of which is
collected and broadcast by itself; a task looks up the different n-grams of a group of texts, and holds one part
at a time. So memory does not grow with the model; the parts together do, with the n-grams of the corpus.
"""
from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import mix, slices
from folioscope.llm.store import stored

ORDER = 5
BITS = 12
SYMBOLS = 1 << BITS
NO_LANGUAGE = -1
PART = 1 << 20


def language_key(lang: str | None) -> int:
    return NO_LANGUAGE if lang is None else zlib.crc32(lang.encode())


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """12-bit symbols of several texts, and where each begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offs]
    high = points >= SYMBOLS // 2
    if high.any():
        points = np.where(high, SYMBOLS // 2 + mix(points.astype(np.uint64)) % np.uint64(SYMBOLS // 2), points).astype(np.uint32)
    return points, begins


def grams(points: np.ndarray, begins: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each character the n-gram of `order` symbols that ends there, as a number."""
    out = np.zeros(len(points), dtype=np.uint64)
    wide = points.astype(np.uint64)
    starts = begins[:-1]
    ends = begins[1:]
    for back in range(order):
        part = np.zeros(len(points), dtype=np.uint64)
        part[back:] = wide[: len(wide) - back]
        for j in range(back):  # characters before the start of a text
            at = (starts + j)[starts + j < ends]
            part[at] = 0
        out |= part << np.uint64(BITS * back)
    return out


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.diff(np.concatenate((first, [len(values)])))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", flush: int = 1_000_000) -> DataFrame:
    """lang_key, gram, n of the longest n-grams. A task adds up what it can hold and sends the rest on in parts."""

    def count(batches):
        held: dict[int, list] = {}

        def sent(key):
            keys, n = merged(held.pop(key))
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), key, dtype=np.int64)), pa.array(part.astype(np.int64)), pa.array(n[i : i + 100_000].astype(np.int64))],
                    ["lang_key", "gram", "n"],
                )

        for batch in batches:
            keys = np.array([language_key(x) for x in batch.column(1).to_pylist()], dtype=np.int64)
            for start, stop, data, offs in slices(batch.column(0)):
                points, begins = symbols(data, offs)
                found = grams(points, begins)
                of = np.repeat(keys[start:stop], np.diff(begins))
                for key in np.unique(of):
                    parts = held.setdefault(int(key), [])
                    parts.append(counted(found[of == key]))
                    if sum(len(k) for k, _ in parts) > flush:
                        parts[:] = [merged(parts)]
                        if len(parts[0][0]) > flush:
                            yield from sent(int(key))
        for key in list(held):
            yield from sent(key)

    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    return rows.mapInArrow(count, "lang_key long, gram long, n long").groupBy("lang_key", "gram").agg(F.sum("n").alias("n"))


def discounts(table: DataFrame) -> DataFrame:
    """D1, D2 and D3+ per language from the counts of counts; a half where these are too few to tell."""
    tally = [F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"t{i}") for i in (1, 2, 3, 4)]
    t = table.groupBy("lang_key").agg(*tally)
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))

    def bounded(i: int):
        raw = F.when(F.col(f"t{i}") > 0, i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}"))
        return F.when((raw > 0) & (raw < i), raw).otherwise(0.5).alias(f"d{i}")

    return t.select("lang_key", bounded(1), bounded(2), bounded(3))


def of_count(prefix: str):
    return F.when(F.col("n") == 1, F.col(f"{prefix}1")).when(F.col("n") == 2, F.col(f"{prefix}2")).otherwise(F.col(f"{prefix}3"))


def estimate(counts: DataFrame) -> DataFrame:
    """k, lang_key, gram, logp, backoff, of every order and counted n-gram."""
    tables = {ORDER: stored(counts, "ngrams")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        tables[k] = stored(tables[k + 1].groupBy("lang_key", suffix.alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    lower = None
    entries = []
    weights: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        context = F.shiftright("gram", BITS).alias("context")
        rows = tables[k].join(F.broadcast(discounts(tables[k])), "lang_key").select("lang_key", "gram", context, "n", of_count("d").alias("d"))
        sums = rows.groupBy("lang_key", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
        p = rows.join(sums, ["lang_key", "context"])
        if lower is None:
            below = F.lit(1.0 / SYMBOLS)
        else:
            known = lower.select("lang_key", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            p = p.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(known, ["lang_key", "suffix"])
            below = F.col("below")
        lower = stored(
            p.select("lang_key", "gram", "n", ((F.col("n") - F.col("d")) / F.col("total") + F.col("freed") / F.col("total") * below).alias("p")),
            "ngram-p",
        )
        weights[k] = sums.select("lang_key", F.col("context").alias("gram"), F.log(F.col("freed") / F.col("total")).alias("backoff"))
        entries.append((k, lower))
    out = None
    for k, table in entries:
        if k < ORDER:
            kept = table.join(weights[k + 1], ["lang_key", "gram"], "left")
        else:
            kept = table.withColumn("backoff", F.lit(None).cast("double"))
        kept = kept.select(F.lit(k).alias("k"), "lang_key", "gram", F.log("p").cast("float").alias("logp"), F.coalesce("backoff", F.lit(0.0)).cast("float").alias("backoff"))
        out = kept if out is None else out.unionByName(kept)
    # contexts that are no n-grams themselves: none at all, and a text's start; one row each per language
    for k in range(ORDER):
        contexts = weights[k + 1].filter("gram = 0")
        out = out.unionByName(contexts.select(F.lit(k).alias("k"), "lang_key", "gram", F.lit(0.0).cast("float").alias("logp"), F.col("backoff").cast("float")))
    return out


def entry_hash(lang_key: np.ndarray | int, gram: np.ndarray) -> np.ndarray:
    lang = np.asarray(lang_key, dtype=np.int64).astype(np.uint64)
    return mix(gram ^ mix(lang + np.uint64(0x1234567)))


class Order:
    """Hashes in ascending order with values; a table over the leading bits says where to start."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray, backoff: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.logp, self.backoff = hashes[order], logp[order], backoff[order]
        self.shift = np.uint64(64 - min(22, max(1, len(hashes)).bit_length() + 1))
        heads = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each hash, -1 where there is none."""
        out = np.full(len(wanted), -1, dtype=np.int32)
        if not len(self.hashes):
            return out
        head = (wanted >> self.shift).astype(np.int64)
        at = self.first[head]
        todo = np.flatnonzero(at < self.first[head + 1])
        at = at[todo]
        for _ in range(self.longest):
            if not len(todo):
                break
            hit = self.hashes[at] == wanted[todo]
            out[todo[hit]] = at[hit]
            todo, at = todo[~hit], at[~hit] + 1
            more = at < self.first[head[todo] + 1]
            todo, at = todo[more], at[more]
        return out


def distinct(texts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different longest n-grams of texts given as symbols, begins and language keys, and the language of each."""
    held: dict[int, list] = {}
    for points, begins, lang_keys in texts:
        found, of = grams(points, begins), np.repeat(lang_keys, np.diff(begins))
        for key in np.unique(of):
            held.setdefault(int(key), []).append(counted(found[of == key])[0])
    each = {key: counted(np.concatenate(parts))[0] for key, parts in held.items()}
    if not each:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(list(each.values())), np.repeat(np.array(list(each), dtype=np.int64), [len(x) for x in each.values()])


class Scores:
    """Log-probabilities of the n-grams of some texts."""

    def __init__(self, gram: np.ndarray, lang_key: np.ndarray, logp: np.ndarray):
        self.table = Order(entry_hash(lang_key, gram), logp, logp)

    def log_probabilities(self, points: np.ndarray, begins: np.ndarray, lang_keys: np.ndarray) -> np.ndarray:
        at = self.table.find(entry_hash(np.repeat(lang_keys, np.diff(begins)), grams(points, begins)))
        if (at < 0).any():
            raise ValueError("an n-gram was not looked up")
        return self.table.logp[at]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds a hash: equal ranges of it as a signed number."""
    return ((((hashes ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def part_begins(parts: int) -> list[int]:
    """The smallest signed hash of each part, but for the first."""
    return [(-((-i << 32) // parts) << 32) - (1 << 63) for i in range(1, parts)]


@dataclass
class Model:
    orders: dict[int, list[Broadcast]]
    roots: dict[int, float]

    def find(self, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether order k has each hash, its log-probability and its backoff weight."""
        hit = np.zeros(len(wanted), dtype=bool)
        logp, backoff = np.zeros(len(wanted), dtype=np.float32), np.zeros(len(wanted), dtype=np.float32)
        parts = self.orders[k]
        of = part_of(wanted, len(parts))
        for i in np.unique(of):
            mine = np.flatnonzero(of == i)
            order = Order(*parts[i].value)
            if getattr(parts[i], "_path", None):  # a worker would keep the value; it can be read again
                vars(parts[i]).pop("_value", None)
            at = order.find(wanted[mine])
            mine, at = mine[at >= 0], at[at >= 0]
            hit[mine], logp[mine], backoff[mine] = True, order.logp[at], order.backoff[at]
        return hit, logp, backoff

    def scores(self, texts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Scores:
        """The n-grams of these texts: natural log-probability of the last symbol after the four before it, under the text's language."""
        gram, lang_key = distinct(texts)
        out = np.zeros(len(gram), dtype=np.float32)
        todo = np.arange(len(gram))
        for k in range(ORDER, 0, -1):
            if not len(todo):
                break
            here, lang = gram[todo], lang_key[todo]
            hit, logp, _ = self.find(k, entry_hash(lang, here & np.uint64((1 << BITS * k) - 1)))
            out[todo[hit]] += logp[hit]
            todo, here, lang = todo[~hit], here[~hit], lang[~hit]
            if k > 1:
                context = (here >> np.uint64(BITS)) & np.uint64((1 << BITS * (k - 1)) - 1)
                out[todo] += self.find(k - 1, entry_hash(lang, context))[2]
        out[todo] -= np.log(SYMBOLS)
        if self.roots and len(todo):
            out[todo] += np.array([self.roots.get(int(x), 0.0) for x in lang_key[todo]], dtype=np.float32)
        return Scores(gram, lang_key, out)

    def log_probabilities(self, points: np.ndarray, begins: np.ndarray, lang_keys: np.ndarray) -> np.ndarray:
        return self.scores([(points, begins, lang_keys)]).log_probabilities(points, begins, lang_keys)


def with_hash(entries: DataFrame) -> DataFrame:
    """k, lang_key, hash, logp, backoff of entries with n-grams."""

    def run(batches):
        for batch in batches:
            lang_key, gram = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(entry_hash(lang_key, gram).view(np.int64)), batch.column(3), batch.column(4)],
                ["k", "lang_key", "hash", "logp", "backoff"],
            )

    rows = entries.select("k", "lang_key", "gram", "logp", "backoff")
    return rows.mapInArrow(run, "k int, lang_key long, hash long, logp float, backoff float")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", part: int = PART) -> Model:
    """The model of `docs`; about `part` entries, and one per language, pass the driver at a time."""
    entries = with_hash(estimate(count_grams(docs, text, lang)))
    # sorted, so that the rows of a part are found by the statistics of the files
    table = stored(entries.repartitionByRange("k", "hash").sortWithinPartitions("k", "hash"), "ngram-model")
    sizes = {r.k: r["count"] for r in table.groupBy("k").count().collect()}
    root = table.filter("k = 0").select("lang_key", "backoff").collect()
    orders: dict[int, list[Broadcast]] = {}
    for k in range(1, ORDER + 1):
        parts = max(1, -(-sizes.get(k, 0) // part))
        begins = part_begins(parts)
        orders[k] = []
        for lo, hi in zip([None, *begins], [*begins, None], strict=True):
            rows = table.filter(F.col("k") == k)
            rows = rows if lo is None else rows.filter(F.col("hash") >= lo)
            rows = rows if hi is None else rows.filter(F.col("hash") < hi)
            found = rows.select("hash", "logp", "backoff").toArrow()
            arrays = tuple(found.column(c).to_numpy() for c in ("hash", "logp", "backoff"))
            orders[k].append(docs.sparkSession.sparkContext.broadcast((arrays[0].view(np.uint64), *arrays[1:])))
            del rows, found, arrays
            pa.default_memory_pool().release_unused()
    return Model(orders, {r.lang_key: r.backoff for r in root})
