"""Mixing sources to target weights by fixed-length blocks of words.

Each source's documents, one after another, are packed into blocks of `block_words` words. Every output shard
draws how many of its slots each source gets from a multinomial: the whole part of the expected count is fixed
and the rest is drawn, so totals stay near their targets. The j-th slot of a source reads block
permutation(j mod blocks) of epoch j div blocks, where each epoch permutes the source's block numbers by a
keyed Feistel network; slots and blocks are then joined by block number. A block is read at most
`max_repeats` times, so no document exceeds that many times its size.

Packing needs the words before each document in its source. A source is cut into CHUNKS chunks by a hash of
doc_id; sums run within chunks and over the chunk totals, so a source with most rows is spread over many tasks.
Only one row per source (size, weight, target) passes the driver.

Null texts have no words; a null source is a source of its own; repeated rows count each; an empty table gives
an empty result. Columns are kept, but for those named size, sid, begin or _row.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.arrays import mix as mix_bits
from folioscope.llm.arrays import slices, words
from folioscope.llm.store import stored

CHUNKS = 1024
RANGE = 64  # shards summed up together
SLOTS_A_TASK = 32_768


@dataclass(frozen=True)
class Source:
    name: str | None
    sid: int
    size: int
    target: float
    blocks: int


def with_sizes(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Adds size, the number of words, and _row, a number per row; without the text unless it is kept."""
    rest = [f for f in docs.schema if f.name not in (text, "size", "_row", "sid", "begin")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", size bigint" + (f", `{text}` string" if keep_text else "")

    def count(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for start, stop, data, offs in slices(column):
                sizes[start:stop] = np.bincount(words(data, offs)[2], minlength=stop - start)
            names = [f.name for f in rest]
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(sizes)]
            if keep_text:
                names, arrays = [*names, "size", text], [*arrays, column]
            else:
                names = [*names, "size"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    counted = docs.select(*[f.name for f in rest], text).mapInArrow(count, schema)
    return counted.withColumn("_row", F.monotonically_increasing_id())


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, block_words: int = 64) -> list[Source]:
    """Sources by code point, null last, weighted in turn, share all words; a share stops at max_repeats times the
    source's size, and what is left over goes to the others by weight until none is above."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {i: weights[i % len(weights)] for i in range(len(ordered))}
    total, cap = sum(s for _, s in ordered), {i: max_repeats * s for i, (_, s) in enumerate(ordered)}
    open_, left, target = set(weight), float(total), {}
    while open_:
        level = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if cap[i] <= weight[i] * level}
        if not full:
            target |= {i: weight[i] * level for i in open_}
            break
        target |= {i: float(cap[i]) for i in full}
        left -= sum(cap[i] for i in full)
        open_ -= full
    return [Source(name, i, size, target[i], -(-size // block_words)) for i, (name, size) in enumerate(ordered)]


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1, by a four-round Feistel network that walks until it is in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (mix_bits(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 % (1 << 64))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def packed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sid and begin, the words of the source before this document."""
    keyed = rows.join(sources.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.lit(CHUNKS)).cast("int"))
    earlier = W.partitionBy("sid", "_chunk").orderBy("doc_id", "size", "_row").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("sid").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        keyed.groupBy("sid", "_chunk").agg(F.sum("size").alias("_n"))
        .select("sid", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        keyed.withColumn("_in", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(bases, ["sid", "_chunk"])
        .withColumn("begin", F.col("_base") + F.col("_in"))
        .drop("_base", "_in", "_chunk")
    )


def segments(rows: DataFrame, block_words: int) -> DataFrame:
    """A row per document and block it has words in: the first of these words in the document, and how many."""
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    cut = rows.filter("size > 0").select("_row", "sid", "begin", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * block_words, F.col("begin"))
    stop = F.least((F.col("block") + 1) * block_words, F.col("begin") + F.col("size"))
    return cut.select("_row", "sid", "block", (start - F.col("begin")).alias("first_word"), (stop - start).alias("n_words"))


def draws(spark, sources: list[Source], block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Per output shard and source: the number of slots, and the source's slots in earlier shards."""
    slots = [s.target / block_words for s in sources]
    total = int(round(sum(slots)))
    shares = np.array(slots) / max(sum(slots), 1e-9)

    def draw(batches):
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for shard in batch.column(0).to_pylist():
                n = min(shard_slots, total - shard * shard_slots)
                expected = shares * n
                fixed = np.floor(expected).astype(np.int64)
                rest = expected - fixed
                left = n - int(fixed.sum())
                if left > 0:
                    p = rest / rest.sum() if rest.sum() > 0 else shares
                    fixed = fixed + np.random.default_rng([seed, shard]).multinomial(left, p)
                for sid in np.flatnonzero(fixed):
                    out[0].append(shard), out[1].append(int(sid)), out[2].append(int(fixed[sid]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64())], ["shard", "sid", "slots"])

    shards = spark.range(-(-total // shard_slots)).mapInArrow(draw, "shard long, sid int, slots long")
    # A source has slots in nearly every shard: its running sum goes by ranges of shards, and over the ranges' totals.
    shards = stored(shards.withColumn("_range", F.floor(F.col("shard") / RANGE)), "mix-draws")
    earlier = W.partitionBy("sid", "_range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    before = W.partitionBy("sid").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = shards.groupBy("sid", "_range").agg(F.sum("slots").alias("_n")).select("sid", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = shards.withColumn("_in", F.coalesce(F.sum("slots").over(earlier), F.lit(0)))
    placed = inside.join(ranges, ["sid", "_range"]).select("shard", "sid", "slots", (F.col("_before") + F.col("_in")).alias("base"))
    return placed.repartition(max(1, -(-total // SLOTS_A_TASK)), "shard", "sid")


def slot_blocks(drawn: DataFrame, sources: list[Source], max_repeats: int, seed: int) -> DataFrame:
    """Which block of its source each slot reads. Slots beyond max_repeats epochs, by which a draw overshot, are left."""
    blocks = np.array([s.blocks for s in sources], dtype=np.int64)

    def place(batches):
        for batch in batches:
            for shard, sid, n, base in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                slot = np.arange(base, min(base + n, max_repeats * int(blocks[sid])), dtype=np.int64)
                block = np.zeros(len(slot), dtype=np.int64)
                epoch = slot // max(int(blocks[sid]), 1)
                for e in np.unique(epoch):
                    here = epoch == e
                    block[here] = permuted(slot[here] % blocks[sid], int(blocks[sid]), (seed * 1009 + sid) * 31 + int(e))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(slot), shard)), pa.array(np.full(len(slot), sid, dtype=np.int32)), pa.array(slot), pa.array(block)],
                    ["shard", "sid", "slot", "block"],
                )

    return drawn.select("shard", "sid", "slots", "base").mapInArrow(place, "shard long, sid int, slot long, block long")


@dataclass(frozen=True)
class Mix:
    sources: list[Source]
    rows: DataFrame  # the rows given, with sid and begin
    slots: DataFrame  # shard, sid, slot, block
    segments: DataFrame  # _row, sid, block, first_word, n_words, times


def mix(
    rows: DataFrame, block_words: int = 64, shard_slots: int = 4096, weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3, seed: int = 17,
) -> Mix:
    """rows: _row, doc_id, source, size of a stored table (see with_sizes)."""
    spark = rows.sparkSession
    totals = [(r.source, int(r.n or 0)) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]  # a row per source
    sources = targets(totals, weights, max_repeats, block_words)
    table = spark.createDataFrame([(s.name, s.sid) for s in sources], "source string, sid int")
    placed = packed(rows, table)
    slots = slot_blocks(draws(spark, sources, block_words, shard_slots, seed), sources, max_repeats, seed)
    times = slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    # Spark merges these, or broadcasts the counts where it finds them below its threshold at run time.
    read = segments(placed, block_words).join(times, ["sid", "block"])
    return Mix(sources, placed, slots, read)


def taken_words(mixed: Mix) -> DataFrame:
    """Per row of the input: size, source_size, target of its source, and the words the mix takes of it."""
    spark = mixed.rows.sparkSession
    per_source = spark.createDataFrame([(s.sid, s.size, s.target) for s in mixed.sources], "sid int, source_size long, target double")
    taken = mixed.segments.groupBy("_row").agg(F.sum(F.col("n_words") * F.col("times")).cast("long").alias("taken"))
    return (
        mixed.rows.select("_row", "doc_id", "size", "sid")
        .join(per_source, "sid").join(taken, "_row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame, block_words: int = 64, **options) -> DataFrame:
    """The documents' rows as the mix takes them: copy r of a document holds its words that are read r times or more.

    Neighbouring words keep the white space between them; words apart are joined by a line end. A document in a
    block that is read twice appears twice; one whose blocks are never read does not appear. n_chars is
    counted again.
    """
    columns = docs.columns
    rows = stored(with_sizes(docs, keep_text=True), "mix-input")
    mixed = mix(rows.select("_row", "doc_id", "source", "size"), block_words, **options)
    pieces = mixed.segments.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words", "times"))).alias("_pieces"))
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            spans_of = batch.column(batch.schema.get_field_index("_pieces")).to_pylist()
            out, at = [], []
            for i, (text, pieces_) in enumerate(zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), spans_of, strict=True)):
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                starts, ends, _ = words(raw, np.array([0, len(raw)]))
                r = 1
                while keep := [(p["first_word"], p["first_word"] + p["n_words"]) for p in pieces_ if p["times"] >= r]:
                    joined = [list(keep[0])]
                    for a, b in keep[1:]:
                        if a == joined[-1][1]:
                            joined[-1][1] = b
                        else:
                            joined.append([a, b])
                    out.append("\n".join(bytes(raw[starts[a] : ends[b - 1]]).decode() for a, b in joined))
                    at.append(i)
                    r += 1
            kept = batch.take(pa.array(at, pa.int64()))
            new = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, kept.column(kept.schema.get_field_index(c))) for c in columns], columns)

    return rows.join(pieces, "_row").select(*columns, "_pieces").mapInArrow(cut, schema)
