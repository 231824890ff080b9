"""Token ids in files of patched frame-of-reference blocks.

Texts are ordered by doc_id over the whole corpus by range, tokenised, and written as segments of whole documents:
a Parquet row per segment, so any store Spark writes to will do, whose `payload` is laid out as below (all numbers
little-endian). Nothing but the payloads is needed to read a corpus back, and a block can be read alone.

    header    4s magic "PFB1", u32 blocks, u64 ids, u32 documents, u32 bytes of the block area
    documents u8 has an id, i64 doc_id, u64 ids of the document, one array after the other
    index     u64 start of each block in the block area
    blocks    u32 minimum, u8 width, u8 exceptions, then BLOCK values less the minimum in `width` bits each, lowest bit
              first, then u8 places and u32 values of the exceptions

The width holds PERCENTILE of a block's values; the others are exceptions, and zero in the packed part. The
last block of a segment is filled up with its last id.

Null texts count as empty: the end id alone. Rows with equal doc_id are ordered by text; null ids come first. An
empty table writes no segment and reads back as none.
"""
from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.arrays import slices, span_hash
from folioscope.llm.worker import PerWorker

BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 17
HEADER = "<4sIQII"
SEGMENT_SCHEMA = "part int, seq int, n_ids long, payload binary"
KNOWN_PIECES = 3_000_000  # about 30 bytes each


class Pieces:
    """Encodes stretches of text once and remembers their ids, KNOWN_PIECES stretches at most before it starts afresh.

    The vocabulary's pattern always begins a token at a blank that a character other than white space follows, and a
    stretch before such a blank has the same tokens alone as in its text. So texts are cut there, and the library
    encodes each different stretch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, dtype=np.uint64)  # ascending
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype="<u4")

    def _learn(self, hashes: np.ndarray, stretches: list[str]):
        found: list[list[int]] = []
        for at in range(0, len(stretches), 4096):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(stretches[at : at + 4096], add_special_tokens=False)]
        count = np.array([len(f) for f in found], dtype=np.int32)
        begin = len(self.flat) + np.cumsum(count, dtype=np.int64) - count
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(count.sum()))))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = (np.insert(a, at, b) for a, b in ((self.hashes, hashes), (self.begin, begin), (self.count, count)))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts one after another, and how many each text has."""
        starts = cuts(data, offs)
        ends = np.append(starts[1:], len(data))
        hashes, sample, inverse = distinct(span_hash(data, starts, ends))
        if len(self.hashes) > KNOWN_PIECES:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), dtype=bool)
        if new.any():
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, hashes)
        begin, n = self.begin[at][inverse], self.count[at][inverse].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin - total[:-1], n)]
        return ids, np.diff(total[np.searchsorted(starts, offs)])


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values in ascending order, a place of each, and which each value is. np.unique sorts stably for the first
    place, which takes longer and is not needed here."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


PLAIN = np.ones(256, dtype=bool)  # first bytes of characters that are surely no white space
PLAIN[:0x21] = PLAIN[0x7F] = PLAIN[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where stretches begin: at texts, and at blanks before a plain character."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[: max(len(data) - 1, 0)] = (data[:-1] == 0x20) & PLAIN[data[1:]]
    cut[offs] = True
    cut[len(data)] = False
    ends = offs[(offs > 0) & (offs < len(data))]
    lone = ends[(data[ends - 1] == 0x20)] - 1  # a text's last blank is followed by another text
    lone = lone[~np.isin(lone, offs)]
    cut[lone] = False
    return np.flatnonzero(cut)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The block area and the start of each block."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, dtype="<u8")
    values = np.concatenate((ids, np.full(n * BLOCK - len(ids), ids[-1], dtype=ids.dtype))).reshape(n, BLOCK).astype(np.uint32)
    low = values.min(axis=1)
    values = values - low[:, None]
    at = np.sort(values, axis=1)[:, (BLOCK * PERCENTILE + 99) // 100 - 1]
    width = np.frexp(at.astype(np.float64))[1].astype(np.int64)  # bits of the percentile
    over = (values.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    exceptions = over.sum(axis=1)
    ends = np.cumsum(6 + width * BLOCK // 8 + 5 * exceptions)
    starts = np.concatenate(([0], ends[:-1]))
    area = np.zeros(int(ends[-1]), dtype=np.uint8)  # all blocks are filled in at once
    area[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    area[starts + 4], area[starts + 5] = width, exceptions
    for w in np.unique(width):
        here = np.flatnonzero(width == w)
        fits = np.where(over[here], 0, values[here]).astype("<u4")
        bits = np.unpackbits(fits.view(np.uint8).reshape(len(here), BLOCK, 4), axis=2, count=int(w), bitorder="little")
        packed = np.packbits(bits.reshape(len(here), -1), axis=1, bitorder="little")
        area[(starts[here] + 6)[:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(over)
    tail = starts + 6 + width * BLOCK // 8
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    area[tail[block] + nth] = place
    at = (tail + exceptions)[block] + 4 * nth
    area[at[:, None] + np.arange(4)] = values[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return area.tobytes(), starts.astype("<u8")


def unpack_blocks(area: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    raw = np.frombuffer(area, dtype=np.uint8)
    begin = starts.astype(np.int64)
    head = raw[begin[:, None] + np.arange(6)] if len(begin) else np.zeros((0, 6), dtype=np.uint8)
    low = head[:, :4].copy().view("<u4")[:, 0] if len(begin) else np.zeros(0, dtype=np.uint32)
    width, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((len(begin), BLOCK), dtype=np.uint32)
    for w in np.unique(width):
        here = np.flatnonzero(width == w)
        if w:
            packed = raw[(begin[here] + 6)[:, None] + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(here), BLOCK, w)
            value = np.zeros((len(here), BLOCK), dtype=np.uint32)
            for i in range(int(w)):
                value |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
            out[here] = value
    total = int(exceptions.sum())
    if total:
        block = np.repeat(np.arange(len(begin)), exceptions)
        nth = np.arange(total) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = begin + 6 + width * BLOCK // 8
        place = raw[tail[block] + nth]
        value = raw[(tail + exceptions)[block][:, None] + 4 * nth[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
        out[block, place] = value
    return (out + low[:, None]).reshape(-1)[:n_ids]


def segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    area, starts = pack_blocks(ids)
    return b"".join((
        struct.pack(HEADER, b"PFB1", len(starts), len(ids), len(counts), len(area)),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array(counts, dtype="<u8").tobytes(), starts.tobytes(), area,
    ))


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids per document, and the ids."""
    magic, blocks, n_ids, docs, size = struct.unpack_from(HEADER, payload)
    if magic != b"PFB1":
        raise ValueError("no token segment")
    at = struct.calcsize(HEADER)
    has = np.frombuffer(payload, dtype=np.uint8, count=docs, offset=at)
    ids = np.frombuffer(payload, dtype="<i8", count=docs, offset=at + docs)
    counts = np.frombuffer(payload, dtype="<u8", count=docs, offset=at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(payload, dtype="<u8", count=blocks, offset=at + 17 * docs)
    area = payload[at + 17 * docs + 8 * blocks :][:size]
    return [int(d) if h else None for h, d in zip(has, ids, strict=True)], counts, unpack_blocks(area, starts, n_ids)


def read_block(payload: bytes, block: int) -> np.ndarray:
    """The ids of one block, found through the index."""
    _, blocks, n_ids, docs, size = struct.unpack_from(HEADER, payload)
    starts = np.frombuffer(payload, dtype="<u8", count=blocks, offset=struct.calcsize(HEADER) + 17 * docs)
    area = payload[struct.calcsize(HEADER) + 17 * docs + 8 * blocks :][:size]
    return unpack_blocks(area, starts[block : block + 1], min(BLOCK, n_ids - BLOCK * block))


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> None:
    """Tokenise and write `docs` in ascending doc_id order. `vocabulary` is the tokenizer file's path on executors."""

    shared = docs.sparkSession.sparkContext.broadcast(PerWorker(Pieces, vocabulary))

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        encode = shared.value.get().encode
        end = np.array([end_id], dtype="<u4").tobytes()
        held: tuple[list, list, list] = ([], [], [])
        n = 0

        def flush():
            ids = np.frombuffer(b"".join(held[2]), dtype="<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([segment(held[0], held[1], ids)], pa.binary())],
                ["part", "seq", "n_ids", "payload"],
            )

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, stop, data, offs in slices(batch.column(1)):
                ids, counts = encode(data, offs)
                raw, stops = ids.tobytes(), 4 * np.cumsum(counts)
                for d, size, to in zip(doc_ids[start:stop], counts.tolist(), stops.tolist(), strict=True):
                    held[0].append(d), held[1].append(size + 1), held[2].append(raw[to - 4 * size : to] + end)
                    n += size + 1
                    if n >= SEGMENT_IDS:
                        yield flush()
                        seq, n, held = seq + 1, 0, ([], [], [])
        if held[0]:
            yield flush()

    # Equal doc_ids fall to one range only where the texts are equal too.
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SEGMENT_SCHEMA).write.parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, seq, base: the ids in all segments before this one; reads the counts only."""
    sizes = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_base"))
    earlier = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return (
        sizes.withColumn("_in", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
        .join(parts, "part").select("part", "seq", (F.col("_part_base") + F.col("_in")).alias("base"))
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, seq, offset (ids of the segment before this document), ids (binary, little-endian u32)."""

    def run(batches):
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, counts, ids = read_segment(payload)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()), pa.array([part] * len(doc_ids), pa.int32()), pa.array([seq] * len(doc_ids), pa.int32()),
                        pa.array(ends - counts), pa.array([raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "part", "seq", "offset", "ids"],
                )

    rows = spark.read.schema(SEGMENT_SCHEMA).parquet(path).select("part", "seq", "payload")
    return rows.mapInArrow(run, "doc_id long, part int, seq int, offset long, ids binary")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
