"""SentencePiece encoding by Viterbi search, and decoding.

The best segmentation has the highest sum of piece scores; of equal sums, the one whose last differing piece is
longer. Scores are whole numbers (log-probabilities times 2**16), so sums are exact in any order. A unigram model's
log-probabilities are taken as they are; a BPE model stores merge ranks, which become Zipf log-probabilities.

Text is read as UTF-8 bytes behind one blank (the model's dummy prefix); blanks stand for the piece sign U+2581.
Bytes that no piece covers are written as byte pieces, so decoding gives back every text exactly; a literal U+2581
is written in bytes for the same reason.

`StreamingViterbi` reads bytes one by one. It keeps a best score for the last positions a piece can still begin
at, at most the longest piece, and commits ids whenever the backpointer paths of these positions meet in
one boundary. Boundaries that no piece of the vocabulary crosses (before a blank after a non-blank, around bytes
that stand in no longer piece) are such points in any text. `encode` cuts texts there and runs the same search over
all different stretches of a slice at once; stretches beyond LONG bytes stream.

Null texts have null ids; an empty text has the ids of the blank alone. Repeated rows get equal ids, an empty table gives no
rows. Columns are kept, but for those named like a result (`ids`, `decoded`).
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.arrays import SpanHashes, slices, span_hash
from folioscope.llm.kneser_ney import Order
from folioscope.llm.worker import PerWorker

LONG = 192
PART_BYTES = 400_000  # searched at a time: some hundred bytes of working memory each
SCALE = 1 << 16
ZIPF_SHIFT = 2.7
SIGN = "▁"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in normal}
        if min(scores.values()) < -1000:  # merge ranks
            harmonic = np.log(sum(1 / (r + ZIPF_SHIFT) for r in range(len(scores))))
            scores = {i: -float(np.log(-s + ZIPF_SHIFT) + harmonic) for i, s in scores.items()}
        self.bytes_of = [b""] * size
        self.ids: dict[bytes, int] = {}
        for i in normal:
            self.bytes_of[i] = model.id_to_piece(i).replace(SIGN, " ").encode()
            self.ids.setdefault(self.bytes_of[i], i)
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
        self.score = np.zeros(size, dtype=np.int64)
        for i, s in scores.items():
            self.score[i] = round(s * SCALE)
        self.covered = np.array([bytes([b]) in self.ids for b in range(256)])  # a piece of one byte always beats the byte piece
        self.byte_score = int(round((min(scores.values()) - 10) * SCALE))
        self.longest = max(map(len, self.ids))
        longer = [p for p in self.ids if len(p) > 1]
        self.alone = np.ones(256, dtype=bool)
        for p in longer:
            self.alone[list(p)] = False
        self.blank_opens = not any(a != 0x20 and b == 0x20 for p in longer for a, b in zip(p, p[1:], strict=False))
        prefixes = sorted({p[:n] for p in self.ids for n in range(1, len(p) + 1)})
        flat = np.frombuffer(b"".join(prefixes), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in prefixes])
        starts = ends - [len(p) for p in prefixes]
        piece = np.array([self.ids.get(p, -1) for p in prefixes], dtype=np.int32)
        order = Order(span_hash(flat, starts, ends), piece, piece)
        self.find, self.piece_at = order.find, order.logp
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)


class StreamingViterbi:
    """Feed bytes; ids come out as soon as they are certain."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.tail = b""  # the last bytes, at most the longest piece
        self.at = 0
        self.base = 0  # committed up to here
        self.best = {0: 0}
        self.back: dict[int, tuple[int, int]] = {}

    def feed(self, data: bytes):
        v = self.vocab
        for byte in data:
            self.tail = (self.tail + bytes([byte]))[-v.longest :]
            self.at += 1
            top, come = self.best[self.at - 1] + v.byte_score, (self.at - 1, int(v.byte_id[byte]))
            for n in range(1, min(len(self.tail), self.at - self.base) + 1):
                piece = v.ids.get(self.tail[-n:])
                if piece is not None and self.at - n in self.best:
                    score = self.best[self.at - n] + int(v.score[piece])
                    if score >= top:
                        top, come = score, (self.at - n, piece)
            self.best[self.at], self.back[self.at] = top, come
            if self.at - v.longest in self.best and self.at - v.longest >= self.base:
                del self.best[self.at - v.longest]
            if self.at % v.longest == 0:
                yield from self._commit(self._meeting())

    def _meeting(self) -> int:
        """The boundary in which the paths of all positions that can still be continued meet."""
        live = {p for p in self.best if p >= self.base}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last][0] if last > self.base else self.base)
        return live.pop()

    def _commit(self, boundary: int):
        ids, p = [], boundary
        while p > self.base:
            p, piece = self.back[p]
            ids.append(piece)
        for q in range(self.base + 1, boundary + 1):
            del self.back[q]
        self.base = max(self.base, boundary)
        self.best = {p: s for p, s in self.best.items() if p >= self.base}
        yield from reversed(ids)

    def finish(self):
        yield from self._commit(self.at)


def streamed(vocab: Vocabulary, data: bytes) -> list[int]:
    search = StreamingViterbi(vocab)
    return [*search.feed(data), *search.finish()]


def stretches(vocab: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of stretches that no piece crosses out of."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data):
        alone = vocab.alone[data]
        cut |= alone
        cut[1:] |= alone[:-1]
        if vocab.blank_opens:
            cut[1:] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
        cut[offs[:-1]] = True
    starts = np.flatnonzero(cut)
    return starts, np.concatenate((starts[1:], [len(data)])).astype(np.int64)[: len(starts)], np.searchsorted(offs[1:], starts, side="right")


def best_paths(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi over all stretches at once: ids of one stretch after another, and how many each has."""
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)))
    total = int(first[-1])
    every = np.arange(total, dtype=np.int32)  # a part has fewer than 2**31 bytes
    local = data[every + np.repeat((starts - first[:-1]).astype(np.int32), lengths)]
    place = (every - np.repeat(first[:-1].astype(np.int32), lengths)).astype(np.int16)  # at most LONG
    stop = np.repeat(first[1:].astype(np.int32), lengths)
    # Boundary b of stretch s is number first[s] + s + b: one more boundary than bytes.
    node = every + np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
    bare = np.flatnonzero(~vocab.covered[local])
    edge_from, edge_len, edge_piece = [bare.astype(np.int32)], [np.ones(len(bare), dtype=np.int32)], [vocab.byte_id[local[bare]]]
    edge_score = [np.full(len(bare), vocab.byte_score, dtype=np.int64)]
    live, hashes = every, SpanHashes(local)
    for n in range(1, vocab.longest + 1):
        live = live[live + n <= stop[live]]
        if not len(live):
            break
        at = vocab.find(hashes.of(live, live + n))
        live, at = live[at >= 0], at[at >= 0]
        piece = vocab.piece_at[at]
        real = piece >= 0
        edge_from.append(live[real])
        edge_len.append(np.full(int(real.sum()), n, dtype=np.int32))
        edge_piece.append(piece[real])
        edge_score.append(vocab.score[piece[real]])
    origin, span = np.concatenate(edge_from), np.concatenate(edge_len)
    piece, score = np.concatenate(edge_piece), np.concatenate(edge_score)
    offset = place[origin]
    order = np.argsort(offset, kind="stable")
    bounds = np.searchsorted(offset[order], np.arange(int(offset.max(initial=-1)) + 2))
    best = np.full(total + len(starts), np.iinfo(np.int64).min // 2)
    back = np.zeros(len(best), dtype=np.int32)
    via = np.zeros(len(best), dtype=np.int32)
    heads = first[:-1] + np.arange(len(starts))
    best[heads] = 0
    for i in range(len(bounds) - 1):
        e = order[bounds[i] : bounds[i + 1]]
        a = node[origin[e]]
        b = a + span[e]
        new = best[a] + score[e]
        win = new > best[b]
        b, e = b[win], e[win]
        best[b], back[b], via[b] = new[win], a[win], piece[e]
    at = heads + lengths
    todo = np.arange(len(starts))[lengths > 0]
    found, owner = [], []
    at = at[todo]
    while len(todo):
        found.append(via[at])
        owner.append(todo)
        at = back[at]
        more = at > heads[todo]
        todo, at = todo[more], at[more]
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(len(starts), dtype=np.int64)
    ids, own = np.concatenate(found)[::-1], np.concatenate(owner)[::-1]
    return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(starts))


def encode_slice(vocab: Vocabulary, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of several texts (each with its blank in front) one after another, and how many each text has."""
    starts, ends, of = stretches(vocab, data, offs)
    if not len(starts):
        return np.zeros(0, dtype=np.int32), np.zeros(len(offs) - 1, dtype=np.int64)
    _, sample, inverse = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    short = (ends - starts)[sample] <= LONG
    ids, counts = best_paths(vocab, data, starts[sample[short]], ends[sample[short]])
    if not short.all():
        every = np.zeros(len(sample), dtype=np.int64)
        every[short] = counts
        pieces = dict(zip(np.flatnonzero(short), np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        for u in np.flatnonzero(~short):
            pieces[u] = np.array(streamed(vocab, data[starts[sample[u]] : ends[sample[u]]].tobytes()), dtype=np.int32)
            every[u] = len(pieces[u])
        ids, counts = np.concatenate([pieces[u] for u in range(len(sample))]), every
    first = np.concatenate(([0], np.cumsum(counts)))
    n = counts[inverse]
    begin = np.concatenate(([0], np.cumsum(n)))
    out = ids[np.arange(begin[-1]) + np.repeat(first[inverse] - begin[:-1], n)]
    return out, np.bincount(of, weights=n, minlength=len(offs) - 1).astype(np.int64)


def with_blank(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank before each text."""
    at = offs[:-1] + np.arange(len(offs) - 1)
    out = np.empty(len(data) + len(at), dtype=np.uint8)
    body = np.ones(len(out), dtype=bool)
    body[at] = False
    out[at], out[body] = 0x20, data
    return out, offs + np.arange(len(offs))


def encode(docs: DataFrame, model: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ids, binary of little-endian unsigned 32-bit numbers. `model` is the vocabulary file's path on executors."""
    kept = [f for f in docs.schema if f.name != "ids" and (keep_text or f.name != text)]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "ids binary"
    names = [f.name for f in kept]

    shared = docs.sparkSession.sparkContext.broadcast(PerWorker(Vocabulary, model))

    def run(batches):
        vocab = shared.value.get()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            null = np.asarray(column.is_null())
            for start, stop, data, offs in slices(column, PART_BYTES):
                ids, counts = encode_slice(vocab, *with_blank(data, offs))
                raw = ids.astype("<u4").tobytes()
                ends = 4 * np.cumsum(counts)
                values = [None if null[start + i] else raw[e - 4 * c : e] for i, (e, c) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True))]
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(values, pa.binary())], [*names, "ids"])

    return docs.select(*[f for f in docs.columns if f != "ids"]).mapInArrow(run, schema)


def decode_ids(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of one document's ids, without the blank put in front."""
    n = vocab.lengths[ids]
    begin = np.concatenate(([0], np.cumsum(n)))
    return vocab.flat[np.arange(begin[-1]) + np.repeat(vocab.first[ids] - begin[:-1], n)].tobytes()[1:]


def decode(encoded: DataFrame, model: str, into: str = "decoded") -> DataFrame:
    """Adds the text of `ids`; bytes that are no UTF-8, which only foreign ids can give, become U+FFFD."""
    kept = [f for f in encoded.schema if f.name != into]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{into}` string"
    names = [f.name for f in kept]

    shared = encoded.sparkSession.sparkContext.broadcast(PerWorker(Vocabulary, model))

    def run(batches):
        vocab = shared.value.get()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = [
                    None if x is None else decode_ids(vocab, np.frombuffer(x, dtype="<u4").astype(np.int64)).decode("utf-8", "replace")
                    for x in part.column(part.schema.get_field_index("ids")).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), pa.array(texts, pa.string())], [*names, into])

    return encoded.select(*names).mapInArrow(run, schema)


def crc32(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
