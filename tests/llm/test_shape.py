"""Shards, source mix and token files against plain computations."""
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import pfor_tokens, slot_shards, source_mix
from folioscope.llm.queries import all_queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(tiny):
    return duckdb.sql(f"select doc_id, text, source from '{tiny}/documents.parquet' order by doc_id").fetchall()


def test_shards_are_even_gapless_and_rerun_equal(spark, tiny, docs):
    rows = all_queries()["op10_virtual_slot_shards"](spark, tiny).collect()
    text = {d: t or "" for d, t, _ in docs}
    load, places = dict.fromkeys(range(24), 0), {}
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(docs) and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values()) + max(r.size for r in rows if r.size < 4000) / 10
    again = {r.doc_id: (r.shard, r.slot) for r in all_queries()["op10_virtual_slot_shards"](spark, tiny).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_a_new_shard_takes_slots_only_into_itself():
    sizes = {s: 50 + s * 7919 % 1000 for s in range(0, 4096, 3)}
    before = slot_shards.rebalanced(slot_shards.first_map(24), sizes, 24)
    after = slot_shards.grown(before, sizes, 24)
    moved = [s for s in range(4096) if before[s] != after[s]]
    load = [sum(sizes.get(s, 0) for s in range(4096) if after[s] == k) for k in range(25)]
    assert moved and all(after[s] == 24 for s in moved) and max(load) < 1.05 * min(load)


def test_rebalancing_moves_few_slots_when_little_changed():
    sizes = dict.fromkeys(range(4096), 100)
    start = slot_shards.first_map(16)
    even = slot_shards.rebalanced(start, sizes, 16)
    assert even == start
    sizes[0] += 5000
    edited = slot_shards.rebalanced(even, sizes, 16)
    assert 0 < sum(a != b for a, b in zip(even, edited, strict=True)) < 200


def expected_targets(sizes):
    """Shares by weight again and again, until no source is above three times its size."""
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    target, free = {}, set(sizes)
    total = sum(sizes.values())
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    return target


def test_source_mix(spark, tiny, docs):
    rows = all_queries()["op9_source_mix"](spark, tiny).collect()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    totals = {}
    for d, n in size.items():
        totals[source[d]] = totals.get(source[d], 0) + n
    want, taken = expected_targets(totals), dict.fromkeys(totals, 0)
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], totals[source[r.doc_id]]) and 0 <= r.taken <= 3 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs)
    for s in totals:
        assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 4 * 64
    again = all_queries()["op9_source_mix"](spark, tiny).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_index_permutations(size):
    one, two = (source_mix.permuted(np.arange(size), size, key) for key in (1, 2))
    assert sorted(one) == sorted(two) == list(range(size)) and (size < 17 or one.tolist() != two.tolist())


def test_mixed_documents_hold_the_words_taken(spark, tiny):
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    mixed = source_mix.mixed_documents(table)
    assert mixed.columns == table.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(r.text))
    taken = {r.doc_id: r.taken for r in all_queries()["op9_source_mix"](spark, tiny).collect() if r.taken}
    assert words == taken


def test_token_files(spark, tiny, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in all_queries()["op7_token_blocks"](spark, tiny).collect()}
    start = 0
    for (d, _, _), found in zip(docs, tokenizer.encode_batch([t or "" for _, t, _ in docs], add_special_tokens=False), strict=True):
        ids = np.array([*found.ids, 2], dtype="<u4")
        assert got.pop(d) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 1 << 31, (1 << 32) - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[:: 17] //= 1000
    payload = pfor_tokens.segment([5, None], [n, 0], ids)
    doc_ids, counts, back = pfor_tokens.read_segment(payload)
    assert doc_ids == [5, None] and counts.tolist() == [n, 0] and (back == ids).all()
    for block in range(-(-n // 128)):
        assert (pfor_tokens.read_block(payload, block) == ids[128 * block : 128 * block + 128]).all()


def test_pieces_are_cut_only_where_tokens_end():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, library = pfor_tokens.Pieces(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", "!", "é", "<|endoftext|>", " x", "　", " ", "日本"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    for size in (1, 40, 2000):  # known stretches are used again
        at = 0
        for lo in range(0, len(texts), size):
            data, offs = np.frombuffer(b"".join(raw[lo : lo + size]), dtype=np.uint8), np.cumsum([0, *map(len, raw[lo : lo + size])])
            ids, counts = ours.encode(data, offs)
            for n, end in zip(counts, np.cumsum(counts), strict=True):
                assert ids[end - n : end].tolist() == library.encode(texts[at], add_special_tokens=False).ids
                at += 1


def test_blocks_are_packed_all_at_once(monkeypatch):
    """Bytes as the format describes them, made without a step for each block."""
    import struct

    rng = np.random.default_rng(3)
    ids = np.where(rng.random(2000) < 0.05, 2**32 - 1, rng.integers(0, 300, 2000)).astype("<u4")
    packed = []
    pack = struct.pack
    monkeypatch.setattr(struct, "pack", lambda *a: packed.append(a) or pack(*a))
    area, starts = pfor_tokens.pack_blocks(ids)
    assert not packed
    assert (pfor_tokens.unpack_blocks(area, starts, len(ids)) == ids).all()
    for at, block in zip(starts.tolist(), np.append(ids, np.full(48, ids[-1], dtype="<u4")).reshape(-1, 128), strict=True):
        low, width, exceptions = struct.unpack_from("<IBB", area, at)
        over = np.flatnonzero((block - low).astype(np.uint64) >> np.uint64(width))
        tail = at + 6 + 16 * width
        assert low == block.min() and list(area[tail : tail + exceptions]) == over.tolist()
        bits = sum((0 if i in over else int(v - low)) << (width * i) for i, v in enumerate(block.tolist()))
        assert int.from_bytes(area[at + 6 : tail], "little") == bits


def test_distinct_values():
    values = np.random.default_rng(4).integers(0, 50, 500).astype(np.uint64)
    found, place, which = pfor_tokens.distinct(values)
    assert (found == np.unique(values)).all() and (values[place] == found).all() and (found[which] == values).all()
