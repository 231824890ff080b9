"""The pipeline's stages on small tables, each against what its operator must do to its own input."""
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm.store import documents, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tiny):
    """The rows that enter each stage, and what leaves the last."""
    rows = [documents(spark, tiny)]
    for name, stage in corpus_pipeline.STAGES:
        rows.append(stored(stage(spark, rows[-1], tiny), f"test-{name}"))
    return rows


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_duplicates", "source_mix", "encode"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    assert all(r.n_chars == len(r.text) for df in stages[2:5] for r in df.collect())


def test_language_keeps_what_has_one(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert all(any(map(str.isalpha, t)) for t in after.values())
    assert len(after) >= 0.98 * len(before)


def test_line_dedup_cuts_and_keeps(stages):
    before, after = texts(stages[1]), texts(stages[2])
    counts = {}
    for t in before.values():
        for line in set(t.split("\n")):
            counts[line] = counts.get(line, 0) + 1
    for d, t in before.items():
        own = [x for x in t.split("\n") if counts[x] == 1 and WORD.search(x)]
        assert set(own) <= set(after.get(d, "").split("\n")) or not own
    gone = set(before) - set(after)
    assert all(any(before[d] == t and e < d for e, t in before.items()) or all(counts[x] > 1 for x in before[d].split("\n")) for d in gone)


def test_one_of_each_near_duplicate_group_stays(stages):
    def shingles(text):
        words = WORD.findall(text)
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    before, after = texts(stages[2]), texts(stages[3])
    sets = {d: shingles(t) for d, t in before.items()}
    ids = sorted(before)
    near = {d: [e for e in ids if e != d and len(sets[d] & sets[e]) >= 0.8 * max(1, len(sets[d] | sets[e]))] for d in ids}
    for d in ids:
        if not near[d]:
            assert d in after
        else:
            assert not (d in after and any(e in after for e in near[d]))


def test_sources_reach_their_targets(stages):
    words = lambda df: {s: sum(len(WORD.findall(r.text)) for r in df.collect() if r.source == s) for s in {r.source for r in df.collect()}}
    before, after = words(stages[3]), words(stages[4])
    total = sum(before.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(before))}
    level = total / sum(weight.values())
    if all(weight[s] * level <= 3 * before[s] for s in before):
        assert all(abs(after.get(s, 0) - weight[s] * level) <= 0.06 * weight[s] * level + 256 for s in before)
    assert abs(sum(after.values()) - total) <= 0.03 * total


def test_every_mixed_text_is_encoded(spark, stages):
    mixed, encoded = stages[4].collect(), stages[5].collect()
    assert len(mixed) == len(encoded) and all(r.n_tokens == len(r.ids) // 4 > 0 for r in encoded)


def test_run_is_the_stages(spark, tiny, stages):
    run = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, tiny).collect())
    assert run == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect())


def test_edge_rows_pass_through_every_stage(spark, tiny):
    rows = [
        (1, "a house by the sea with a garden and a wall of stone", "en", "a", 52), (2, None, None, None, None), (3, "", "en", "", 0),
        (4, "12 34", None, "b", 5), (1, "a house by the sea with a garden and a wall of stone", "en", "a", 52), (5, "x " * 5000, None, "b", 10000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        df = stored(spark.createDataFrame(data, schema), "edge")
        for name, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, tiny), f"edge-{name}")
        assert bool(df.count()) == bool(data)


def test_batches_of_a_stage_are_bounded(spark, tiny):
    """What goes to a Python worker at once is so many bytes, however long the texts are."""
    corpus_pipeline.language(spark, documents(spark, tiny), tiny)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("palavra "), 25_000).alias("text"))  # 40 MB
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 9_000_000
