"""The approximate index against the exact scan."""
import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import search, vector_index as vi
from folioscope.plans import desk


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    table = desk.index_vectors(spark, "/root/testdata/sf0.01").drop("vec_id", "group_id")
    odd = spark.createDataFrame([("zero", None, True, [0.0] * 64), ("none", None, True, None)], table.select("part_id", "user_id", "confirmed", "embedding").schema)
    table = table.select("part_id", "user_id", "confirmed", "embedding").unionByName(odd)
    model = vi.fit(table, lists=16, subspaces=16)
    root = str(tmp_path_factory.mktemp("lists") / "index")
    vi.write_index(table, model, root)
    return table, model, vi.read_index(spark, root)


def test_recall_against_the_exact_scan(spark, built):
    table, model, index = built
    queries = [[float(v) for v in r["embedding"]] for r in table.filter("embedding is not null").orderBy(F.xxhash64("part_id")).limit(12).collect()]
    assert index.count() == table.count() - 2  # every row with a direction is in one list
    probes = vi.probes_for(index, model, queries[:8], 0.96, keep=150)
    assert probes < 16 and vi.recall(index, model, queries, 10, probes, keep=150) >= 0.95
    assert vi.recall(index, model, queries[:3], 10, probes=16, keep=600) == 1.0
    exact = search.vector_search(table.filter("part_id <> 'zero' and part_id <> 'none'"), queries[0], 12, user_id=1).select("part_id", "score").collect()
    assert vi.approximate_search(index, model, queries[0], 12, probes=16, keep=600, user_id=1).select("part_id", "score").collect() == exact


def test_only_the_nearest_lists_are_opened(spark, built):
    _, model, index = built
    found = vi.approximate_search(index, model, [1.0] * 64, 5, probes=3, keep=20)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain("formatted")
    plan = out.getvalue()
    opened = [int(x) for x in model.probes(np.full(64, 0.125), 3)]
    assert plan.count("PartitionFilters: [list") >= 2 and all(str(x) in plan for x in opened)
    assert {r["list"] for r in found.join(index.select("part_id", "list"), "part_id").collect()} <= set(opened)


def test_groups_cover_all_rows():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(40, 6)) * 0.01 + c for c in np.eye(6)])
    centres = vi.k_means(rows, 6)
    assert len(set(vi._nearest(rows, centres))) == 6 and np.abs(np.sort(centres.max(axis=1)) - 1).max() < 0.05
    assert len(vi.k_means(rows[:2], 5)) == 2 and vi.k_means(np.zeros((3, 2)), 3).shape == (3, 2)


def test_nothing_to_index(spark):
    assert vi.fit(spark.createDataFrame([("a", None)], "part_id string, embedding array<float>")) is None


def test_few_lists_suffice_where_vectors_have_groups(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(60, 24)) * 0.08 + c for c in rng.normal(size=(20, 24))])
    table = spark.createDataFrame([(f"v{i:04d}", [float(x) for x in r]) for i, r in enumerate(rows)], "part_id string, embedding array<float>")
    model = vi.fit(table, lists=20, subspaces=8)
    vi.write_index(table, model, str(tmp_path / "lists"))
    index = vi.read_index(spark, str(tmp_path / "lists"))
    assert vi.recall(index, model, [[float(x) for x in rows[i]] for i in range(0, 1200, 130)], 10, probes=2, keep=60) >= 0.95


def test_texts_scored_where_they_are_hashed(spark):
    from folioscope.operators.embedding import hashed_vectors, hashing_model

    words = ["moinho", "água", "do", "rio", "são", "1815"]
    texts = spark.createDataFrame([(f"t{i:03d}", " ".join(words[(i * k) % 6] for k in range(i % 7))) for i in range(300)], "part_id string, text string")
    query = [float(v) for v in hashing_model()(["moinho do rio"])[0]]
    found = search.text_search(texts, query, 20).collect()
    assert found == search.vector_search(hashed_vectors(texts).select("part_id", "text", "embedding", F.lit(None).cast("bigint").alias("user_id")), query, 20).select("part_id", "text", "score").collect()
    with pytest.raises(ValueError):
        search.text_search(texts, query, 21, 20)


def test_hits_of_a_hybrid_search_are_found_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(search, "durable", lambda df, real=search.durable: made.append(df.columns) or real(df))
    numbered = spark.createDataFrame([("p1", "a", 2, 1, "o rio"), ("p1", "b", 1, 1, "RÍO"), ("p2", "c", 1, 1, "mar")], "page_id string, part_id string, linha_documento int, parte int, text string")
    pages = spark.createDataFrame([("p1", "rio.jpg"), ("p2", "rio2.jpg")], "page_id string, filename string")
    similar = spark.createDataFrame([("p1", "a", 0.9), ("p2", "c", 0.5), ("p9", "z", 0.4)], "page_id string, part_id string, score double")
    for size, literal in ((None, ["a", "b"]), (1, ["b"])):
        out = search.hybrid_search(pages, numbered, similar, "rio", size)
        got = sorted((r.section, r.page_id, r.part_id) for r in out.collect())
        assert got == [("literal", "p1", x) for x in literal] + [("name", "p2", None), ("similar", "p2", "c")]
        assert "translate(text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert made == [["page_id", "part_id"], ["page_id", "part_id", "linha_documento", "parte"]]
