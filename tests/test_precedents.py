import glob
import json
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.responses import failure_kind, json_object, parse_embeddings, response_texts
from folioscope.operators import embedding, precedents, reading, search, threshold, transcribe
from conftest import page, rows


def plain_forms(texts, least, most):
    """Words of the texts by how many texts hold them."""
    held = {}
    for text in texts:
        for word in set(re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", re.sub(r"(?i)\[ileg[ií]vel\]", " ", text))):
            if 2 <= len(word) <= 40 and word.lower() not in precedents.STOP_WORDS:
                held[word] = held.get(word, 0) + 1
    return sorted(((w, n) for w, n in held.items() if n >= least), key=lambda x: (-x[1], x[0]))[:most]


def test_forms_of_random_texts(spark):
    rnd = random.Random(11)
    pool = ["d'água", "Óbidos", "óbidos", "x", "de", "DA", "w" * 41, "w" * 40, "[ilegível]", "[ILEGIVEL]", "1815", "moinho2", "légua-e-meia", "ñ’andu", "mó", "reis"]
    texts = [" ".join(rnd.choices(pool, k=rnd.randrange(9))) for _ in range(80)] + ["", " "]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    for least, most in ((1, 100), (9, 3)):
        assert [tuple(r) for r in precedents.word_forms(table, least, most).collect()] == plain_forms(texts, least, most)


def vectors(spark, n, width=8, seed=3):
    rnd = random.Random(seed)
    return [(f"v{i:03d}", [float(rnd.randrange(-2, 3)) for _ in range(width)], f"g{i % 5}") for i in range(n)]


@pytest.mark.parametrize("blocks", [{}, {"query_block": 16, "vector_block": 32}])
def test_similarity_join_is_exact(spark, blocks):
    data = vectors(spark, 150) + [("zero", [0.0] * 8, "z"), ("none", None, "z")]
    queries = spark.createDataFrame([("q" + i, v, g) for i, v, g in data[:60]], "query_id string, vector array<float>, group_id string")
    table = spark.createDataFrame(data, "part_id string, embedding array<float>, group_id string")
    found = search.knn_join(queries, table, 4, width=8, **blocks)
    expected = []
    for i, v, g in data[:60]:
        scored = []
        for j, w, h in data[:150]:
            a, b = np.array(v), np.array(w)
            if h != g and a.any() and b.any():
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), j))
        expected += [("q" + i, j, rank) for rank, (_, j) in enumerate(sorted(scored)[:4], 1)]
    assert rows(found, "query_id", "part_id", "rank") == sorted(expected)


def sparse_block(seed, n, groups, width=768):
    """Vectors of a dozen words, some of them frequent; every third is near one of fifty texts."""
    rnd = np.random.default_rng(seed)
    at = np.concatenate((rnd.integers(0, 40, (n, 4)), rnd.integers(0, width, (n, 8))), axis=1)
    at[::3, 2:] = np.random.default_rng(9).integers(0, width, (50, 10))[rnd.integers(0, 50, len(at[::3]))]
    dense = np.zeros((n, width), dtype="float32")
    np.add.at(dense, (np.arange(n)[:, None], at), 1)
    return [(f"r{seed}_{i:05d}", [float(x) for x in v], f"g{i % groups}") for i, v in enumerate(dense)], dense


def test_folded_vectors_rule_out_most_pairs_and_lose_none(spark, monkeypatch):
    left, q = sparse_block(1, 300, 7)
    right, s = sparse_block(2, 2500, 7)
    wanted, whole, scored = [], [], []
    unit = lambda x: x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    sims = np.round(unit(q) @ unit(s).T, 9)
    for i, (name, _, g) in enumerate(left):
        near = sorted((-sims[i, j], right[j][0]) for j in np.flatnonzero(sims[i] >= 0.7) if right[j][2] != g)
        wanted += [(name, part) for _, part in near[:4]]
    packs = []
    for data, key, column in ((left, "query_id", "vector"), (right, "part_id", "embedding")):
        frame = spark.createDataFrame(data, f"{key} string, {column} array<float>, group_id string")
        packs.append(search.packed(frame, column).toArrow())
    long, short = search._Best._long, search._Best._short
    monkeypatch.setattr(search._Best, "_long", lambda self, *a: whole.append(1) or long(self, *a))
    monkeypatch.setattr(search._Best, "_short", lambda self, *a: scored.append(found := short(self, *a)) or found)
    found = search._block_best(*packs, 4, 768, 0.7)
    assert sorted(zip(found["query_id"].to_pylist(), found["part_id"].to_pylist(), strict=True)) == sorted(wanted)
    assert not whole and sum(len(r) for r, _ in scored) < 0.1 * sims.size


def test_folded_vectors_are_given_up_where_they_rule_out_nothing(spark):
    rnd = np.random.default_rng(4)
    data = [(f"r{i:03d}", [float(x) for x in v], f"g{i % 3}") for i, v in enumerate(rnd.normal(size=(200, 768)) + 0.5)]
    frame = lambda key, column: search.packed(spark.createDataFrame(data, f"{key} string, {column} array<float>, group_id string"), column).toArrow()
    found = search._block_best(frame("query_id", "vector"), frame("part_id", "embedding"), 4, 768, 0.0)
    dense = np.array([v for _, v, _ in data], dtype="float32").astype("float64")
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    sims, wanted = np.round(unit @ unit.T, 9), []
    for i in range(200):
        wanted += [(data[i][0], part) for _, part in sorted((-sims[i, j], data[j][0]) for j in range(200) if j % 3 != i % 3)[:4]]
    assert sorted(zip(found["query_id"].to_pylist(), found["part_id"].to_pylist(), strict=True)) == sorted(wanted)


def test_every_cell_of_a_similarity_join_is_a_task(spark):
    from folioscope.operators.spread import even_keys

    for n in (1, 7, 24, 70):
        keys = spark.createDataFrame([(k,) for k in even_keys(spark, n)], "id long").repartition(n, "id")
        assert keys.select(F.spark_partition_id()).distinct().count() == n
    data = vectors(spark, 400)
    queries = spark.createDataFrame([("q" + i, v, g) for i, v, g in data], "query_id string, vector array<float>, group_id string")
    table = spark.createDataFrame(data, "part_id string, embedding array<float>, group_id string")
    packs = [search.packed(x, c) for x, c in ((queries, "vector"), (table, "embedding"))]
    grid = search._knn_grid(*packs, 4, 8, 64, 64, float("-inf"))
    tasks = grid.select(F.spark_partition_id()).distinct().count()  # cells that found something
    assert tasks >= 3 * spark.sparkContext.defaultParallelism


def test_a_vector_many_rows_share_is_kept_as_often_as_it_can_be_wanted(spark):
    """Rows of the query's own group come first; the next of the same vector are still found, and no more rows than can be wanted are compared."""
    data = [(f"a{i:03d}", [1.0, 0.0], "own") for i in range(50)] + [(f"b{i:03d}", [1.0, 0.0], f"g{i % 9}") for i in range(200)]
    table = search.packed(spark.createDataFrame(data, "part_id string, embedding array<float>, group_id string"), "embedding")
    assert search._first_of_equal(table, 4).count() == 8
    queries = spark.createDataFrame([("q", [2.0, 0.0], "own"), ("r", [2.0, 0.0], "g0"), ("s", [2.0, 0.0], None)], "query_id string, vector array<float>, group_id string")
    got = rows(search.knn_join(queries, table, 4), "query_id", "rank", "part_id")
    assert got == sorted(
        [("q", n, f"b{n - 1:03d}") for n in range(1, 5)] + [("r", n, f"a{n - 1:03d}") for n in range(1, 5)] + [("s", n, f"a{n - 1:03d}") for n in range(1, 5)]
    )


def test_similarity_joins_move_short_vectors_and_keep_all_ties(spark):
    """Packed rows are as short as their texts; a thousand equal vectors lose none of the smallest ids; a least score cuts what is below."""
    rnd = np.random.default_rng(5)
    data = [(f"p{i:04d}", [float(x) for x in np.bincount(rnd.integers(0, 768, 6), minlength=768)], f"g{i % 5}") for i in range(1300)]
    data += [(f"t{i:04d}", [1.0] + [0.0] * 767, "h") for i in range(1500)]
    table = spark.createDataFrame(data, "part_id string, embedding array<float>, group_id string")
    short = search.packed(table, "embedding")
    assert short.agg(F.max(F.length("embedding"))).first()[0] <= 12 + 8 * 6
    queries = table.filter("part_id < 'p0040' or part_id = 't0700'").select(F.col("part_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit("q").alias("group_id"))
    vectors = np.array([v for _, v, _ in data])
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    place = {p: i for i, (p, _, _) in enumerate(data)}
    want = []
    for q in [f"p{i:04d}" for i in range(40)] + ["t0700"]:
        score = np.round(vectors @ vectors[place[q]], 9)
        best = sorted(range(len(data)), key=lambda i: (-score[i], data[i][0]))[:5]
        want += [(q, rank, data[i][0], score[i]) for rank, i in enumerate(best, 1)]
    for least in (float("-inf"), 0.55):
        found = search.knn_join(queries, short, 5, least=least)
        assert rows(found, "query_id", "rank", "part_id", "score") == sorted(w for w in want if w[3] >= least)


def test_vectors_of_another_size_stop_the_similarity_join(spark):
    queries = spark.createDataFrame([("q", [1.0, 2.0], "g")], "query_id string, vector array<float>, group_id string")
    table = spark.createDataFrame([("a", [1.0, 2.0], "h"), ("b", [1.0], "h")], "part_id string, embedding array<float>, group_id string")
    with pytest.raises(Exception, match="another size than 2"):
        search.knn_join(queries, table, 4, width=2).collect()


def test_vector_search_orders_and_refuses(spark):
    table = spark.createDataFrame(
        [("b", [1.0, 0.0], 1, True), ("a", [2.0, 0.0], 1, True), ("c", [-1.0, 0.0], 2, True), ("z", [0.0, 0.0], None, True), ("n", None, 1, True)],
        "part_id string, embedding array<float>, user_id long, confirmed boolean",
    )
    found = [(r.part_id, r.score) for r in search.vector_search(table, [1.0, 0.0], 20).collect()]
    with pytest.raises(ValueError, match="99 rows where 20"):
        search.vector_search(table, [1.0, 0.0], 99)
    assert found == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("z", 0.0)]
    assert [r.part_id for r in search.vector_search(table, [1.0, 0.0], 0).collect()] == ["a"]
    assert [r.part_id for r in search.vector_search(table, [1.0, 0.0], user_id=2).collect()] == ["c", "z"]


def test_answers(spark):
    df = spark.createDataFrame([
        ('{"linhas":["[sem texto]", null, {"text": "b"}]}', 4), ('```json\n{"linhas": "a\\nb\\n"}\n```', 2), ('x {"linhas":["um\\ndois"]} y', 2),
        ('{"linhas": 3}', 1), ("nada", 1), ('{"a":', 1),
    ], "a string, n int")
    got = [r[0] for r in df.select(response_texts(json_object(F.col("a")), F.col("n"))).collect()]
    assert got[:4] == [["", "", "b", ""], ["a", "b"], ["um", "dois"], [""]]
    assert [r[0] is None for r in df.select(json_object(F.col("a"))).collect()] == [False, False, False, False, True, True]
    kinds = spark.createDataFrame([("RuntimeError", "model runner died"), ("X", "timed out"), ("ResponseError", "x"), ("ValueError", "x")], "c string, m string")
    assert [r[0] for r in kinds.select(failure_kind(F.col("c"), F.col("m"))).collect()] == ["runner", "timeout", "retry", ""]


def test_embedding_answers(spark):
    df = spark.createDataFrame([
        ('{"embeddings": [[0.1, 0.2], [0.3, 0.4]]}',), ('{"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}',),
        ('{"embeddings": [[0.1, 0.2]]}',), ('{"embeddings": [[0.1], [0.2]]}',), ('{"data": [{"index": 0}, {"index": 1, "embedding": [1, 2]}]}',),
    ], "p string")
    found, error = parse_embeddings(F.col("p"), F.lit(2), 2)
    got = df.select(found.alias("v"), error.alias("e")).collect()
    assert got[0].v == [[0.1, 0.2], [0.3, 0.4]] and got[1].v == [[1.0, 2.0], [3.0, 4.0]]
    assert [r.e for r in got] == [None, None, "count", "size", "invalid"]


def test_wrong_vector_size_stops_the_job(spark):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="vectors of size"):
        embedding.embed_texts(df, lambda: lambda texts: [[0.0] for _ in texts], width=2).collect()


def test_second_reading_over_several_groups(spark):
    """Two pages and three read groups: gaps that share a neighbour, a group whose second answer is short, one without precedents."""
    firsts = {
        ("p001", 1): ["casa [ilegível] do rio fundo", "sem falha nenhuma", "ponte [ILEGIVEL] da serra alta"],
        ("p001", 2): ["casa velha [ilegível] rio fundo", "outra [ilegível] linha do rio fundo"],
        ("p002", 1): ["[ilegível] qualquer coisa distinta"],
    }
    seconds = {("p001", 1): ["casa nova do rio fundo", "nunca usada", " "], ("p001", 2): ["só uma"], ("p002", 1): ["nem pedida"]}
    boxes = {"p001": [(f"a{i}", (0, 60 * i, 200, 60 * i + 40)) for i in range(3)] + [(f"b{i}", (0, 600 + 60 * i, 200, 640 + 60 * i)) for i in range(2)], "p002": [("c0", (0, 0, 200, 40))]}
    lines = None
    for page_id, held in boxes.items():
        more = page(spark, *[(i, box, True, [(f"pt_{page_id}_{i}", "")]) for i, box in held], page_id=page_id)
        lines = more if lines is None else lines.unionByName(more)
    pages = spark.createDataFrame([("p001", 300, 900), ("p002", 300, 900)], "page_id string, width int, height int")
    known = [("k1", "casa velha do rio fundo", True), ("k2", "ponte nova da serra alta", True), ("k3", "casa  velha do rio fundo", True), ("k4", "outra casa do rio fundo", False)]
    table = embedding.embed_texts(spark.createDataFrame(known, "part_id string, text string, confirmed boolean")).withColumns(
        {"user_id": F.lit(None).cast("bigint"), "updated_at": F.current_timestamp()}
    )

    def factory():
        def ask(prompt, row):
            key = (row["page_id"], row["group_no"])
            if "fraseado parecido" not in prompt:
                return json.dumps({"linhas": firsts[key]})
            assert prompt.count("- casa velha do rio fundo") == 1 and "outra casa do rio fundo" not in prompt
            assert ("- ponte nova da serra alta" in prompt) == (key == ("p001", 1))
            return json.dumps({"linhas": seconds[key]} if key != ("p001", 2) else {"linhas": None})

        return ask

    out, outcome = transcribe.read_lines(lines, pages, factory, table=table)
    texts = {(r.page_id, r.line_id): (r.parts[0].text, r.parts[0].confirmed) for r in out.collect()}
    assert texts == {
        ("p001", "a0"): ("casa nova do rio fundo", False), ("p001", "a1"): ("sem falha nenhuma", False), ("p001", "a2"): ("ponte [ILEGIVEL] da serra alta", False),
        ("p001", "b0"): ("casa velha [ilegível] rio fundo", False), ("p001", "b1"): ("outra [ilegível] linha do rio fundo", False),
        ("p002", "c0"): ("[ilegível] qualquer coisa distinta", False),
    }
    assert {r.status for r in outcome.collect()} == {"done"}


def test_a_failed_group_leaves_the_others(spark):
    lines = page(spark, *[(f"l{i:02d}", (0, 60 * i, 90, 60 * i + 40), True, [(f"p{i}", "")]) for i in range(12)])
    pages = spark.createDataFrame([("p001", 100, 800), ("p002", 100, 800)], "page_id string, width int, height int")

    def factory():
        def ask(prompt, row):
            if row["group_no"] == 1:
                raise RuntimeError("caiu a rede")
            return '{"linhas": ["ok", "ok", "ok", "ok"]}'

        return ask

    out, outcome = transcribe.read_lines(lines, pages, factory)
    assert out.filter("parts[0].text = 'ok'").count() == 4
    found, idle = sorted(outcome.collect(), key=lambda r: r.page_id)
    assert (idle.groups, idle.status, idle.message) == (0, "done", "Nenhuma linha vazia para ler.")
    assert (found.groups, found.failures, found.status) == (2, 1, "partial")
    assert found.message == "Leitura parcial. D-001 a D-008: caiu a rede"


def test_rounds_of_repeated_calls(spark, tmp_path):
    """Kinds wait once each, on the driver; nothing that is answered or final is asked again; requests are dealt out."""
    folder = str(tmp_path)
    errors = {"slow": "timed out", "dead": "model runner has unexpectedly stopped", "final": "mal formado"}
    requests = spark.createDataFrame(
        [("p001", n, f"{kind}-{n}") for n, kind in enumerate(["fine", "slow", "dead", "final", "never"] * 40)], "page_id string, group_no int, prompt string"
    ).coalesce(1)

    def factory():
        def ask(prompt, row):
            asked = len(glob.glob(f"{folder}/{prompt}.*"))
            open(f"{folder}/{prompt}.{asked}.{os.getpid()}.{row['group_no'] // 64}", "w").close()
            kind = prompt.split("-")[0]
            if kind == "never" or (kind in errors and (asked == 0 or kind == "final")):
                raise RuntimeError(errors.get(kind, "timed out"))
            return f"{prompt} {asked}"

        return ask

    waits = []
    out = {r.prompt: (r.answer, r.failure) for r in reading.ask_groups(requests, factory, 3, wait=waits.append, per_task=16).collect()}
    calls = Counter(os.path.basename(f).split(".")[0].split("-")[0] for f in glob.glob(f"{folder}/*"))
    assert len(out) == 200 and calls == {"fine": 40, "slow": 80, "dead": 80, "final": 40, "never": 120}
    assert all(out[f"fine-{n}"] == (f"fine-{n} 0", None) for n in range(0, 200, 5))
    assert all(out[f"{k}-{n}"] == (f"{k}-{n} 1", None) for at, k in ((1, "slow"), (2, "dead")) for n in range(at, 200, 5))
    assert out["final-3"] == (None, "mal formado") and out["never-4"] == (None, "timed out")
    # first round: 20 s for what timed out, 25 more for the runner; second round: 20 s for what never comes
    assert waits == [20.0, 25.0, 20.0]
    dealt = reading._dealt(requests, 16)
    sizes = [len(list(p)) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == max(13, spark.sparkContext.defaultParallelism) and max(sizes) < 45
    assert reading.ask_groups(requests.limit(0), factory, wait=waits.append).collect() == []


@pytest.mark.parametrize("block", [8192, 7])
def test_threshold_join_equals_all_pairs(spark, block):
    rnd = random.Random(8)
    vector = lambda: [float(rnd.choice([0] * 9 + [1, 1, 2, 5])) for _ in range(40)]
    data = [(f"v{i:03d}", vector(), f"g{i % 7}") for i in range(260)] + [("zero", [0.0] * 40, "z"), ("none", None, "z"), ("twin", None, None)]
    data[-1] = ("twin", data[0][1], None)
    queries = spark.createDataFrame([("q" + i, v, g) for i, v, g in data[:80] + data[-3:]], "query_id string, vector array<float>, group_id string")
    table = spark.createDataFrame(data, "part_id string, embedding array<float>, group_id string")
    everything = search.knn_join(queries, table, len(data), width=40)
    for least, k in ((0.55, 4), (0.7, 3), (0.2, 6)):
        found = threshold.threshold_join(queries, table, least, k, width=40, block=block)
        want = everything.filter((F.col("score") >= least) & (F.col("rank") <= k))
        assert rows(found, "query_id", "rank", "part_id", "score") == rows(want, "query_id", "rank", "part_id", "score")
    assert threshold.threshold_join(queries.limit(0), table, 0.5, width=40).collect() == []
    assert threshold.threshold_join(queries, table.limit(0), 0.5, width=40).collect() == []


def test_few_pairs_are_scored(spark):
    """Where words are rare, lists are short; and both ways give the same neighbours."""
    rnd = random.Random(3)
    vector = lambda: [float(v) for v in np.bincount([rnd.randrange(300) for _ in range(12)], minlength=300)]
    data = [(f"v{i:04d}", vector(), f"g{i % 9}", f"t{i}") for i in range(900)]
    data += [(f"w{i:04d}", [x + (k == 7) for k, x in enumerate(data[i][1])], "h", f"t{i}") for i in range(300)]
    table = spark.createDataFrame(data, "part_id string, embedding array<float>, group_id string, text string")
    gaps = table.filter("part_id < 'v0400'").select(F.col("part_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id")
    assert 300 <= threshold.prefix_index(gaps, table, 0.55).scored_pairs() < 0.35 * 400 * 1200
    columns = ["query_id", "part_id", "rank", "score", "neighbour"]
    assert rows(precedents.gap_neighbours(gaps, table, sparse=True), *columns) == rows(precedents.gap_neighbours(gaps, table), *columns)


def test_rounds_have_a_bounded_number_of_tasks(spark):
    requests = spark.range(1000).select(F.lit("p001").alias("page_id"), F.col("id").cast("int").alias("group_no"))
    cores = spark.sparkContext.defaultParallelism
    assert reading._dealt(requests, 1).rdd.getNumPartitions() == reading.MOST_TASKS * cores
    assert reading._dealt(requests, 500).rdd.getNumPartitions() == max(cores, 2)
