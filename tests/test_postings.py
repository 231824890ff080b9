"""Posting lists give the rows of the plain search, and few texts are candidates."""
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import postings, search
from conftest import rows

SCHEMA = "page_id string, line_id string, part_id string, linha_documento int, parte int, text string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rnd = random.Random(6)
    words = ["Água", "agua", "àguas", "rio", "do", "moinho", "Moínho", "x", "é", "São", "sao", "ponté", "日本語", "", "  ", "a b"]
    data = [(f"p{i % 40:02d}", f"l{i}", f"t{i:05d}", i // 40, 1, " ".join(rnd.choices(words, k=rnd.randrange(6)))) for i in range(9000)]
    data += [("p99", "l", f"u{i}", i, 1, None) for i in range(3)] + [("p98", "l", "v", 1, 1, "raridade única no moinho")]
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    root = str(tmp_path_factory.mktemp("postings"))
    postings.write_postings(frame, root, 8)
    return frame, root


@pytest.mark.parametrize("query", ["agua", " ÁGUA rio ", "moinho do", "sao", "x", "é", "do", "日本語", "a b", "raridade moinho", "ponte", "nada disso", "zzz", "água  rio", "r"])
def test_same_hits_as_reading_every_text(spark, table, query):
    frame, root = table
    columns = ["page_id", "part_id", "text"]
    assert rows(postings.indexed_hits(spark, root, query, 8), *columns) == rows(search.literal_hits(frame, query), *columns)


def test_candidates_and_totals(spark, table):
    frame, root = table
    assert postings.candidates(spark, root, postings.query_grams("raridade moinho"), 8).count() == 1
    many = search.literal_hits(frame, "agua rio").count()
    assert many <= postings.candidates(spark, root, postings.query_grams("agua rio"), 8).count() < frame.count() / 2
    found = postings.indexed_search(spark, root, "agua rio", first=5, size=7, buckets=8)
    want = search.literal_search(frame, "agua rio", first=5, size=7)
    assert rows(found, *want.columns) == rows(want, *want.columns)
    assert {r.total for r in found.collect()} == {many}
    # a word of two letters has no trigram: every text is read
    assert postings.query_grams("do") == [] and postings.query_grams("do rio") == ["rio"]


def test_lists_are_sorted_and_bounded(spark, table):
    _, root = table
    lists = spark.read.parquet(f"{root}/postings")
    assert lists.filter(F.size("places") > 1 << postings.CHUNK_BITS).count() == 0
    assert lists.filter(F.array_sort("places") != F.col("places")).count() == 0


def test_lists_of_a_chunk_hold_every_trigram_once():
    texts = ["abab", "", "ab", "日本語𝄞x", "a\x00b\x00", "xabab"]
    found = postings.chunk_lists(3, [0, 1, 2, 5, 7, 4095], texts).to_pylist()
    want = {}
    for place, text in zip([0, 1, 2, 5, 7, 4095], texts):
        for gram in {text[i : i + 3] for i in range(len(text) - 2)}:
            want.setdefault(gram, []).append(place)
    assert {r["gram"]: r["places"] for r in found} == want and {r["chunk"] for r in found} == {3} and len(found) == len(want)
    assert postings.chunk_lists(0, [0], ["ab"]).num_rows == 0


def test_only_candidates_are_folded(spark, table):
    """The match stands above the join with the candidates in the plan, and not at the scan of all texts."""
    _, root = table
    plan = postings.indexed_hits(spark, root, "agua rio", 8)._jdf.queryExecution().optimizedPlan().toString()
    join = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    assert not any("translate" in line for line in plan.splitlines()[join + 1 :]) and "translate" in plan


def test_fold_and_strip_of_plain_and_other_texts(spark):
    from folioscope.functions import text as tx

    data = ["", " ", "Abc", " Abc\n", "Água ", "é x", "x ", " x y\x85", "\ta b\x1c", "İi", None, "a", " 𝄞 ", "x\r\n", "ÀB\x0b"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").select(
        "i", tx.strip(F.col("x")), tx.fold(F.col("x")), F.regexp_replace("x", f"^{tx.SPACE}+|{tx.SPACE}+$", ""),
        F.lower(F.regexp_replace(F.translate("x", *tx._fold_table()), r"\p{M}+", "")),
    )
    assert all(r[1] == r[3] and r[2] == r[4] for r in got.collect())
