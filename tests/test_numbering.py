"""Reading order, specks, passages and second detections on pages of our own."""
import random

import pytest
from pyspark.sql import functions as F

from conftest import page, rows
from folioscope.operators import catalog, numbering, passages, redetect, spread
from folioscope.operators.fragments import drop_fragments
from folioscope.plans import desk


def stack(name, x0, x1, tops, height=25):
    return [(f"{name}{i}", (x0, y, x1, y + height), True, [(f"{name}{i}p", f"texto {name}{i}")]) for i, y in enumerate(tops)]


def test_numbers_follow_the_page_and_skip_what_is_left_out(spark):
    lines = page(
        spark,
        ("rodape", (50, 900, 700, 930), False, [("r1", "nota solta")]),
        ("corpo", (50, 300, 700, 330), True, [("k1", "um trecho"), ("k2", "outro"), ("k3", "fim")]),
        ("vazia", (50, 500, 700, 530), True, []),
        ("titulo", (60, 100, 640, 150), True, [("t1", "Livro de contas")]),
    )
    numbered = numbering.number_parts(lines)
    assert rows(numbered, "line_id", "linha_documento", "parte", "linha_transcrita") == [
        ("corpo", 2, 1, 2), ("corpo", 2, 2, 3), ("corpo", 2, 3, 4), ("rodape", 4, 1, None), ("titulo", 1, 1, 1), ("vazia", 3, None, None),
    ]
    labels = dict(rows(numbering.line_labels(numbered), "line_id", "label"))
    assert labels == {"titulo": "D-001  T-001", "corpo": "D-002  T-002–004", "vazia": "D-003  sem T", "rodape": "D-004  sem T"}


@pytest.mark.parametrize("shift", [0, 37, 2500])
def test_two_columns_are_read_one_after_the_other(spark, shift):
    left, right = stack("e", 30 + shift, 480 + shift, (15, 90, 210, 333)), stack("d", 560 + shift, 1010 + shift, (12, 95, 205))
    mixed = left + right
    random.Random(shift).shuffle(mixed)
    found = [r.line_id for r in numbering.number_lines(page(spark, *mixed)).orderBy("linha_documento").collect()]
    assert found == ["e0", "e1", "e2", "e3", "d0", "d1", "d2"]


def test_one_page_of_many_lines_and_inverted_boxes(spark):
    n = 150_000
    boxes = spark.range(n).select(
        F.lit("p001").alias("page_id"), F.format_string("l%06d", "id").alias("line_id"), F.col("id").cast("int").alias("line_pos"),
        F.when(F.col("id") % 1000 == 7, 400).otherwise(40).alias("x0"), (F.col("id") * 3).cast("int").alias("y0"),
        F.when(F.col("id") % 1000 == 7, 40).otherwise(400).alias("x1"), (F.col("id") * 3 + 2).cast("int").alias("y1"), F.lit(True).alias("include"),
    )
    numbered = numbering.number_lines(boxes)
    assert numbered.filter(F.col("linha_documento") != F.col("line_pos") + 1).count() == 0
    assert numbered.count() == n


def test_numbering_runs_no_job_and_moves_no_texts(spark, tiny):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    plan = numbering.number_parts(numbering.without_texts(desk.lines(spark, tiny, marks=False))).select("part_id", "linha_transcrita")
    catalog.page_stats(desk.lines(spark, tiny, marks=False))
    # reading a table's schema is the only work before an action
    assert len(tracker.getJobIdsForGroup("building")) <= 2
    spark.sparkContext.setJobGroup("other", "")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(page_id") == 1


def test_specks_between_columns_leave(spark):
    book = stack("a", 100, 950, range(20, 420, 45)) + stack("b", 1200, 2000, range(25, 420, 45))
    assert drop_fragments(page(spark, *book, ("mancha", (1040, 200, 1075, 230), True, []))).count() == len(book)
    # a short word under full lines is no speck
    below = [*stack("a", 100, 950, range(20, 420, 45)), ("fim", (300, 470, 390, 500), True, [])]
    assert drop_fragments(page(spark, *below)).count() == len(below)


def test_passages_are_written_parts(spark):
    lines = page(
        spark, ("x", (5, 5, 90, 20), True, [("x1", "\t dez arrobas  ", True), ("x2", "")]), ("y", (5, 30, 90, 45), False, [("y1", "à margem")]),
        ("z", (5, 60, 90, 75), True, [("z1", " \n ")]),
    )
    found = passages.passages(numbering.number_parts(lines))
    assert rows(found, "part_id", "text", "linha_documento", "linha_transcrita", "confirmed") == [
        ("x1", "dez arrobas", 1, 1, True), ("y1", "à margem", 2, None, False),
    ]


def test_a_second_detection_keeps_what_was_written(spark):
    lines = page(
        spark, ("m", (20, 100, 500, 140), True, [("m1", "conta de março", True)]), ("n", (20, 300, 500, 340), True, []),
        ("o", (20, 700, 500, 740), True, [("o1", "sem par")]), ("q", (20, 900, 500, 940), True, [("q1", "  ")]),
    )
    boxes = spark.createDataFrame(
        [("p001", i, 25, y, 510, y + 42) for i, y in enumerate((112, 305, 520))], "page_id string, box_pos int, x0 int, y0 int, x1 int, y1 int"
    )
    out = {r.line_id: r for r in redetect.redetect(lines, boxes).collect()}
    assert (out["m"].y0, out["m"].parts[0].text, out["m"].parts[0].confirmed) == (112, "conta de março", True)
    assert out["n"].y0 == 305 and len(out["n"].parts) == 1
    assert out["o"].y0 == 700 and "q" not in out and len(out) == 4


def test_box_matching_against_every_pair(spark):
    rng = random.Random(11)
    lines = [(f"l{i}", (10, y, 90, y + rng.choice([5, 20, 60])), True, []) for i, y in enumerate(rng.choices(range(600), k=60))]
    boxes = [("p001", i, 10, y, 90, y + rng.choice([8, 25])) for i, y in enumerate(rng.choices(range(600), k=70))]
    found = redetect.match_boxes(page(spark, *lines), spark.createDataFrame(boxes, "page_id string, box_pos int, x0 int, y0 int, x1 int, y1 int"))
    got = {r.box_pos: r.line_pos for r in found.collect() if r.box_pos is not None}
    free = dict(enumerate(b for _, b, _, _ in lines))
    for _, i, _, y0, _, y1 in boxes:
        share = {k: max(0, min(b[3], y1) - max(b[1], y0)) / max(1, min(b[3] - b[1], y1 - y0)) for k, b in free.items()}
        best = min(share, key=lambda k: (-share[k], k))
        assert got[i] == (best if share[best] > 0.4 else None)
        if got[i] is not None:
            del free[best]


def test_positions_are_dense_and_run(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(6)
    placed = spread.positions(df, [F.col("v")], "at", running={"sum": F.col("v")}).orderBy("v").collect()
    assert [(r.v, r.at, r["sum"]) for r in placed] == [(i, i + 1, i * (i - 1) // 2) for i in range(1000)]
