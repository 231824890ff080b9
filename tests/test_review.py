import pytest
from pyspark.sql import functions as F

from folioscope.operators import edits, numbering, review, spread
from conftest import page, rows

PARTS = "page_id string, part_id string, text string, confirmed boolean, skipped boolean"


@pytest.mark.parametrize(
    "new, old, marks",
    [
        (("", True, True), ("x", True, False), (False, False)),
        (("x", True, True), None, (True, False)),
        (("x", False, True), ("x", True, False), (False, True)),
        (("x", False, True), None, (False, True)),
        (("y", False, True), ("x", True, False), (False, False)),
        (("x", False, False), None, (True, False)),
        (("y", False, False), ("x", True, False), (False, False)),
        (("x", False, False), ("x", True, False), (True, False)),
        (("x", False, False), ("x", False, True), (False, True)),
    ],
)
def test_marks_after_a_save(spark, new, old, marks):
    saved = spark.createDataFrame([("p001", "a", *new)], PARTS)
    stored = spark.createDataFrame([("p001", "a", *old)] if old else [], PARTS)
    found = review.apply_confirmation(saved, stored).first()
    assert (found.confirmed, found.skipped) == marks


def test_model_texts_fill_blank_lines_and_clear_marks(spark):
    lines = page(
        spark, ("one", (0, 0, 9, 9), True, [("p1", " ", False, False)]), ("two", (0, 20, 9, 29), True, [("p2", "já corrigido", True)]),
        ("none", (0, 40, 9, 49), True, []),
    )
    readings = spark.createDataFrame([("p001", i, "lido") for i in ("one", "two", "none")], "page_id string, line_id string, text string")
    filled = {r.line_id: r.parts[0] for r in review.set_line_texts(lines, readings).collect()}
    assert filled["one"].text == "lido" and filled["two"].text == "já corrigido" and filled["two"].confirmed
    assert filled["none"].text == "lido" and filled["none"].part_id.startswith("pt_")
    forced = {r.line_id: r.parts[0] for r in review.set_line_texts(lines, readings, only_empty=False).collect()}
    assert forced["two"].text == "lido" and not forced["two"].confirmed


def test_bad_ids_reject_the_page(spark):
    good = page(spark, ("ok", (1, 1, 50, 20), True, []), page_id="p001")
    bad = page(spark, ("x", (1, 1, 50, 20), True, [("a", "")]), ("x", (1, 30, 50, 50), True, [("a", "")]), page_id="p002")
    pages = spark.createDataFrame([("p001", 40, 30), ("p002", 40, 30)], "page_id string, width int, height int")
    kept, broken = review.clean_lines(good.unionByName(bad), pages)
    assert rows(kept, "page_id", "x0", "y0", "x1", "y1") == [("p001", 1, 1, 40, 20)]
    assert rows(broken, "page_id", "kind", "item_id", "reason") == [("p002", "line", "x", "repeated"), ("p002", "part", "a", "repeated")]


EDITS = "page_id string, line_id string, op string, part_id string, text string, new_id string, x0 double, y0 double, x1 double, y1 double, ts timestamp, event_id long"


def log(spark, *ops):
    data = []
    for at, (line, op, part, text, new_id) in enumerate(ops):
        data.append(("p001", line, op, part, text, new_id, 1.0, 2.0, 300.0, 40.0, at))
    return spark.createDataFrame(data, EDITS.replace("ts timestamp, event_id", "event_id")).withColumn("ts", F.timestamp_seconds("event_id"))


def test_edits_in_log_order(spark):
    lines = page(spark, ("a", (0, 0, 99, 20), True, [("a1", "um", True, False), ("a2", "dois")]), ("b", (0, 30, 99, 50), True, [("b1", "x")]))
    pages = spark.createDataFrame([("p001", 200, 100, 1)], "page_id string, width int, height int, view_scale int")
    ops = log(
        spark,
        ("a", "split", "a1", None, "n1"), ("a", "split", "a1", None, "n2"), ("a", "text", "n2", "novo", None),
        ("a", "confirm", "n2", None, None), ("a", "text", "a1", " ", None), ("a", "remove_part", "a2", None, None),
        ("b", "delete_line", None, None, None), ("c", "draw", None, None, "drawn"),
    )
    out = edits.apply_line_edits(lines, ops, pages)
    parts = numbering.part_rows(out.filter("line_id = 'a'")).orderBy("parte").collect()
    assert [(p.part_id, p.text, p.confirmed) for p in parts] == [("a1", " ", False), ("n2", "novo", True), ("n1", "", False)]
    assert rows(out, "line_id", "x1")[-1] == ("drawn", 200) and out.filter("line_id = 'b'").count() == 0
    reduced = edits.reduce_edits(ops)
    assert reduced.count() <= ops.count()
    again = edits.apply_line_edits(lines, reduced, pages)
    assert rows(numbering.part_rows(again), "line_id", "part_id", "text", "confirmed") == rows(numbering.part_rows(out), "line_id", "part_id", "text", "confirmed")


def test_queue_positions_over_many_partitions(spark):
    """Neighbours across partition and batch borders, and no more exchanges than the sort, the totals and the pages."""
    n = 5000
    rows = spark.range(n).select(F.format_string("p%02d", F.pmod(F.xxhash64("id"), F.lit(23))).alias("page_id"), F.format_string("k%05d", "id").alias("part_id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = spread.queue_positions(rows, [F.col("page_id"), F.col("part_id")], "part_id")
        found = [tuple(r) for r in got.orderBy("position").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(map(tuple, rows.collect()))
    assert found == [
        (p, k, i + 1, n, want[i - 1][1] if i else None, want[i + 1][1] if i + 1 < n else None) for i, (p, k) in enumerate(want)
    ]
    assert spread.queue_positions(rows.limit(0), [F.col("part_id")], "part_id").collect() == []
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1  # the partitions' totals
