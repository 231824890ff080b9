"""New boxes matched with stored lines, so that a second detection keeps the texts."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.boxes import CORNERS
from folioscope.functions.text import has_text
from folioscope.operators.fragments import drop_fragments
from folioscope.operators.review import derived_id, empty_part
from folioscope.settings import REDETECT_OVERLAP


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _taken(box_y0: pd.Series, box_y1: pd.Series, line_y0: pd.Series, line_y1: pd.Series) -> pd.Series:
    """Per part of a page: for each box in turn the unused line it overlaps most in height, the earliest of equals; -1 for none."""
    out = []
    for tops, bottoms, old_tops, old_bottoms in zip(box_y0, box_y1, line_y0, line_y1):
        # Lines by top; no line is taller than `tallest`, so those a box can touch lie in one window of the order.
        order = np.argsort(old_tops, kind="stable")
        sorted_tops = old_tops[order]
        tallest = int((old_bottoms - old_tops).max(initial=0))
        free = np.ones(len(old_tops), dtype=bool)
        taken = np.full(len(tops), -1, dtype="int32")
        first = np.searchsorted(sorted_tops, np.asarray(tops) - tallest, side="left")
        last = np.searchsorted(sorted_tops, bottoms, side="right")
        for i in range(len(tops)):
            near = np.sort(order[first[i] : last[i]])
            near = near[free[near]]
            if not len(near):
                continue
            shared = np.minimum(old_bottoms[near], bottoms[i]) - np.maximum(old_tops[near], tops[i])
            smaller = np.minimum(old_bottoms[near] - old_tops[near], bottoms[i] - tops[i])
            ratio = np.maximum(0, shared) / np.maximum(1, smaller)
            best = int(np.argmax(ratio))
            if ratio[best] > REDETECT_OVERLAP:
                taken[i] = near[best]
                free[near[best]] = False
        out.append(taken)
    return pd.Series(out)


def _pairs(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, box, line): every box with the line it takes over or null, and every line no box took with a null box.

    A page is cut where no interval of heights crosses: rows by their top, a new part where one begins below all bottoms so
    far. No match crosses a cut, so parts are matched apart, and an array holds one part's rows and never a page's.
    """
    def side(frame: DataFrame, name: str, pos: str) -> DataFrame:
        known = {"line_id": "string", "include": "boolean", "parts": lines.schema["parts"].dataType}
        fields = [F.col(c) if c in frame.columns and name == "line" else F.lit(None).cast(kind).alias(c) for c, kind in known.items()]
        return frame.select("page_id", F.lit(name).alias("side"), F.col(pos).cast("bigint").alias("pos"), *CORNERS, *fields)

    rows = side(boxes, "box", "box_pos").unionByName(side(lines, "line", "line_pos"))
    order = W.partitionBy("page_id").orderBy("y0", "y1", "side", "pos")
    above = F.max("y1").over(order.rowsBetween(W.unboundedPreceding, -1))
    cut = rows.withColumn("_new", F.when(above.isNull() | (F.col("y0") >= above), 1).otherwise(0))
    parted = cut.withColumn("_part", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    item = F.struct("pos", *CORNERS, "line_id", "include", "parts")
    sides = parted.groupBy("page_id", "_part").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "box", item))).alias("b"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "line", item))).alias("l"),
    )
    chosen = sides.withColumn("t", _taken("b.y0", "b.y1", "l.y0", "l.y1"))
    none = F.lit(None).cast(sides.schema["b"].dataType.elementType)
    boxed = F.transform(
        "b", lambda box, i: F.struct(box.alias("box"), F.when(F.get("t", i) >= 0, F.get(F.col("l"), F.get("t", i))).otherwise(none).alias("line"))
    )
    indexes = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.size("l") - 1)).otherwise(F.array().cast("array<int>"))
    left = F.transform(F.array_except(indexes, "t"), lambda i: F.struct(none.alias("box"), F.get(F.col("l"), i).alias("line")))
    return chosen.select("page_id", F.inline(F.concat(boxed, left)))


def match_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, box_pos, line_pos): which stored line each new box takes over, and which lines are left."""
    return _pairs(lines, boxes).select("page_id", F.col("box.pos").alias("box_pos"), F.col("line.pos").alias("line_pos"))


def redetect(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines after a second detection: boxes in order, then stored lines with text that no box took; specks out."""
    boxed, known = F.col("box").isNotNull(), F.col("line").isNotNull()
    corners = [F.when(boxed, F.col(f"box.{c}")).otherwise(F.col(f"line.{c}")).cast("int") for c in CORNERS]
    fresh_id = derived_id("ln", "page_id", F.col("box.pos").cast("string"), F.concat_ws(",", *[F.col(f"box.{c}") for c in CORNERS]))
    written = F.exists("line.parts", lambda p: has_text(p["text"]))
    parts = (
        F.when(~known, F.array(empty_part("page_id", fresh_id)))
        .when(boxed & F.col("line.include") & (F.size("line.parts") == 0), F.array(empty_part("page_id", "line.line_id")))
        .otherwise(F.col("line.parts"))
    )
    result = _pairs(lines, boxes).filter(boxed | written).select(
        "page_id",
        F.coalesce("line.line_id", fresh_id).alias("line_id"),
        # Left-over lines come after all boxes.
        F.when(boxed, F.col("box.pos")).otherwise(F.col("line.pos") + F.lit(1 << 40)).alias("line_pos"),
        *[value.alias(c) for value, c in zip(corners, CORNERS, strict=True)],
        F.coalesce("line.include", F.lit(True)).alias("include"),
        parts.alias("parts"),
    )
    return drop_fragments(result)
