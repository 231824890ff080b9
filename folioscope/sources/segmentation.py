"""Segmenter output to line boxes."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.boxes import segment_box
from folioscope.operators.fragments import drop_fragments

_BOXES = "lines array<struct<box:array<double>>>"


def read_segmentation(answers: DataFrame, column: str = "payload") -> DataFrame:
    """{"lines": [{"box": [x0, y0, x1, y1]}]} per page to rows; boxes without four values are left out."""
    keep = [c for c in answers.columns if c != column]
    rows = answers.select(*keep, F.posexplode(F.from_json(column, _BOXES)["lines"]).alias("line_pos", "_line"))
    box = F.col("_line.box")
    return rows.filter(F.size(box) == 4).select(
        *keep, "line_pos", *[box[i].cast("int").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    )


def segmentation_boxes(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Polygons or baselines to padded, clipped boxes without unusable ones and without specks."""
    sized = segments.join(pages.select("page_id", "width", "height"), "page_id")
    boxes = sized.withColumn(
        "_box", segment_box(F.col("boundary"), F.col("baseline"), F.col("width"), F.col("height"))
    ).filter("_box IS NOT NULL").select("page_id", "line_pos", "_box.*")
    return drop_fragments(boxes)
