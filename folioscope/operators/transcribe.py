"""Batch transcription end to end: pending lines to texts, with a second reading of gaps."""
from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import has_gap
from folioscope.operators import geometry, precedents, reading, review
from folioscope.operators.embedding import Model, embed_texts
from folioscope.operators.passages import confirmed_texts
from folioscope.operators.search import packed, searchable
from folioscope.operators.spread import durable

Ask = Callable[[], reading.Ask]


def _requests(prompts: DataFrame, crops: DataFrame, groups: DataFrame) -> DataFrame:
    """Prompts with the crop rectangles of their lines (a group has a handful of lines)."""
    rectangles = (
        groups.join(crops.select("page_id", "linha_documento", "crop_x0", "crop_y0", "crop_x1", "crop_y1"), ["page_id", "linha_documento"])
        .groupBy("page_id", "group_no")
        .agg(F.array_sort(F.collect_list(F.array("linha_documento", "crop_x0", "crop_y0", "crop_x1", "crop_y1"))).alias("crops"))
    )
    return prompts.join(rectangles, ["page_id", "group_no"], "left")


def corrections(
    readings: DataFrame,
    groups: DataFrame,
    pending: DataFrame,
    table: DataFrame,
    ask_factory: Ask,
    model_factory: Callable[[], Model] | None = None,
    gutters: DataFrame | None = None,
    crops: DataFrame | None = None,
    forms: list[str] | None = None,
    user_id: int | None = None,
    wait: reading.Wait = time.sleep,
) -> DataFrame:
    """Gapped readings looked up among confirmed rows and read again with what was found.

    readings: page_id, group_no, position, linha_documento, text. Returns the same rows with
    texts replaced where the second reading fills a gap.
    """
    group_id = F.concat_ws("#", "page_id", F.col("group_no").cast("string"))
    first = readings.withColumn("group_id", group_id)
    gaps = embed_texts(
        precedents.gap_queries(first).select(
            F.concat_ws("#", "group_id", F.col("position").cast("string")).alias("query_id"), "group_id", "position", "query"
        ),
        model_factory, text="query",
    ).withColumnRenamed("embedding", "vector")
    gaps = durable(packed(gaps, "vector"))
    # The parts being read are no precedents of their own group.
    own = pending.select("page_id", "linha_documento", F.explode("part_ids").alias("part_id")).join(
        groups.withColumn("group_id", group_id), ["page_id", "linha_documento"]
    ).select("part_id", "group_id")
    known = packed(searchable(table, user_id, confirmed_only=True).select("part_id", "text", "embedding"), "embedding")
    candidates = durable(known.join(own, "part_id", "left"))
    close = precedents.gap_neighbours(gaps, candidates)
    found = precedents.gap_precedents(close, gaps)
    listed = found.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("_n")).select(
        F.substring_index("group_id", "#", 1).alias("page_id"),
        F.substring_index("group_id", "#", -1).cast("int").alias("group_no"),
        F.transform("_n", lambda n: n["neighbour"]).alias("neighbours"),
    )
    again = reading.build_prompts(
        groups.join(listed.select("page_id", "group_no"), ["page_id", "group_no"], "left_semi"), gutters, forms, listed
    )
    if crops is not None:
        again = _requests(again, crops, groups)
    answered = reading.ask_groups(again, ask_factory, wait=wait)
    second = reading.line_readings(groups, reading.parsed_answers(answered)).withColumn("group_id", group_id)
    return precedents.merge_reread(first, second.select("group_id", "position", "text")).drop("group_id")


def read_lines(
    lines: DataFrame,
    pages: DataFrame,
    ask_factory: Ask,
    only_empty: bool = True,
    table: DataFrame | None = None,
    model_factory: Callable[[], Model] | None = None,
    user_id: int | None = None,
    wait: reading.Wait = time.sleep,
) -> tuple[DataFrame, DataFrame]:
    """(lines with the readings, outcome per page). `table`, the passage index, turns precedents on.

    Answers are written to the checkpoint folder round by round, so that no call is repeated when a later stage is. `wait`
    is called on the driver with the seconds to wait before a round of repeated calls.
    """
    # These tables feed several steps.
    pending = durable(review.pending_lines(lines, only_empty))
    groups = durable(reading.read_groups(pending))
    gutters = durable(geometry.page_gutters(lines, pages))
    crops = geometry.line_crops(pending, pages, gutters)
    forms = None
    if table is not None:
        recent = confirmed_texts(searchable_texts(table, user_id))
        forms = [row["form"] for row in precedents.word_forms(recent).collect()]  # 40 at most
    requests = _requests(reading.build_prompts(groups, gutters, forms), crops, groups)
    answered = durable(reading.parsed_answers(reading.ask_groups(requests, ask_factory, wait=wait)))
    readings = reading.line_readings(groups, answered)
    if table is not None and not readings.filter(has_gap(F.col("text"))).isEmpty():
        readings = corrections(
            readings, groups, pending, table, ask_factory, model_factory, gutters, crops, forms, user_id, wait
        )
    by_line = readings.join(pending.select("page_id", "linha_documento", "line_id"), ["page_id", "linha_documento"])
    written = review.set_line_texts(lines, by_line, only_empty)
    spans = reading.group_spans(groups).select("page_id", "group_no", "span")
    outcome = reading.reading_outcome(
        spans.join(answered.select("page_id", "group_no", "failure"), ["page_id", "group_no"], "left"), pages
    )
    return written, outcome


def searchable_texts(table: DataFrame, user_id: int | None) -> DataFrame:
    """Rows whose texts a user may learn from; they need no vector."""
    return table if user_id is None else table.filter((F.col("user_id") == user_id) | F.col("user_id").isNull())
