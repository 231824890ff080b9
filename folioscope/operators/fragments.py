"""Narrow boxes that are specks between columns, not lines.

A narrow box stays when more than half of its width lies under at least two wide boxes. A wide
box is wider than the narrow one, so it covers more than half of it exactly when it reaches past
the narrow box's middle on both sides. Counting the wide boxes over a point takes a running sum
of starts and ends along x; no box is paired with another.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Fixed values of the rule.
MIN_BOXES = 8
MIN_LINE_WIDTH = 48
MEDIAN_SHARE = 0.15
MIN_COVER = 2
MIN_KEPT = 4

# At one x: ends go first, then middles, then starts, so that touching is not covering.
_END, _MIDDLE, _START = 0, 1, 2


def _limit(median: Column) -> Column:
    return F.greatest(F.lit(MIN_LINE_WIDTH), (median * F.lit(MEDIAN_SHARE)).cast("int"))


def _kept(frame: DataFrame) -> Column:
    wide_enough = F.col("_width") >= F.col("_limit")
    return wide_enough | ((F.col("_width") > 0) & (F.col("_cover") >= MIN_COVER))


def _events() -> Column:
    """Doubled x positions: a wide box starts and ends, a narrow box asks at its middle."""

    def event(at: Column, kind: int, change: int) -> Column:
        return F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.lit(change).alias("change"))

    wide = F.array(event(2 * F.col("x0"), _START, 1), event(2 * F.col("x1"), _END, -1))
    narrow = F.array(event(F.col("x0") + F.col("x1"), _MIDDLE, 0))
    return F.when(F.col("_width") >= F.col("_limit"), wide).otherwise(narrow)


def flag_fragments(lines: DataFrame) -> DataFrame:
    """Adds keep: false for specks."""
    page = W.partitionBy("page_id")
    by_width = page.orderBy("_width")
    ranked = lines.withColumn("_width", F.col("x1") - F.col("x0")).select(
        "*", F.count("*").over(page).alias("_n"), F.row_number().over(by_width).alias("_rank")
    )
    median = F.max(F.when(F.col("_rank") == F.floor(F.col("_n") / 2) + 1, F.col("_width"))).over(page)
    limited = ranked.withColumn("_limit", _limit(median))
    along = page.orderBy("_e.at", "_e.kind").rowsBetween(W.unboundedPreceding, 0)
    covered = (
        limited.withColumn("_e", F.explode(_events()))
        .withColumn("_cover", F.sum("_e.change").over(along))
        .filter(F.col("_e.kind") != _END)
    )
    flagged = covered.withColumn("_keep", _kept(covered))
    survivors = F.sum(F.col("_keep").cast("int")).over(page)
    keep = (F.col("_n") < MIN_BOXES) | (survivors < MIN_KEPT) | F.col("_keep")
    return flagged.withColumn("keep", keep).select(*lines.columns, "keep")


def drop_fragments(lines: DataFrame) -> DataFrame:
    return flag_fragments(lines).filter("keep").drop("keep")
