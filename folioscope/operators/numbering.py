"""Reading order: columns, document numbers D, transcript numbers T, labels, nested pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.settings import DEFAULT_SENSITIVITY, MIN_COLUMN_GAP


READING_ORDER = ["reading_column", "y0", "x0", "line_id"]


def reading_columns(lines: DataFrame) -> DataFrame:
    """0 for the left page of an open book (or the only column), 1 for the right."""
    page = W.partitionBy("page_id")
    across = page.orderBy(F.col("x0") + F.col("x1"), "line_pos")
    seen = lines.select(
        "*",
        F.row_number().over(across).alias("_rank"),
        F.lead("x0").over(across).alias("_next_x0"),
        F.count("*").over(page).alias("_n"),
    )
    gap = F.col("_next_x0") - F.col("x1")
    usable = (F.col("_n") >= 4) & (gap >= MIN_COLUMN_GAP) & (F.col("_rank") >= 2) & (F.col("_n") - F.col("_rank") >= 2)
    # The widest gap, the leftmost of equals.
    best = F.max(F.when(usable, F.struct(gap.alias("gap"), (-F.col("_rank")).alias("at")))).over(page)
    return (
        seen.withColumn("_split", -best["at"])
        .withColumn("reading_column", F.when(F.col("_rank") > F.col("_split"), 1).otherwise(0))
        .select(*lines.columns, "reading_column")
    )


def number_lines(lines: DataFrame, running: dict[str, Column] | None = None) -> DataFrame:
    """Adds reading_column and linha_documento.

    `running` adds, per entry, the total of a non-negative line column over the lines before
    this one in D order; it shares the window that numbers the lines.
    """
    down = W.partitionBy("page_id").orderBy(*READING_ORDER)
    earlier = down.rowsBetween(W.unboundedPreceding, -1)
    return reading_columns(lines).select(
        "*",
        F.row_number().over(down).alias("linha_documento"),
        *[F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name) for name, value in (running or {}).items()],
    )


def without_texts(lines: DataFrame) -> DataFrame:
    """Lines whose parts keep their ids and marks only: what numbering moves when nobody reads the texts."""
    return lines.withColumn(
        "parts",
        F.transform("parts", lambda p: F.struct(p["part_id"].alias("part_id"), F.lit("").alias("text"), p["confirmed"].alias("confirmed"), p["skipped"].alias("skipped"))),
    )


def part_rows(lines: DataFrame) -> DataFrame:
    """One row per part (1-based parte), one row with null part columns for a line without parts."""
    kept = [c for c in lines.columns if c != "parts"]
    return lines.select(*kept, F.size("parts").alias("parts_in_line"), F.posexplode_outer("parts").alias("_pos", "_part")).select(
        *kept,
        "parts_in_line",
        (F.col("_pos") + 1).alias("parte"),
        F.col("_part.part_id").alias("part_id"),
        F.coalesce("_part.text", F.lit("")).alias("text"),
        F.coalesce("_part.confirmed", F.lit(False)).alias("confirmed"),
        (F.coalesce("_part.skipped", F.lit(False)) & ~F.coalesce("_part.confirmed", F.lit(False))).alias("skipped"),
    )


def number_parts(lines: DataFrame) -> DataFrame:
    """The numbered view: one row per part with D, T and parte.

    D and the T offset come from one window over lines; the parts are exploded afterwards, so
    the whole view needs a single exchange on page_id.
    """
    numbered_here = F.when(F.col("include"), F.size("parts")).otherwise(0)
    rows = part_rows(number_lines(lines, {"_t_before": numbered_here}))
    return rows.withColumn(
        "linha_transcrita",
        F.when(F.col("include") & F.col("part_id").isNotNull(), F.col("_t_before") + F.col("parte")).cast("int"),
    ).drop("_t_before")


def _pad(number: Column) -> Column:
    return F.format_string("%03d", number)


def line_labels(numbered: DataFrame) -> DataFrame:
    """D-001  T-001–003 per line, or D-001  sem T."""
    lines = numbered.groupBy("page_id", "line_id", "linha_documento", "include").agg(
        F.min("linha_transcrita").alias("_from"), F.max("linha_transcrita").alias("_to")
    )
    label = (
        F.when(~F.col("include") | F.col("_from").isNull(), F.lit("sem T"))
        .when(F.col("_from") == F.col("_to"), F.concat(F.lit("T-"), _pad(F.col("_from"))))
        .otherwise(F.concat(F.lit("T-"), _pad(F.col("_from")), F.lit("–"), _pad(F.col("_to"))))
    )
    return lines.select(
        "page_id", "line_id", "linha_documento",
        F.concat(F.lit("D-"), _pad(F.col("linha_documento")), F.lit("  "), label).alias("label"),
    )


def nest_lines(numbered: DataFrame) -> DataFrame:
    """Numbered lines nested again, in D order: one row per page."""
    part = F.struct("parte", "part_id", "text", "confirmed", "skipped", "linha_transcrita")
    line = numbered.groupBy(
        "page_id", "line_id", "line_pos", "x0", "y0", "x1", "y1", "include", "linha_documento"
    ).agg(F.array_sort(F.collect_list(F.when(F.col("part_id").isNotNull(), part))).alias("parts"))
    return line.groupBy("page_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "linha_documento", "line_id",
                    F.array("x0", "y0", "x1", "y1").alias("box"), "include", "parts", "line_pos",
                )
            )
        ).alias("lines")
    )


def page_view(pages: DataFrame, numbered: DataFrame) -> DataFrame:
    """Pages with defaults and their numbered lines."""
    view = pages.select(
        "page_id", "filename", "width", "height",
        F.when(F.coalesce("original_width", F.lit(0)) == 0, F.col("width")).otherwise(F.col("original_width")).alias("original_width"),
        F.when(F.coalesce("original_height", F.lit(0)) == 0, F.col("height")).otherwise(F.col("original_height")).alias("original_height"),
        F.coalesce(F.get("crop_origin", F.lit(0)), F.lit(0)).alias("origin_x"),
        F.coalesce(F.get("crop_origin", F.lit(1)), F.lit(0)).alias("origin_y"),
        F.when(F.coalesce("view_scale", F.lit(0)) == 0, 1.0).otherwise(F.col("view_scale").cast("double")).alias("view_scale"),
        F.coalesce("prepared", F.lit(False)).alias("prepared"),
        F.when(F.coalesce("sensitivity", F.lit(0.0)) == 0, DEFAULT_SENSITIVITY).otherwise(F.col("sensitivity")).alias("sensitivity"),
    )
    return view.join(nest_lines(numbered), "page_id", "left")
