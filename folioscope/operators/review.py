"""Review marks, review queue, validation of saved lines, model texts written back."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.boxes import clamp_box, corners, half_up, named
from folioscope.functions.text import has_text
from folioscope.operators.numbering import number_lines
from folioscope.operators.spread import queue_positions
from folioscope.settings import MAX_TEXT_CHARS

# What ids may look like.
ITEM_ID = r"\A[A-Za-z0-9_-]{1,48}\z"


def derived_id(prefix: str, *parts: Column | str) -> Column:
    """A repeatable id where the reference draws a random one."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8))


def _part(part_id: Column, text: Column, confirmed: Column, skipped: Column) -> Column:
    return F.struct(
        part_id.alias("part_id"), text.alias("text"), confirmed.alias("confirmed"), skipped.alias("skipped")
    )


def empty_part(*seed: Column | str, text: Column | None = None) -> Column:
    return _part(derived_id("pt", *seed), F.lit("") if text is None else text, F.lit(False), F.lit(False))


def pending_lines(lines: DataFrame, only_empty: bool = True) -> DataFrame:
    """Included lines still to be read, numbered, with their part ids."""
    numbered = number_lines(lines).filter("include")
    if only_empty:
        numbered = numbered.filter(~F.exists("parts", lambda p: has_text(p["text"])))
    return numbered.withColumn(
        "part_ids", F.filter(F.transform("parts", lambda p: p["part_id"]), lambda i: F.coalesce(i, F.lit("")) != "")
    ).drop("parts")


def draft_parts(numbered: DataFrame) -> DataFrame:
    """Written parts of included lines that are neither confirmed nor skipped."""
    return numbered.filter(
        F.col("include") & has_text(F.col("text")) & ~F.col("confirmed") & ~F.col("skipped")
    )


def review_positions(numbered: DataFrame) -> DataFrame:
    """Where each draft stands in the whole queue and in its page, and its neighbours in the queue."""
    drafts = draft_parts(numbered).select("page_id", "linha_documento", "parte", "part_id")
    queue = queue_positions(drafts, [F.col(c) for c in ("page_id", "linha_documento", "parte", "part_id")], "part_id")
    # From a hash of the page on, sizes and rows meet without another exchange.
    dealt = queue.repartition("page_id")
    per_page = dealt.groupBy("page_id").agg(F.min("position").alias("_first"), F.count("*").alias("page_total"))
    return dealt.join(per_page, "page_id").select(
        "page_id", "part_id", "position", "total",
        (F.col("position") - F.col("_first") + 1).alias("page_position"), "page_total",
        F.col("previous_part_id").alias("previous_part"), F.col("next_part_id").alias("next_part"),
    )


def confirmation_marks(text: Column, confirmed: Column, skipped: Column, old_text: Column, old_confirmed: Column,
                       old_skipped: Column, known: Column) -> tuple[Column, Column]:
    """The review state after a save, from the payload and the part as it was."""
    changed = known & (F.coalesce(old_text, F.lit("")) != text)
    blank = ~has_text(text)
    skip_kept = skipped & ~changed
    to_confirmed = (
        F.when(blank, False).when(confirmed, True).when(skip_kept, False).when(~known, True).when(changed, False)
        .otherwise(old_confirmed)
    )
    to_skipped = (
        F.when(blank | confirmed, False).when(skip_kept, True).when(~known | changed, False)
        .otherwise(old_skipped & ~old_confirmed)
    )
    return to_confirmed, to_skipped


def apply_confirmation(parts: DataFrame, previous: DataFrame) -> DataFrame:
    """Flat saved parts against the parts stored before, joined on (page_id, part_id)."""
    old = previous.select(
        "page_id", "part_id",
        F.coalesce("text", F.lit("")).alias("_old_text"),
        F.coalesce("confirmed", F.lit(False)).alias("_old_confirmed"),
        F.coalesce("skipped", F.lit(False)).alias("_old_skipped"),
        F.lit(True).alias("_known"),
    )
    confirmed, skipped = confirmation_marks(
        F.coalesce("text", F.lit("")), F.coalesce("confirmed", F.lit(False)), F.coalesce("skipped", F.lit(False)),
        F.col("_old_text"), F.col("_old_confirmed"), F.col("_old_skipped"), F.coalesce("_known", F.lit(False)),
    )
    joined = parts.join(old, ["page_id", "part_id"], "left")
    return joined.withColumns({"confirmed": confirmed, "skipped": skipped}).select(*parts.columns)


def strip_lines(lines: DataFrame) -> DataFrame:
    """The canonical form a client saves: rounded box, include true by default, marks only on text."""

    def part(p: Column) -> Column:
        text = F.coalesce(p["text"], F.lit(""))
        confirmed = F.coalesce(p["confirmed"], F.lit(False))
        skipped = F.coalesce(p["skipped"], F.lit(False))
        return _part(p["part_id"], text, confirmed & has_text(text), skipped & has_text(text) & ~confirmed)

    return lines.withColumns({
        **{c: half_up(F.col(c)) for c in ("x0", "y0", "x1", "y1")},
        "include": F.coalesce("include", F.lit(True)),
        "parts": F.transform(F.coalesce("parts", F.array().cast(lines.schema["parts"].dataType)), part),
    })


def violations(lines: DataFrame) -> DataFrame:
    """What breaks the rules, one row each: malformed or repeated line ids and part ids, boxes without four values."""
    line_id = F.coalesce("line_id", F.lit(""))
    parts = lines.select("page_id", F.explode("parts").alias("p")).select(
        "page_id", F.coalesce("p.part_id", F.lit("")).alias("item_id")
    )

    def check(items: DataFrame, kind: str) -> DataFrame:
        counted = items.groupBy("page_id", "item_id").agg(F.count("*").alias("_n"))
        reason = F.when(~F.col("item_id").rlike(ITEM_ID), "malformed").when(F.col("_n") > 1, "repeated")
        return counted.select("page_id", F.lit(kind).alias("kind"), "item_id", reason.alias("reason")).filter(
            "reason IS NOT NULL"
        )

    missing = F.col("x0").isNull() | F.col("y0").isNull() | F.col("x1").isNull() | F.col("y1").isNull()
    boxes = lines.filter(missing).select("page_id", F.lit("box").alias("kind"), line_id.alias("item_id"), F.lit("box").alias("reason")).distinct()
    return check(lines.select("page_id", line_id.alias("item_id")), "line").unionByName(check(parts, "part")).unionByName(boxes)


def clean_lines(lines: DataFrame, pages: DataFrame, max_chars: int | None = MAX_TEXT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Validated lines, and the violations. A page with a violation is left out as a whole.

    Texts are cut after `max_chars` code points; None keeps them whole.
    """
    bad = violations(lines)
    kept = lines.join(bad.select("page_id").distinct(), "page_id", "left_anti").join(
        pages.select("page_id", "width", "height"), "page_id"
    )

    def part(p: Column) -> Column:
        text = F.coalesce(p["text"], F.lit(""))
        return _part(
            p["part_id"],
            text if max_chars is None else F.substring(text, 1, max_chars),
            F.coalesce(p["confirmed"], F.lit(False)),
            F.coalesce(p["skipped"], F.lit(False)),
        )

    include = F.coalesce("include", F.lit(True))
    parts = F.transform("parts", part)
    return (
        kept.select(
            "page_id", "line_id", "line_pos",
            *named(clamp_box(corners(), F.col("width"), F.col("height"))),
            include.alias("include"),
            F.when(include & (F.size(parts) == 0), F.array(empty_part("page_id", "line_id"))).otherwise(parts).alias("parts"),
        ),
        bad,
    )


def set_line_texts(lines: DataFrame, readings: DataFrame, only_empty: bool = True) -> DataFrame:
    """Model texts into the first part of their lines; the part's marks are cleared."""
    text = F.substring(F.col("_reading"), 1, MAX_TEXT_CHARS)
    joined = lines.join(
        readings.select("page_id", "line_id", F.col("text").alias("_reading")), ["page_id", "line_id"], "left"
    )
    applies = F.col("_reading").isNotNull()
    if only_empty:
        applies = applies & ~F.exists("parts", lambda p: has_text(p["text"]))
    first = F.when(
        F.size("parts") == 0, empty_part("page_id", "line_id", text=text)
    ).otherwise(_part(F.get("parts", F.lit(0))["part_id"], text, F.lit(False), F.lit(False)))
    rest = F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))
    return joined.withColumn(
        "parts", F.when(applies, F.concat(F.array(first), rest)).otherwise(F.col("parts"))
    ).select(*lines.columns)
