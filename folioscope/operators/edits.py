"""An edit log applied to lines.

Field edits keep the latest by (ts, event_id). They are reduced per part and then per line
with map-side combine, so a part that is edited very often costs no more than one that is not.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.boxes import corners, half_up, named
from folioscope.functions.text import has_text
from folioscope.operators.review import derived_id, empty_part

# The ops a log may hold.
PART_OPS = ("text", "confirm", "skip")
STRUCTURE_OPS = ("split", "remove_part")
LINE_OPS = ("include", "omit", "delete_line", "box", "draw")


def latest_edits(edits: DataFrame, key: str = "part_id") -> DataFrame:
    """The last edit of each part; later ts wins, then the larger event_id."""
    order = F.struct("ts", "event_id")
    fields = [c for c in edits.columns if c != key]
    return edits.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_e")).select(
        key, *[F.col(f"_e.{c}").alias(c) for c in fields]
    )


def reduce_edits(edits: DataFrame) -> DataFrame:
    """The edits that still matter: applying them gives the same lines as applying the whole log.

    Reduced logs can be joined with later edits and reduced again, in any order of arrival.
    """
    at = F.struct("ts", "event_id")
    op = F.col("op")
    kind = (
        F.when((op == "text") & ~has_text(F.col("text")), "blank")
        .when(op == "text", "text")
        .when(op.isin("confirm", "skip"), "mark")
        .when(op.isin("include", "omit"), "include")
        .when(op.isin("box", "delete_line"), op)
    )
    # Marks and texts are per part, the other fields per line. Splits and removals undo one another, so all of them stay;
    # an edit that arrives twice counts once.
    each = op.isin(*STRUCTURE_OPS, "draw")
    kept = edits.withColumns({
        "_kind": F.when(each, op).otherwise(kind),
        "_part": F.when(kind.isin("blank", "text", "mark"), F.col("part_id")),
        "_at": F.when(each, at),
    }).filter("_kind IS NOT NULL")
    row = F.struct(*edits.columns)
    last = kept.groupBy("page_id", "line_id", "_part", "_kind", "_at").agg(F.max_by(row, at).alias("_row"))
    return last.select("page_id", "line_id", *[F.col(f"_row.{c}").alias(c) for c in edits.columns if c not in ("page_id", "line_id")]).select(*edits.columns)


def _part_changes(edits: DataFrame) -> DataFrame:
    """Per part: last text, last mark, and whether a blank text came after that mark."""
    at = F.struct("ts", "event_id")
    op = F.col("op")
    per_part = edits.filter(op.isin(*PART_OPS)).groupBy("page_id", "line_id", "part_id").agg(
        F.max_by(F.when(op == "text", F.col("text")), F.when(op == "text", at)).alias("text"),
        F.count_if(op == "text").alias("_texts"),
        F.max_by(F.when(op != "text", op), F.when(op != "text", at)).alias("mark"),
        F.max(F.when(op != "text", at)).alias("_mark_at"),
        F.max(F.when((op == "text") & ~has_text(F.col("text")), at)).alias("_blank_at"),
    )
    cleared = F.col("_blank_at").isNotNull() & (F.col("_mark_at").isNull() | (F.col("_blank_at") > F.col("_mark_at")))
    return per_part.select(
        "page_id", "line_id",
        F.struct(
            "part_id",
            F.when(F.col("_texts") > 0, F.coalesce("text", F.lit(""))).alias("text"),
            F.when(~cleared, F.col("mark")).alias("mark"),
            cleared.alias("cleared"),
        ).alias("change"),
    )


def _changed(part: Column, changes: Column) -> Column:
    """One part with its field changes."""
    change = F.get(F.filter(changes, lambda c: c["part_id"] == part["part_id"]), F.lit(0))
    text = F.coalesce(change["text"], part["text"])
    cleared = F.coalesce(change["cleared"], F.lit(False))
    confirmed = F.when(change["mark"].isNotNull(), change["mark"] == "confirm").otherwise(part["confirmed"] & ~cleared)
    skipped = F.when(change["mark"].isNotNull(), change["mark"] == "skip").otherwise(part["skipped"] & ~cleared)
    confirmed = confirmed & has_text(text)
    return F.struct(
        part["part_id"].alias("part_id"), text.alias("text"), confirmed.alias("confirmed"),
        (skipped & has_text(text) & ~confirmed).alias("skipped"),
    )


def _restructured(parts: Column, ops: Column) -> Column:
    """Splits and removals in log order: a split puts an empty part behind the selected one."""

    def step(now: Column, op: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(now, lambda p: p["part_id"]), op["part_id"]), F.lit(0)).cast("int")
        added = F.struct(
            op["new_id"].alias("part_id"), F.lit("").alias("text"), F.lit(False).alias("confirmed"), F.lit(False).alias("skipped")
        )
        after = F.concat(
            F.slice(now, F.lit(1), at), F.array(added), F.slice(now, at + 1, F.greatest(F.size(now) - at, F.lit(0)))
        )
        known = F.exists(now, lambda p: p["part_id"] == op["new_id"])
        return F.when((op["op"] == "split") & known, now).when(op["op"] == "split", after).otherwise(F.filter(now, lambda p: p["part_id"] != op["part_id"]))

    return F.aggregate(ops, parts, step)


def apply_line_edits(lines: DataFrame, edits: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Lines after the log. Edits name page_id, line_id, op and, by op, part_id, text, new_id, x0..y1, ts, event_id."""
    at = F.struct("ts", "event_id")
    op = F.col("op")
    box = F.struct("x0", "y0", "x1", "y1")
    changes = _part_changes(edits).groupBy("page_id", "line_id").agg(F.collect_list("change").alias("_changes"))
    structure = (
        edits.filter(op.isin(*STRUCTURE_OPS))
        .groupBy("page_id", "line_id")
        .agg(F.array_sort(F.collect_set(F.struct(at.alias("_at"), "op", "part_id", "new_id"))).alias("_ops"))
    )
    fields = edits.filter(op.isin("include", "omit", "delete_line", "box")).groupBy("page_id", "line_id").agg(
        F.max_by(F.when(op.isin("include", "omit"), op == "include"), F.when(op.isin("include", "omit"), at)).alias("_include"),
        F.max_by(F.when(op == "box", box), F.when(op == "box", at)).alias("_box"),
        F.count_if(op == "delete_line").alias("_deleted"),
    )
    keys = ["page_id", "line_id"]
    joined = lines.join(fields, keys, "left").join(changes, keys, "left").join(structure, keys, "left")
    joined = joined.filter(F.coalesce("_deleted", F.lit(0)) == 0)
    parts = F.when(F.col("_ops").isNull(), F.col("parts")).otherwise(_restructured(F.col("parts"), F.col("_ops")))
    changed = F.transform(parts, lambda p: _changed(p, F.coalesce("_changes", F.array().cast(changes.schema["_changes"].dataType))))
    out = joined.withColumns({
        **{c: F.coalesce(half_up(F.col("_box")[c]), F.col(c)) for c in ("x0", "y0", "x1", "y1")},
        "include": F.coalesce("_include", "include"),
        "parts": changed,
    }).select(*lines.columns)
    if pages is None:
        return out
    # Lines drawn by hand go behind the others, clamped to the page with at least 8 view pixels.
    size = F.greatest(F.col("view_scale"), F.lit(1)) * 8
    drawn = edits.filter(op == "draw").join(pages.select("page_id", "width", "height", "view_scale"), "page_id")
    x0, y0, x1, y1 = (half_up(c) for c in corners())
    x0 = F.greatest(F.lit(0), F.least(F.col("width") - size, x0))
    y0 = F.greatest(F.lit(0), F.least(F.col("height") - size, y0))
    clamped = (x0, y0, F.greatest(x0 + size, F.least(F.col("width"), x1)), F.greatest(y0 + size, F.least(F.col("height"), y1)))
    new_line = F.coalesce("new_id", derived_id("ln", "page_id", F.col("event_id").cast("string")))
    new_rows = drawn.select("page_id", new_line.alias("line_id"), *named(tuple(c.cast("int") for c in clamped)), "event_id").select(
        "*", (F.lit(1 << 40) + F.col("event_id")).alias("line_pos"), F.lit(True).alias("include"),
        F.array(empty_part("page_id", "line_id")).alias("parts"),
    )
    extra = [c for c in lines.columns if c not in new_rows.columns]
    new_rows = new_rows.withColumns({c: F.lit(None).cast(lines.schema[c].dataType) for c in extra})
    return out.withColumn("line_pos", F.col("line_pos").cast("bigint")).unionByName(new_rows.select(*lines.columns))
