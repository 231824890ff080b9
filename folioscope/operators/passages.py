"""The passage index: what is indexed, what changed, and the next version of the table.

Plain parquet has no MERGE, so each save yields the rows of a new version. Joins are on part_id,
which is unique, so no join key is shared by many rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import content_hash, has_text, strip
from folioscope.operators.spread import positions
from folioscope.schemas import TRANSCRIPTIONS

_META = ["page_name", "line_id", "linha_documento", "linha_transcrita"]


def passages(numbered: DataFrame) -> DataFrame:
    """One row per written part with an id, lines outside the transcription included."""
    name = F.coalesce("filename", "page_id") if "filename" in numbered.columns else F.col("page_id")
    return numbered.filter(has_text(F.col("text")) & (F.coalesce("part_id", F.lit("")) != "")).select(
        "page_id",
        F.when(name == "", F.col("page_id")).otherwise(name).alias("page_name"),
        "line_id",
        "part_id",
        "linha_documento",
        "linha_transcrita",
        strip(F.col("text")).alias("text"),
        content_hash(strip(F.col("text"))).alias("content_hash"),
        "confirmed",
    )


def passage_diff(current: DataFrame, stored: DataFrame, saved_pages: DataFrame) -> DataFrame:
    """(page_id, part_id, action) for the saved pages: write, refresh or delete."""
    ours = current.select("page_id", "part_id", F.col("content_hash").alias("_new"))
    theirs = stored.join(saved_pages.select("page_id"), "page_id", "left_semi").select(
        "page_id", "part_id", F.col("content_hash").alias("_old")
    )
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_new") == F.col("_old"), "refresh").otherwise("write")
    return ours.join(theirs, ["page_id", "part_id"], "full_outer").select("page_id", "part_id", action.alias("action"))


def index_upsert(
    stored: DataFrame, current: DataFrame, saved_pages: DataFrame, now: Column, user_id: Column | None = None
) -> DataFrame:
    """The table after saving pages: gone parts out, same texts keep their vector, others lose it.

    One full outer join on part_id decides every row. A part that moved to another page counts as
    written there, and the page it left does not delete it.
    """
    owner = F.lit(None).cast("bigint") if user_id is None else user_id
    new = current.select(
        "part_id", F.lit(True).alias("_is_new"), *[F.col(c).alias(f"n_{c}") for c in ("page_id", *_META, "text", "content_hash", "confirmed")]
    )
    touched = saved_pages.select("page_id", F.lit(True).alias("_touched"))
    old = stored.join(touched, "page_id", "left").withColumn("_is_old", F.lit(True))
    both = old.join(new, "part_id", "full_outer")
    is_new, is_old = F.coalesce("_is_new", F.lit(False)), F.coalesce("_is_old", F.lit(False))
    same = is_new & is_old & (F.col("page_id") == F.col("n_page_id")) & (F.col("content_hash") == F.col("n_content_hash"))
    kept = both.filter(is_new | ~F.coalesce("_touched", F.lit(False)))
    taken = {c: F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("page_id", *_META, "text", "content_hash", "confirmed")}
    return kept.select(
        "id",
        F.when(is_new, owner).otherwise(F.col("user_id")).alias("user_id"),
        taken["page_id"], taken["page_name"], taken["line_id"], "part_id",
        taken["linha_documento"], taken["linha_transcrita"], taken["text"], taken["content_hash"],
        F.when(~is_new | same, F.col("embedding")).alias("embedding"),
        taken["confirmed"],
        F.when(is_new, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def index_saved(stored: DataFrame, current: DataFrame, now: Column, user_id: Column | None = None) -> DataFrame:
    """The rows of the saved pages after the save: what index_upsert gives where `stored` has rows of saved pages only.

    Joined by page and part, so tables kept in buckets of pages are not shuffled; of `stored` no text is read. Only where
    stored rows have ids, the keys of parts that came from another saved page are looked up by part_id alone.
    """
    keys = ["page_id", "part_id"]
    old = stored.select(*keys, "id", F.col("content_hash").alias("_hash"), F.col("embedding").alias("_vector"))
    table = current.join(old, keys, "left")
    known = F.col("id")
    numbered = old.filter("id IS NOT NULL").select(*keys, "id")
    if not numbered.isEmpty():
        left = numbered.join(current.select(*keys), keys, "left_anti").groupBy("part_id").agg(F.min("id").alias("_moved"))
        came = current.select(*keys).join(old.select(*keys), keys, "left_anti").join(left, "part_id")
        table = table.join(came, keys, "left")
        known = F.coalesce("id", "_moved")
    owner = F.lit(None).cast("bigint") if user_id is None else user_id
    return table.select(
        known.alias("id"), owner.alias("user_id"), "page_id", "page_name", "line_id", "part_id", "linha_documento", "linha_transcrita",
        "text", "content_hash", F.when(F.col("_hash") == F.col("content_hash"), F.col("_vector")).alias("embedding"), "confirmed",
        now.alias("updated_at"),
    )


def assign_ids(table: DataFrame) -> DataFrame:
    """Ids for rows that have none, after the largest there is, in (page_id, linha_documento, part_id) order."""
    largest = table.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = positions(
        table.filter("id IS NULL"), [F.col(c) for c in ("page_id", "linha_documento", "part_id")], "_position"
    )
    numbered = fresh.withColumn("id", F.col("_position") + largest).select(*table.columns)
    return table.filter("id IS NOT NULL").unionByName(numbered)


def outstanding(table: DataFrame, limit: int | None = None, page_id: str | None = None) -> DataFrame:
    """Rows without a vector: all of them, or the `limit` oldest."""
    rows = table.filter(F.col("embedding").isNull())
    if page_id is not None:
        rows = rows.filter(F.col("page_id") == page_id)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def write_back_vectors(table: DataFrame, vectors: DataFrame, now: Column) -> DataFrame:
    """Vectors into rows whose text is still the one that was embedded and that have none yet."""
    fresh = vectors.select("part_id", "content_hash", F.col("embedding").alias("_vector"))
    joined = table.join(fresh, ["part_id", "content_hash"], "left")
    filled = F.col("embedding").isNull() & F.col("_vector").isNotNull()
    return joined.withColumns({
        "embedding": F.coalesce("embedding", "_vector"),
        "updated_at": F.when(filled, now).otherwise(F.col("updated_at")),
    }).select(*table.columns)


def delete_pages(table: DataFrame, pages: DataFrame) -> DataFrame:
    return table.join(pages.select("page_id"), "page_id", "left_anti")


def delete_user(table: DataFrame, users: DataFrame) -> DataFrame:
    return table.join(users.select("user_id"), "user_id", "left_anti")


def legacy_import(table: DataFrame, legacy: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows of an older index that the table does not have; of equal ids the smallest row counts."""
    columns = ["page_id", "page_name", "line_id", "linha_documento", "linha_transcrita", "text", "content_hash", "embedding"]
    first = legacy.groupBy("part_id").agg(
        F.min_by(F.struct(*columns), F.struct("page_id", "line_id", "linha_documento", "content_hash")).alias("_row")
    )
    known = [f for f in TRANSCRIPTIONS.fieldNames() if f in table.columns]
    moved = first.join(table.select("part_id"), "part_id", "left_anti").select("part_id", "_row.*").withColumns({
        "id": F.lit(None).cast("bigint"), "user_id": F.lit(None).cast("bigint"), "confirmed": F.lit(False),
        "updated_at": F.current_timestamp() if now is None else now,
    })
    return table.select(*known).unionByName(moved.select(*known))


def confirmed_texts(table: DataFrame, limit: int | None = None, order: str = "updated_at") -> DataFrame:
    """Confirmed rows with text: all of them, or the `limit` newest."""
    rows = table.filter(F.col("confirmed") & has_text(F.col("text"))).select("part_id", "text", order)
    return rows if limit is None else rows.orderBy(F.desc(order), "part_id").limit(limit)
