"""Batch import of image files: which are taken, under which name and page id, and which fail."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import strip
from folioscope.operators.spread import positions
from folioscope.settings import MAX_NAME_CHARS

# Accepted files and wordings.
IMAGE_NAME = r"(?i)\.(jpe?g|png|tif|tiff|webp)$"
DEFAULT_NAME = "manuscrito.jpg"
EMPTY_FILE = "arquivo vazio"
NO_IMAGE = "Nenhuma imagem recebida"
PIECE = 4096


def read_files(spark: SparkSession, path: str, listing: DataFrame | None = None) -> DataFrame:
    """Files below a folder with their bytes; the bytes are carried, never decoded here.

    The reader leaves out files of no length. A listing of the upload (path, length) brings them
    back, so that they can be reported.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if listing is None:
        return files
    empty = listing.filter("length = 0").select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), F.col("length").cast("bigint").alias("length"),
        F.lit(b"").alias("content"),
    )
    return files.unionByName(empty)


def safe_name(path: Column) -> Column:
    base = F.element_at(F.split(F.regexp_replace(F.coalesce(path, F.lit(DEFAULT_NAME)), "/+$", ""), "/"), -1)
    name = strip(F.regexp_replace(base, r"\x{00}", ""))
    return F.substring(F.when(name == "", DEFAULT_NAME).otherwise(name), 1, MAX_NAME_CHARS)


def ingest_images(files: DataFrame) -> DataFrame:
    """Accepted files with name and error (null when fine). Files that are no images are not part of the batch."""
    accepted = F.element_at(F.split("path", "/"), -1).rlike(IMAGE_NAME)
    if "mime" in files.columns:
        accepted = accepted | F.coalesce(F.col("mime").startswith("image/"), F.lit(False))
    name = safe_name(F.col("path"))
    failed = F.coalesce(F.col("length"), F.lit(0)) == 0
    return files.filter(accepted).select(
        "*", name.alias("filename"), F.when(failed, F.concat(name, F.lit(": " + EMPTY_FILE))).alias("error")
    )


def next_page_ids(existing: DataFrame, new_rows: DataFrame, order: list[str]) -> DataFrame:
    """New rows with the smallest free page ids, holes first, in the given (total) order."""
    spark = new_rows.sparkSession
    numbered = existing.select("page_id", F.regexp_extract("page_id", r"^p(\d+)$", 1).alias("_digits")).filter(
        "_digits <> ''"
    ).select("page_id", F.col("_digits").cast("bigint").alias("number"))
    used = numbered.filter((F.col("page_id") == F.format_string("p%03d", F.col("number"))) & (F.col("number") >= 1)).select("number").distinct()
    wanted = new_rows.count()
    # A used number less its place is how many free numbers lie before it; numbers in a row share that count. So slots above one
    # run's count and up to the next one's fill the hole between the two, and slot + places used so far is their number.
    start = spark.createDataFrame([(0, 0)], "shift long, taken long")
    runs = positions(used, [F.col("number")], "_place").select((F.col("number") - F.col("_place")).alias("shift"), F.col("_place").alias("taken"))
    runs = runs.filter(F.col("shift") < wanted).unionByName(start).groupBy("shift").agg(F.max("taken").alias("taken"))
    runs = positions(runs, [F.col("shift")], "_run")
    after = runs.select((F.col("_run") - 1).alias("_run"), F.col("shift").alias("until"))
    holes = runs.join(after, "_run", "left").select("shift", "taken", F.coalesce("until", F.lit(wanted).cast("bigint")).alias("until")).filter("until > shift")
    # A hole is cut into pieces of PIECE slots, so that none becomes one task's work.
    cut = holes.select("*", F.explode(F.sequence(F.floor(F.col("shift") / PIECE), F.floor((F.col("until") - 1) / PIECE))).alias("_piece"))
    slots = F.sequence(F.greatest(F.col("shift"), F.col("_piece") * PIECE) + 1, F.least(F.col("until"), (F.col("_piece") + 1) * PIECE))
    free = cut.select("taken", F.explode(slots).alias("_slot")).select("_slot", (F.col("_slot") + F.col("taken")).alias("number"))
    placed = positions(new_rows, [F.col(c) for c in order], "_slot")
    return placed.join(free, "_slot").select(*new_rows.columns, F.format_string("p%03d", F.col("number")).alias("page_id"))


def import_summary(ingested: DataFrame, batch: str = "batch") -> DataFrame:
    """Per batch: imported and failed files, and an error only where nothing was imported."""
    failed = F.col("error").isNotNull()
    counts = ingested.groupBy(batch).agg(
        F.count_if(~failed).alias("imported"), F.count_if(failed).alias("failed"),
        F.min_by("error", F.when(failed, F.col("path"))).alias("_first"),
    )
    error = F.when(F.col("imported") == 0, F.coalesce("_first", F.lit(NO_IMAGE)))
    return counts.select(batch, "imported", "failed", error.alias("error"))
