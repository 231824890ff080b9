"""The desk model derived from the given tables by fixed integer formulas.

documents gives pages, their text lines give boxes and parts, labels gives confirmations,
embeddings gives stored vectors, events gives edits and progress, conversations gives model
responses. Everything here is a projection of a scan (plus the labels join), so on tables of many
files it adds no shuffle of its own.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import has_text, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page_id() -> Column:
    return F.format_string("p%06d", F.col("doc_id") + 1)


def _filename() -> Column:
    return F.concat_ws("-", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


def lines(spark: SparkSession, sf_dir: str, marks: bool = True) -> DataFrame:
    """Lines with nested parts. marks=False leaves the labels out (no join) where nobody reads them."""
    docs = _documents(spark, sf_dir)
    if marks:
        docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    else:
        docs = docs.withColumn("quality", F.lit(None).cast("int"))
    split = docs.withColumn("_a", F.split("text", "\n")).withColumn("n", F.size("_a"))
    rows = split.select("doc_id", "lang", "source", "quality", "n", F.posexplode("_a").alias("k", "t"))
    doc, k, n, t = F.col("doc_id"), F.col("k"), F.col("n"), F.col("t")
    half = F.floor(n / 2).cast("int")
    column = F.when((n >= 6) & (doc % 3 == 0) & (2 * k >= n), 1).otherwise(0)
    speck = k % 17 == 16
    left = 40 + 1100 * column + (7 * k) % 13
    y0 = 40 + 60 * (k - F.when(column == 1, half).otherwise(0))
    raw = F.when((F.length(t) > 200) & (k % 5 == 0), F.array(F.substring(t, 1, 100), F.substring(t, 101, 1 << 30))).otherwise(F.array(t))

    def part(piece: Column, i: Column) -> Column:
        text = (
            F.when((doc + k) % 13 == 0, F.lit(""))
            .when((31 * doc + k) % 11 == 0, F.concat(F.lit("[ilegível] "), piece))
            .otherwise(piece)
        )
        confirmed = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & ((doc + k) % 13 != 0)
        return F.struct(
            F.concat_ws("_", F.lit("pt"), doc.cast("string"), k.cast("string"), (i + 1).cast("string")).alias("part_id"),
            text.alias("text"),
            confirmed.alias("confirmed"),
            (~confirmed & has_text(text) & ((doc + k) % 19 == 0)).alias("skipped"),
        )

    return rows.select(
        _page_id().alias("page_id"),
        _filename().alias("filename"),
        F.concat_ws("_", F.lit("ln"), doc.cast("string"), k.cast("string")).alias("line_id"),
        k.alias("line_pos"),
        F.when(speck, 980).otherwise(left).cast("int").alias("x0"),
        y0.cast("int").alias("y0"),
        F.when(speck, 1020).otherwise(left + 60 + F.least(F.lit(840), F.length(t))).cast("int").alias("x1"),
        (y0 + 44).cast("int").alias("y1"),
        ((doc + k) % 9 != 4).alias("include"),
        F.transform(raw, part).alias("parts"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, marks=False).drop("parts")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page; the height follows from the number of lines, so no grouping is needed."""
    doc, n = F.col("doc_id"), F.size(F.split("text", "\n"))
    deepest = F.when((n >= 6) & (doc % 3 == 0), F.ceil(n / 2) - 1).otherwise(n - 1)
    return _documents(spark, sf_dir).select(
        _page_id().alias("page_id"),
        _filename().alias("filename"),
        F.lit(2200).alias("width"),
        (40 + 60 * deepest + 84).cast("int").alias("height"),
        F.array((doc % 50).cast("int"), (doc % 30).cast("int")).alias("crop_origin"),
        (1 + doc % 3).cast("int").alias("view_scale"),
        (doc % 4).cast("int").alias("prep_version"),
        (doc % 4 > 0).alias("prepared"),
        F.when(doc % 5 == 0, F.lit(None)).otherwise(2200 + 40).cast("int").alias("original_width"),
        F.when(doc % 5 == 0, F.lit(None)).otherwise(40 + 60 * deepest + 124).cast("int").alias("original_height"),
        F.when(doc % 7 == 0, F.lit(None)).otherwise(F.lit(0.4)).cast("double").alias("sensitivity"),
    )


def stored(passages: DataFrame) -> DataFrame:
    """An index as an earlier save left it: some pages missing, some texts stale, some parts gone."""
    doc = F.split_part("part_id", F.lit("_"), F.lit(2)).cast("bigint")
    stale = (doc + F.col("linha_documento")) % 6 == 0
    base = passages.filter(doc % 10 != 3).select(
        *[c for c in passages.columns if c not in ("content_hash", "linha_documento", "confirmed")],
        "linha_documento",
        "confirmed",
        F.when(stale, "stale").otherwise(F.col("content_hash")).alias("content_hash"),
        ((doc + F.col("linha_documento")) % 23 == 0).alias("_old"),
    )
    # Each row once, and once more under an id that is no longer on the page.
    return base.select(
        *[c for c in passages.columns if c not in ("part_id",)],
        F.explode(
            F.when(F.col("_old"), F.array(F.col("part_id"), F.concat(F.col("part_id"), F.lit("_old"))))
            .otherwise(F.array("part_id"))
        ).alias("part_id"),
    )


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "click", "text")
        .when(F.col("event_type") == "view", "skip")
        .when(F.col("event_type") == "purchase", "confirm")
        .when(F.col("event_type") == "error", "delete")
        .otherwise("omit")
    )
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        F.concat(F.lit("pt_"), (F.col("event_id") % 2000).cast("string")).alias("part_id"),
        op.alias("op"),
        F.when(op == "text", F.concat(F.lit("edit "), F.col("event_id").cast("string"))).alias("text"),
    )


def index_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec,
        F.concat(F.lit("pv_"), vec.cast("string")).alias("part_id"),
        F.concat(F.lit("g_"), (vec % 7).cast("string")).alias("group_id"),
        F.when(F.col("label") % 4 == 0, F.lit(None)).otherwise(F.col("label") % 3 + 1).cast("bigint").alias("user_id"),
        (vec % 2 == 0).alias("confirmed"),
        "embedding",
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmenter output per line: a polygon, or a baseline for every fourth line."""
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    return boxes(spark, sf_dir).select(
        "page_id", "line_pos",
        F.when(F.col("line_pos") % 4 != 0, F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))).alias("boundary"),
        F.when(F.col("line_pos") % 4 == 0, F.array(F.array(x0, y1), F.array(x1, y1))).alias("baseline"),
    )


def new_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second detection: the same boxes shifted down by up to 36 pixels, every seventh missing."""
    shift = (F.col("line_pos") % 5) * 9
    return boxes(spark, sf_dir).filter(F.col("line_pos") % 7 != 6).select(
        "page_id", F.col("line_pos").alias("box_pos"), "x0", (F.col("y0") + shift).alias("y0"), "x1", (F.col("y1") + shift).alias("y1")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in the shapes models give them: plain, fenced, after a thought, as objects, as one string."""
    rows = F.transform(
        F.split("text", "\n"), lambda t, i: F.when(i % 5 == 3, " [Sem Texto] ").otherwise(strip(t))
    )
    plain = F.to_json(F.struct(rows.alias("linhas")))
    objects = F.to_json(F.struct(F.transform(rows, lambda r: F.struct(r.alias("texto"))).alias("linhas")))
    single = F.to_json(F.struct(F.array_join(rows, "\n").alias("linhas")))
    kind = F.col("conv_id") % 5
    return table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", "turn",
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("<think>hm {</think> "), plain))
        .when(kind == 3, objects)
        .otherwise(single).alias("response"),
        (1 + F.col("turn") % 4).cast("int").alias("expected"),
    )


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = (
        F.when(F.col("event_type") == "click", "tile")
        .when(F.col("event_type") == "view", "original")
        .when(F.col("event_type") == "purchase", "finished")
        .when(F.col("event_type") == "error", "error")
        .otherwise("crop")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("folha_"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("filename"),
        stage.alias("stage"),
        (F.col("event_id") % 100).alias("done"),
        F.lit(100).cast("bigint").alias("total"),
    )
