"""TXT and JSON exports of numbered lines."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import has_text, strip

# Wording of the text export.
HEADER = ["T = linha transcrita. D = linha no documento.", ""]
NO_PAGES = "Nenhuma página importada."
OMITTED = "Fora da transcrição: "


def export_rows(numbered: DataFrame) -> DataFrame:
    """One row per part of the included lines, under the exported field names."""
    return numbered.filter(F.col("include") & F.col("part_id").isNotNull()).select(
        "page_id",
        "linha_transcrita",
        "linha_documento",
        "parte",
        F.col("text").alias("texto"),
        F.array("x0", "y0", "x1", "y1").alias("caixa"),
        F.col("line_id").alias("id_linha_documento"),
        F.col("part_id").alias("id_linha_transcrita"),
    )


def export_omitted(numbered_lines: DataFrame) -> DataFrame:
    """Lines outside the transcription with their stored texts (numbered lines with nested parts)."""
    texts = F.transform(F.filter("parts", lambda p: has_text(p["text"])), lambda p: p["text"])
    return numbered_lines.filter(~F.col("include")).select(
        "page_id", "linha_documento",
        F.array("x0", "y0", "x1", "y1").alias("caixa"),
        F.array_join(texts, " / ").alias("texto_guardado"),
    )


def export_pages(pages: DataFrame, numbered: DataFrame) -> DataFrame:
    """The export document of every page as JSON text: arquivo, largura, altura, linhas, linhas_documento_sem_transcricao."""
    rows = export_rows(numbered)
    item = F.struct("linha_transcrita", *[c for c in rows.columns if c not in ("page_id", "linha_transcrita")])
    included = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("linhas"))
    box = F.array("x0", "y0", "x1", "y1")
    texts = F.array_sort(F.collect_list(F.when(F.col("part_id").isNotNull() & has_text(F.col("text")), F.struct("parte", "text"))))
    outside = (
        numbered.filter(~F.col("include")).groupBy("page_id", "linha_documento", box.alias("caixa")).agg(texts.alias("_t"))
        .select("page_id", F.struct("linha_documento", "caixa", F.array_join(F.transform("_t", lambda p: p["text"]), " / ").alias("texto_guardado")).alias("_o"))
        .groupBy("page_id").agg(F.array_sort(F.collect_list("_o")).alias("linhas_documento_sem_transcricao"))
    )
    whole = pages.select("page_id", F.col("filename").alias("arquivo"), F.col("width").alias("largura"), F.col("height").alias("altura"))
    document = whole.join(included, "page_id", "left").join(outside, "page_id", "left")
    fields = [
        "arquivo", "largura", "altura", F.coalesce("linhas", F.array().cast(included.schema["linhas"].dataType)).alias("linhas"),
        F.coalesce("linhas_documento_sem_transcricao", F.array().cast(outside.schema["linhas_documento_sem_transcricao"].dataType)).alias("linhas_documento_sem_transcricao"),
    ]
    return document.select("page_id", F.to_json(F.struct(*fields)).alias("json"))


def export_text(pages: DataFrame, numbered: DataFrame) -> DataFrame:
    """Lines of the text export; (page_id, section, seq) gives their order. A blank line follows each page but the last."""
    d_label = F.format_string("D%03d", F.col("linha_documento"))
    several = F.col("parts_in_line") > 1
    body = numbered.filter(F.col("include") & has_text(F.col("text")))
    clean = strip(F.regexp_replace(F.regexp_replace("text", "\r\n", "\n"), "\n", " / "))
    line = F.concat(
        F.format_string("[T%03d | ", F.coalesce("linha_transcrita", F.lit(0))), d_label,
        F.when(several, F.concat(F.lit(" parte "), F.col("parte").cast("string"))).otherwise(""),
        F.lit("] "), clean,
    )
    shape = ["page_id", "section", "seq", "text"]
    title = pages.select("page_id", F.lit(0).alias("section"), F.lit(0).alias("seq"), F.concat(F.lit("# "), F.col("filename")).alias("text"))
    written = body.select("page_id", F.lit(1).alias("section"), F.col("linha_transcrita").alias("seq"), line.alias("text"))
    listed = numbered.filter(~F.col("include")).groupBy("page_id").agg(F.array_sort(F.collect_set("linha_documento")).alias("_ds"))
    omitted = listed.select(
        "page_id", F.lit(2).alias("section"), F.lit(0).alias("seq"),
        F.concat(F.lit(OMITTED), F.array_join(F.transform("_ds", lambda d: F.format_string("D%03d", d)), ", ")).alias("text"),
    )
    last = pages.agg(F.max("page_id").alias("_last"))
    blank = title.join(F.broadcast(last), F.col("page_id") < F.col("_last")).select("page_id", F.lit(3).alias("section"), "seq", F.lit("").alias("text"))
    return title.unionByName(written.select(*shape)).unionByName(omitted).unionByName(blank)


def write_text(lines: DataFrame, path: str) -> None:
    """Part files that, read in name order, are the export. A long page spans several files."""
    spark = lines.sparkSession
    if lines.isEmpty():
        spark.createDataFrame([(t,) for t in [*HEADER, NO_PAGES]], "value string").coalesce(1).write.text(path)
        return
    head = spark.createDataFrame([("", -1, i, text) for i, text in enumerate(HEADER)], lines.schema)
    keys = ["page_id", "section", "seq"]
    ordered = head.unionByName(lines).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select(F.col("text").alias("value")).write.text(path)
