"""Page statistics, corpus totals, status labels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import has_text, strip
from folioscope.operators.numbering import number_lines


def page_stats(lines: DataFrame) -> DataFrame:
    """lines, written, confirmed and a preview per page, lines outside the transcription included.

    Works on lines with nested parts: the window that numbers the lines also counts the written
    lines before each one, so the preview needs no second ranking, and the rest is one
    aggregation with map-side combine on the same partitioning.
    """
    texts = F.filter("parts", lambda p: has_text(p["text"]))
    written = F.size(texts) > 0
    facts = number_lines(
        lines.select(
            *[c for c in lines.columns if c != "parts"],
            written.alias("written"),
            F.forall(texts, lambda p: F.coalesce(p["confirmed"], F.lit(False))).alias("settled"),
            F.when(written, strip(texts[0]["text"])).alias("first_text"),
        ),
        {"_written_before": F.col("written").cast("int")},
    )

    def bit(nth: int) -> Column:
        return F.max(F.when(F.col("written") & (F.col("_written_before") == nth), F.col("first_text")))

    return facts.groupBy("page_id").agg(
        F.count("*").alias("lines"),
        F.count_if("written").alias("written"),
        F.count_if(F.col("written") & F.col("settled")).alias("confirmed"),
        F.concat_ws(" ", bit(0), bit(1)).alias("preview"),
    )


def corpus_totals(pages: DataFrame, stats: DataFrame) -> DataFrame:
    per_page = pages.select("page_id").join(stats.select("page_id", "lines", "written"), "page_id", "left")
    return per_page.agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("written"), F.lit(0)).alias("written"),
    )


def status_label(lines: Column, written: Column, confirmed: Column) -> Column:
    of = F.concat(written.cast("string"), F.lit(" de "), lines.cast("string"), F.lit(" linhas"))
    return (
        F.when(lines == 0, "Sem linhas")
        .when((written == 0) | (confirmed == 0), of)
        .when(confirmed == written, F.concat(of, F.lit(" conferidas")))
        .otherwise(F.concat(of, F.lit(" · "), confirmed.cast("string"), F.lit(" conferidas")))
    )


def with_status(stats: DataFrame) -> DataFrame:
    return stats.select(
        "*",
        status_label(F.col("lines"), F.col("written"), F.col("confirmed")).alias("status"),
        F.when(F.col("lines") == 0, 0)
        .otherwise(F.floor(F.col("written") / F.col("lines") * 100 + F.lit(0.5)))
        .cast("int")
        .alias("percent"),
    )


def in_scope(stats: DataFrame, scope: str) -> DataFrame:
    """todos: every page; texto: pages with text; vazio: pages without."""
    if scope == "texto":
        return stats.filter("written > 0")
    if scope == "vazio":
        return stats.filter("written = 0")
    return stats
