"""Import and reading progress: the last state per file or page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.schemas import PROGRESS_EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON event per line."""
    return spark.read.schema(PROGRESS_EVENT).json(path)


def stage_message(stage: Column, filename: Column, done: Column, total: Column) -> Column:
    return (
        F.when(stage == "original", F.concat(filename, F.lit(" · Preparando o documento…")))
        .when(
            stage == "tile",
            F.concat(F.lit("Zoom + Melhorias · bloco "), done.cast("string"), F.lit(" de "), total.cast("string")),
        )
        .when(stage == "crop", "Refilagem · ajustando as bordas…")
        .when(stage == "finished", "Melhorias concluídas · marcando as linhas…")
    )


def last_state(events: DataFrame, key: str = "filename", order: str = "seq") -> DataFrame:
    """The state the newest event left, per key. Works on streams as well (update mode)."""
    state = F.max_by(F.struct("stage", "done", "total"), F.col(order))
    return events.groupBy(key).agg(state.alias("_s"), F.max(order).alias(order)).select(
        key, order, F.col("_s.stage").alias("stage"), F.col("_s.done").alias("done"), F.col("_s.total").alias("total")
    )


def import_progress(events: DataFrame) -> DataFrame:
    state = last_state(events)
    return state.withColumn("message", stage_message(F.col("stage"), F.col("filename"), F.col("done"), F.col("total")))
