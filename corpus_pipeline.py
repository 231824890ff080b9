"""From documents to token ids: five stages, each on all rows the one before has kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. `run` writes each stage's rows to the shared folder and reads them back.

language            drops texts without a language (null, no letters) or without one that covers half; null lang is filled
line_dedup          cuts line blocks that an earlier document has; a document with nothing left goes
near_duplicates     keeps one document of each group of near copies, the one of smallest doc_id
source_mix          takes blocks of words so that sources reach their target weights; a document may come repeatedly
encode              ids of the pieces of every text

Tables may be empty; null and repeated rows are handled as the operators say. SQL cannot express the learned and
iterative stages, so ORACLE_SQL is None and tests compare stages with plain computations on small tables.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import chosen_path, line_patience, mixture_language, piece_viterbi, source_mix
from folioscope.llm.store import documents, dropped, recorded, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SHARE = 0.5
BATCH_BYTES = "8m"  # of rows that go to a Python worker at once; Spark holds each batch outside its heap, in buffers that double as they grow
ORACLE_SQL = None


_earlier: list[str] = []  # tables the stage before has stored; its rows are written by now


def stage(fn):
    """A stage that first deletes what the one before has stored, so that disk follows one stage and not all of them.

    It leaves the session's `spark.sql.execution.arrow.maxBytesPerBatch` at BATCH_BYTES, since its rows are made later.
    """

    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark, _earlier)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        with recorded(_earlier):
            return fn(spark, docs, sf_dir)

    return run_stage


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = mixture_language.fit(docs.select("text", "lang"))
    found = mixture_language.identify(docs, model)
    kept = found.filter((F.col("lang_pred") != mixture_language.UND) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = line_patience.without_repeats(docs).filter((F.col("text") != "") | (F.col("lines_cut") == 0))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(docs).filter("first_of_class").select(*COLUMNS)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs.select(*COLUMNS))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the piece vocabulary of the public_tokenizers package, at the same path on executors."""
    import public_tokenizers

    rows = piece_viterbi.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    return rows.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "ids")


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", mix),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, run_stage in STAGES:
        docs = stored(run_stage(spark, docs, sf_dir), f"pipeline-{name}")
    dropped(spark, _earlier)
    return docs
