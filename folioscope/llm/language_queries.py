"""Queries that read texts through a model learned from the corpus."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import mixture_language, piece_viterbi, quality_perplexity
from folioscope.llm.queries import query
from folioscope.llm.store import documents


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op6_language_mixture")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by mixture inference, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = mixture_language.fit(docs.filter(~is_held_out()).select("text", "lang"))
    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return mixture_language.identify(rows, model).drop("text")


@query("op1_perplexity_bands")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every document, and whether its perplexity lies in its language's band."""
    rows = quality_perplexity.judged(documents(spark, sf_dir).select("doc_id", "lang", "text"))
    return rows.select("doc_id", *quality_perplexity.COUNTS, "base_failed", "kept", "perplexity", "nll_adjusted", "nll_low", "nll_high")


@query("op8_piece_viterbi")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to the same text."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_viterbi.decode(piece_viterbi.encode(documents(spark, sf_dir).select("doc_id", "text"), model), model)
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
