"""Queries that compare documents: repeated lines, fingerprints."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import chosen_path, collinear_chains, line_patience, winnowing
from folioscope.llm.queries import query
from folioscope.llm.store import documents


@query("op3_winnowing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to each other and to the next text's."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = winnowing.with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = winnowing.with_fingerprint(rows, "text", "f")
    rows = winnowing.with_fingerprint(rows, "edited", "e")
    rows = winnowing.with_fingerprint(rows, "next_text", "x").select(
        "doc_id", "n_chars", "edited_sha256", winnowing.written(F.col("f")).alias("fingerprint"), winnowing.written(F.col("e")).alias("edited_fingerprint"),
        *[winnowing.hashes(F.col(c)).alias(c) for c in "fex"],
    )
    rows = winnowing.likeness(winnowing.likeness(rows, "f", "e", "near_edited"), "f", "x", "near_next")
    return rows.drop("f", "e", "x")


@query("op2_line_patience")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words cut from every document, the documents they repeat, and the digest of what stays."""
    rows = line_patience.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "lines_cut", "words_cut", "sources", F.sha2("text", 256).alias("text_sha256"))


@query("op4_chosen_path")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document, five-word shingles, similarity of 0.8 or more."""
    return chosen_path.near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


@query("op5_collinear_chains")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier document has too, and how many later ones come from it."""
    return collinear_chains.repeated_passages(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
