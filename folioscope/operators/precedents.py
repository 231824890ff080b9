"""Precedents: repeated word forms, gaps and their confirmed neighbours, second readings."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators.search import knn_join
from folioscope.operators.threshold import threshold_join
from folioscope.settings import (
    MAX_FORMS,
    MAX_NEIGHBOURS,
    MIN_FORM_COUNT,
    MIN_GAP_QUERY_CHARS,
    MIN_NEIGHBOUR_SCORE,
    NEIGHBOUR_CHARS,
)

# Words that are no precedent.
STOP_WORDS = (
    "ilegivel", "ilegível", "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos", "a", "o", "as", "os", "e",
    "ou", "um", "uma", "que", "por", "para", "com", "sem", "ao", "aos", "se", "sua", "seu", "não", "nao",
)


def word_forms(texts: DataFrame, min_count: int = MIN_FORM_COUNT, limit: int = MAX_FORMS) -> DataFrame:
    """Words found in at least `min_count` texts, the most frequent first; each text counts once per word."""
    words = F.array_distinct(tx.tokens(tx.gap_query(F.col("text"))))
    return (
        texts.select(F.explode(words).alias("form"))
        .filter(F.length("form").between(2, 40) & ~F.lower("form").isin(*STOP_WORDS))
        .groupBy("form")
        .agg(F.count("*").alias("texts"))
        .filter(F.col("texts") >= min_count)
        .orderBy(F.desc("texts"), "form")
        .limit(limit)
    )


def gap_queries(rows: DataFrame) -> DataFrame:
    """Rows with a gap and enough readable text left to search with."""
    query = tx.gap_query(F.col("text"))
    return rows.filter(tx.has_gap(F.col("text"))).withColumn("query", query).filter(F.length("query") >= MIN_GAP_QUERY_CHARS)


def gap_neighbours(gaps: DataFrame, table: DataFrame, sparse: bool = False, **blocks) -> DataFrame:
    """Close confirmed rows per gapped row: (query_id, part_id, rank, score, neighbour).

    gaps: query_id, vector, group_id; table: part_id, embedding, group_id, text; vectors are arrays or, but for `sparse`, packed. Rows of the
    group that is being read are not neighbours. `sparse` scores only rows that share a rare enough dimension,
    which pays where most of a vector's norm lies in rare words; otherwise all pairs are scored. The rows are the same.
    """
    # the score is rounded to four decimals before it is compared
    least = MIN_NEIGHBOUR_SCORE - 6e-5
    near = threshold_join(gaps, table, least, MAX_NEIGHBOURS, **blocks) if sparse else knn_join(gaps, table, MAX_NEIGHBOURS, least=least, **blocks)
    close = near.withColumn("score", F.round("score", 4)).filter(F.col("score") >= MIN_NEIGHBOUR_SCORE)
    texts = table.select("part_id", F.substring(tx.squeeze(F.col("text")), 1, NEIGHBOUR_CHARS).alias("neighbour"))
    found = close.join(texts, "part_id").filter("neighbour <> ''")
    once = W.partitionBy("query_id", "neighbour").orderBy("rank")
    return found.withColumn("_again", F.row_number().over(once)).filter("_again = 1").drop("_again")


def gap_precedents(neighbours: DataFrame, gaps: DataFrame) -> DataFrame:
    """At most four precedents per read group, gaps in line order and each gap's nearest first."""
    rows = neighbours.join(gaps.select("query_id", "group_id", "position"), "query_id")
    # A neighbour several gaps share counts where it comes first.
    first = rows.groupBy("group_id", "neighbour").agg(F.min(F.struct("position", "rank")).alias("_at"))
    order = W.partitionBy("group_id").orderBy("_at", "neighbour")
    return (
        first.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= MAX_NEIGHBOURS)
        .select("group_id", "rank", "neighbour")
    )


def merge_reread(first: DataFrame, second: DataFrame) -> DataFrame:
    """A second reading replaces gapped texts where it has text, in groups it answers in full.

    first, second: group_id, position (0-based), text.
    """
    sizes = first.groupBy("group_id").agg(F.count("*").alias("_n"))
    full = (
        second.groupBy("group_id").agg(F.count("*").alias("_m"))
        .join(sizes, "group_id").filter("_m >= _n").select("group_id", F.lit(True).alias("_full"))
    )
    again = second.select("group_id", "position", F.col("text").alias("_again")).join(full, "group_id")
    replace = F.coalesce("_full", F.lit(False)) & tx.has_gap(F.col("text")) & tx.has_text(F.col("_again"))
    return first.join(again, ["group_id", "position"], "left").withColumn(
        "text", F.when(replace, F.col("_again")).otherwise(F.col("text"))
    ).select(*first.columns)
