"""Literal search over posting lists of trigrams, so that texts are read only where a hit is possible.

Texts are stored with row numbers, CHUNK rows to a chunk and chunks to slabs (folders). For every trigram of a folded
text and every chunk there is one sorted list of places in the chunk; lists lie in files by hash of the trigram, sorted by it, so
a look-up opens a few row groups. A query's trigrams are those of its words, or of the whole phrase where that must
occur as it stands; lists are intersected chunk by chunk, candidates are read from their slabs, and text_match decides. A query
without any trigram (words of one or two letters) reads all texts, as the plain search does.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators.search import HIT_ORDER
from folioscope.operators.spread import durable

CHUNK_BITS = 12  # a place fits a short
SLAB_BITS = 8  # chunks to a slab
BUCKETS = 64
POINT = np.uint64((1 << 21) - 1)
NARROW = 1 << 20  # candidates that may be broadcast


def query_grams(query: str) -> list[str]:
    """Trigrams every matching text has."""
    phrase = tx.fold_query(query)
    pieces = phrase.split() if len(tx.query_words(query)) > 1 else [phrase]
    return sorted({p[i : i + 3] for p in pieces for i in range(len(p) - 2)})


def chunk_lists(number: int, places: list[int], folded: list[str]) -> pa.RecordBatch:
    """gram, chunk, places of one chunk: the trigrams of all its texts at once, as numbers of three code points."""
    points = np.frombuffer("".join(folded).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    lengths = np.array([len(x) for x in folded])
    ends = np.cumsum(lengths)
    of = np.repeat(np.arange(len(folded)), lengths)
    first = np.flatnonzero(np.arange(len(points)) + 2 < ends[of])  # a trigram ends inside its text
    codes, which = np.unique(points[first] << np.uint64(42) | points[first + 1] << np.uint64(21) | points[first + 2], return_inverse=True)
    pairs = np.unique(which.astype(np.int64) << CHUNK_BITS | np.array(places, dtype=np.int64)[of[first]])
    bounds = np.searchsorted(pairs, np.arange(len(codes) + 1) << CHUNK_BITS)
    letters = np.stack([codes >> np.uint64(42), codes >> np.uint64(21) & POINT, codes & POINT], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((pairs & ((1 << CHUNK_BITS) - 1)).astype(np.int16)))
    grams = [letters[i : i + 3] for i in range(0, len(letters), 3)]
    return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([number] * len(grams), pa.int64()), lists], ["gram", "chunk", "places"])


def write_postings(numbered: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Texts by slab, and their posting lists by bucket. A chunk's lists are made inside one task; no trigram is shuffled."""
    spark = numbered.sparkSession
    rows = numbered.filter(tx.has_text(F.col("text"))).withColumn("_row", F.monotonically_increasing_id())
    chunk = F.shiftright("_row", CHUNK_BITS)
    rows.withColumn("_slab", F.shiftright(chunk, SLAB_BITS)).write.partitionBy("_slab").parquet(f"{root}/texts")
    texts = spark.read.parquet(f"{root}/texts")

    def lists(batches):
        at, rows, held = -1, [], []
        for batch in batches:
            for row, folded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if row >> CHUNK_BITS != at:
                    if rows:
                        yield chunk_lists(at, rows, held)
                    at, rows, held = row >> CHUNK_BITS, [], []
                rows.append(row & ((1 << CHUNK_BITS) - 1)), held.append(folded)
        if rows:
            yield chunk_lists(at, rows, held)

    folded = texts.select("_row", tx.fold(tx.strip(F.col("text"))).alias("_folded"))
    # A file holds rows in the order of their numbers; where Spark cuts it, a chunk has two lists, which are read as one.
    found = folded.mapInArrow(lists, "gram string, chunk long, places array<short>")
    placed = found.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("gram", "chunk").write.partitionBy("bucket").parquet(f"{root}/postings")


def candidates(spark: SparkSession, root: str, grams: list[str], buckets: int = BUCKETS) -> DataFrame:
    """_slab, _row of the rows that have all of `grams`."""
    wanted = spark.range(0, 1, 1, 1).select(F.explode(F.array(*[F.lit(g) for g in grams])).alias("gram"))
    opened = [r[0] for r in wanted.select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct().collect()]  # one per trigram of the query
    found = spark.read.parquet(f"{root}/postings").filter(F.col("bucket").isin(opened) & F.col("gram").isin(grams))
    lists = found.groupBy("chunk", "gram").agg(F.flatten(F.collect_list("places")).alias("places"))
    chunks = lists.groupBy("chunk").agg(F.count("*").alias("_n"), F.collect_list("places").alias("_all")).filter(F.col("_n") == len(grams))
    common = F.aggregate(F.slice("_all", 2, len(grams)), F.get("_all", F.lit(0)), F.array_intersect)
    places = chunks.select("chunk", F.explode(common).alias("place"))
    return places.select(F.shiftright("chunk", SLAB_BITS).alias("_slab"), (F.shiftleft("chunk", CHUNK_BITS) + F.col("place").cast("long")).alias("_row"))


def indexed_hits(spark: SparkSession, root: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """Every part that matches, as literal_hits finds them."""
    texts = spark.read.parquet(f"{root}/texts")
    grams = query_grams(query)
    match = tx.text_match(F.col("text"), query)
    if grams:
        found = durable(candidates(spark, root, grams, buckets).withColumn("_found", F.lit(True)))
        texts = texts.join(F.broadcast(found) if found.count() <= NARROW else found, ["_slab", "_row"])
        match = F.when(F.col("_found"), match)  # a condition on texts alone would be moved below the join, to all of them
    return texts.filter(match).drop("_slab", "_row", "_found")


def indexed_search(spark: SparkSession, root: str, query: str, first: int = 0, size: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of search.literal_search. Hits are stored once; the total counts them there."""
    hits = durable(indexed_hits(spark, root, query, buckets))
    total = hits.count()
    shown = hits if size is None else hits.orderBy(*HIT_ORDER).offset(first).limit(size)
    return shown.select(
        "page_id", "line_id", "part_id", "linha_documento", "parte", "text", tx.snippet(F.col("text"), query).alias("snippet"),
        F.lit(total).cast("bigint").alias("total"),
    )
