"""Queries that lay the corpus out: token files, the mix of sources, and shards."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import pfor_tokens, slot_shards, source_mix
from folioscope.llm.queries import query
from folioscope.llm.store import documents, shared_folder, stored, text_bytes

SHARDS = 24


END_ID = 2


@query("op7_token_blocks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to block files and read back."""
    import public_tokenizers

    path = f"{shared_folder(spark)}/llm/tokens-{uuid.uuid4().hex}"
    pfor_tokens.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    rows = pfor_tokens.read_tokens(spark, path).select(  # the ids themselves need not move
        "doc_id", "part", "seq", "offset", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
    starts = pfor_tokens.segment_starts(spark, path)
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


@query("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, in blocks of 64 words."""
    rows = stored(source_mix.with_sizes(documents(spark, sf_dir).select("doc_id", "source", "text")), "mix-sizes")
    return source_mix.taken_words(source_mix.mix(rows))


@query("op10_virtual_slot_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes over 4096 virtual slots by doc_id."""
    rows = documents(spark, sf_dir).select(
        "doc_id", (text_bytes("text") + 8).alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32")
    )
    folder = f"{shared_folder(spark)}/llm/shard-map-{uuid.uuid4().hex}"
    _, version = slot_shards.balance(rows, "doc_id", "size", SHARDS, folder)
    placed = slot_shards.assign(rows, "doc_id", slot_shards.read_map(spark, folder, version), ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )
