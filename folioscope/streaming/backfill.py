"""Vectors for index rows that have none, as the index grows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from folioscope.operators.embedding import Model, embed_texts, hashed_vectors
from folioscope.operators.search import pack, packed
from folioscope.operators.spread import durable
from folioscope.schemas import TRANSCRIPTIONS
from folioscope.settings import VECTOR_SIZE
from folioscope.sources import index_table


def outstanding_rows(spark: SparkSession, index_root: str, files_per_trigger: int = 1000) -> DataFrame:
    """Index rows without a vector, as files of new versions appear."""
    return (
        spark.readStream.schema(TRANSCRIPTIONS)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(index_root)
        .filter("part_id IS NOT NULL AND embedding IS NULL")
        .select("part_id", "content_hash", "text")
    )


def embed_batch(batch: DataFrame, batch_id: int, vectors_root: str, model_factory: Callable[[], Model] | None, width: int) -> None:
    """Embeds what no earlier batch has embedded, and keeps it under (part_id, content_hash).

    Only the buckets of the batch's parts are opened, and of them keys and hashes are read; vectors only of parts that get another
    one, which are written together with it. A retried batch writes the same version again.
    """
    store = index_table.vector_store(batch.sparkSession, vectors_root)
    todo = durable(batch.dropDuplicates(["part_id", "content_hash"]))
    fresh = todo
    if started := bool(store.manifest(batch_id)["buckets"]):  # else there is nothing to compare texts with
        done = store.read(todo, batch_id).select("part_id", "content_hash")
        fresh = durable(todo.join(done, ["part_id", "content_hash"], "left_anti"))
    if fresh.isEmpty():
        return
    if model_factory is None:  # packed where they are made
        embedded = hashed_vectors(fresh, width=width, use=("embedding", T.BinaryType(), pack))
    else:  # a model's answers are stored before they are used; word hashing is cheaper than that
        embedded = durable(packed(embed_texts(fresh, model_factory, width=width), "embedding"))
    embedded = embedded.select("part_id", "content_hash", "embedding")
    store.write(store.read(fresh, batch_id).unionByName(embedded) if started else embedded, None, batch_id)


def stream_embed_backfill(
    rows: DataFrame,
    vectors_root: str,
    checkpoint: str,
    model_factory: Callable[[], Model] | None = None,
    width: int = VECTOR_SIZE,
    available_now: bool = True,
) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        embed_batch(batch, batch_id, vectors_root, model_factory, width)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
