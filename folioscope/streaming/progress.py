"""Live status per page from a stream of progress events."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from folioscope.sources.progress import last_state, stage_message


def stream_progress(events: DataFrame, out: str, checkpoint: str, key: str = "filename", available_now: bool = True) -> StreamingQuery:
    """Keeps the newest state per key and writes the keys each batch changed."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    writer = (
        last_state(events, key).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_progress(spark: SparkSession, out: str, key: str = "filename") -> DataFrame:
    """The status as of the last batch."""
    states = last_state(spark.read.option("recursiveFileLookup", "true").parquet(out), key)
    return states.withColumn("message", stage_message(F.col("stage"), F.col(key), F.col("done"), F.col("total")))
