"""The passage index on parquet: page versions beside a table of vectors.

Vectors are kept under (part_id, content_hash). A row finds its vector only while its text is the
one that was embedded, which is what guards a backfill against edits made meanwhile.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.search import packed, unpacked
from folioscope.schemas import TRANSCRIPTIONS
from folioscope.sources import versions
from folioscope.sources.page_store import PageStore

VECTORS = T.StructType([
    T.StructField("part_id", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("embedding", T.BinaryType()),  # packed: a text of thirty words is some 300 bytes instead of 3 KB
])


def write_base(table: DataFrame, root: str, version: int = 0) -> str:
    """A whole table, spread by range over (page_id, part_id), so page filters skip row groups."""
    ordered = table.repartitionByRange("page_id", "part_id").sortWithinPartitions("page_id", "part_id")
    return versions.write_all(ordered.select(*TRANSCRIPTIONS.fieldNames()), root, version)


def read_table(spark: SparkSession, root: str, below: int | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Current rows of the index."""
    return versions.read_pages(spark, root, TRANSCRIPTIONS, "part_id", below, pages)


def vector_store(spark: SparkSession, root: str, buckets: int = 256) -> PageStore:
    """Vectors in hash buckets of their part, one for each text the part has had embedded."""
    return PageStore(spark, root, VECTORS, "content_hash", "part_id", buckets)


def read_packed(spark: SparkSession, root: str) -> DataFrame:
    """Vectors as they are stored, for joins."""
    return vector_store(spark, root).read()


def read_vectors(spark: SparkSession, root: str) -> DataFrame:
    return read_packed(spark, root).withColumn("embedding", unpacked(F.col("embedding")))


def with_vectors(table: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with the vector their present text was given. Vectors are arrays or packed, and move packed."""
    fresh = packed(vectors, "embedding").withColumnRenamed("embedding", "_vector")
    return (
        table.join(fresh, ["part_id", "content_hash"], "left")
        .withColumn("embedding", F.coalesce("embedding", unpacked(F.col("_vector"))))
        .select(*table.columns)
    )
