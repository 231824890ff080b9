"""Intermediate tables that outlive executors, and positions over a whole table."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-folio-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """Materialise rows where they outlive the executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A function that keeps rows as `durable` does, as compressed Parquet that is deleted with the block: for steps whose results are written inside it."""
    root = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)

    def keep(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """`n` whole numbers that repartition(n, key) deals to as many partitions, for work whose pieces are known and long."""
    tried = 16 * n
    while True:
        found = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n))).agg(F.min("id").alias("id")).collect()  # n rows
        if len(found) == n:
            return sorted(r["id"] for r in found)
        tried *= 2


def place_in_partition(seq: str) -> Column:
    """1-based place of a row in its partition, from its monotonically increasing id."""
    return F.col(seq).bitwiseAND(F.lit((1 << 33) - 1)) + 1


def queue_positions(df: DataFrame, order: list[Column], value: str, name: str = "position") -> DataFrame:
    """Adds the 1-based position in the whole order, `total`, and the `value` of the row before and after (null at the ends).

    One range sort. Inside a range partition, neighbours are next to each other; of a partition only the first and the last
    value, and its size, are seen by the others. `order` must be total, `value` a string column without nulls.
    """
    sorted_ = df.orderBy(*order).withColumns({"_pid": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    names = sorted_.columns
    schema = T.StructType([*sorted_.schema.fields, T.StructField("_before", T.StringType()), T.StructField("_after", T.StringType())])
    empty = pa.array([None], pa.string())

    def run(batches):
        last, held = empty, None
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(names.index(value)).cast(pa.string())
            if held is not None:
                yield pa.RecordBatch.from_arrays([*held, pa.concat_arrays([held[names.index(value)].cast(pa.string()).slice(1), values.slice(0, 1)])], [*names, "_before", "_after"])
            held = [*batch.columns, pa.concat_arrays([last, values.slice(0, len(values) - 1)])]
            last = values.slice(len(values) - 1)
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held, pa.concat_arrays([held[names.index(value)].cast(pa.string()).slice(1), empty])], [*names, "_before", "_after"])

    tagged = durable(sorted_.mapInArrow(run, schema))
    # One row per range partition, however many rows the table has.
    parts = tagged.groupBy("_pid").agg(F.count("*").alias("_n"), F.min_by(value, "_seq").alias("_head"), F.max_by(value, "_seq").alias("_tail"))
    by_part = W.orderBy("_pid")
    parts = parts.select(
        "_pid", "_n", F.coalesce(F.sum("_n").over(by_part.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.lag("_tail").over(by_part).alias("_came"), F.lead("_head").over(by_part).alias("_comes"),
        F.sum("_n").over(by_part.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
    )
    placed = tagged.join(F.broadcast(parts), "_pid").withColumn("_rn", place_in_partition("_seq"))
    return placed.select(
        *df.columns, (F.col("_base") + F.col("_rn")).alias(name), "total",
        F.when(F.col("_rn") == 1, F.col("_came")).otherwise(F.col("_before")).alias(f"previous_{value}"),
        F.when(F.col("_rn") == F.col("_n"), F.col("_comes")).otherwise(F.col("_after")).alias(f"next_{value}"),
    )


def positions(
    df: DataFrame,
    order: list[Column],
    name: str,
    keys: list[str] | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """Dense 1-based positions without a one-task sort.

    Rows are sorted by range over (keys, order) and written once; then each range partition's
    size and totals give its offset. `order` must be total, so that no two rows tie. With
    `keys`, positions restart per group (few groups: the hot ones). `running` adds, per entry,
    the total of a non-negative column over the rows before this one.
    """
    keys = keys or []
    running = running or {}
    work = df
    for label, value in running.items():
        work = work.withColumn(f"_v_{label}", value)
    by = [F.col(k) for k in keys] + order
    tagged = durable(
        work.orderBy(*by)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    totals = tagged.groupBy("_pid").agg(
        F.count("*").alias("_n"), *[F.sum(f"_v_{r}").alias(f"_s_{r}") for r in running]
    )
    # One row per range partition, however many rows the table has.
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        *[F.coalesce(F.sum(f"_s_{r}").over(before), F.lit(0)).alias(f"_b_{r}") for r in running],
    )
    # The low bits of the row number are a row's place in its partition; only running totals need their rows in order again.
    earlier = W.partitionBy("_pid").orderBy("_seq").rowsBetween(W.unboundedPreceding, -1)
    placed = tagged.select(
        "*",
        place_in_partition("_seq").alias("_rn"),
        *[F.coalesce(F.sum(f"_v_{r}").over(earlier), F.lit(0)).alias(f"_l_{r}") for r in running],
    ).join(F.broadcast(offsets), "_pid")
    placed = placed.withColumn(name, F.col("_base") + F.col("_rn"))
    for r in running:
        placed = placed.withColumn(r, F.col(f"_b_{r}") + F.col(f"_l_{r}"))
    if keys:
        heads = placed.groupBy(*keys).agg(
            F.min(name).alias("_first"), *[F.min(r).alias(f"_f_{r}") for r in running]
        )
        placed = placed.join(heads, keys).withColumn(name, F.col(name) - F.col("_first") + 1)
        for r in running:
            placed = placed.withColumn(r, F.col(r) - F.col(f"_f_{r}"))
    return placed.select(*df.columns, name, *running)
