"""Versioned page tables on parquet.

Each write adds a folder `version=N` with the whole content of the pages it touches, so a save costs
what it changes, not the table. A page's rows are those of its newest version; a page without
rows is kept as one row whose other columns are null. Writing a version again replaces it, so a
retried batch leaves one copy.

A version written with `buckets` is bucketed and sorted by page_id, as Spark's bucketed tables are, so joins, groups and
windows by page read it where it lies and do not shuffle its rows. A marker file in its folder names the number of
buckets. Readers see such versions as partitions of an external table, one per root, in the session's catalog.
"""
from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _folders(spark: SparkSession, root: str) -> list[int]:
    """Committed versions (the only thing listed on the driver: one entry per version)."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    folder = path_of(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and fs.exists(path_of(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def newest(spark: SparkSession, root: str) -> int | None:
    found = _folders(spark, root)
    return found[-1] if found else None


def _marker(spark: SparkSession, path: str, name: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path, name)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()), file


def buckets_of(spark: SparkSession, root: str, version: int) -> int | None:
    """The number of buckets of a version; None for plain files."""
    fs, pattern = _marker(spark, f"{root}/version={version}", "_buckets_*")
    found = fs.globStatus(pattern)
    return int(found[0].getPath().getName().split("_")[-1]) if found else None


def _write(rows: DataFrame, path: str, buckets: int | None) -> str:
    if buckets is None:
        rows.write.mode("overwrite").parquet(path)
        return path
    spark, name = rows.sparkSession, f"folioscope_write_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, "page_id").sortBy("page_id").option("compression", "zstd")
    writer.option("path", path).mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    fs, file = _marker(spark, path, f"_buckets_{buckets}")
    fs.create(file, True).close()
    return path


def write_pages(rows: DataFrame, touched: DataFrame, root: str, version: int, buckets: int | None = None) -> str:
    """The rows of the touched pages as version `version`."""
    return _write(touched.select("page_id").distinct().join(rows, "page_id", "left"), f"{root}/version={version}", buckets)


def write_all(rows: DataFrame, root: str, version: int, buckets: int | None = None) -> str:
    """Rows that are whole pages already (a first load, a compaction): no join, and no shuffle but the one into buckets."""
    dealt = rows if buckets is None else rows.repartition(buckets, "page_id")
    return _write(dealt, f"{root}/version={version}", buckets)


def _bucketed(spark: SparkSession, root: str, full: T.StructType, versions: list[int], buckets: int) -> DataFrame:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields)
    name = f"folioscope_{hashlib.md5(f'{root} {columns} {buckets}'.encode()).hexdigest()}"
    place = root.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (version) "
        f"CLUSTERED BY (page_id) SORTED BY (page_id) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (version={v})" for v in versions))
    spark.catalog.refreshTable(name)  # a retried batch has other files
    return spark.table(name).filter(F.col("version").isin(versions))


def read_versions(spark: SparkSession, root: str, schema: T.StructType, versions: list[int]) -> DataFrame:
    """All rows of these versions, markers of empty pages included, with `version`."""
    full = T.StructType([*schema.fields, T.StructField("version", T.IntegerType())])
    kinds: dict[int | None, list[int]] = {}
    for v in versions:
        kinds.setdefault(buckets_of(spark, root, v), []).append(v)
    found = []
    for buckets, held in kinds.items():
        if buckets is None:
            found.append(spark.read.schema(full).option("basePath", root).parquet(*[f"{root}/version={v}" for v in held]))
        else:
            found.append(_bucketed(spark, root, full, held, buckets))
    return reduce(DataFrame.unionByName, found)


def read_pages(
    spark: SparkSession, root: str, schema: T.StructType, item: str, below: int | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """The current rows. `item` is the column that is null on the marker of an empty page.

    `below` reads the table as it was before that version; `pages` limits the work to some pages
    before versions are compared.
    """
    versions = [v for v in _folders(spark, root) if below is None or v < below]
    if not versions:
        return spark.createDataFrame([], schema)
    stored = read_versions(spark, root, schema, versions)
    if pages is not None:
        stored = stored.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    if len(versions) == 1:
        return stored.filter(F.col(item).isNotNull()).select(*schema.fieldNames())
    last = stored.groupBy("page_id").agg(F.max("version").alias("_last"))
    # Not written as an equality, which would make the version a key of the join, and rows kept by page would move.
    return stored.join(last, "page_id").filter((F.col("version") >= F.col("_last")) & F.col(item).isNotNull()).select(*schema.fieldNames())


def compact(spark: SparkSession, root: str, schema: T.StructType, item: str, target: str) -> str:
    """All current rows as the first version of another root."""
    return write_all(read_pages(spark, root, schema, item), target, 0)
