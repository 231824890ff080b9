"""Tables written to the shared folder, so that later jobs do not depend on executors that may be lost."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only in local mode with none set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_recorders: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]):
    """Adds to `paths` the folders of tables stored inside the block."""
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nobody reads any more, and empty the list."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    paths.clear()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_bytes(text) -> object:
    """Column: UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
