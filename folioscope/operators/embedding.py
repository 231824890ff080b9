"""Texts to vectors with a model passed in as a function."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import fold, tokens
from folioscope.settings import EMBED_BATCH, VECTOR_SIZE

Model = Callable[[list[str]], list[list[float]]]


def hashing_model() -> Model:
    """Word counts in 768 hash buckets, at unit length. Expects folded words separated by spaces."""
    known: dict[str, int] = {}

    def bucket(token: str) -> int:
        found = known.get(token)
        if found is None:
            if len(known) > 200_000:  # forget, rather than grow with the vocabulary
                known.clear()
            found = known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % VECTOR_SIZE
        return found

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            counts = np.bincount(np.array([bucket(t) for t in text.split(" ") if t], dtype="int64"), minlength=VECTOR_SIZE).astype("float64")
            norm = np.sqrt((counts * counts).sum())
            out.append((counts / norm if norm else counts).astype("float32"))
        return out

    return embed


def hashed_vectors(
    rows: DataFrame, text: str = "text", width: int = VECTOR_SIZE, use: tuple[str, T.DataType, Callable[[pa.Array], pa.Array]] | None = None
) -> DataFrame:
    """Adds `embedding`: counts of folded words in hash buckets, at unit length. `use` (name, type, function of the vectors) adds
    what the function gives in their place, so that vectors do not leave the task.

    Words are hashed by SQL functions; a task only turns bucket numbers into dense vectors, for a batch at once.
    """
    bucket = F.transform(tokens(fold(F.col(text))), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % width).cast("int"))
    kept = rows.columns
    name, kind, made = use or ("embedding", T.ArrayType(T.FloatType()), None)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                lists = part.column(part.schema.get_field_index("_buckets"))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                cell = np.repeat(np.arange(part.num_rows), sizes) * width + lists.flatten().to_numpy(zero_copy_only=False)
                counts = np.bincount(cell, minlength=part.num_rows * width).reshape(-1, width).astype("float64")
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                values = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).astype("float32")
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width)
                vectors = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), made(vectors) if made else vectors], [*kept, name])

    return rows.withColumn("_buckets", bucket).mapInArrow(dense, schema)


def embed_texts(
    rows: DataFrame,
    model_factory: Callable[[], Model] | None = None,
    text: str = "text",
    batch: int = EMBED_BATCH,
    width: int = VECTOR_SIZE,
    spread: int | None = None,
) -> DataFrame:
    """Adds `embedding`. The factory runs once per task; requests carry `batch` texts.

    `spread` deals the texts out to that many tasks first, for input that comes in fewer; texts
    are far smaller than the vectors and calls they cause.

    The default is word hashing on folded words. A request that answers with another number of
    vectors, or with vectors of another size, fails the task.
    """
    dealt = rows if spread is None else rows.repartition(spread)
    if model_factory is None:
        return hashed_vectors(dealt, text, width)
    prepared = dealt.withColumn("_in", F.col(text))
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for frame in batches:
            texts = frame["_in"].tolist()
            vectors: list = []
            for start in range(0, len(texts), batch):
                chunk = texts[start : start + batch]
                answer = model(chunk)
                if len(answer) != len(chunk):
                    raise RuntimeError(f"{len(answer)} vectors for {len(chunk)} texts")
                vectors.extend(answer)
            wrong = {len(v) for v in vectors} - {width}
            if wrong:
                raise RuntimeError(f"vectors of size {sorted(wrong)} where {width} is set")
            yield frame.drop(columns="_in").assign(embedding=vectors)

    return prepared.mapInPandas(embed, schema)


