"""Helpers for bounded groups and for connected components."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.store import stored


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a group next to each other in one partition; for groups of bounded size."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group begins in its table (and the end), from rows sorted by key."""
    held: list[pa.RecordBatch] = []

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for key in keys:
            column = table.column(key).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, int(at[-2])).combine_chunks(), at[:-1]
            held = table.slice(int(at[-2])).combine_chunks().to_batches()
        else:
            held = table.to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, bounds(table)


def local_components(linked: np.ndarray) -> np.ndarray:
    """Smallest member number reachable from each member of a small symmetric boolean matrix."""
    label = np.arange(len(linked))
    reach = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(linked)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) for edges a, b of whole numbers.

    Each round takes the smallest label among neighbours and follows labels one step, so a path of n edges needs
    about log n rounds. Labels stay distributed and every round is written to the shared folder.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        best = (
            both.join(labels, F.col("b") == F.col("vertex")).groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("_best"))
        )
        near = labels.join(best, "vertex").select("vertex", "component", F.least("component", "_best").alias("_near"))
        up = labels.select(F.col("vertex").alias("_near"), F.col("component").alias("_up"))
        after = stored(near.join(up, "_near").select("vertex", F.col("component").alias("_old"), F.least("_near", "_up").alias("component")), "labels")
        labels = after.select("vertex", "component")
        if after.filter("_old <> component").isEmpty():
            return labels
