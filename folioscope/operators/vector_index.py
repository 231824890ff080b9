"""Approximate search over inverted lists: k-means lists, product codes, exact re-ranking.

A model is fitted on a bounded sample of rows (`sample`, those of smallest hash): `lists` centroids of unit vectors, and for each of
`subspaces` slices of a vector a codebook of up to 256 residuals. Every row is then assigned to its nearest list and coded
(one byte a slice), and written by list. A search opens the `probes` lists nearest to the query, which Spark prunes as partitions,
scores their codes by table look-up, and re-ranks the best `keep` rows by their exact cosine. The exact scan
(`search.vector_search`) stays the default way; `recall` measures this one against it.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.search import SEARCH_DEFAULT, _unit, cosine, searchable, shown_score

SAMPLE = 20_000
LISTS = 64
SUBSPACES = 16
CODES = 256
PROBES = 12
KEEP = 200


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)


def k_means(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Centres of at most k groups; the start is drawn far apart, empty groups take the worst placed row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(rows))
    centres = rows[rng.integers(len(rows))][None, :]
    gap = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        chance = gap / gap.sum() if gap.sum() > 0 else None
        centres = np.vstack((centres, rows[rng.choice(len(rows), p=chance)]))
        gap = np.minimum(gap, ((rows - centres[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        group = _nearest(rows, centres)
        n = np.bincount(group, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, group, rows)
        worst = np.argsort(-((rows - centres[group]) ** 2).sum(axis=1), kind="stable")
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        for place, row in zip(np.flatnonzero(n == 0), worst, strict=False):
            new[place] = rows[row]
        if np.allclose(new, centres):
            break
        centres = new
    return centres


@dataclass
class Quantizer:
    """The fitted model; it travels to tasks as it is (lists and codebooks, bounded by its parameters)."""

    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def slices(self) -> list[slice]:
        edges = np.linspace(0, self.width, len(self.books) + 1).astype(int)
        return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def lists_of(self, rows: np.ndarray) -> np.ndarray:
        return _nearest(rows, self.centres)

    def codes_of(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = rows - self.centres[lists]
        return np.stack([_nearest(rest[:, s], book) for s, book in zip(self.slices(), self.books, strict=True)], axis=1).astype(np.uint8)

    def probes(self, query: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-(self.centres @ query), kind="stable")[:n]

    def tables(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the query with every centre, and with every code of every slice."""
        part = np.zeros((len(self.books), CODES))
        for i, (s, book) in enumerate(zip(self.slices(), self.books, strict=True)):
            part[i, : len(book)] = book @ query[s]
        return self.centres @ query, part


def fit(table: DataFrame, lists: int = LISTS, subspaces: int = SUBSPACES, sample: int = SAMPLE) -> Quantizer | None:
    """The model of a bounded sample; None where no row has a direction."""
    picked = table.filter(F.col("embedding").isNotNull()).select("embedding", F.xxhash64("part_id").alias("_h")).orderBy("_h").limit(sample).select("embedding").toArrow()
    column = picked.column(0)
    if not len(column):
        return None
    width = max(map(len, column.to_pylist()))
    rows, known = _unit(column, width)
    rows = rows[known]
    if not len(rows):
        return None
    centres = k_means(rows, lists)
    rest = rows - centres[_nearest(rows, centres)]
    edges = np.linspace(0, width, min(subspaces, width) + 1).astype(int)
    return Quantizer(centres, [k_means(rest[:, a:b], CODES, rounds=8) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def write_index(table: DataFrame, model: Quantizer, root: str) -> None:
    """Every row of `table` that has a direction, with its list and codes, in one folder per list."""
    names, width = table.columns, model.width
    schema = T.StructType([*table.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("list", T.IntegerType())])

    def run(batches):
        for batch in batches:
            rows, known = _unit(batch.column(names.index("embedding")), width)
            lists = model.lists_of(rows)
            code = model.codes_of(rows, lists)
            full = pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary()), pa.array(lists.astype(np.int32))], [*names, "code", "list"])
            yield full.filter(pa.array(known))

    # rows of a list in a few files; a list that holds a third of all rows is dealt out like any other
    dealt = table.mapInArrow(run, schema).withColumn("_deal", F.pmod(F.xxhash64("part_id"), F.lit(8)))
    dealt.repartition("list", "_deal").drop("_deal").sortWithinPartitions("list", "part_id").write.mode("overwrite").partitionBy("list").parquet(root)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def _code_score(model: Quantizer, query: np.ndarray):
    centre, part = model.tables(query)
    places = np.arange(len(model.books))

    @F.arrow_udf(T.DoubleType())
    def score(code: pa.Array, lists: pa.Array) -> pa.Array:
        raw = np.frombuffer(b"".join(code.to_pylist()), dtype=np.uint8).reshape(-1, len(places))
        return pa.array(centre[lists.to_numpy(zero_copy_only=False)] + part[places[None, :], raw].sum(axis=1))

    return score


def approximate_search(
    index: DataFrame, model: Quantizer, query: list[float], limit: int = SEARCH_DEFAULT, probes: int = PROBES, keep: int = KEEP, **filters
) -> DataFrame:
    """The `limit` best rows among those of the nearest lists, as vector_search returns them."""
    target = np.asarray(query, dtype="float64")
    length = float(np.sqrt(target @ target))
    unit = target / length if length else target
    opened = [int(x) for x in model.probes(unit, probes)]
    rows = searchable(index.filter(F.col("list").isin(opened)), **filters)
    kept = [c for c in rows.columns if c not in ("embedding", "code", "list")]
    # codes first: vectors are read again only in the lists opened, for `keep` rows
    best = rows.select("part_id", _code_score(model, unit)(F.col("code"), F.col("list")).alias("_near")).orderBy(F.desc("_near"), "part_id").limit(max(keep, limit))
    again = rows.join(F.broadcast(best.select("part_id")), "part_id", "left_semi")
    scored = again.select(*kept, F.round(cosine(F.col("embedding"), list(map(float, query))), 9).alias("_score"))
    return scored.orderBy(F.col("_score").desc_nulls_last(), "part_id").limit(limit).select(*kept, shown_score(F.col("_score")).alias("score"))


def recall(index: DataFrame, model: Quantizer, queries: list[list[float]], limit: int = 10, probes: int = PROBES, keep: int = KEEP) -> float:
    """Share of the exact nearest rows (over all lists) that the approximate search finds, for a handful of queries."""
    found = total = 0
    for query in queries:
        exact = index.select("part_id", F.round(cosine(F.col("embedding"), query), 9).alias("s")).orderBy(F.desc("s"), "part_id").limit(limit)
        want = {r["part_id"] for r in exact.collect()}
        found += len(want & {r["part_id"] for r in approximate_search(index, model, query, limit, probes, keep).collect()})
        total += len(want)
    return found / total if total else 1.0


def probes_for(index: DataFrame, model: Quantizer, queries: list[list[float]], target: float = 0.95, limit: int = 10, keep: int = KEEP) -> int:
    """The least number of lists with a recall of `target` on these queries. Vectors without groups need most of them; the exact scan is then the better way."""
    low, high = 1, len(model.centres)
    while low < high:
        middle = (low + high) // 2
        if recall(index, model, queries, limit, middle, keep) >= target:
            high = middle
        else:
            low = middle + 1
    return low
