"""Similarity joins with a least score over sparse vectors: an inverted index of prefixes, and an exact check.

Dimensions are ordered by how many stored rows have them, the rarest first. A vector's prefix is its leading dimensions up to
where those that follow have a norm below the least score. Of two unit vectors whose cosine reaches it, the first
dimension they have in common lies in both prefixes: were it beyond one, the cosine could not exceed the norm of what follows.
So only rows that share a prefix dimension are scored, and a pair counts in the list of its first common dimension
alone, where its cosine is at most the product of the two norms from that dimension on: pairs below the least score by that
bound are not scored either (lists are sorted by it). The `common` most frequent dimensions, last in order, share one list, so
that a pair that meets in frequent words alone is scored once. Lists are cut into blocks of bounded size on both sides; a task multiplies two blocks and keeps at most k rows per
query. What passes the driver is one count per dimension.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.search import _unit
from folioscope.operators.spread import durable
from folioscope.settings import LIST_BLOCK, SEARCH_DEFAULT

_ENTRY = "dim int, id string, grp string, tail double, dims binary, vals binary"
CHUNK = 64  # queries multiplied at a time
COMMON = 32  # dimensions that share a list
_PAIR = "query_id string, part_id string, score double"


def _counts(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """How many vectors have each dimension."""

    def run(batches):
        total = np.zeros(width, dtype=np.int64)
        for batch in batches:
            total += (_unit(batch.column(0), width)[0] != 0).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["dim", "n"])

    out = np.zeros(width, dtype=np.int64)
    found = rows.select(column).mapInArrow(run, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    for dim, n in found.collect():  # as many rows as a vector has dimensions
        out[dim] = n
    return out


def _entries(rows: DataFrame, key: str, column: str, order: np.ndarray, least: float, common: int) -> DataFrame:
    """A row for every list a vector is in (dim, its place in the order), with the norm from there on and the vector's dimensions (in order) and values."""
    width = len(order)
    cut = max(0, width - common)

    def run(batches):
        for batch in batches:
            dense, _ = _unit(batch.column(1), width)
            dense = dense[:, order]
            ahead = np.cumsum((dense * dense)[:, ::-1], axis=1)[:, ::-1]  # squared norm from here on
            prefix = (dense != 0) & (ahead >= least * least - 1e-12)
            # of the dimensions that share the last list, a vector's first stands for all
            shared = prefix[:, cut:]
            prefix[:, cut:] &= np.cumsum(shared, axis=1) == 1
            row, at = np.nonzero(prefix)
            ids, groups = batch.column(0).take(pa.array(row)), batch.column(2).take(pa.array(row))
            place = [np.flatnonzero(v).astype("<i2") for v in dense]
            dims, vals = [p.tobytes() for p in place], [v[p].astype("<f8").tobytes() for v, p in zip(dense, place, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(at, cut).astype(np.int32)), ids, groups, pa.array(np.sqrt(ahead[row, at])), pa.array([dims[r] for r in row], pa.binary()), pa.array([vals[r] for r in row], pa.binary())],
                ["dim", "id", "grp", "tail", "dims", "vals"],
            )

    return rows.select(key, column, "group_id").mapInArrow(run, _ENTRY)


@dataclass
class PrefixIndex:
    """Entries of both sides, and the length of every list on each side."""

    queries: DataFrame
    stored: DataFrame
    n_queries: dict[int, int]
    n_stored: dict[int, int]
    least: float
    last: int  # the list the most frequent dimensions share

    def cells(self, block: int = LIST_BLOCK) -> tuple:
        """Both sides grouped alike: a group is a block of the queries and a block of the stored rows of one list."""
        lists = [(dim, -(-n // block), -(-self.n_stored[dim] // block)) for dim, n in self.n_queries.items() if dim in self.n_stored]
        blocks = F.broadcast(self.queries.sparkSession.createDataFrame(lists, "dim int, q_blocks int, s_blocks int"))  # a row per dimension

        def dealt(rows: DataFrame, own: str, other: str, names: tuple[str, str]):
            placed = rows.join(blocks, "dim").withColumn(names[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
            return placed.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("q_blocks", "s_blocks").groupBy("dim", "_q", "_s")

        return dealt(self.queries, "q_blocks", "s_blocks", ("_q", "_s")), dealt(self.stored, "s_blocks", "q_blocks", ("_s", "_q"))

    def scored_pairs(self) -> int:
        """How many times a pair is scored in a join over these lists."""
        least = self.least

        def count(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.table({"n": pa.array([sum((hi - lo) * many for lo, hi, many in _chunks(left, right, least))], pa.int64())})

        q, s = self.cells()
        return q.cogroup(s).applyInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def prefix_index(queries: DataFrame, table: DataFrame, least: float, width: int | None = None, common: int = COMMON) -> PrefixIndex:
    """queries: query_id, vector, group_id; table: part_id, embedding, group_id. Vectors of another size than `width` fail the job."""
    if width is None:
        first = table.select(F.size("embedding").alias("n")).filter("n > 0").first()
        width = first["n"] if first else 1
    q = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector", F.coalesce("group_id", F.lit("")).alias("group_id"))
    s = table.filter(F.col("embedding").isNotNull()).select("part_id", "embedding", F.coalesce("group_id", F.lit(" ")).alias("group_id"))
    order = np.argsort(_counts(s, "embedding", width), kind="stable")
    sides = [durable(_entries(q, "query_id", "vector", order, least, common)), durable(_entries(s, "part_id", "embedding", order, least, common))]
    sizes = [{r["dim"]: r["count"] for r in side.groupBy("dim").count().collect()} for side in sides]  # a row per dimension
    return PrefixIndex(*sides, *sizes, least, max(0, width - common))


def _matrix(table: pa.Table, columns: np.ndarray) -> np.ndarray:
    dims = [np.frombuffer(d, dtype="<i2") for d in table.column("dims").to_pylist()]
    vals = np.concatenate([np.frombuffer(v, dtype="<f8") for v in table.column("vals").to_pylist()])
    row = np.repeat(np.arange(len(dims)), [len(d) for d in dims])
    dim = np.concatenate(dims)
    at = np.minimum(np.searchsorted(columns, dim), len(columns) - 1)
    there = columns[at] == dim
    out = np.zeros((len(dims), len(columns)))
    out[row[there], at[there]] = vals[there]
    return out


def _chunks(left: pa.Table, right: pa.Table, least: float):
    """Query rows lo to hi, and how many stored rows can reach the least score with one of them; both sides by falling tail."""
    tails, others = (np.sort(t.column("tail").to_numpy())[::-1] for t in (left, right))
    for lo in range(0, len(tails), CHUNK):
        many = int(np.searchsorted(-others, -(least - 1e-9) / tails[lo], side="right"))
        if many:
            yield lo, min(lo + CHUNK, len(tails)), many


def _cell(left: pa.Table, right: pa.Table, least: float, k: int, last: int) -> pa.Table:
    """The k best rows of a block of one dimension's list, for the queries of another, pairs that first meet here only."""
    found: tuple[list, list, list] = ([], [], [])
    if left.num_rows and right.num_rows:
        left, right = left.sort_by([("tail", "descending")]), right.sort_by([("tail", "descending")])
        dim = left.column("dim")[0].as_py()
        columns = np.unique(np.concatenate([np.frombuffer(d, dtype="<i2") for d in left.column("dims").to_pylist()]))
        q, s = _matrix(left, columns), _matrix(right, columns)
        _, codes = np.unique(np.array(left.column("grp").to_pylist() + right.column("grp").to_pylist(), dtype=str), return_inverse=True)
        rows, cols, scores = [], [], []
        for lo, hi, many in _chunks(left, right, least):
            score = np.round(q[lo:hi] @ s[:many].T, 9)
            a, b = np.nonzero((score >= least) & (codes[lo:hi, None] != codes[None, len(q) : len(q) + many]))
            first = np.zeros(len(a), dtype=bool)
            for at in range(0, len(a), 65_536):
                some = slice(at, at + 65_536)
                meet = columns[((q[lo + a[some]] != 0) & (s[b[some]] != 0)).argmax(axis=1)]
                first[some] = np.minimum(meet, last) == dim
            rows.append(lo + a[first]), cols.append(b[first]), scores.append(score[a[first], b[first]])
        if rows:
            a, b, score = np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)
            ids, parts = np.array(left.column("id").to_pylist(), dtype=object), np.array(right.column("id").to_pylist(), dtype=object)
            by_part = np.argsort(parts[b], kind="stable")
            order = by_part[np.lexsort((-score[by_part], a[by_part]))]
            a, b, score = a[order], b[order], score[order]
            best = np.arange(len(a)) - np.searchsorted(a, a, side="left") < k
            found = ids[a[best]].tolist(), parts[b[best]].tolist(), score[best].tolist()
    return pa.table({"query_id": pa.array(found[0], pa.string()), "part_id": pa.array(found[1], pa.string()), "score": pa.array(found[2], pa.float64())})


def threshold_join(
    queries: DataFrame, table: DataFrame, least: float, k: int = SEARCH_DEFAULT, width: int | None = None, block: int = LIST_BLOCK, common: int = COMMON
) -> DataFrame:
    """The k nearest stored rows of every query among those with a cosine of `least` or more: (query_id, part_id, score, rank).

    Equal to the exact join of all pairs, whatever the vectors; for dense ones, whose prefixes are long, that one is cheaper. Rows of a
    query's own group are not neighbours, vectors without a direction have none. Ties go to the smaller part_id.
    """
    index = prefix_index(queries, table, least, width, common)
    q, s = index.cells(block)
    last = index.last

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return _cell(left, right, least, k, last)

    pairs = q.cogroup(s).applyInArrow(cell, _PAIR)
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "part_id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
