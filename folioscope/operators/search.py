"""Search: literal hits, cosine top-k, similarity joins, merged results."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import text as tx
from folioscope.operators.embedding import hashed_vectors
from folioscope.operators.spread import durable, even_keys
from folioscope.settings import (
    CROWDED,
    FOLD_SHARE,
    HEAD_DIMS,
    QUERY_BLOCK,
    QUERY_ROWS,
    SCORE_BLOCK,
    SEARCH_DEFAULT,
    SEARCH_MAX,
    TAIL_DIMS,
    VECTOR_BLOCK,
)

HIT_ORDER = ("page_id", "linha_documento", "parte")


def literal_hits(numbered: DataFrame, query: str) -> DataFrame:
    """Every part that matches; no order, no cap."""
    return numbered.filter(tx.has_text(F.col("text")) & tx.text_match(F.col("text"), query))


def literal_search(numbered: DataFrame, query: str, first: int = 0, size: int | None = None) -> DataFrame:
    """Hits with snippet and the number of all hits: all of them, or in reading order `size` hits after the first `first`."""
    hits = literal_hits(numbered, query)
    total = hits.agg(F.count("*")).scalar()
    shown = hits if size is None else hits.orderBy(*HIT_ORDER).offset(first).limit(size)
    return shown.select(
        "page_id", "line_id", "part_id", "linha_documento", "parte", "text",
        tx.snippet(F.col("text"), query).alias("snippet"), total.alias("total"),
    )


def hits_by_page(numbered: DataFrame, query: str) -> DataFrame:
    """How many hits each page has."""
    return literal_hits(numbered, query).groupBy("page_id").agg(F.count("*").alias("hits"))


def name_matches(pages: DataFrame, query: str) -> DataFrame:
    return pages.filter(tx.name_match(F.col("filename"), query))


def visible_to(table: DataFrame, user_id: int | None) -> DataFrame:
    """Everything without a user; else the user's own rows and rows nobody owns."""
    return table if user_id is None else table.filter((F.col("user_id") == user_id) | F.col("user_id").isNull())


def searchable(
    table: DataFrame, user_id: int | None = None, confirmed_only: bool = False, exclude: DataFrame | list[str] | None = None
) -> DataFrame:
    """Rows a search may return. `exclude` is a list of part ids, or a table of them."""
    rows = visible_to(table.filter(F.col("embedding").isNotNull()), user_id)
    if confirmed_only:
        rows = rows.filter("confirmed")
    if isinstance(exclude, DataFrame):
        return rows.join(exclude.select("part_id").distinct(), "part_id", "left_anti")
    excluded = [item for item in (exclude or []) if item]
    return rows.filter(~F.col("part_id").isin(excluded)) if excluded else rows


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine with a constant vector; null where a norm is zero or the sizes differ.

    Evaluated on Arrow batches: the values of a batch are one flat buffer, so a batch is one
    matrix product, with no Python object per row.
    """
    return F.arrow_udf(cosines(query), T.DoubleType())(vector)


def cosines(query: list[float]) -> Callable[[pa.Array], pa.Array]:
    """The function of `cosine` on an Arrow column of vectors."""
    target = np.asarray(query, dtype="float64")
    length = float(np.sqrt((target * target).sum()))

    def score(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        fits = sizes == len(target)
        values = pc.filter(column, pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        rows = values.astype("float64").reshape(int(fits.sum()), len(target))
        norms = np.sqrt((rows * rows).sum(axis=1)) * length
        found = np.full(len(column), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            found[fits] = np.where(norms > 0, rows @ target / norms, np.nan)
        return pa.array(found, from_pandas=True)

    return score


def shown_score(score: Column) -> Column:
    """Clamped to 0..1 at four decimals; an undefined similarity shows as 0."""
    known = F.when(score.isNull() | F.isnan(score), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))
    return F.round(known, 4)


def vector_search(table: DataFrame, query: list[float], limit: int = SEARCH_DEFAULT, most: int = SEARCH_MAX, **filters) -> DataFrame:
    """Nearest rows by cosine, one at least; more than `most` are refused. Ties go to the smaller part_id."""
    if limit > most:
        raise ValueError(f"{limit} rows where {most} are allowed")
    k = max(1, int(limit))
    rows = searchable(table, **filters)
    kept = [c for c in rows.columns if c != "embedding"]
    return _nearest(rows.select(*kept, cosine(F.col("embedding"), query).alias("_score")), k)


def text_search(rows: DataFrame, query: list[float], limit: int = SEARCH_DEFAULT, most: int = SEARCH_MAX, text: str = "text") -> DataFrame:
    """vector_search over texts that have no stored vectors: they are hashed to vectors and scored in one task, so no vector moves."""
    if limit > most:
        raise ValueError(f"{limit} rows where {most} are allowed")
    return _nearest(hashed_vectors(rows, text, len(query), ("_score", T.DoubleType(), cosines(query))), max(1, int(limit)))


def _nearest(scored: DataFrame, k: int) -> DataFrame:
    kept = [c for c in scored.columns if c != "_score"]
    scored = scored.withColumn("_score", F.round("_score", 9))
    # The vector itself is dropped before rows are ordered, so only k narrow rows per task move.
    return (
        scored.orderBy(F.col("_score").desc_nulls_last(), "part_id")
        .limit(k)
        .select(*kept, shown_score(F.col("_score")).alias("score"))
    )


_PAIR = "query_id string, part_id string, score double"


def _unit(vectors: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length from the flat buffer of a list column, and which rows have a direction at all."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.list_value_length(column)
    if pc.any(pc.not_equal(sizes, width)).as_py():
        raise ValueError(f"a vector of another size than {width}")
    usable = pc.fill_null(pc.equal(sizes, width), False)
    fits = usable.to_numpy(zero_copy_only=False)
    dense = np.zeros((len(column), width))
    dense[fits] = pc.filter(column, usable).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.sqrt((dense * dense).sum(axis=1))
    known = norms > 0
    dense[known] /= norms[known, None]
    return dense, known


_HEAD = np.dtype("<i4")
_DENSE, _SPARSE = 0, 1


def packed(rows: DataFrame, column: str) -> DataFrame:
    """The vectors of `column` as bytes: a head (size, layout, bytes a value), then all values, or places and values of those that are not 0.

    Whichever is shorter; values keep their precision. Similarity joins take packed vectors as they take arrays, and move no others:
    a text of thirty words is some 200 bytes instead of 3 KB.
    """
    if isinstance(rows.schema[column].dataType, T.BinaryType):
        return rows
    kept = [c for c in rows.columns if c != column]

    def run(batches):
        for batch in batches:
            out = pack(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), out], [*kept, column])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(column, T.BinaryType())])
    return rows.select(*kept, column).mapInArrow(run, schema)


def pack(vectors: pa.Array) -> pa.Array:
    """The function of `packed` on an Arrow column of vectors."""
    value = "<f4" if vectors.type.value_type == pa.float32() else "<f8"
    size = np.dtype(value).itemsize
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False).astype(value), pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    used = np.flatnonzero(flat != 0)
    ends = np.cumsum(np.maximum(sizes, 0))
    cut = np.searchsorted(used, np.concatenate(([0], ends)))
    out: list[bytes | None] = []
    for i, (n, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
        at = used[cut[i] : cut[i + 1]]
        if n < 0:
            out.append(None)
        elif len(at) * (4 + size) < n * size:
            out.append(np.array([n, _SPARSE, size], dtype=_HEAD).tobytes() + (at - (end - n)).astype("<i4").tobytes() + flat[at].tobytes())
        else:
            out.append(np.array([n, _DENSE, size], dtype=_HEAD).tobytes() + flat[end - n : end].tobytes())
    return pa.array(out, pa.binary())


def unpacked(column: Column) -> Column:
    """Packed vectors as arrays of single-precision values."""

    def run(vectors: pa.Array) -> pa.Array:
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        values, sizes = [np.empty(0, dtype="float32")], []
        for raw in vectors.to_pylist():
            n, layout, size = np.frombuffer(raw, dtype=_HEAD, count=3).tolist() if raw is not None else (0, _SPARSE, 4)
            sizes.append(n)
            if raw is None:
                continue
            if layout == _DENSE:
                values.append(np.frombuffer(raw, dtype=f"<f{size}", offset=12).astype("float32"))
            else:
                many, dense = (len(raw) - 12) // (4 + size), np.zeros(n, dtype="float32")
                dense[np.frombuffer(raw, dtype="<i4", count=many, offset=12)] = np.frombuffer(raw, dtype=f"<f{size}", offset=12 + 4 * many)
                values.append(dense)
        offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), pa.float32()), mask=vectors.is_null())

    return F.arrow_udf(run, T.ArrayType(T.FloatType()))(column)


def _unpacked(vectors: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """As _unit, from packed vectors."""
    column = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    dense = np.zeros((len(column), width))
    wide = np.frombuffer(column.buffers()[1], dtype=np.int32 if pa.types.is_binary(column.type) else np.int64)
    ends = wide[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    if len(held):
        raw = np.frombuffer(column.buffers()[2], dtype=np.uint8, count=int(ends[-1] - ends[0]), offset=int(ends[0])).view("<i4")  # lengths are whole words
        at, words = (ends[held] - ends[0]) // 4, (ends[held + 1] - ends[held]) // 4 - 3
        n, layout, size = raw[at], raw[at + 1], raw[at + 2] // 4
        if (n != width).any():
            raise ValueError(f"a vector of another size than {width}")
        for kind in np.unique(layout * 4 + size).tolist():
            here = np.flatnonzero(layout * 4 + size == kind)
            step = kind % 4  # words a value
            many = words[here] // (step + (kind // 4 == _SPARSE))
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = np.repeat(at[here] + 3, many)
            if kind // 4 == _SPARSE:
                place, begin = raw[begin + nth], begin + np.repeat(many, many)
            else:
                place = nth
            value = np.stack([raw[begin + step * nth + i] for i in range(step)], axis=1)
            dense[np.repeat(held[here], many), place] = value.view(f"<f{4 * step}")[:, 0]
    norms = np.sqrt((dense * dense).sum(axis=1))
    known = norms > 0
    dense[known] /= norms[known, None]
    return dense, known


def _strings(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=object)


class _Fold:
    """Shorter vectors whose products are never below those of the vectors themselves: the `HEAD_DIMS` dimensions that weigh most, and the norms of
    `TAIL_DIMS` groups of the others (the product over a group is at most that of its norms)."""

    def __init__(self, weight: np.ndarray):
        order = np.argsort(-weight, kind="stable")
        self.head, tail = order[:HEAD_DIMS], order[HEAD_DIMS:]
        groups = [tail[g::TAIL_DIMS] for g in range(TAIL_DIMS)]
        self.tail, self.begins = np.concatenate(groups), np.cumsum([0, *(len(g) for g in groups[:-1])])

    def __call__(self, single: np.ndarray) -> np.ndarray:
        rest = single[:, self.tail]
        return np.concatenate((single[:, self.head], np.sqrt(np.add.reduceat(rest * rest, self.begins, axis=1))), axis=1)


class _Best:
    """The k best stored rows per query, of those with `least` or more; equal scores go by the rows' order.

    Products are taken in single precision first, of folded vectors where these rule out most rows, else of whole ones. Their error is
    below `slack`, so what may be among the k best is known from them, and only that is scored in double precision.
    """

    def __init__(self, q: np.ndarray, q_ok: np.ndarray, groups: np.ndarray, k: int, least: float, fold: _Fold | None = None):
        self.q, self.q_ok, self.groups, self.k = q, q_ok, groups, k
        self.single, self.slack = q.astype("float32"), 2.0**-22 * (q.shape[1] + 2)
        self.fold, self.short = fold, fold(self.single) if fold else None
        self.floor = np.full(len(q), least)  # what a row must reach to count
        self.floor[~q_ok] = np.inf
        self.rows, self.at, self.scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)

    def _short(self, s: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Pairs that may reach the cut, by folded vectors first; None where those rule out too few to be worth it."""
        folded, found, left = self.fold(s).T, [], int(FOLD_SHARE * len(self.q) * len(s)) + self.k * len(self.q)
        for at in range(0, len(self.q), SCORE_BLOCK):
            near = self.short[at : at + SCORE_BLOCK] @ folded
            flat = np.flatnonzero(near >= cut[at : at + SCORE_BLOCK, None])
            left -= len(flat)
            if left < 0:
                self.fold = None
                return None
            rows, cols = at + flat // len(s), flat % len(s)
            many = np.bincount(rows - at, minlength=len(near)) > CROWDED // 2
            if many.any():  # a product of matrices where it takes less time than pair by pair
                held = at + np.flatnonzero(many)
                r, c = np.nonzero(self.single[held] @ s.T >= cut[held, None])
                found.append((held[r], c))
                few = ~many[rows - at]
                rows, cols = rows[few], cols[few]
            for lo in range(0, len(rows), 8 * SCORE_BLOCK):
                r, c = rows[lo : lo + 8 * SCORE_BLOCK], cols[lo : lo + 8 * SCORE_BLOCK]
                close = np.einsum("ij,ij->i", self.single[r], s[c]) >= cut[r]
                found.append((r[close], c[close]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, dtype=np.int64),) * 2

    def _long(self, s: np.ndarray, s_ok: np.ndarray, groups: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _short, by products of whole vectors."""
        k, rough = self.k, self.single @ s.T
        rough[:, ~s_ok] = -np.inf
        new = np.flatnonzero(np.isneginf(cut))
        if len(new):  # fewer than k rows so far
            some = rough[new]
            some[self.groups[new, None] == groups[None, :]] = -np.inf
            if some.shape[1] > k:
                cut[new] = np.partition(some, -k, axis=1)[:, -k] - 2 * self.slack - 1e-7
        return np.nonzero(rough >= cut[:, None])

    def add(self, s: np.ndarray, s_ok: np.ndarray, groups: np.ndarray, first: int) -> None:
        """Stored rows with numbers from `first` on, in order."""
        single, cut = s.astype("float32"), (self.floor - self.slack - 1e-7).astype("float32")
        short = self._short(single, cut) if self.fold and not np.isneginf(cut).any() else None
        rows, cols = self._long(single, s_ok, groups, cut) if short is None else short
        fit = (self.groups[rows] != groups[cols]) & s_ok[cols] & self.q_ok[rows]
        rows, cols = rows[fit], cols[fit]
        if not len(rows):
            return
        scores = np.empty(len(rows))
        crowded = np.bincount(rows, minlength=len(self.q))[rows] > CROWDED
        dense = np.unique(rows[crowded])
        for at in range(0, len(dense), SCORE_BLOCK):  # a product of matrices where most of a row is wanted
            held = dense[at : at + SCORE_BLOCK]
            here = np.flatnonzero(crowded & (rows >= held[0]) & (rows <= held[-1]))
            scores[here] = (self.q[held] @ s.T)[np.searchsorted(held, rows[here]), cols[here]]
        few = np.flatnonzero(~crowded)
        for at in range(0, len(few), 8 * SCORE_BLOCK):
            here = few[at : at + 8 * SCORE_BLOCK]
            scores[here] = np.einsum("ij,ij->i", self.q[rows[here]], s[cols[here]])
        scores = np.round(scores, 9)
        good = scores >= self.floor[rows]
        self._merge(rows[good], cols[good] + first, scores[good])

    def _merge(self, rows: np.ndarray, at: np.ndarray, scores: np.ndarray) -> None:
        rows, at, scores = np.concatenate((self.rows, rows)), np.concatenate((self.at, at)), np.concatenate((self.scores, scores))
        order = np.lexsort((at, -scores, rows))
        rows, at, scores = rows[order], at[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        full = place == self.k - 1
        self.floor[rows[full]] = scores[full]
        kept = place < self.k
        self.rows, self.at, self.scores = rows[kept], at[kept], scores[kept]


def _block_best(left: pa.Table, right: pa.Table, k: int, width: int, least: float) -> pa.Table:
    """The k best rows of a block of stored rows for a block of queries, both packed; vectors are unpacked for some rows at a time."""
    out: tuple[list, list, list] = ([], [], [])
    if left.num_rows and right.num_rows:
        right = right.sort_by("part_id")  # of equal scores the smaller part_id: order by bytes, as Spark has it
        _, codes = np.unique(np.concatenate([_strings(left["group_id"]), _strings(right["group_id"])]).astype(str), return_inverse=True)
        parts, ids = _strings(right["part_id"]), _strings(left["query_id"])
        vectors, stored = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (left["vector"], right["embedding"]))
        fold = None
        if width >= 2 * (HEAD_DIMS + TAIL_DIMS):
            fold = _Fold(sum((_unpacked(v[:SCORE_BLOCK], width)[0] ** 2).sum(axis=0) for v in (vectors, stored)))
        for lo in range(0, len(ids), QUERY_ROWS):
            hi = min(lo + QUERY_ROWS, len(ids))
            best = _Best(*_unpacked(vectors[lo:hi], width), codes[lo:hi], k, least, fold)
            for at in range(0, len(parts), SCORE_BLOCK):
                end = min(at + SCORE_BLOCK, len(parts))
                best.add(*_unpacked(stored[at:end], width), codes[len(ids) + at : len(ids) + end], at)
            out[0].extend(ids[lo + best.rows].tolist()), out[1].extend(parts[best.at].tolist()), out[2].extend(best.scores.tolist())
    return pa.table({"query_id": pa.array(out[0], pa.string()), "part_id": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})


def knn_join(
    queries: DataFrame,
    table: DataFrame,
    k: int = SEARCH_DEFAULT,
    width: int | None = None,
    query_block: int = QUERY_BLOCK,
    vector_block: int = VECTOR_BLOCK,
    least: float = float("-inf"),
) -> DataFrame:
    """Exact k nearest stored rows for every query: (query_id, part_id, rank, score), those below `least` left out.

    queries: query_id, vector, group_id; table: part_id, embedding, group_id; vectors are arrays or `packed`. Rows of the query's
    own group are not neighbours. Queries and stored rows are hashed into blocks of bounded size; each task multiplies two blocks
    and keeps k rows per query, never the pairs. A vector of another size than `width` (by default the size of the stored
    vectors) fails the job. Both sides are read several times; those that are not packed yet are packed and stored first.
    """
    q = queries.select("query_id", "vector", F.coalesce("group_id", F.lit("")).alias("group_id"))
    s = table.filter(F.col("embedding").isNotNull()).select(
        "part_id", "embedding", F.coalesce("group_id", F.lit(" ")).alias("group_id")
    )
    q, s = (rows if isinstance(rows.schema[c].dataType, T.BinaryType) else durable(packed(rows, c)) for rows, c in ((q, "vector"), (s, "embedding")))
    if width is None:
        first = s.select("embedding").filter(F.length("embedding") > 12).first()
        width = int(np.frombuffer(first["embedding"], dtype=_HEAD, count=1)[0]) if first else 1
    pairs = _knn_grid(q, s, k, width, query_block, vector_block, least)
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "part_id")
    return pairs.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def _first_of_equal(s: DataFrame, k: int) -> DataFrame:
    """Without rows that no query can have among its k best, as enough equal vectors of smaller part_id come before them.

    Of a vector's rows a query takes the first k that are not of its own group. They are among the first k of their groups, and of
    these rows at most k more, those of the query's group, come before the last of them.
    """
    own, all_ = W.partitionBy("embedding", "group_id").orderBy("part_id"), W.partitionBy("embedding").orderBy("part_id")
    near = s.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= k)
    return near.withColumn("_n", F.row_number().over(all_)).filter(F.col("_n") <= 2 * k).drop("_n")


def _knn_grid(q: DataFrame, s: DataFrame, k: int, width: int, query_block: int, vector_block: int, least: float) -> DataFrame:
    """Every (query block, stored block) cell is one task's work; hashing ids keeps the blocks even.

    A block has as many bytes as so many single-precision vectors: of short ones it holds more, so that fewer copies of the rows move.
    """

    def blocks(rows: DataFrame, column: str, block: int) -> int:
        size = rows.agg(F.sum(F.coalesce(F.length(column), F.lit(0)) + 32)).first()[0] or 0
        return max(1, -(-size // (block * (4 * width + 44))))

    rows, cols = blocks(q, "vector", query_block), blocks(s, "embedding", vector_block)
    # At least three cells per core, so that no core waits long for another: more columns copy queries, never stored rows.
    cores = q.sparkSession.sparkContext.defaultParallelism
    cols = max(cols, -(-3 * cores // rows))
    cols = next(c for c in range(cols, cols + cores + 1) if rows * c >= 0.95 * cores * -(-rows * c // cores))  # no last round with few tasks
    s = _first_of_equal(s, k)
    keys = F.lit(even_keys(q.sparkSession, rows * cols))
    r, c = F.pmod(F.xxhash64("query_id"), F.lit(rows)).cast("int"), F.pmod(F.xxhash64("part_id"), F.lit(cols)).cast("int")
    q_cells = q.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.get(keys, r * cols + c))))
    s_cells = s.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.get(keys, r * cols + c))))
    q_cells, s_cells = (cells.repartition(rows * cols, "_cell") for cells in (q_cells, s_cells))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_best(left, right, k, width, least)

    return q_cells.groupBy("_cell").cogroup(s_cells.groupBy("_cell")).applyInArrow(cell, _PAIR)


def hybrid_search(
    pages: DataFrame, numbered: DataFrame, similar: DataFrame, query: str, size: int | None = None
) -> DataFrame:
    """Literal hits (`size` of them in reading order, or all), then similar rows that are none, then pages that match by name alone."""
    # Hits are asked for three times; they are found once. Unless they are ordered, nothing needs their numbers.
    hits = durable(literal_hits(numbered, query).select("page_id", "part_id", *([] if size is None else HIT_ORDER[1:])))
    literal_ids = hits.select("part_id")
    literal = (hits if size is None else hits.orderBy(*HIT_ORDER).limit(size)).select(
        F.lit("literal").alias("section"), "page_id", "part_id", F.lit(None).cast("double").alias("score")
    )
    live = hits_on_live_pages(similar, pages)
    close = live.join(literal_ids, "part_id", "left_anti").select(
        F.lit("similar").alias("section"), "page_id", "part_id", "score"
    )
    named = name_matches(pages, query).join(hits.select("page_id").distinct(), "page_id", "left_anti").select(
        F.lit("name").alias("section"), "page_id", F.lit(None).cast("string").alias("part_id"), F.lit(None).cast("double").alias("score")
    )
    return literal.unionByName(close).unionByName(named)


def hits_on_live_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    return hits.join(pages.select("page_id"), "page_id", "left_semi")


def exclude_parts(hits: DataFrame, parts: DataFrame) -> DataFrame:
    return hits.join(parts.select("part_id"), "part_id", "left_anti")
