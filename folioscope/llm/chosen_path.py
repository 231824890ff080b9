"""Jaccard self-join of word n-gram sets by chosen paths.

Sets are shingles of `words` words, hashed. Equal sets are one class with one member that is searched. A set is
embedded as POSITIONS minhash tokens (position, value): the share of tokens two sets have in common is an
estimate of their Jaccard similarity. Each run starts a bucket of all sets and splits it by the values at positions
drawn from the bucket's path, 1 / threshold of them on average, so a pair above the threshold is expected to
survive every level; buckets of at most `limit` sets are compared by brute force, larger ones split again. Before a large
bucket is split, at every level, it is compared in random blocks of `limit` sets, and the blocks' leaders among
themselves. A bucket whose members are one part by then (a group of near copies) is done; all members of any
other are split on, until buckets are small or one part. What is neither after DEEPEST splits is compared whole, in
cells of two blocks.

Runs come in rounds of `runs`, repeated until the target recall: two rounds are independent draws, so the share of the sets with
a candidate in one round that have one in the other estimates each round's recall, and that of all rounds together
(`recall_of`). Rounds go on until the estimate reaches `recall`, `most_rounds` at most.

Compared sets whose token shares come within SLACK of the threshold are candidates. Only the connected parts of the
candidates go on: every part's exact shingle sets are compared with each other, in cells of two blocks of CELL sets
where a part is larger, and pairs at the threshold are links. Neither step emits pairs: rows grow with
documents. So a group of n near copies costs n * limit comparisons of tokens a run, and n * n exact ones, in blocks.

Texts without a word have no set, no links, and are classes of their own. A text of fewer than `words` words is one
shingle. Repeated rows and equal texts share a class. Null doc_ids order last. An empty table gives no rows.
Columns are kept, but for those named like a result or a working column (see near_duplicates).
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import mix, slices, span_hash, windows, words
from folioscope.llm.groups import components, local_components, together, whole_groups
from folioscope.llm.store import stored

WORDS = 5
THRESHOLD = 0.8
POSITIONS = 128
RUNS = 4
RECALL = 0.995
MOST_ROUNDS = 8
LIMIT = 2000
DEEPEST = 30
SLACK = 0.13
CELL = 512
LAST = (1 << 63) - 1


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each text, and where each text's begin (and the end)."""
    starts, ends, of = words(data, offs)
    hashes = span_hash(data, starts, ends)
    found, first = windows(hashes, of, size)
    owner = of[first]
    texts = len(offs) - 1
    n = np.bincount(of, minlength=texts)
    for t in np.flatnonzero((n > 0) & (n < size)):  # fewer words than a shingle: all of them are one
        lo = np.searchsorted(of, t)
        total = np.uint64(int(n[t]))
        for h in hashes[lo : lo + n[t]]:
            total = mix(np.array([total ^ h], dtype=np.uint64))[0]
        at = np.searchsorted(owner, t)
        found, owner = np.insert(found, at, total), np.insert(owner, at, t)
    if len(found):
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(texts + 1))


def token_factors() -> np.ndarray:
    return mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def minhashes(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts with a set) x POSITIONS tokens of 32 bits."""
    some = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(some), POSITIONS), dtype=np.uint32)
    if len(some):
        for i, factor in enumerate(token_factors()):
            out[:, i] = np.minimum.reduceat(((found ^ (factor >> np.uint64(17))) * factor) >> np.uint64(32), some)
    return out


def with_sets(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Adds _row, _n (shingles), _h1 and _h2 (of the set), _tokens and _short (a byte of each token)."""
    kept, names = docs.schema.fields, docs.columns
    added = "_n int, _h1 bigint, _h2 bigint, _tokens array<int>, _short binary"

    def run(batches):
        for batch in batches:
            for start, stop, data, offs in slices(batch.column(batch.schema.get_field_index(text))):
                found, bounds = shingles(data, offs, size)
                n = np.diff(bounds)
                sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(found, dtype=np.uint64)))
                other = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(found + np.uint64(77)), dtype=np.uint64)))
                tokens = minhashes(found, bounds)
                short = (mix(tokens.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                rank = np.cumsum(n > 0) - 1
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate(([0], np.cumsum((n > 0) * POSITIONS))).astype(np.int32)), pa.array(tokens.view(np.int32).reshape(-1))
                )
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.get_field_index(c)) for c in names), pa.array(n.astype(np.int32)),
                        pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)), pa.array((other[bounds[1:]] - other[bounds[:-1]]).view(np.int64)),
                        lists, pa.array([short[r].tobytes() if c else None for r, c in zip(rank, n, strict=True)], pa.binary()),
                    ],
                    [*names, "_n", "_h1", "_h2", "_tokens", "_short"],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + added
    return docs.select(*names).mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def children(rows: DataFrame, threshold: float) -> DataFrame:
    """round, path, _row and _tokens after one split."""
    split = F.pmod(F.xxhash64("path", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * (1 / threshold - 1))

    def child(k: int):
        position = F.pmod(F.xxhash64("path", F.lit(k)), F.lit(POSITIONS)).cast("int")
        return F.xxhash64("path", F.lit(k), position, F.element_at("_tokens", position + 1))

    return rows.select("round", "_row", "_tokens", F.explode(F.when(split, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("path"))


def counted(rows: DataFrame) -> DataFrame:
    """Rows of buckets with two sets or more, with the bucket's size, and without tokens."""
    rows = rows.drop("_tokens")
    sizes = stored(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), "path-sizes")
    return rows.join(sizes, "path")


def compared(cells: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """round, path, a (a row), b (the smallest row its candidates in the cell lead to), for all rows of cells path, block."""
    least = threshold - SLACK
    # equal bytes are the tokens in common and a 256th of the others
    need = int(np.ceil(POSITIONS * (least + (1 - least) / 256)))

    def run(batches):
        for table, at in whole_groups(batches, "path", "block"):
            row, path, n, round_ = (table.column(c).to_numpy() for c in ("_row", "path", "_n", "round"))
            short = np.frombuffer(b"".join(table.column("_short").to_pylist()), dtype=np.uint8).reshape(-1, POSITIONS)
            leader = row.copy()
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo == 1:
                    continue
                s = short[lo:hi]
                if hi - lo == 2:
                    if np.count_nonzero(s[0] == s[1]) >= need and min(n[lo:hi]) >= threshold * max(n[lo:hi]):
                        leader[lo:hi] = row[lo:hi].min()
                    continue
                linked = np.empty((hi - lo, hi - lo), dtype=bool)
                for i in range(hi - lo):
                    linked[i] = (s == s[i]).sum(axis=1) >= need
                sizes = n[lo:hi].astype(float)
                linked &= np.minimum.outer(sizes, sizes) >= threshold * np.maximum.outer(sizes, sizes)
                label = local_components(linked)
                smallest = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(smallest, label, row[lo:hi])
                leader[lo:hi] = smallest[label]
            yield pa.RecordBatch.from_arrays([pa.array(round_), pa.array(path), pa.array(row), pa.array(leader)], ["round", "path", "a", "b"])

    full = cells.join(tokens.select("_row", "_n", "_short"), "_row").select("round", "path", "block", "_row", "_n", "_short")
    return together(full, "path", "block").mapInArrow(run, "round int, path long, a long, b long")


def met_in_blocks(large: DataFrame, reps: DataFrame, threshold: float, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """Edges found in random blocks of large buckets, and the rows of those whose members are not one part by then."""
    blocks = F.ceil(F.col("size") / limit)
    cells = large.withColumn("block", F.pmod(F.xxhash64("_row", "path", F.lit(0)), blocks).cast("int"))
    edges = [stored(compared(cells, reps, threshold), "blocks")]
    heads = stored(counted(edges[0].select("round", "path", F.col("b").alias("_row")).distinct()), "paths")
    # Leaders are compared again where blocks have shrunk to a few; elsewhere the next split does more.
    few = heads.filter(F.col("size") <= limit)
    met = stored(compared(few.withColumn("block", F.lit(0)), reps, threshold), "leaders")
    open_ = heads.filter(F.col("size") > limit).select("path").unionByName(counted(met.select("path", F.col("b").alias("_row")).distinct()).select("path"))
    return [*edges, met], large.join(open_.distinct(), "path", "left_semi")


def met_in_pairs(large: DataFrame, reps: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Edges of large buckets whose sets are all compared, in cells of two blocks."""
    blocks = F.ceil(F.col("size") / limit)
    dealt = large.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("_row", "path"), blocks))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    cells = dealt.withColumn("block", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    return compared(cells, reps, threshold)


def met(reps: DataFrame, threshold: float, runs: int, rounds: range, limit: int) -> list[DataFrame]:
    """Edges a, b met in each of these rounds of `runs` runs. All runs go through the levels together.

    Paths follow from tokens alone, so a level is made from the sets where they lie: they are split again from the first path
    on, and only buckets that are split further are followed. Their paths are broadcast; each stands for more than `limit`
    rows, so they are few against the rows. Tokens are not shuffled.
    """
    draws = [F.struct(F.lit(r).alias("round"), F.xxhash64(F.lit(f"run {r * runs + k}")).alias("path")) for r in rounds for k in range(runs)]
    start = reps.select("_row", "_tokens", F.explode(F.array(*draws)).alias("_d")).select("_row", "_tokens", "_d.round", "_d.path")
    edges = []
    rows = children(start, threshold)
    for level in range(DEEPEST):
        buckets = stored(counted(rows), "paths")
        edges.append(compared(buckets.filter(F.col("size") <= limit).withColumn("block", F.lit(0)), reps, threshold))
        large = buckets.filter(F.col("size") > limit)
        if large.isEmpty():
            break
        if level:
            found, large = met_in_blocks(large, reps, threshold, limit)
            edges += found
            large = stored(large, "paths")
            if large.isEmpty():
                break
        open_ = stored(large.select("path").distinct(), "open-paths")
        rows = children(rows.join(F.broadcast(open_), "path", "left_semi"), threshold)
    else:
        edges.append(met_in_pairs(large, reps, threshold, limit))
    found = stored(reduce(DataFrame.unionByName, edges).filter("a <> b").select("round", "a", "b").distinct(), "met")
    return [found.filter(F.col("round") == r).select("a", "b") for r in rounds]


def recall_of(rounds: list[DataFrame]) -> float:
    """Estimated share of the sets with a candidate that the rounds together have found, from how far the last two agree."""
    first, second = (
        e.select("a").unionByName(e.select(F.col("b").alias("a"))).distinct().withColumn(c, F.lit(1)) for e, c in zip(rounds[-2:], ("in_1", "in_2"), strict=True)
    )
    n = first.join(second, "a", "full").agg(F.count("in_1").alias("n1"), F.count("in_2").alias("n2"), F.count_if(F.expr("in_1 = 1 and in_2 = 1")).alias("both")).first()
    if not n["n1"] and not n["n2"]:
        return 1.0
    missed = (1 - n["both"] / max(n["n2"], 1)) * (1 - n["both"] / max(n["n1"], 1))
    return 1 - missed ** (len(rounds) / 2)


def candidates(reps: DataFrame, threshold: float, runs: int, limit: int, recall: float = RECALL, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Edges a, b whose connected parts hold every candidate pair that some run has met."""
    found = met(reps, threshold, runs, range(2), limit)
    while len(found) < most_rounds and recall_of(found) < recall:
        found += met(reps, threshold, runs, range(len(found), len(found) + 1), limit)
    return reduce(DataFrame.unionByName, found).distinct()


def exact_links(members: DataFrame, size: int, threshold: float, text: str) -> DataFrame:
    """_row, b (the smallest row reached by links within its cell), links (in this cell) for members _row, part, text."""

    def sets(batches):
        for batch in batches:
            row, part, part_size = (batch.column(batch.schema.get_field_index(c)) for c in ("_row", "part", "part_size"))
            for start, stop, data, offs in slices(batch.column(batch.schema.get_field_index(text))):
                found, bounds = shingles(data, offs, size)
                values = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(start, stop - start) for c in (row, part, part_size)), pa.array(values, pa.binary())], ["_row", "part", "part_size", "set"]
                )

    with_set = members.select("_row", "part", "part_size", text).mapInArrow(sets, "_row long, part long, part_size long, set binary")
    blocks = F.ceil(F.col("part_size") / CELL).cast("int")
    own = F.pmod(F.xxhash64("_row"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = with_set.withColumn("own", own).select("*", other.alias("other"))
    dealt = dealt.select("_row", "part", "set", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(batches):
        for table, at in whole_groups(batches, "part", "low", "high"):
            row, own_, low, high = (table.column(c).to_numpy() for c in ("_row", "own", "low", "high"))
            raw = table.column("set").to_pylist()
            leader, links = row.copy(), np.zeros(len(row), dtype=np.int64)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                common, sizes = intersections([np.frombuffer(x, dtype=np.uint64) for x in raw[lo:hi]])
                linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
                np.fill_diagonal(linked, False)
                if low[lo] != high[lo]:  # pairs inside a block are compared in the block's own cell
                    linked &= own_[lo:hi, None] != own_[None, lo:hi]
                links[lo:hi] = linked.sum(axis=1)
                label = local_components(linked)
                smallest = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(smallest, label, row[lo:hi])
                leader[lo:hi] = smallest[label]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(leader), pa.array(links)], ["_row", "b", "links"])

    return together(dealt, "part", "low", "high").mapInArrow(run, "_row long, b long, links long")


def intersections(sets: list[np.ndarray], columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """How many values each two sets share, and the sets' sizes."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    common = np.zeros((len(sets), len(sets)))
    if len(sets) == 2:
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    elif len(sets) > 2:
        values, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
        several = n > 1
        number = np.cumsum(several) - 1
        keep = several[code]
        owner, code = owner[keep], number[code[keep]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for first in range(0, int(several.sum()), columns):
            lo, hi = np.searchsorted(code, (first, first + columns))
            there = np.zeros((len(sets), columns), dtype=np.float32)
            there[owner[lo:hi], code[lo:hi] - first] = 1
            common += there @ there.T
    np.fill_diagonal(common, sizes)
    return common, sizes


def near_duplicates(
    docs: DataFrame, words_: int = WORDS, threshold: float = THRESHOLD, runs: int = RUNS, limit: int = LIMIT,
    key: str = "doc_id", text: str = "text", recall: float = RECALL,
) -> DataFrame:
    """The rows of `docs` with class_id (the smallest key in its connected group of links and equal sets), copy_of (the
    smallest key with an equal set), n_copies (rows with an equal set) and n_links (other sets linked to its own), and
    first_of_class (true for one row of each group)."""
    added = ("class_id", "copy_of", "n_copies", "n_links", "first_of_class")
    docs = docs.drop(*added, "_row", "_key", "_n", "_h1", "_h2", "_tokens", "_short")
    table = stored(with_sets(docs, words_, text).withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(LAST))), "sets")
    same = (
        table.filter("_n > 0").groupBy("_n", "_h1", "_h2")
        .agg(F.min(F.struct("_key", "_row")).alias("_first"), F.count("*").alias("n_copies"))
    )
    rep_rows = same.select(F.col("_first._row").alias("_row"))
    reps = stored(table.select("_row", "_n", "_tokens", "_short").join(rep_rows, "_row", "left_semi"), "set-firsts")
    parts = components(candidates(reps, threshold, runs, limit, recall))
    sized = parts.groupBy("component").agg(F.count("*").alias("part_size"))
    members = parts.join(sized, "component").select(F.col("vertex").alias("_row"), F.col("component").alias("part"), "part_size")
    # Members may be any share of all rows: nothing bounds them, so they are merged and never broadcast.
    with_text = members.hint("merge").join(table.select("_row", text), "_row")
    links = stored(exact_links(with_text, words_, threshold, text), "links")
    groups = components(links.select(F.col("_row").alias("a"), "b"))
    n_links = links.groupBy("_row").agg(F.sum("links").alias("n_links"))
    # Row numbers do not follow keys: the group's first member is the one with the smallest key.
    rep_keys = same.select(F.col("_first._row").alias("_rep"), F.col("_first._key").alias("_rep_key"))
    grouped = groups.join(rep_keys, F.col("vertex") == F.col("_rep"))
    heads = grouped.groupBy("component").agg(F.min(F.struct("_rep_key", "_rep")).alias("_head"))
    head_of = grouped.join(heads, "component").select("_rep", "_head")
    per_set = (
        same.withColumn("_rep", F.col("_first._row")).join(head_of, "_rep", "left").join(n_links.withColumnRenamed("_row", "_rep"), "_rep", "left")
        .select("_n", "_h1", "_h2", "_first", "n_copies", F.coalesce(F.col("_head._rep"), F.col("_rep")).alias("_head_row"),
                F.coalesce(F.col("_head._rep_key"), F.col("_first._key")).alias("_head_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    own_key = F.when(F.col("_key") != LAST, F.col("_key"))
    return (
        table.drop("_tokens", "_short").join(per_set, ["_n", "_h1", "_h2"], "left")
        .withColumn("class_id", F.when(F.col("_head_key").isNull(), own_key).otherwise(F.when(F.col("_head_key") != LAST, F.col("_head_key"))))
        .withColumn("copy_of", F.when(F.col("_first").isNull(), own_key).otherwise(F.when(F.col("_first._key") != LAST, F.col("_first._key"))))
        .withColumn("first_of_class", F.coalesce(F.col("_row") == F.col("_head_row"), F.lit(True)))
        .select(*docs.columns, "class_id", "copy_of", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_of_class")
    )
