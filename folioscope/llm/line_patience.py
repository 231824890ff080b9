"""Line dedup by pairwise alignment.

Lines are the \\n-split pieces of a text, compared whole. A document's links go from its lines to the earliest
document with the same line (a star per line, never all pairs), however frequent the line is: a document is
aligned with every different earlier holder of its lines. Each linked pair is aligned by patience diff: lines unique in both texts, their longest increasing
chain, and the same again between its members, with equal lines joined at both ends. Lines of the later
document that are aligned with some earlier one are covered; runs of covered lines with `min_words` words or more are
deleted.

Documents are ordered by doc_id (null last), then by their row in the stored input. Exact copies of an earlier text
are aligned from end to end without a search, and deleted if they have `min_words` words. Lines without a word neither link nor end a run. Null
texts have no lines and stay null. Rows always stay; a text that loses all lines with words becomes "". Sequences of
line hashes travel, texts only once, when lines are cut out. Repeated rows count as copies; columns are kept, but for those
named like a result or _row, _key, _lines, _covered. An empty table gives no rows.
"""
from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import SEPARATOR, slices, span_hash
from folioscope.llm.store import stored

RARE = 50
MIN_WORDS = 10
LAST = (1 << 63) - 1


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and whether it has a word, of every line; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate((offs[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((offs[1:], breaks)))
    of = np.sort(np.concatenate((np.arange(len(offs) - 1), np.searchsorted(offs[1:], breaks, side="right"))))
    filled = np.concatenate(([0], np.cumsum(~SEPARATOR[data])))
    return starts, ends, of, filled[ends] > filled[starts]


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _lines: the lines' hashes as little-endian 64-bit numbers, 0 for a line without a word; null for a null text."""
    kept = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", _lines binary"
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            null = np.asarray(column.is_null())
            out = []
            for start, stop, data, offs in slices(column):
                a, b, of, has = line_spans(data, offs)
                hashes = np.where(has, span_hash(data, a, b) | np.uint64(1), np.uint64(0))
                bounds = np.searchsorted(of, np.arange(stop - start + 1))
                out += [None if null[start + i] else hashes[bounds[i] : bounds[i + 1]].tobytes() for i in range(stop - start)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(out, pa.binary())], [*names, "_lines"])

    return docs.select(*names).mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def unique_lines(reps: DataFrame) -> DataFrame:
    """hash, _key, _row, pos of lines with a word that stand once in their document."""

    def run(batches):
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for key, row, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values, first, n = np.unique(np.frombuffer(raw, dtype="<i8"), return_index=True, return_counts=True)
                once = (n == 1) & (values != 0)
                found[0].append(values[once])
                found[1].append(np.full(int(once.sum()), key))
                found[2].append(np.full(int(once.sum()), row))
                found[3].append(first[once])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in found], ["hash", "_key", "_row", "pos"])

    return reps.select("_key", "_row", "_lines").mapInArrow(run, "hash long, _key long, _row long, pos long")


def linked_pairs(lines: DataFrame) -> DataFrame:
    """later, earlier: rows whose lines are to be aligned, a document with each earliest holder of one of its lines."""
    # stored, so that both sides of the join come from exchanges whose large partitions can be split
    first = stored(
        lines.groupBy("hash").agg(F.count("*").alias("df"), F.min(F.struct("_key", "_row")).alias("first"))
        .filter("df > 1").select("hash", F.col("first._row").alias("earlier")), "line-first",
    )
    return lines.join(first, "hash").filter("_row <> earlier").select(F.col("_row").alias("later"), "earlier").distinct()


def longest_chain(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v), at.append(i)
        else:
            tops[pile], at[pile] = v, i
        before[i] = at[pile - 1] if pile else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), increasing in both, with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count: dict[int, list[int]] = {}
        for i in range(a0, a1):
            count.setdefault(a[i], [0, 0, i, -1])[0] += 1
        for j in range(b0, b1):
            if (c := count.get(b[j])) is not None:
                c[1] += 1
                c[3] = j
        both = sorted((c[2], c[3]) for c in count.values() if c[0] == c[1] == 1)
        anchors = [both[i] for i in longest_chain([j for _, j in both])]
        if not anchors:
            continue
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if i1 < a1:
                out.append((i1, j1))
            stack.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(out)


def aligned(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """later, earlier, covered: ranges of lines [from, to) of the later document that are aligned with the earlier."""
    ours = table.select(F.col("_row").alias("later"), F.col("_lines").alias("later_lines"))
    theirs = table.select(F.col("_row").alias("earlier"), F.col("_lines").alias("earlier_lines"))

    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], []]
            for later, earlier, b, a in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                b_ = np.frombuffer(b, dtype="<i8").tolist()
                ranges: list[list[int]] = []
                for _, j in patience(np.frombuffer(a, dtype="<i8").tolist(), b_):
                    if b_[j] == 0:
                        continue
                    if ranges and ranges[-1][1] == j:
                        ranges[-1][1] = j + 1
                    else:
                        ranges.append([j, j + 1])
                if ranges:
                    rows[0].append(later), rows[1].append(earlier), rows[2].append(ranges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.list_(pa.int64())))], ["later", "earlier", "covered"]
            )

    joined = pairs.join(theirs, "earlier").join(ours, "later").select("later", "earlier", "later_lines", "earlier_lines")
    return joined.mapInArrow(run, "later long, earlier long, covered array<array<bigint>>")


def cut_text(text: str, covered: list[list[int]], min_words: int) -> tuple[str, int, int]:
    """The text without its covered runs, the lines and the words cut."""
    lines = text.split("\n")
    drop = [False] * len(lines)
    for a, b in covered:
        for i in range(a, b):
            drop[i] = True
    # \x1c-\x1f and other blanks of Unicode belong to words here
    words = [len(line.translate(BLANKS).split(" ")) - line.translate(BLANKS).split(" ").count("") for line in lines]
    i = 0
    while i < len(lines):
        if not drop[i]:
            i += 1
            continue
        j, total, last = i, 0, i
        while j < len(lines) and (drop[j] or words[j] == 0):
            if drop[j]:
                total, last = total + words[j], j
            j += 1
        for k in range(i, last + 1):
            drop[k] = total >= min_words
        i = j
    kept = [line for line, d in zip(lines, drop, strict=True) if not d]
    if not any(w for w, d in zip(words, drop, strict=True) if not d) and any(drop):
        return "", len(lines), sum(words)
    return "\n".join(kept), sum(drop), sum(w for w, d in zip(words, drop, strict=True) if d)


BLANKS = {c: " " for c in (0x09, 0x0B, 0x0C, 0x0D)}


def without_repeats(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with repeated line blocks cut out of their texts, and n_lines, lines_cut, words_cut, sources
    (keys of the earlier documents that blocks were aligned with, ascending). `rare` is taken for older callers only: lines
    link however frequent they are."""
    docs = docs.drop("_row", "_key", "_lines", "_covered", "n_lines", "lines_cut", "words_cut", "sources")
    table = stored(with_lines(docs, text).withColumn("_key", F.coalesce(F.col(key).cast("long"), F.lit(LAST))), "lines")
    hashed = table.filter(F.col("_lines").isNotNull()).select("_row", "_key", F.xxhash64("_lines").alias("_h"), F.length("_lines").alias("_n"))
    firsts = hashed.groupBy("_h", "_n").agg(F.min(F.struct("_key", "_row")).alias("first"), F.count("*").alias("_copies"))
    copies = (
        hashed.join(firsts.filter("_copies > 1"), ["_h", "_n"]).filter("_row <> first._row and _n > 0")
        .select(F.col("_row").alias("later"), F.col("first._row").alias("earlier"), (F.col("_n") / 8).cast("long").alias("_n"))
    )
    first_rows = firsts.select(F.col("first._row").alias("_row"))
    reps = stored(table.select("_row", "_key", "_lines").join(first_rows, "_row", "left_semi"), "line-firsts")
    found = aligned(linked_pairs(unique_lines(reps)), reps)
    whole = copies.select("later", "earlier", F.array(F.array(F.lit(0).cast("bigint"), F.col("_n"))).alias("covered"))
    keys = table.select(F.col("_row").alias("earlier"), F.col(key).alias("_source"))
    per_doc = (
        found.unionByName(whole).join(keys, "earlier").groupBy("later")
        .agg(F.flatten(F.collect_list("covered")).alias("_covered"), F.array_sort(F.collect_set("_source")).alias("sources"))
        .withColumnRenamed("later", "_row")
    )
    kept, names = docs.schema.fields, docs.columns
    source_type = docs.schema[key].dataType.simpleString()
    added = f"n_lines bigint, lines_cut bigint, words_cut bigint, sources array<{source_type}>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + added

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            texts: list = []
            counts: list[list] = [[], [], []]
            for t, covered in zip(batch.column(at(text)).to_pylist(), batch.column(at("_covered")).to_pylist(), strict=True):
                n = 0 if t is None else t.count("\n") + 1
                new, lines, words = (t, 0, 0) if t is None or not covered else cut_text(t, covered, min_words)
                texts.append(new), counts[0].append(n), counts[1].append(lines), counts[2].append(words)
            arrays = [pa.array(texts, pa.string()) if n == text else batch.column(at(n)) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*arrays, *(pa.array(c, pa.int64()) for c in counts), batch.column(at("sources"))], [*names, "n_lines", "lines_cut", "words_cut", "sources"]
            )

    rows = table.drop("_lines", "_key").join(per_doc, "_row", "left")
    rows = rows.withColumn("sources", F.coalesce("sources", F.array().cast(f"array<{source_type}>")))
    return rows.select(*names, "_covered", "sources").mapInArrow(run, schema)
