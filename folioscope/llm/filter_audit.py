"""How filters interact: what each removes alone, after others, and in every order.

Five filters judge a whole text. FAILS is a bit mask of the filters a document fails. A document survives a subset of
the filters if it fails none of them, so its row of the truth table over all 32 subsets is one 32-bit word: bit s is set
where s and the failures have no filter in common. Everything the report needs is how many documents of a part and label
have bit s: these counts are positional popcounts of the words, made in every task by carry-save adders (three words of
one weight become a sum word of that weight and a carry word of the next), and added up by Spark.

A  fewer than `least_words` words                       B  distinct words below `distinct_pct` % of the words
C  `[A-Z]` characters above `capital_pct` % of the code points   D  holds one of `[#$%&*|]`
E  equal to the text of a smaller doc_id, whatever becomes of that one

Defined results: a null text is an empty text (fails A and, but for the first such document, E). A null source is the
part ''. Null doc_ids count as larger than all others, and have no label. Rows that repeat a doc_id and its text do not
fail E for each other's sake. Several labels of a doc_id: quality 1 or toxic 1 if one of them says so. An empty table
has no part and no row. Other columns of the documents are not read, so their names cannot clash.

Texts are read once; what moves is 50 bytes or so per document. A third of all rows with one text stays cheap: first
doc_ids are pre-aggregated, and the join back to them is one that Spark splits where it is skewed.
"""
from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrays import SpanHashes, code_points, per_text, slices, words
from folioscope.llm.store import stored

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
BITS = [f"s{i}" for i in range(SUBSETS)]
MARKS = np.zeros(256, dtype=bool)
MARKS[[ord(c) for c in "#$%&*|"]] = True
LABELS = ("documents", "good", "toxic")


def text_failures(
    docs: DataFrame, least_words: int = 50, distinct_pct: int = 65, capital_pct: int = 5, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """_key, part, _same (a 128-bit digest of the text) and fails (bits of A to D) for every row."""
    rows = docs.select(
        F.col(key).cast("long").alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    rows = rows.select("_key", "part", F.unhex(F.md5("_text")).alias("_same"), "_text")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            for start, stop, data, offs in slices(batch.column(names.index("_text"))):
                texts = stop - start
                starts, ends, of = words(data, offs)
                n = np.bincount(of, minlength=texts)
                hashes = SpanHashes(data).of(starts, ends)
                order = np.lexsort((hashes, of))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
                distinct = np.bincount(of[order][new], minlength=texts)
                at = np.repeat(np.arange(texts), np.diff(offs))
                capitals = per_text((data >= 65) & (data <= 90), at, texts)
                length = per_text(code_points(data), at, texts)
                marked = np.bincount(at[MARKS[data]], minlength=texts) > 0
                fails = (n < least_words) * 1 + (100 * distinct < distinct_pct * n) * 2 + (100 * capitals > capital_pct * length) * 4 + marked * 8
                part_ = batch.slice(start, texts)
                yield pa.RecordBatch.from_arrays(
                    [*(part_.column(names.index(c)) for c in ("_key", "part", "_same")), pa.array(fails.astype(np.int32))], ["_key", "part", "_same", "fails"]
                )

    return rows.mapInArrow(run, "_key long, part string, _same binary, fails int")


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds the bit of E to `fails`: the text stands under a smaller key."""
    firsts = rows.groupBy("_same").agg(F.min("_key").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = F.col("_first").isNotNull() & (F.col("_key").isNull() | (F.col("_key") > F.col("_first")))
    fails = F.col("fails") + F.when(later, F.lit(16)).otherwise(F.lit(0))
    return rows.join(firsts, "_same", "left").select("_key", "part", fails.alias("fails"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic. Rows without a key are dealt out, so that they do not meet in one task."""
    marks = (
        labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_key"))
        .agg(F.max((F.coalesce("quality", F.lit(0)) == 1)).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1)).alias("toxic"))
        .filter("good or toxic").withColumn("_spread", F.lit(0).cast("long"))
    )
    spread = F.when(F.col("_key").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
    keyed = rows.select(F.coalesce("_key", F.lit(0).cast("long")).alias("_key"), spread.alias("_spread"), "part", "fails")
    joined = keyed.join(marks, ["_key", "_spread"], "left")
    return joined.select("part", "fails", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survival_words() -> np.ndarray:
    """The truth-table word of each failure mask."""
    subsets = np.arange(SUBSETS, dtype=np.uint32)
    return np.array([np.sum((np.uint64(1) << subsets[(subsets & mask) == 0].astype(np.uint64))) for mask in range(SUBSETS)], dtype=np.uint64).astype(np.uint32)


def positional_popcount(values: np.ndarray) -> np.ndarray:
    """How many of the 32-bit `values` have each bit, by carry-save addition."""
    counts = np.zeros(32, dtype=np.int64)
    shifts = np.arange(32, dtype=np.uint32)
    level, weight = values.astype(np.uint32), 1
    while len(level):
        carries = []
        while len(level) >= 3:
            third = len(level) // 3
            a, b, c = level[:third], level[third : 2 * third], level[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate((half ^ c, level[3 * third :]))
        counts += weight * ((level[:, None] >> shifts) & np.uint32(1)).sum(axis=0, dtype=np.int64)
        level, weight = (np.concatenate(carries) if carries else level[:0]), weight * 2
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """part, label, s0..s31: documents of the part and label that survive each subset, from part, fails, good, toxic."""

    def run(batches):
        of_mask = survival_words()
        for batch in batches:
            part = batch.column(batch.schema.names.index("part")).dictionary_encode()
            fails, good, toxic = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("fails", "good", "toxic"))
            codes, names = part.indices.to_numpy(), part.dictionary.to_pylist()
            found = of_mask[fails]
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(names) + 1))
            out: list[tuple] = []
            for number, name in enumerate(names):
                of_part = order[bounds[number] : bounds[number + 1]]
                for label, chosen in zip(LABELS, (of_part, of_part[good[of_part]], of_part[toxic[of_part]]), strict=True):
                    out.append((name, label, positional_popcount(found[chosen])))
            counts = np.array([c for *_, c in out], dtype=np.int64).reshape(-1, SUBSETS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, *_ in out], pa.string()), pa.array([x for _, x, _ in out], pa.string()), *(pa.array(counts[:, i]) for i in range(SUBSETS))],
                ["part", "label", *BITS],
            )

    found = rows.mapInArrow(run, "part string, label string, " + ", ".join(f"{b} long" for b in BITS))
    return found.groupBy("part", "label").agg(*[F.sum(b).alias(b) for b in BITS])


def orders_table(spark) -> DataFrame:
    """number, filter_order, step, its filter's place, the subsets before and after it: 120 orders of five steps, 600 rows."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, place in enumerate(order, 1):
            rows.append((len(rows), "".join(FILTERS[i] for i in order), step, place, before, before | 1 << place))
            before |= 1 << place
    return spark.createDataFrame(rows, "number int, filter_order string, step int, place int, before int, after int")


def report(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of the step, from the survivors of every subset."""
    per_part = counts.groupBy("part").agg(*[
        F.max(F.when(F.col("label") == label, F.array(*BITS))).alias(label) for label in LABELS
    ])
    steps = orders_table(counts.sparkSession)
    last = SUBSETS - 1
    n = lambda label, subset: F.element_at(label, subset + 1)
    rows = per_part.select("*", F.explode(F.sequence(F.lit(0), F.lit(599))).alias("number")).join(F.broadcast(steps), "number")  # 600 rows, always
    alone = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("place") + 1)
    removed = n("documents", F.col("before")) - n("documents", F.col("after"))
    total = F.lit(None)
    for place in range(len(FILTERS)):  # a subset before the filter's turn stands in so many orders
        terms = F.lit(0).cast("long")
        for before in (s for s in range(SUBSETS) if not s >> place & 1):
            size = bin(before).count("1")
            ways = int(np.prod(range(1, size + 1))) * int(np.prod(range(1, len(FILTERS) - size)))
            terms = terms + F.lit(ways) * (n("documents", F.lit(before)) - n("documents", F.lit(before | 1 << place)))
        total = F.when(F.col("place") == place, terms).otherwise(total)
    return rows.select(
        "part", "filter_order", "step", n("documents", F.col("after")).alias("kept"), removed.alias("removed"),
        (n("documents", F.lit(0)) - n("documents", alone) - removed).alias("redundant"),
        (n("documents", F.lit(last) - alone) - n("documents", F.lit(last))).alias("unique_fails"),
        (n("good", F.col("before")) - n("good", F.col("after"))).alias("good_lost"),
        (n("toxic", F.col("before")) - n("toxic", F.col("after"))).alias("toxic_lost"), total.cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """The report of all orders for the documents, part by part."""
    rows = stored(text_failures(docs, **limits), "failures")
    return report(stored(survivors(with_labels(with_repeats(rows), labels)), "survivors"))
