"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are words [^\\x20\\x09-\\x0D]+, hashed to 31 bits. The hash of a k-gram is the rolling one, w0 * B**(k-1) + ... + w(k-1)
modulo the prime 2**31 - 1, made for all positions of a text at once: a pass multiplies by B and adds the next word. Of
every `window` successive hashes the smallest is chosen, the rightmost of equal ones; each choice is kept once, with its position. Any run of window + k - 1 words that two
texts share gives both a common hash, and no shared run shorter than k words is seen.

A text of fewer than k words, but one at least, has one hash of all its words at position 0; fewer than `window`
grams make one window. Null and empty texts have no hashes. Two fingerprints without hashes are alike (1.0). Repeated rows get
equal fingerprints, an empty table gives no rows. Columns are kept, but for those named like the result, and _copy and _bucket.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.store import stored

K = 5
WINDOW = 12
LOW = 0x7FFFFFFF  # the prime 2**31 - 1, and the low 31 bits
BASE = 1_000_003
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
BUCKET_ROWS = 512
KNOTS = 64


def _paired(array: Column, shift: int, merge) -> Column:
    """merge(array[i], array[i + shift]) for every i for which both exist."""
    n = F.greatest(F.size(array) - shift, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(shift + 1), n), merge)


def _spans(df: DataFrame, column: str, span: int, merge) -> DataFrame:
    """Combine every `span` successive items by doubling; the last step overlaps, which `merge` must allow."""
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        df = df.withColumn(column, _paired(F.col(column), step, merge))
        reach += step
    return df


def with_fingerprint(df: DataFrame, text: str, into: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds `into`: array of whole numbers, each a 31-bit hash and the complement of its position in 32 bits."""
    h, g, whole = f"_{into}_words", f"_{into}_grams", f"_{into}_whole"
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPLIT), lambda w: w != "")
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(LOW).cast("bigint"))))
    df = df.withColumn(whole, F.when((F.size(h) > 0) & (F.size(h) < k), F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn(g, F.col(h))
    for shift in range(1, k):  # products stay below 2**62
        n = F.greatest(F.size(h) - shift, F.lit(0))
        df = df.withColumn(g, F.zip_with(F.slice(g, F.lit(1), n), F.slice(h, F.lit(shift + 1), n), lambda a, b: (a * BASE + b) % LOW))
    grams = F.when(F.size(g) > 0, F.col(g)).otherwise(F.col(whole))
    df = df.withColumn(g, grams)
    df = df.withColumn(g, F.transform(g, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit(LOW).cast("bigint")), 32).bitwiseOR((F.lit(LOW) - i).cast("bigint"))))
    few = F.when((F.size(g) > 0) & (F.size(g) < window), F.array(F.array_min(g))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(whole, few)
    df = _spans(df, g, window, lambda a, b: F.least(a, b))
    chosen = F.when(F.size(g) > 0, F.array_distinct(g)).otherwise(F.col(whole))
    return df.withColumn(into, chosen).drop(h, g, whole)


def positions(fingerprint: Column) -> Column:
    """Structs of hash and position, in the order of positions."""
    return F.transform(fingerprint, lambda v: F.struct(F.shiftright(v, 32).alias("hash"), (F.lit(LOW) - v.bitwiseAND(F.lit(LOW).cast("bigint"))).cast("int").alias("position")))


def written(fingerprint: Column) -> Column:
    """hash.position of every choice, in hexadecimal and decimal."""
    return F.array_join(F.transform(fingerprint, lambda v: F.concat(F.hex(F.shiftright(v, 32)), F.lit("."), (F.lit(LOW) - v.bitwiseAND(F.lit(LOW).cast("bigint"))).cast("string"))), " ")


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32)))


def likeness(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """Jaccard similarity of two hash sets."""
    df = df.withColumn("_common", F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - F.col("_common")
    return df.withColumn(into, F.when(union == 0, 1.0).otherwise(F.col("_common") / union)).drop("_common")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds next_text, the text of the row that follows in descending key order; the first row follows the last.

    Rows are cut into key ranges of about `bucket_rows` (ranges between quantiles, divided evenly), so one exchange of
    the texts serves a window per range. The first row of each range is also given to the range before it.
    Null keys come last; rows of equal key are ordered by a hash of their text.
    """
    knots = docs.agg(F.percentile_approx(key, [i / KNOTS for i in range(KNOTS + 1)], 10000).alias("q"), F.count("*").alias("n")).first()
    ranges = max(1, -(-(knots.n or 0) // (bucket_rows * KNOTS)))
    if knots.q:
        points = F.array(*[F.lit(x).cast("bigint") for x in knots.q])
        at = F.least(F.size(F.filter(points, lambda p: p <= F.col(key))), F.lit(KNOTS))
        at = F.greatest(at, F.lit(1))
        low, high = F.element_at(points, at).cast("double"), F.element_at(points, at + 1).cast("double")
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(key).cast("double") - low) / F.greatest(high - low, F.lit(1.0))))
        place = F.least(F.floor(share * ranges), F.lit(ranges - 1))
        bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at * ranges + place).cast("bigint")
    else:
        bucket = F.lit(-1).cast("bigint")
    rows = docs.drop("next_text", "_copy").withColumn("_bucket", bucket)
    heads = rows.groupBy("_bucket").agg(F.max(key).alias("_head"))
    # The next range is looked for between two quantiles, and for the last one there in a table of a row per quantile.
    heads = stored(heads.withColumn("_knot", F.floor(F.col("_bucket") / ranges)), "range-heads")
    firsts = heads.groupBy("_knot").agg(F.min("_bucket").alias("_least"))
    by_knot = W.orderBy("_knot")  # KNOTS + 1 rows at most
    lowest = F.min("_least").over(by_knot.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = firsts.select("_knot", F.coalesce(F.lead("_least").over(by_knot), lowest).alias("_beyond"))
    following = F.lead("_bucket").over(W.partitionBy("_knot").orderBy("_bucket"))
    # stored, so that the planner knows how small it is before the texts move
    above = stored(heads.withColumn("_following", following).join(F.broadcast(firsts), "_knot").select(
        F.col("_bucket").alias("_from"), "_head", F.coalesce("_following", "_beyond").alias("_to")), "range-followers")
    copies = rows.join(above, (F.col("_bucket") == F.col("_from")) & F.col(key).eqNullSafe(F.col("_head"))).withColumn("_bucket", F.col("_to"))
    both = rows.withColumn("_copy", F.lit(0)).unionByName(copies.select(*rows.columns, F.lit(1).alias("_copy")))
    w = W.partitionBy("_bucket").orderBy("_copy", F.col(key).desc_nulls_last(), F.xxhash64(text))
    return both.withColumn("next_text", F.lead(F.coalesce(text, F.lit(""))).over(w)).filter("_copy = 0").drop("_copy", "_bucket")
