"""Sharding over fixed virtual slots.

Every record hashes into one of VIRTUAL_SLOTS slots by its key, for ever. Bytes are summed per slot, and a
versioned table says which shard each slot belongs to. Rebalancing edits the table: it moves the fewest bytes
from full shards to empty ones, so most records stay where they were. Only the slot table, whose size is the
number of slots whatever the data, passes the driver.

Null keys hash like any other value; equal keys share a slot; an empty table gives an empty result; columns of
the input are kept, and those the operator adds replace columns of the same name.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIRTUAL_SLOTS = 4096
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def with_slot(df: DataFrame, key: str, slots: int = VIRTUAL_SLOTS) -> DataFrame:
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int"))


def slot_bytes(slotted: DataFrame, size: str) -> DataFrame:
    """Bytes and rows of each slot that has any: partial sums before the exchange, at most `slots` rows out."""
    return slotted.groupBy("virtual_slot").agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("rows"))


def first_map(shards: int, slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def rebalanced(current: list[int], sizes: dict[int, int], shards: int, tolerance: float = 0.001) -> list[int]:
    """Edit a map until no move from the fullest to the emptiest shard evens them out by more than `tolerance`.

    Each edit moves the slot whose size is nearest to half the difference, or swaps two slots where a swap
    comes nearer. Works on the slot table alone.
    """
    new = list(current)
    load = [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, shard in enumerate(new):
        held[shard].add(slot)
        load[shard] += sizes.get(slot, 0)
    enough = tolerance * sum(load) / shards
    size = lambda s: sizes.get(s, 0)
    for _ in range(8 * len(new)):
        high, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        if gap <= enough:
            break
        moves = [(abs(gap - 2 * size(s)), s, None) for s in held[high] if 0 < size(s) < gap]
        best = min(moves, default=None, key=lambda m: m[:2])
        if best is None or best[0] > enough:
            ours, theirs = sorted(held[high], key=lambda s: (size(s), s)), sorted(held[low], key=lambda s: (size(s), s))
            at = 0
            for s in ours:
                while at + 1 < len(theirs) and size(s) - size(theirs[at + 1]) >= gap / 2:
                    at += 1
                for t in theirs[at : at + 2]:
                    if 0 < size(s) - size(t) < gap and (best is None or abs(gap - 2 * (size(s) - size(t))) < best[0]):
                        best = (abs(gap - 2 * (size(s) - size(t))), s, t)
        if best is None:
            break
        for slot, to in ((best[1], low), (best[2], high)):
            if slot is not None:
                held[new[slot]].discard(slot)
                load[new[slot]] -= size(slot)
                new[slot] = to
                held[to].add(slot)
                load[to] += size(slot)
    return new


def grown(current: list[int], sizes: dict[int, int], shards: int) -> list[int]:
    """A map with one more shard: slots move only into the new shard, each time from the fullest one."""
    new = list(current)
    load = [0] * shards
    for slot, shard in enumerate(new):
        load[shard] += sizes.get(slot, 0)
    by_shard: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(new):
        by_shard[shard].append(slot)
    for held in by_shard:
        held.sort(key=lambda s: sizes.get(s, 0))
    heap = [(-load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    target, moved = sum(load) / (shards + 1), 0
    while heap and moved < target:
        weight, shard = heapq.heappop(heap)
        while by_shard[shard]:
            slot = by_shard[shard].pop()
            step = sizes.get(slot, 0)
            if step and moved + step <= target * 1.01:
                new[slot] = shards
                moved += step
                heapq.heappush(heap, (weight + step, shard))
                break
    return new


def write_map(spark: SparkSession, folder: str, version: int, shards_of: list[int]) -> None:
    rows = [(version, slot, shard) for slot, shard in enumerate(shards_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}").select("virtual_slot", "shard")


def balance(
    df: DataFrame, key: str, size: str, shards: int, folder: str, slots: int = VIRTUAL_SLOTS
) -> tuple[DataFrame, int]:
    """Write map version 1 and the version edited for the bytes of `df`; returns the slot totals and that version."""
    spark = df.sparkSession
    totals = slot_bytes(with_slot(df, key, slots), size)
    sizes = {r.virtual_slot: r.bytes or 0 for r in totals.collect()}  # at most `slots` rows
    start = first_map(shards, slots)
    write_map(spark, folder, 1, start)
    write_map(spark, folder, 2, rebalanced(start, sizes, shards))
    return totals, 2


def assign(df: DataFrame, key: str, mapping: DataFrame, order: list[str], slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Adds virtual_slot, shard, and place: 0, 1, ... without gaps within each shard.

    A place is the rank within the virtual slot plus the rows of the shard's earlier slots, so no task sees more
    than a few virtual slots.
    """
    slotted = with_slot(df, key, slots)
    counts = slotted.groupBy("virtual_slot").agg(F.count("*").alias("_rows"))
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    bases = (
        F.broadcast(mapping).join(counts, "virtual_slot")
        .select("virtual_slot", "shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    )
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)) - 1
    return (
        slotted.drop("shard", "place", "_rank", "_base").withColumn("_rank", rank)
        .join(F.broadcast(bases), "virtual_slot")
        .withColumn("place", (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_rank", "_base")
    )
