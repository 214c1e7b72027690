"""Consistent-hash ring with virtual nodes and bounded loads.

The ring has RING slots. Each shard owns `vnodes` points on it; a row belongs to the
slot of its key's hash and walks clockwise from there. A shard takes rows until its
capacity is full, rows beyond continue to the next point whose shard has room. The walk
goes in rounds: whoever reached a shard in fewer steps is placed first, within a round
slots are served in ring order, within a slot rows in order of their key's hash. So
the placement depends on the rows alone, not on partitions or arrival.

Only the number of rows of each slot (RING numbers at most, whatever the input) goes to
the driver; what comes back is a table of (slot, range of ranks) -> (shard, first slot
number) with at most RING + shards rows. Texts are never shuffled.

Nulls: a null text has no bytes; rows with a null key are spread by their text.
Repeated rows are placed one after another. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import packed, read

#: Slots of the ring, a power of two. It bounds what the driver sees and what is broadcast.
RING = 1 << 14


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of each virtual node in clockwise order."""
    at = lambda s, v: int.from_bytes(blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
    points = sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))
    return [(h * RING >> 64, s) for h, s in points]


def place(counts: dict[int, int], capacity: list[int], points: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(slot, lo, hi, shard, base): rows lo..hi-1 of a slot go to a shard, as its rows base, base+1, ..."""
    room, used, n = list(capacity), [0] * len(capacity), len(points)
    starts = [p for p, _ in points]
    waiting = [(slot, 0, c, bisect_left(starts, slot) % n) for slot, c in sorted(counts.items()) if c]
    out = []
    open_at = _open(points, room)
    while waiting:
        arrived: dict[int, list] = {}
        for slot, lo, hi, at in waiting:
            i = open_at[at]
            arrived.setdefault(points[i][1], []).append((slot, lo, hi, i))
        waiting, filled = [], False
        for shard, rows in arrived.items():
            for slot, lo, hi, i in rows:
                take = min(room[shard], hi - lo)
                if take:
                    out.append((slot, lo, lo + take, shard, used[shard]))
                    room[shard] -= take
                    used[shard] += take
                    filled |= not room[shard]
                if lo + take < hi:
                    waiting.append((slot, lo + take, hi, (i + 1) % n))
        if filled:
            open_at = _open(points, room)
        waiting.sort()
    return out


def _open(points: list[tuple[int, int]], room: list[int]) -> list[int]:
    """For each point, the next one clockwise (itself included) whose shard has room."""
    n, nxt = len(points), [0] * len(points)
    last = next((i for i in range(n) if room[points[i][1]]), 0)
    for i in range(n - 1, -1, -1):
        if room[points[i][1]]:
            last = i
        nxt[i] = last
    return nxt


def assign_shards(df: DataFrame, key: Column, tie: list[Column], shards: int, vnodes: int = 128, load_factor: float | None = None) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard); columns of these names are replaced.

    load_factor: a shard takes at most this times the mean number of rows; None fills
    all evenly, so that no two shards differ by more than one row.
    tie: columns that order rows of equal keys; rows equal in all of them are interchangeable.
    """
    ring = F.shiftrightunsigned(F.col("_h"), 64 - RING.bit_length() + 1).cast("int")
    rows = df.select(packed(df, ("shard", "slot")), key.alias("_h"), *(t.alias(f"_t{i}") for i, t in enumerate(tie))).withColumn("_at", ring)
    counts = {r["_at"]: r["count"] for r in rows.groupBy("_at").count().collect()}
    total = sum(counts.values())
    even = [total // shards + (s < total % shards) for s in range(shards)]
    if load_factor is not None:
        even = [max(e, int(load_factor * total / shards)) for e in even]
    parts = place(counts, even, ring_points(shards, vnodes))
    plan = df.sparkSession.createDataFrame(parts, "_slot int, _lo long, _hi long, shard int, _base long")
    # The ring's plan has RING + shards rows at most.
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_at").orderBy("_h", *(f"_t{i}" for i in range(len(tie))))).cast("long") - 1)
    on = (F.col("_at") == F.col("_slot")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    placed = ranked.join(F.broadcast(plan), on)
    return placed.select("row.*", "shard", (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("slot"))


def documents_to_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents over `shards` shards, counts at most one apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = read(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")).alias("_key"),
    )
    out = assign_shards(rows, F.col("_key"), [F.col(c) for c in ("doc_id", "text_crc32", "size")], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
