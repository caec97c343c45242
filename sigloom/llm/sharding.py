"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VIRTUAL`` points on a ring of 64-bit hashes; a document belongs to the arc in which the hash
of its ``doc_id`` falls and goes to that arc's shard. Loads are bounded: a shard takes no more rows than its
capacity, first those of its own arcs, and what overflows a full shard continues clockwise to the next arc
whose shard has room. With ``slack`` 0 (the default) capacities add up to the number of rows and differ by at
most one, so counts are at most one apart; with more slack fewer rows move when shards are added.

Only counts of arcs go to the driver (shards x virtual nodes, whatever the data). It decides for each arc which
ranks of its rows go to which shard; rows get their rank by a window over their arc, and rank and table give
shard and slot. The result depends on the rows alone, not on their order or partitioning.

Defined results: a null text has size 8 and the crc32 of no bytes. Rows without ``doc_id`` are spread by the
hash of their text. Repeated rows are placed one by one. Other columns are ignored by :func:`place`; an empty
table gives an empty result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VIRTUAL = 128


def _mix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """Sorted ``(point, shard)``; points are signed, as Spark's hashes are. More shards only add points."""
    return sorted((_mix(_mix(s) + v) - 2**63, s) for s in range(shards) for v in range(virtual))


def allot(arcs: list[int], counts: dict[int, int], shards: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first rank, rank after the last, shard, first slot)``: which rows of each arc go where.

    ``arcs`` has the shard of each arc in ring order."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) + int(slack * total / shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []

    def give(arc: int, first: int, shard: int, n: int):
        out.append((arc, first, first + n, shard, used[shard]))
        used[shard] += n

    for arc, shard in enumerate(arcs):
        n = counts.get(arc, 0)
        take = min(n, room[shard] - used[shard])
        if take:
            give(arc, 0, shard, take)
        if n > take:
            over.append((arc, take, n))
    free = [a for a, s in enumerate(arcs) if used[s] < room[s]]
    for arc, first, n in over:
        while first < n:
            at = bisect.bisect_right(free, arc) % len(free)
            shard = arcs[free[at]]
            take = min(n - first, room[shard] - used[shard])
            give(arc, first, shard, take)
            first += take
            if used[shard] == room[shard]:
                free = [a for a in free if arcs[a] != shard]
    return out


def place(docs: DataFrame, shards: int, virtual: int = VIRTUAL, slack: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default ``doc_id``) with ``size``, ``text_crc32``, ``shard`` and ``slot``;
    kept columns of these names give way."""
    keep = [c for c in keep or ["doc_id"] if c not in ("size", "text_crc32", "shard", "slot")]
    body = F.coalesce("text", F.lit(""))
    points = ring(shards, virtual)
    ends = np.array([p for p, _ in points], np.int64)

    @F.arrow_udf("int")
    def arc_of(spots: pa.Array) -> pa.Array:  # the next point clockwise; past the last one, the first
        return pa.array((np.searchsorted(ends, spots.to_numpy(zero_copy_only=False)) % len(ends)).astype(np.int32))

    spot = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(1), "text")).otherwise(F.xxhash64(F.lit(0), "doc_id"))
    counts = docs.select(spot.alias("spot")).groupBy(arc_of("spot").alias("arc")).count().collect()
    table = allot([s for _, s in points], {r["arc"]: r["count"] for r in counts}, shards, slack)
    plan = docs.sparkSession.createDataFrame(table, "__in int, __first long, __last long, shard int, __slot long")
    rows = docs.select(*keep, (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
                       spot.alias("__spot")).withColumn("__arc", arc_of("__spot"))
    rank = F.row_number().over(Window.partitionBy("__arc").orderBy("__spot", "text_crc32", "size")) - 1
    rows = rows.withColumn("__rank", rank.cast("long"))
    there = (F.col("__arc") == F.col("__in")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__last"))
    return (rows.join(F.broadcast(plan), there)  # at most 2 x arcs + shards rows
            .select(*keep, "size", "text_crc32", "shard", (F.col("__slot") + F.col("__rank") - F.col("__first")).alias("slot")))
