"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A key belongs to the first virtual node clockwise from its place. Each shard has a capacity; the keys of an arc that its
shard can't take go on clockwise to the next virtual node's shard, and so on. Only counts by arc reach the driver (one
for each virtual node); a row's shard and slot follow from its rank within its arc, so rows shuffle once, by arc.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conjunct.llm.shared import utf8

PLACES = 1 << 62


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node, clockwise. A shard's places don't depend on the other shards."""
    place = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % PLACES
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def arc_of(place: Column, places: list[int]) -> Column:
    """Index of the first of the sorted places that isn't before `place`, by binary search; past the last comes 0."""
    steps = len(places).bit_length()
    padded = F.array(*[F.lit(p) for p in places])
    found = F.aggregate(
        F.array(*[F.lit(1 << s) for s in reversed(range(steps))]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(places)) & (F.get(padded, at + step - 1) < place), at + step).otherwise(at),
    )
    return F.pmod(found, F.lit(len(places)))


def allot(counts: dict[int, int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): who takes which ranks of each arc.

    In round r every arc offers what it still holds to the shard r virtual nodes on, in ring order. The capacities
    together must be at least the sum of the counts.
    """
    room, taken, out = list(capacity), [0] * len(capacity), []
    pending = {a: (0, n) for a, n in sorted(counts.items()) if n}
    for r in range(len(owners)):
        if not pending:
            break
        for a, (start, left) in list(pending.items()):
            shard = owners[(a + r) % len(owners)]
            if n := min(left, room[shard]):
                out.append((a, start, start + n, shard, taken[shard]))
                room[shard] -= n
                taken[shard] += n
                if n == left:
                    del pending[a]
                else:
                    pending[a] = start + n, left - n
    if pending:
        raise ValueError("the capacities are less than the rows")
    return out


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, nodes: int = 128, slack: float | None = 0.0) -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    slack 0 makes the shards' counts differ by one at most (law `rows`); slack s > 0 lets a shard take up to 1 + s times
    the mean (law `bounded`). slack None is the ring alone (law `key`): doc_id and the number of shards decide, and
    grown_shard is where the row would be with one shard more. Rows with a null key are placed by their text; repeated
    rows get slots of their own; an empty table gives no rows; other columns of df are ignored.
    """
    spark, nodes_at = df.sparkSession, ring(shards, nodes)
    places, owners = [p for p, _ in nodes_at], [s for _, s in nodes_at]
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(utf8(F.col(text))) + 8).cast("long").alias("size"),
        F.crc32(utf8(F.col(text)).cast("binary")).alias("text_crc32"),
    )
    place = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id")), F.lit(PLACES))
    rows = rows.withColumn("_place", place).withColumn("_arc", arc_of(F.col("_place"), places))
    if slack is None:
        more = ring(shards + 1, nodes)
        owner = F.array(*[F.lit(s) for s in owners])
        rows = rows.withColumn("shard", F.get(owner, F.col("_arc")))
        rows = rows.withColumn("grown_shard", F.get(F.array(*[F.lit(s) for _, s in more]), arc_of(F.col("_place"), [p for p, _ in more])))
    counts = {r["_arc"]: r["count"] for r in rows.groupBy("_arc").count().collect()}
    total = sum(counts.values())
    if slack is None:
        capacity = [total] * shards
    elif slack == 0:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        capacity = [-(-int(total * (1 + slack)) // shards) + 1] * shards
    given = spark.createDataFrame(allot(counts, owners, capacity), "_arc int, _from long, _to long, _shard int, _slot long")
    rank = Window.partitionBy("_arc").orderBy("_place", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rank", F.row_number().over(rank).cast("long") - 1)
    placed = ranked.join(F.broadcast(given), "_arc").filter("_rank >= _from and _rank < _to")
    law = "key" if slack is None else "rows" if slack == 0 else "bounded"
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_slot") + F.col("_rank") - F.col("_from")).alias("slot"),
        (F.col("grown_shard") if slack is None else F.lit(None)).cast("int").alias("grown_shard"),
    )
