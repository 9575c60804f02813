"""Sharding by minimax contiguous partition, in DataFrame operations only.

Groups of equal texts are atomic and ordered by their smallest id. Binary search
(several capacities a round) finds the smallest capacity at which a greedy pass
over the ordered groups needs no more shards than asked for; the groups are cut
where that pass cuts. The greedy pass jumps from cut to cut over the written
prefix sums, so each step is one aggregate and nothing is gathered.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ordered_prefix

CANDIDATES = 24  # capacities that one round of the search tries side by side


def _jump(groups: DataFrame, reach: list[int | None]) -> list[int]:
    """For each offset, the end of the last group that ends at or before it (-1: none)."""
    asked = [(k, x) for k, x in enumerate(reach) if x is not None]
    if not asked:
        return [-1] * len(reach)
    lo, hi = min(x for _, x in asked), max(x for _, x in asked)
    got = groups.where(F.col("_start") <= F.lit(hi)).where(F.col("_end") <= F.lit(hi)).agg(
        *[F.max(F.when(F.col("_end") <= F.lit(x).cast("long"), F.col("_end"))).alias(f"m{k}") for k, x in asked]).first()
    out = [-1] * len(reach)
    for k, _ in asked:
        out[k] = -1 if got[f"m{k}"] is None else got[f"m{k}"]
    return out


def smallest_capacity(groups: DataFrame, n_shards: int, total: int, largest: int) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest capacity for which greedy needs at most
    ``n_shards`` shards, and the ends of its shards.

    ``groups`` has ``_start`` and ``_end`` offsets of the ordered groups.
    """
    lo = max(largest, -(-total // n_shards))  # no smaller capacity can do
    hi = max(lo, lo + largest)                # greedy always can with this one
    best: tuple[int, list[int]] | None = None
    while best is None or lo < best[0]:
        top = hi if best is None else best[0] - 1
        n = min(CANDIDATES, top - lo + 1)
        caps = sorted({lo + (top - lo) * i // max(1, n - 1) for i in range(n)}) if n > 1 else [lo]
        cuts: list[list[int]] = [[] for _ in caps]
        for _ in range(n_shards):
            at = [c[-1] if c else 0 for c in cuts]
            reach = [None if a >= total else a + cap for a, cap in zip(at, caps)]
            if all(x is None for x in reach):
                break
            for c, x, end in zip(cuts, reach, _jump(groups, reach)):
                if x is not None:
                    c.append(end)
        fits = [bool(c) and c[-1] >= total for c in cuts]
        for cap, c, ok in zip(caps, cuts, fits):
            if ok and (best is None or cap < best[0]):
                best = cap, c
        failed = [cap for cap, ok in zip(caps, fits) if not ok and (best is None or cap < best[0])]
        if failed:
            lo = max(lo, max(failed) + 1)
        elif best is not None:
            lo = best[0]
        if best is None and not failed:
            raise AssertionError("no feasible capacity")
    return best


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot): one row per row of ``docs``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; ``crc`` its CRC-32
    (null: that of no bytes). Rows with equal texts stay together; null is a text
    of its own, apart from the empty one. Groups are ordered by their smallest id
    (null ids last), rows of a group by id, and ``slot`` counts them from 0 in
    each shard. Repeated rows are rows of their own. Fewer groups than shards
    leave shards empty. An empty table gives an empty table.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_hash"),
                       text.isNull().alias("_null"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"))
    rows = cut(rows.withColumn("_key", F.concat(F.col("_hash"), F.col("_null").cast("string").cast("binary"))).drop("_hash", "_null"), "shard-rows")
    order = F.coalesce(F.col("_lo"), F.lit((1 << 63) - 1).cast("long"))
    groups = rows.groupBy("_key").agg(F.min("id").alias("_lo"), F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_n"))
    groups = ordered_prefix(groups.withColumn("_lo", order), ["_lo", "_key"], {"_start": "_bytes", "_first": "_n"}, "shard-order")
    groups = cut(groups.withColumn("_end", F.col("_start") + F.col("_bytes")), "shard-groups")
    total, largest = groups.agg(F.sum("_bytes"), F.max("_bytes")).first()
    narrow = groups.select("_start", "_end").persist()  # two numbers a group, read at every step; rebuilt if lost
    cuts = smallest_capacity(narrow, n_shards, total, largest)[1] if total else []
    narrow.unpersist()
    shard = F.lit(0)
    for c in cuts[:-1]:  # at most n_shards terms
        shard = shard + F.when(F.col("_start") >= F.lit(c).cast("long"), 1).otherwise(0)
    placed = groups.select("_key", "_lo", "_first", shard.cast("int").alias("shard"))
    bases = placed.groupBy("shard").agg(F.min("_first").alias("_base"))  # at most n_shards rows
    placed = placed.join(F.broadcast(bases), "shard").select("_key", "_lo", "shard", "_base")
    rows = rows.join(placed, "_key")
    rows = rows.withColumn("_one", F.lit(1)).withColumn("_id", F.coalesce("id", F.lit((1 << 63) - 1).cast("long")))
    ranked = ordered_prefix(rows, ["_lo", "_key", "_id"], {"_at": "_one"}, "shard-slots")
    return ranked.select("id", "size", "crc", "shard", (F.col("_at") - F.col("_base")).alias("slot"))
