"""Shards of near equal bytes: a minimax contiguous partition of ordered groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.common import cut, pick

#: Bits of a group's place in the order (the head of its text's MD5).
BITS = 60
#: The driver holds sums of key ranges, 2 to the power of FIRST at first, never groups; a range is halved STEP times where a cut may fall.
FIRST, STEP = 14, 6


@dataclass
class Range:
    """Groups whose key has `bits` leading bits equal to `head`."""

    bits: int
    head: int
    weight: int
    groups: int

    @property
    def start(self) -> int:
        return self.head << (BITS - self.bits)

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.bits == BITS


def _edges(ranges: list[Range]) -> list[int]:
    out = [0]
    for r in ranges:
        out.append(out[-1] + r.weight)
    return out


def greedy(edges: list[int], ranges: list[Range], capacity: int, shards: int, hopeful: bool) -> list[int] | None:
    """Ends of greedily filled shards, or None if the last one doesn't reach the end.

    Whole ranges are placed. If hopeful, a range of several groups may be cut at any byte, so None then
    proves that no cut between groups works; otherwise a list proves that one does.
    """
    at, ends = 0, []
    for _ in range(shards):
        want = at + capacity
        i = bisect_right(edges, want) - 1
        at = want if hopeful and i < len(ranges) and not ranges[i].atomic else edges[i]
        at = min(at, edges[-1])
        ends.append(at)
    return ends if at >= edges[-1] else None


def smallest(edges: list[int], ranges: list[Range], shards: int, low: int, hopeful: bool) -> int:
    """Binary search for the smallest capacity that greedy() accepts."""
    low, high = max(low, 1), max(edges[-1], 1)
    while low < high:
        mid = (low + high) // 2
        if greedy(edges, ranges, mid, shards, hopeful) is None:
            low = mid + 1
        else:
            high = mid
    return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Keys at which shards 1, 2, ... start, and the capacity. groups: (key long, weight long).

    Ranges of keys are summed and refined only where a greedy cut can fall for a capacity that is still
    possible, until the bounds of the capacity meet; the capacity is then the least for whole groups.
    """

    def summed(df: DataFrame, bits: int) -> list[Range]:
        # a row for each range: 2**FIRST, then 2**STEP for each range that is refined
        rows = df.groupBy(F.shiftrightunsigned("key", BITS - bits).alias("head")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        return [Range(bits, r["head"], r["w"], r["n"]) for r in rows]

    ranges = sorted(summed(groups, FIRST), key=lambda r: r.start)
    while True:
        edges = _edges(ranges)
        least = max([-(-edges[-1] // shards), *(r.weight for r in ranges if r.atomic)], default=0)
        low = smallest(edges, ranges, shards, least, True)
        high = smallest(edges, ranges, shards, low, False)
        first = last = 0
        wanted: set[int] = set()
        for _ in range(shards):
            i = bisect_right(edges, first + low) - 1
            first = edges[min(i, len(ranges))]
            last = min(last + high, edges[-1])
            for j in range(i, min(bisect_right(edges, last), len(ranges))):
                wanted.add(j)
        wanted = {j for j in wanted if not ranges[j].atomic}
        if low == high or not wanted:
            ends = greedy(edges, ranges, high, shards, False)
            starts = [r.start for r in ranges]
            return [starts[i] if (i := bisect_right(edges, e) - 1) < len(starts) else 1 << BITS for e in ends[:-1]], high
        fine = []
        for bits in sorted({ranges[j].bits for j in wanted}):
            heads = [(ranges[j].head,) for j in wanted if ranges[j].bits == bits]
            some = groups.sparkSession.createDataFrame(heads, T.StructType([T.StructField("h", T.LongType())]))
            fine += summed(groups.join(F.broadcast(some), F.shiftrightunsigned("key", BITS - bits) == F.col("h"), "left_semi"), min(BITS, bits + STEP))
        ranges = sorted([r for j, r in enumerate(ranges) if j not in wanted] + fine, key=lambda r: r.start)


def shard_documents(docs: DataFrame, shards: int = 24, overhead: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law `bytes`).

    Equal texts form an atomic group; groups are ordered by the hash of their text. A group of at least the
    mean of the shards that are left takes a shard for itself (it bounds the capacity however the rest is
    placed); the others are cut by minimax_cuts(). Null texts count as empty. slot numbers a shard's rows
    from 0 by (bucket, doc_id); rows that repeat an id get slots of their own. An empty table gives an
    empty result; there may be empty shards if there are fewer groups than shards.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    md5 = F.md5("t")
    base = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text.alias("t")).select(
        "doc_id", (F.octet_length("t") + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.col("t").cast("binary")).alias("text_crc32"), F.conv(F.substring(md5, 1, BITS // 4), 16, 10).cast("long").alias("key")
    )
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total, rows = groups.agg(F.sum("weight"), F.sum("n")).first()
    alone: list[int] = []
    left, total = shards, total or 0
    while left > 1 and total:
        big = groups.filter((F.col("weight") * left >= total) & ~F.col("key").isin(alone or [-1])).orderBy(F.desc("weight")).limit(left - 1).collect()  # at most so many can be that large
        if not big or len(alone) + len(big) >= shards:
            break
        alone += [r["key"] for r in big]
        left, total = left - len(big), total - sum(r["weight"] for r in big)
    cuts, _ = minimax_cuts(groups.filter(~F.col("key").isin(alone or [-1])), left)
    shard: Column = sum(((F.col("key") >= c).cast("int") for c in cuts), F.lit(0))
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(left + i)).otherwise(shard)
    # slots: rows of a shard are dealt to buckets, numbered inside a bucket, and moved by the rows of the buckets before
    buckets = max(64, -(-(rows or 0) // (shards * 50_000)))
    placed = base.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).alias("b"))
    before = placed.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("n")).selectExpr("shard as s2", "b as b2", "sum(n) over (partition by shard order by b) - n as before")
    local = placed.selectExpr("*", "row_number() over (partition by shard, b order by doc_id, size, text_crc32) - 1 as i")
    return local.join(F.broadcast(before) if buckets <= 10_000 else before, (F.col("shard") == F.col("s2")) & (F.col("b") == F.col("b2"))).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
