"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapwise.llm.common import load, text_or_empty

#: (size class, segment, bytes, rows): what the driver sees of the rows of one class in one segment of the ring.
Unit = tuple[int, int, int, int]
#: (upper end in bytes, shard): rows whose running total ends up to there go to the shard.
Share = tuple[int, int]


class Ring:
    """Virtual nodes on the segments of the ring, and the order in which a key meets the shards."""

    def __init__(self, n_shards: int, vnodes: int, seed: str):
        self.bits = (2 * n_shards * vnodes - 1).bit_length()
        taken: dict[int, int] = {}
        for shard in range(n_shards):
            for v in range(vnodes):
                at = int.from_bytes(hashlib.md5(f"{seed}:{shard}:{v}".encode()).digest()[:8], "big") >> (64 - self.bits)
                while taken.setdefault(at, shard) != shard:
                    at = (at + 1) % (1 << self.bits)
        self.n_shards = n_shards
        self.places = sorted(taken)
        self.owners = [taken[p] for p in self.places]
        self._walks: dict[int, list[int]] = {}

    def walk(self, segment: int) -> list[int]:
        """The shards in the order of their first virtual node clockwise from ``segment``."""
        first = bisect_left(self.places, segment) % len(self.places)
        if first not in self._walks:
            self._walks[first] = list(dict.fromkeys(self.owners[first:] + self.owners[:first]))
        return self._walks[first]


def place_units(ring: Ring, units: list[Unit], cap: int) -> dict[tuple[int, int], list[Share]]:
    """How the rows of each (class, segment) are shared out.

    Classes of large rows come first. Within a class each unit fills its own shard up to ``cap``; what doesn't
    fit continues clockwise to the next shard with room. A unit is cut between rows: as the row at a cut
    goes on to the next shard, that one keeps the room of one row free for it. Rows that fit nowhere, as
    no shard has that much room in one piece, go to the least loaded.
    """
    loads, shares = [0] * ring.n_shards, {}
    for kind, members in groupby(sorted(units, key=lambda u: (-u[0], u[1])), key=lambda u: u[0]):
        row, left = 1 << kind, []
        for _, segment, amount, n in members:
            own = ring.walk(segment)[0]
            room = cap - loads[own]
            take = amount if amount <= room else room if n > 1 and room >= row else 0
            shares[kind, segment] = [(take, own)] if take else []
            loads[own] += take
            if take < amount:
                left.append((segment, take, amount, n))
        for segment, low, amount, n in left:
            given = shares[kind, segment]
            for shard in ring.walk(segment)[1:]:
                free = cap - loads[shard] - (row if low else 0)
                take = amount - low if amount - low <= free else free if n > 1 and free >= row else 0
                if take:
                    loads[shard] += take
                    low += take
                    given.append((low, shard))
                if low == amount:
                    break
            while low < amount:
                shard = min(range(ring.n_shards), key=lambda s: (loads[s], s))
                take = amount - low if n == 1 else min(row, amount - low)
                loads[shard] += take
                low += take
                given.append((low, shard))
    return shares


def shard(docs: DataFrame, n_shards: int = 40, *, epsilon: float = 0.0005, vnodes: int = 32, seed: str = "ring-2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: no shard holds more than (1 + epsilon) times the mean but for single rows that fit
    nowhere, so sizes are near equal, and a key leaves its own shard only where that shard is full. One rule
    places every row: rows meet by size class (powers of two) and segment of the ring, the driver shares out
    the sums of these units, and a row's running total within its unit tells its shard. There are at most
    twice to four times n_shards * vnodes segments and 63 classes, so what the driver sees and broadcasts
    doesn't grow with the input. Defined results: a null text counts 16 bytes and has checksum 0; a row is placed
    by its id and checksum, without an id by the checksum alone; equal rows are placed one by one; ids may
    be of any type that can be a string; an empty table gives an empty result; other columns are ignored.
    """
    spark, text, ring = docs.sparkSession, text_or_empty(text_col), Ring(n_shards, vnodes, seed)
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    at = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32")
    slim = slim.withColumns({"at": at, "segment": F.shiftrightunsigned(at, 64 - ring.bits).cast("int"), "kind": F.length(F.bin("size"))})
    units = [tuple(r) for r in slim.groupBy("kind", "segment").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    cap = -(-int(sum(u[2] for u in units) * (1 + epsilon)) // n_shards)
    plan = [(kind, segment, shares) for (kind, segment), shares in place_units(ring, units, cap).items()]
    table = spark.createDataFrame(plan, "p_kind int, p_segment int, shares array<struct<high: bigint, to: int>>")

    order = Window.partitionBy("kind", "segment").orderBy("at", "size", "text_crc32", F.col("doc_id").cast("string"))
    ended = slim.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = ended.join(F.broadcast(table), (F.col("kind") == F.col("p_kind")) & (F.col("segment") == F.col("p_segment")))
    dealt = dealt.withColumn("piece", F.size(F.filter("shares", lambda x: x["high"] < F.col("end"))))
    dealt = dealt.select("doc_id", "size", "text_crc32", "kind", "segment", "piece", F.get("shares", F.col("piece"))["to"].alias("shard"), "end")

    # A shard's pieces follow each other; there are little more of them than units.
    pieces = dealt.groupBy("shard", "kind", "segment", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("kind", "segment", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = pieces.select(F.col("kind").alias("p_kind"), F.col("segment").alias("p_segment"), F.col("piece").alias("p_piece"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    same = (F.col("kind") == F.col("p_kind")) & (F.col("segment") == F.col("p_segment")) & (F.col("piece") == F.col("p_piece"))
    within = Window.partitionBy("kind", "segment", "piece").orderBy("end")
    out = dealt.withColumn("place", F.row_number().over(within)).join(F.broadcast(bases), same)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_bounded_ring(spark, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"))
