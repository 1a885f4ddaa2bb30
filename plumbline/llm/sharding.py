"""Sharding over fixed virtual slots.

Every record is hashed into one of `SLOTS` slots, whatever the number of shards. Bytes and rows
are summed per slot, and a slot-to-shard map is made from those sums: the slots in order of size
go, one after the other, to the shard that has least. Rows never move on their own, only slots
do, by an edit of the map that makes a new version of it. The law that holds is `bytes`.

Only the slot sums reach the driver: `SLOTS` rows at most, at any size of the table.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Virtual slots; fixed for the life of a data set. Thousands, so that one slot is a small part of a shard.
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """A version of the map: `shard_of[slot]`, and the slots' bytes and rows it was made from."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for shard, size in zip(self.shard_of, self.bytes_of, strict=True):
            out[shard] += size
        return out

    def uneven(self, bytes_of: list[int], slack: float = 0.02) -> bool:
        """Whether a shard holds over (1 + slack) times the mean by these slot sums."""
        return max(replace(self, bytes_of=tuple(bytes_of)).loads()) * self.shards > (1 + slack) * sum(bytes_of)

    def rebalanced(self, bytes_of: list[int], rows_of: list[int], shards: int | None = None, slack: float = 0.02) -> SlotMap:
        """The next version for new slot sums or another number of shards: slots leave a shard only
        while it holds over (1 + slack) times the mean or no longer exists, largest first.
        """
        shards = shards or self.shards
        loads, homes = [0] * shards, list(self.shard_of)
        most = (1 + slack) * sum(bytes_of) / shards
        free = []
        for slot in sorted(range(len(homes)), key=lambda s: (-bytes_of[s], s)):
            home = homes[slot]
            if home < shards and loads[home] + bytes_of[slot] <= most:
                loads[home] += bytes_of[slot]
            else:
                free.append(slot)
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        for slot in free:
            load, homes[slot] = heap[0]
            heapq.heapreplace(heap, (load + bytes_of[slot], homes[slot]))
        return replace(self, version=self.version + 1, shards=shards, shard_of=tuple(homes), bytes_of=tuple(bytes_of), rows_of=tuple(rows_of))

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the versions kept under `path`; one that is there already stays as it is."""
        if self.version in SlotMap.versions(spark, path):
            return
        rows = [(self.version, self.shards, s, *x) for s, x in enumerate(zip(self.shard_of, self.bytes_of, self.rows_of, strict=True))]
        spark.createDataFrame(rows, "version int, shards int, slot int, shard int, bytes long, rows long").coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions kept under `path`: none if nothing is there."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return []
        return sorted(r[0] for r in spark.read.parquet(path).select("version").distinct().collect())

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A version kept under `path`; the newest, if none is named."""
        kept = spark.read.parquet(path)
        version = version if version is not None else kept.agg(F.max("version")).first()[0]
        rows = sorted(kept.where(F.col("version") == version).collect(), key=lambda r: r["slot"])
        return SlotMap(version, rows[0]["shards"], *(tuple(r[c] for r in rows) for c in ("shard", "bytes", "rows")))


def first_map(bytes_of: list[int], rows_of: list[int], shards: int) -> SlotMap:
    """Version 1: largest slot first, each to the shard with the least bytes."""
    homes = [slot % shards for slot in range(len(bytes_of))]  # empty slots stay dealt in turn
    heap = [(0, shard) for shard in range(shards)]
    for slot in sorted(filter(bytes_of.__getitem__, range(len(homes))), key=lambda s: (-bytes_of[s], s)):
        load, homes[slot] = heap[0]
        heapq.heapreplace(heap, (load + bytes_of[slot], homes[slot]))
    return SlotMap(1, shards, tuple(homes), tuple(bytes_of), tuple(rows_of))


def _measured(docs: DataFrame, slots: int) -> DataFrame:
    text = F.col("text").cast("string")
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    # the checksum takes part, so that rows of one repeated or missing id still spread
    return slim.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int"))


def slot_sums(docs: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """(bytes, rows) of every slot."""
    sums = _measured(docs, slots).groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    bytes_of, rows_of = [0] * slots, [0] * slots
    for r in sums:
        bytes_of[r["vslot"]], rows_of[r["vslot"]] = r["b"], r["n"]
    return bytes_of, rows_of


def shard(docs: DataFrame, shards: int, slot_map: SlotMap | None = None, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot,
    grown_shard, vslot, map_version.

    size: the text's UTF-8 bytes (null: none) plus 16; text_crc32: unsigned, of the text's UTF-8
    (null as empty: 0). shard: where the map puts the row's virtual slot `vslot`. slot: the row's
    place in its shard, 0, 1, 2 and on without a gap, by virtual slot, doc_id (null first) and
    checksum; equal rows take their places in any order. Under the law `bytes` grown_shard is null.
    A map given in `slot_map` is used as it is. Else the newest version kept under `map_path` is: it
    is rebalanced for this table's slot sums, which makes the next version, if a shard has grown too
    large by them or their number has changed. Where there is none, version 1 is made. The map that was used
    is kept under `map_path`. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bytes_of, rows_of = slot_sums(docs, slots)
    if not slot_map and map_path and SlotMap.versions(spark, map_path):
        slot_map = SlotMap.load(spark, map_path)
        if slot_map.shards != shards or slot_map.uneven(bytes_of):
            slot_map = slot_map.rebalanced(bytes_of, rows_of, shards)
    slot_map = slot_map or first_map(bytes_of, rows_of, shards)
    if map_path:
        slot_map.save(spark, map_path)
    places, filled = [], [0] * slot_map.shards
    for vslot, home in enumerate(slot_map.shard_of):
        places.append((vslot, home, filled[home]))
        filled[home] += rows_of[vslot]
    order = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    ranked = _measured(docs, slots).withColumn("_rank", F.row_number().over(order))
    placed = ranked.join(F.broadcast(spark.createDataFrame(places, "vslot int, shard int, _before long")), "vslot")  # `slots` rows
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_before") + F.col("_rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.lit(slot_map.version).alias("map_version"),
    )
