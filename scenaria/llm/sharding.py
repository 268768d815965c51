"""Sharding through fixed virtual slots.

Records hash into thousands of virtual slots by key; a small versioned table maps slots to shards.
Rebalancing edits that table: ``grow_map`` gives a new shard its part of every old shard's slots,
``balance_map`` moves slots from heavy to light shards by their measured bytes. Records never rehash.

Defined results: a null key counts as the empty text; a null text has size 1 (no bytes, plus 1);
repeated rows are placed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import utf8

N_SLOTS = 4096
#: A slot's rows are numbered in so many parts, so that a hot key's rows are shared out by their text.
RANK_PARTS = 16


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_slots).cast("int")


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Key, size, text checksum and virtual slot of each record; texts go no further."""
    return docs.select(
        "doc_id",
        (F.octet_length(utf8(F.col("text"))) + F.lit(1)).cast("long").alias("size"),
        F.crc32(utf8(F.col("text"))).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), n_slots).alias("virtual_slot"),
    ).withColumn("part", (F.col("text_crc32") % RANK_PARTS).cast("int"))


def slot_sizes(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each (slot, part): at most n_slots * RANK_PARTS rows, combined map-side."""
    return recs.groupBy("virtual_slot", "part").agg(
        F.count(F.lit(1)).alias("part_rows"), F.sum("size").alias("part_bytes")
    )


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Slots dealt round-robin: slot counts of the shards are at most one apart."""
    return spark.range(n_slots).select(
        F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % n_shards).cast("int").alias("shard")
    )


def grow_map(slot_map: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The map for one more shard: every old shard keeps its even part, the rest goes to the new shard."""
    keep, extra = divmod(n_slots, n_shards + 1)
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("virtual_slot"))
    keeps = F.lit(keep) + (F.col("shard") < extra).cast("int")
    return slot_map.select(
        "virtual_slot", F.when(rank <= keeps, F.col("shard")).otherwise(F.lit(n_shards)).cast("int").alias("shard")
    )


def balance_map(slot_map: DataFrame, sizes: DataFrame, n_shards: int) -> DataFrame:
    """The map after moving slots from shards above the mean bytes into the room that others have.

    Shards keep their largest slots up to the mean; the others, laid end to end, fall into the shards'
    free room laid end to end. All tables here have n_slots or n_shards rows.
    """
    load = slot_map.join(
        sizes.groupBy("virtual_slot").agg(F.sum("part_bytes").alias("bytes")), "virtual_slot", "left"
    ).fillna(0, ["bytes"])
    mean = load.agg((F.sum("bytes") / n_shards).alias("mean"))
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    load = load.crossJoin(F.broadcast(mean)).withColumn("upto", F.sum("bytes").over(by_size))
    load = load.withColumn("stays", F.col("upto") <= F.col("mean"))
    shards = load.groupBy("shard", "mean").agg(F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("held"))
    room = shards.withColumn("room", F.greatest(F.col("mean") - F.col("held"), F.lit(0.0)))
    room = room.withColumn("room_to", F.sum("room").over(Window.orderBy("shard")))
    room = room.select(F.col("shard").alias("to_shard"), (F.col("room_to") - F.col("room")).alias("room_from"), "room_to")
    moved = load.filter(~F.col("stays")).withColumn(
        "middle", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "virtual_slot")) - F.col("bytes") / 2
    )
    moved = moved.join(
        F.broadcast(room), (F.col("middle") >= F.col("room_from")) & (F.col("middle") < F.col("room_to")), "left"
    )
    return moved.select("virtual_slot", F.coalesce("to_shard", "shard").alias("shard")).unionByName(
        load.filter("stays").select("virtual_slot", "shard")
    )


class MapStore:
    """Versions of a slot-to-shard map in a shared folder; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, slot_map: DataFrame, version: int) -> DataFrame:
        slot_map.coalesce(1).write.parquet(f"{self.root}/version-{version:06d}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version-{version:06d}")


def assign(recs: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds each record's shard and its gapless place in the shard.

    ``slot_map`` has virtual_slot, shard and any columns to carry along; places run through a shard's
    slots in order. No window holds more than one part of one slot; offsets come from the size table
    (at most n_slots * RANK_PARTS rows, which bounds the broadcast).
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part")
    starts = sizes.join(F.broadcast(slot_map), "virtual_slot").withColumn(
        "start", F.sum("part_rows").over(before) - F.col("part_rows")
    )
    within = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        recs.withColumn("rank", F.row_number().over(within))
        .join(F.broadcast(starts.drop("part_rows", "part_bytes")), ["virtual_slot", "part"])
        .withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))
        .drop("start", "rank", "part")
    )
