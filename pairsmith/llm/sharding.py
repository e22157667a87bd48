"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots; bytes and rows are aggregated per slot; a versioned map says which shard
owns each slot. Adding a shard edits the map: the new shard takes slots from the others, nothing else moves.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsmith.llm.base import cut, kept, table
from pairsmith.operators.values import shared_folder

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Version and owner of each slot. Version 1 has one shard; each edit makes the next version."""

    owners: tuple[int, ...]
    shards: int = 1
    version: int = 1

    @staticmethod
    def of(shards: int, slots: int = SLOTS) -> SlotMap:
        """The map after growing from one shard to this many: the number of shards alone decides it."""
        m = SlotMap((0,) * slots)
        while m.shards < shards:
            m = m.grown()
        return m

    def grown(self) -> SlotMap:
        """One more shard, which takes its share of slots from the shards that own most (the smallest shard first
        among equals, and from each its highest slots); all other slots stay."""
        owned: dict[int, list[int]] = {s: [] for s in range(self.shards)}
        for slot, s in enumerate(self.owners):
            owned[s].append(slot)
        owners = list(self.owners)
        for _ in range(len(owners) // (self.shards + 1)):
            s = max(owned, key=lambda s: (len(owned[s]), -s))
            owners[owned[s].pop()] = self.shards
        return SlotMap(tuple(owners), self.shards + 1, self.version + 1)

    def moved(self, slot: int, shard: int) -> SlotMap:
        """An edit by hand: one slot goes to another shard."""
        owners = list(self.owners)
        owners[slot] = shard
        return SlotMap(tuple(owners), max(self.shards, shard + 1), self.version + 1)

    def rebalanced(self, slot_bytes: dict[int, int]) -> SlotMap:
        """Slots go from the heaviest shard to the lightest while that narrows the gap between them."""
        load = [0] * self.shards
        for slot, s in enumerate(self.owners):
            load[s] += slot_bytes.get(slot, 0)
        owners, edited = list(self.owners), False
        while self.shards > 1:
            high, low = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            fits = [(slot_bytes.get(i, 0), i) for i, s in enumerate(owners) if s == high and 0 < 2 * slot_bytes.get(i, 0) <= load[high] - load[low]]
            if not fits:
                break
            size, slot = max(fits)
            owners[slot], edited = low, True
            load[high] -= size
            load[low] += size
        return SlotMap(tuple(owners), self.shards, self.version + 1) if edited else self

    def table(self, spark: SparkSession) -> DataFrame:
        """virtual_slot, shard and grown_shard (under the map with one more shard): a row a slot."""
        rows = list(zip(range(len(self.owners)), self.owners, self.grown().owners, strict=True))
        return spark.createDataFrame(rows, "virtual_slot int, shard int, grown_shard int").coalesce(1)


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of an integer key by multiplicative hashing (2654435761 = 2^32 / golden ratio); null has slot 0."""
    low = F.pmod(F.coalesce(key.cast("long"), F.lit(0)), F.lit(1 << 31))
    mixed = F.pmod(low * F.lit(2654435761), F.lit(1 << 32))
    return F.floor(mixed * F.lit(slots) / F.lit(1 << 32)).cast("int")


def slot_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """slot, rows and bytes (UTF-8 bytes of the text plus 8 a row) of each slot in use; at most ``slots`` rows."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    return df.select(slot_of(F.col(key), slots).alias("slot"), size.alias("size")).groupBy("slot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def write_slots(df: DataFrame, slot_map: SlotMap, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes the slot table of df under a map: slot, rows, bytes, shard, shards and version of every slot, used or not."""
    slots = df.sparkSession.range(0, len(slot_map.owners), 1, 1).select(F.col("id").cast("int").alias("slot"))
    used = slot_bytes(df, key, text, len(slot_map.owners))
    owners = slot_map.table(df.sparkSession).select(F.col("virtual_slot").alias("slot"), "shard")
    out = slots.join(F.broadcast(owners), "slot").join(F.broadcast(used), "slot", "left").fillna(0, ["rows", "bytes"]).select("slot", "rows", "bytes", "shard")
    out.withColumns({"shards": F.lit(slot_map.shards), "version": F.lit(slot_map.version)}).coalesce(1).write.parquet(path)


def read_slots(spark: SparkSession, path: str) -> tuple[SlotMap, dict[int, int]]:
    """The map of a slot table, and the bytes of each slot, as ``rebalanced`` takes them."""
    rows = spark.read.parquet(path).orderBy("slot").collect()
    return SlotMap(tuple(x.shard for x in rows), rows[0].shards, rows[0].version), {x.slot: x.bytes for x in rows}


#: Equal rows that one task numbers; more are dealt over several.
EQUAL = 100_000


def assign(df: DataFrame, slot_map: SlotMap, key: str = "doc_id", text: str = "text", spread: int = 16) -> DataFrame:
    """key, size, text_crc32, virtual_slot, shard, slot (the row's place in its shard: 0, 1, ... without gaps),
    map_version and grown_shard (under the map with one more shard).

    Null keys have slot 0 of the virtual slots; null text has size 8 and the checksum of the empty text; an empty table
    gives an empty one. Rows with one key share a shard. Places follow the virtual slot, the checksum modulo ``spread``,
    the key (null first), the checksum and the size, so any rerun gives the same ones. Equal rows are counted before they
    are shuffled and numbered as one; places are numbered within cells, a cell being a virtual slot and a remainder of the
    checksum, and offset by prefix sums over the counts of cells (at most slots * spread rows, broadcast with the map's
    slots). So neither a hot key nor repeated rows meet in one task. Texts are read once and never shuffled."""
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("_key"), (F.octet_length(raw).cast("long") + 8).alias("size"), F.crc32(F.encode(raw, "UTF-8")).cast("long").alias("text_crc32"))
    same = rows.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("n"))
    same = cut(same.withColumns({"virtual_slot": slot_of(F.col("_key"), len(slot_map.owners)), "_cell": F.pmod("text_crc32", F.lit(spread)).cast("int")}))
    cells = same.groupBy("virtual_slot", "_cell").agg(F.sum("n").alias("n")).join(F.broadcast(slot_map.table(df.sparkSession)), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("virtual_slot", "_cell", "shard", "grown_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("virtual_slot", "_cell").orderBy("_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("_at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), ["virtual_slot", "_cell"])
    placed = placed.withColumn("slot", F.col("_from") + F.col("_at"))
    few, many = placed.where(F.col("n") <= EQUAL), placed.where(F.col("n") > EQUAL)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(EQUAL).cast("long")))
    many = many.withColumn("_b", block).withColumns({"slot": F.col("slot") + F.col("_b"), "n": F.least(F.col("n") - F.col("_b"), F.lit(EQUAL))}).drop("_b").repartition("shard", "slot")
    every = few.unionByName(many).withColumn("slot", F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)))
    return every.select(F.col("_key").alias(key), "size", "text_crc32", "virtual_slot", "shard", "slot", F.lit(slot_map.version).alias("map_version"), "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law key: the map of 24 shards, stored with bytes and rows of its slots and read back, without rebalancing."""
    docs, path = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/slots-{uuid.uuid4().hex}"
    kept(spark, path)
    write_slots(docs, SlotMap.of(24), path)
    out = assign(docs, read_slots(spark, path)[0])
    return out.withColumn("law", F.lit("key"))


_MAP = SlotMap.of(24)
_HEX = "strpos('123456789ABCDEF', {0})"
QUERIES = {"op5_sharding": op5_sharding}
ORACLE_SQL = {
    "op5_sharding": f"""
WITH m(virtual_slot, shard, grown_shard) AS (VALUES {", ".join(map(str, zip(range(SLOTS), _MAP.owners, _MAP.grown().owners, strict=True)))}),
steps AS (SELECT list(t ORDER BY b) AS steps FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c // 2, (c % 2) * 3988292384)) AS t FROM range(256) r(b))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, string_split(hex(encode(coalesce(text, ''))), '') AS h FROM documents),
e AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * size - 16, 2), lambda i: CAST(16 * {_HEX.format('h[i]')} + {_HEX.format('h[i + 1]')} AS BIGINT))),
  lambda c, b: xor(c // 256, steps[CAST(xor(c % 256, b) + 1 AS INTEGER)])), 4294967295) AS text_crc32 FROM d, steps),
f AS (SELECT doc_id, size, text_crc32, CAST(floor(((((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648) * 2654435761) % 4294967296) * {SLOTS} / 4294967296.0) AS INTEGER) AS virtual_slot FROM e)
SELECT doc_id, size, text_crc32, virtual_slot, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, text_crc32 % 16, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, {_MAP.version} AS map_version, grown_shard, 'key' AS law
FROM f JOIN m USING (virtual_slot)"""
}
