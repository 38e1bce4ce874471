"""Sharding over fixed virtual slots.

Every record is hashed into one of ``n_slots`` virtual slots, which never change. The bytes of each slot
are aggregated, and a versioned map says which shard holds a slot. Rebalancing edits the map: it moves
whole slots and leaves all others where they are. Only DataFrame functions run on the executors.

Law: ``bytes``. Shards differ by about one slot's bytes, or by one record where a record is larger. The
slot of a row is a hash of its id, text checksum and number among equal rows, so neither a group of equal
texts nor a row that is repeated without end overloads a shard: both are spread over the slots.

Nulls: a null text has 0 bytes and counts 1, a null id is hashed as null. Repeated rows get slots and
positions of their own. Of a very long text only its size and checksum travel. An empty table gives an
empty result. Other columns are ignored, whatever their names.

A stored map is a table of ``n_slots`` rows for each version; ``load_map`` raises where there is none.
``rebalance`` reads two lists of that length and no records.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.common import materialise, numbered_copies, shared_dir

N_SLOTS = 4096
MAP_SCHEMA = "version int, n_shards int, virtual_slot int, shard int, first long, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map; ``shard_of[v]`` is the shard of virtual slot v."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for s, b in zip(self.shard_of, self.bytes_of, strict=True):
            out[s] += b
        return out

    def rows(self) -> list[tuple]:
        """Rows of MAP_SCHEMA; ``first`` is the number of rows in the shard's slots before this one."""
        seen, out = [0] * self.n_shards, []
        for v, (s, b, n) in enumerate(zip(self.shard_of, self.bytes_of, self.rows_of, strict=True)):
            out.append((self.version, self.n_shards, v, s, seen[s], b, n))
            seen[s] += n
        return out

    def save(self, spark: SparkSession, path: str) -> DataFrame:
        """Write this version beside the others; no version is ever overwritten."""
        at = f"{path}/version={self.version}"
        spark.createDataFrame(self.rows(), MAP_SCHEMA).drop("version").coalesce(1).write.parquet(at)
        return spark.read.parquet(at)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version of the map, the latest unless said."""
    found = spark.read.parquet(path)
    if version is None:
        version = found.agg(F.max("version")).first()[0]
    rows = sorted(found.filter(F.col("version") == version).select("virtual_slot", "shard", "bytes", "rows", "n_shards").collect())
    return SlotMap(version, rows[0][4], *(tuple(r[i] for r in rows) for i in (1, 2, 3)))


def first_map(bytes_of: list[int], rows_of: list[int], n_shards: int) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes."""
    heap, shard_of = [(0, s) for s in range(n_shards)], [0] * len(bytes_of)
    for v in sorted(range(len(bytes_of)), key=lambda v: (-bytes_of[v], v)):
        load, s = heapq.heappop(heap)
        shard_of[v] = s
        heapq.heappush(heap, (load + bytes_of[v], s))
    return SlotMap(1, n_shards, tuple(shard_of), tuple(bytes_of), tuple(rows_of))


def rebalance(old: SlotMap, n_shards: int, bytes_of: list[int] | None = None, rows_of: list[int] | None = None) -> SlotMap:
    """The next version for ``n_shards`` shards: moves the slots of removed shards, then slots from the
    fullest to the emptiest shard while that narrows their difference."""
    sizes = list(bytes_of or old.bytes_of)
    shard_of = list(old.shard_of)
    loads, held = [0] * n_shards, [set() for _ in range(n_shards)]
    for v, s in enumerate(shard_of):
        if s < n_shards:
            loads[s] += sizes[v]
            held[s].add(v)

    def put(v: int, s: int) -> None:
        shard_of[v] = s
        loads[s] += sizes[v]
        held[s].add(v)

    for v in sorted((v for v, s in enumerate(shard_of) if s >= n_shards), key=lambda v: (-sizes[v], v)):
        put(v, min(range(n_shards), key=lambda s: (loads[s], s)))
    largest = max(sizes, default=0)  # shards that differ by a slot are even
    for _ in range(len(sizes)):
        high = max(range(n_shards), key=lambda s: (loads[s], -s))
        low = min(range(n_shards), key=lambda s: (loads[s], s))
        gap = loads[high] - loads[low]
        movable = [v for v in held[high] if 0 < sizes[v] < gap]
        if not movable or gap <= largest:
            break
        v = min(movable, key=lambda v: (abs(2 * sizes[v] - gap), v))
        if max(loads[high] - sizes[v], loads[low] + sizes[v]) >= loads[high]:
            break
        held[high].discard(v)
        loads[high] -= sizes[v]
        put(v, low)
    return SlotMap(old.version + 1, n_shards, tuple(shard_of), tuple(sizes), tuple(rows_of or old.rows_of))


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, number among equal rows, virtual_slot): the records without their texts, as a table."""
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "alike"), F.lit(n_slots)).cast("int")
    return materialise(numbered_copies(rows, "alike").withColumn("virtual_slot", slot), "slotted")


def measure(records: DataFrame, n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each virtual slot: at most ``n_slots`` rows come to the driver."""
    sizes, counts = [0] * n_slots, [0] * n_slots
    for v, b, n in records.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        sizes[v], counts[v] = b, n
    return sizes, counts


def place(records: DataFrame, slot_map: SlotMap, path: str) -> DataFrame:
    """Add shard and slot, the gapless position in the shard: rows are numbered within their virtual slot
    and the map holds how many come before, so no task sorts a shard. The map has ``n_slots`` rows."""
    stored = slot_map.save(records.sparkSession, path).select("virtual_slot", "shard", "first")
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "alike"))
    return records.withColumn("_n", number).join(F.broadcast(stored), "virtual_slot").withColumn("slot", (F.col("first") + F.col("_n") - 1).cast("long")).drop("_n", "first", "alike")


def shard(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) of all rows under the first version of the map."""
    records = slotted(df, id_col, text_col, n_slots)
    path = map_path or f"{shared_dir(df.sparkSession)}/siltstone/{uuid.uuid4().hex}/slot_map"
    return place(records, first_map(*measure(records, n_slots), n_shards), path)
