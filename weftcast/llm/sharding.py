"""Sharding by fixed virtual slots.

Rows are hashed by text into ``SLOTS`` slots; bytes are added up per slot, and a versioned
map says which shard a slot belongs to. The map is a table in the shared folder: a version
is written once, readers take the newest, and rebalancing writes the next version with as
few slots moved as it takes. The law is ``bytes``: shards of nearly equal size.

Equal texts share a slot and so a shard. A text whose copies outweigh a fair share of a shard
can't: its rows are taken out of their slot, by the text alone, and dealt over ``PARTS`` units
by doc_id that the map places one by one; whatever else hashes to that slot stays together.
There are fewer such texts than shards. Rows are numbered within slot and part, so a text
that a third of all rows share is dealt over its parts wherever rows are sorted.

Null counts as empty; every row has a size of one byte at least. Very long texts count with
all their bytes; one that outweighs a fair share makes its shard as large as it is. Rows that
repeat are rows of their own; a null doc_id sorts first. Columns besides doc_id and text
aren't read. All of it is DataFrame code; the driver sees SLOTS x PARTS sums and those of fewer
heavy texts than shards, whatever the data.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, session_dir, stored

SLOTS, PARTS = 2048, 32
#: What tells a text from others here: 64 and 32 bits of two hashes, and its size.
TEXT = ("text_hash", "text_crc32", "size")


@dataclass(frozen=True)
class SlotMap:
    """Shard of each unit; a unit is a slot (slot, -1, -1) or a part of a heavy text in it (slot, hash of the text, part)."""

    version: int
    shards: int
    placed: dict[tuple[int, int, int], int]


def write_map(spark: SparkSession, path: str, slot_map: SlotMap) -> None:
    """Adds a version to the maps under ``path``; one that is there already is never overwritten, that is an error."""
    rows = [(slot_map.shards, *unit, shard) for unit, shard in slot_map.placed.items()]
    spark.createDataFrame(rows, "shards int, slot int, text long, part int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/version={slot_map.version}")


def latest_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The newest version under ``path``; SLOTS rows and those of a few heavy texts."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    versions = [int(f.getPath().getName().removeprefix("version=")) for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    if not versions:
        return None
    rows = spark.read.parquet(f"{path}/version={max(versions)}").collect()
    return SlotMap(max(versions), rows[0]["shards"] if rows else 0, {(r["slot"], r["text"], r["part"]): r["shard"] for r in rows})


def balanced(sizes: dict[tuple[int, int, int], int], shards: int) -> SlotMap:
    """A first map: the heaviest unit goes to the lightest shard, and so on."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for unit, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return SlotMap(1, shards, placed)


def rebalanced(old: SlotMap, sizes: dict[tuple[int, int, int], int], shards: int, slack: float = 0.02) -> SlotMap:
    """The next version: units stay where they are, but for those that move from shards over (1 + slack) times the mean, or that no longer exist, to the lightest ones; units not yet placed go there too."""
    mean = sum(sizes.values()) / shards
    placed = {u: s for u, s in old.placed.items() if u in sizes and s < shards}
    loads = [0] * shards
    for u, s in placed.items():
        loads[s] += sizes[u]
    loose = [u for u in sizes if u not in placed]
    for shard in range(shards):
        if loads[shard] <= mean * (1 + slack):
            continue
        for u in sorted((u for u, s in placed.items() if s == shard), key=lambda u: (-sizes[u], u)):
            if loads[shard] - sizes[u] >= mean * (1 - slack / 2):
                loads[shard] -= sizes[u]
                loose.append(u)
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    for u in sorted(loose, key=lambda u: (-sizes[u], u)):
        load, shard = heapq.heappop(heap)
        placed[u] = shard
        heapq.heappush(heap, (load + sizes[u], shard))
    return replace(old, version=old.version + 1, shards=shards, placed=placed)


def slotted(docs: DataFrame) -> DataFrame:
    """doc_id, size, the hashes of the text, and the slot and part of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs_of(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(PARTS)).cast("int").alias("part"))
    return stored(rows.withColumn("vslot", F.pmod("text_hash", F.lit(SLOTS)).cast("int")), "slotted")


def heavy_texts(rows: DataFrame, shards: int) -> list[tuple[int, int, int]]:
    """The texts whose copies outweigh a fair share, found in the slots that do: fewer than ``shards``."""
    slots = {r["vslot"]: r["bytes"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}
    fair = sum(slots.values()) / shards
    heavy = [s for s, n in slots.items() if n > fair]
    if not heavy:
        return []
    texts = rows.where(F.col("vslot").isin(heavy)).groupBy(*TEXT).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where((F.col("bytes") > fair) & (F.col("n") > 1))
    return sorted(tuple(r[c] for c in TEXT) for r in texts.collect())


def with_units(rows: DataFrame, heavy: list[tuple[int, int, int]]) -> DataFrame:
    """``slotted`` rows with ``heavy``, the hash of the text if that is a heavy one, else -1."""
    is_heavy = F.lit(False)
    for values in heavy:
        same = F.lit(True)
        for c, v in zip(TEXT, values):
            same = same & (F.col(c) == v)
        is_heavy = is_heavy | same
    return rows.withColumn("heavy", F.when(is_heavy, F.col("text_hash")).otherwise(F.lit(-1).cast("long")))


def cell_sums(rows: DataFrame) -> dict[tuple[int, int, int], tuple[int, int]]:
    """Bytes and rows of each slot, heavy text and part."""
    return {(r["vslot"], r["heavy"], r["part"]): (r["size"], r["n"]) for r in rows.groupBy("vslot", "heavy", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}


def unit_of(cell: tuple[int, int, int]) -> tuple[int, int, int]:
    """The unit that a cell is placed with: its slot, or the part of a heavy text that it is."""
    slot, heavy, _ = cell
    return (slot, -1, -1) if heavy == -1 else cell


def units(cells: dict[tuple[int, int, int], tuple[int, int]]) -> dict[tuple[int, int, int], int]:
    """Bytes of each unit."""
    out: dict[tuple[int, int, int], int] = {}
    for cell, (size, _) in cells.items():
        out[unit_of(cell)] = out.get(unit_of(cell), 0) + size
    return out


def sharded(rows: DataFrame, cells: dict[tuple[int, int, int], tuple[int, int]], slot_map: SlotMap, next_map: SlotMap) -> DataFrame:
    """Rows of ``with_units`` with their shard, their place in it, gapless from 0, and whether the next map moves them."""
    starts, at = [], [0] * slot_map.shards
    for cell, (_, n) in sorted(cells.items()):
        unit = unit_of(cell)
        shard = slot_map.placed[unit]
        starts.append((*cell, shard, at[shard], next_map.placed[unit] != shard))
        at[shard] += n
    table = rows.sparkSession.createDataFrame(starts, "vslot int, heavy long, part int, shard int, before long, moves boolean")  # (SLOTS + heavy texts) x PARTS rows at most
    within = Window.partitionBy("vslot", "heavy", "part").orderBy("doc_id", "text_crc32", "size", "text_hash")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(table), ["vslot", "heavy", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).alias("slot"), "moves")


def shard_assignment(docs: DataFrame, shards: int = 16, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, map_version, moves of every row. ``maps`` is the folder of the versioned map: where it has one, that map is edited, else the first is made; by default a new folder of this session. ``moves`` tells which rows the edit for one more shard would take elsewhere; it is written when that many shards are asked for."""
    spark = docs.sparkSession
    maps = maps or f"{session_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = slotted(docs)
    rows = with_units(rows, heavy_texts(rows, shards))
    cells = cell_sums(rows)
    sizes = units(cells)
    old = latest_map(spark, maps)
    now = balanced(sizes, shards) if old is None else rebalanced(old, sizes, shards)
    if old is None or now.placed != old.placed or now.shards != old.shards:
        write_map(spark, maps, now)
    else:
        now = old
    now = latest_map(spark, maps)
    grown = rebalanced(now, sizes, shards + 1)
    out = sharded(rows, cells, now, grown)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.lit(now.version).alias("map_version"), "moves")
