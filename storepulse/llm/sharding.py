"""Sharding through fixed virtual slots.

Every record hashes by identifier into one of ``SLOTS`` virtual slots, which never
change.  A small versioned table maps slots to shards: version 1 deals the slots out in
turn, and each rebalancing writes the next version, edited by moving or swapping slots
until the shards' bytes are nearly equal.  Only the bytes and rows of each slot (at most
``SLOTS`` rows) reach the driver, whatever the size of the table.

Nulls: a null text has no bytes, a null identifier hashes like any value.  Repeated rows
each get a place of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storepulse.llm.common import scratch_path, text_or_empty, written

SLOTS = 16384
#: Bytes that a record takes besides its text.
RECORD_BYTES = 8
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Identifier, size, checksum and virtual slot of each record."""
    text = text_or_empty(text_col)
    return df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit("slot")), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 1: slots dealt out in turn."""
    return np.arange(slots, dtype=np.int64) % shards


def rebalanced(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map after edits that even out the load.

    The heaviest and the lightest shard exchange: one slot moves, or two are swapped,
    whichever brings the pair closest to its mean; it ends when no exchange of the
    heaviest shard with any lighter one helps.
    """
    shard_of, load = shard_of.copy(), load.astype(np.int64)
    total = np.bincount(shard_of, weights=load, minlength=shards).astype(np.int64)
    while True:
        heavy = int(total.argmax())
        for light in np.argsort(total, kind="stable"):
            gap = int(total[heavy] - total[light])
            if gap <= 1:
                continue
            ours = np.flatnonzero((shard_of == heavy) & (load > 0))
            theirs = np.flatnonzero((shard_of == light) & (load > 0))
            theirs = theirs[np.argsort(load[theirs], kind="stable")]
            back = np.concatenate([[0], load[theirs]])  # 0: nothing comes back
            want = load[ours] - gap / 2
            at = np.searchsorted(back, want)
            best = None
            for near in (np.clip(at - 1, 0, len(back) - 1), np.clip(at, 0, len(back) - 1)):
                moved = load[ours] - back[near]
                off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
                if len(off) and np.isfinite(off.min()) and (best is None or off.min() < best[0]):
                    k = int(off.argmin())
                    best = (off[k], ours[k], theirs[near[k] - 1] if near[k] else None, int(moved[k]))
            if best:
                _, out, into, moved = best
                shard_of[out] = light
                if into is not None:
                    shard_of[into] = heavy
                total[heavy] -= moved
                total[light] += moved
                break
        else:
            return shard_of


def grown(shard_of: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map for one more shard, which only receives: slots move out of the heaviest
    shards until the new one has its share."""
    shard_of, total = shard_of.copy(), np.bincount(shard_of, weights=load, minlength=shards + 1)
    share = load.sum() / (shards + 1)
    while True:
        heavy = int(total[:shards].argmax())
        ours = np.flatnonzero((shard_of == heavy) & (load > 0) & (load <= share - total[shards]))
        if not len(ours):
            return shard_of
        out = ours[load[ours].argmax()]
        shard_of[out] = shards
        total[heavy] -= load[out]
        total[shards] += load[out]


def save_version(spark: SparkSession, path: str, version: int, shard_of: np.ndarray) -> None:
    """Add a version to the stored slot map; earlier ones stay."""
    rows = [(version, slot, int(shard)) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_version(spark: SparkSession, path: str, version: int | None = None) -> np.ndarray:
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows: Iterable = stored.where(F.col("version") == version).orderBy("virtual_slot").collect()
    return np.array([r["shard"] for r in rows], dtype=np.int64)


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                   map_path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """Each record's shard, and its place in it (``slot``, gapless from 0 in each shard).

    The map at ``map_path`` (a new one in the shared folder by default) gets version 1 if
    it has none, then a rebalanced version, which is the one that holds.
    """
    spark = df.sparkSession
    rows = written(records(df, id_col, text_col, slots), "records")
    loads = slot_loads(rows).collect()  # at most `slots` rows
    load, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in loads:
        load[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    if map_path is None:
        map_path = scratch_path(spark, "slot_map")
        save_version(spark, map_path, 1, first_map(shards, slots))
    current = load_version(spark, map_path)
    held = spark.read.schema(MAP_SCHEMA).parquet(map_path).agg(F.max("version")).first()[0]
    shard_of = rebalanced(current, load, shards)
    if (shard_of != current).any():
        save_version(spark, map_path, held + 1, shard_of)

    # where each slot's rows begin in their shard
    begin = np.zeros(slots, np.int64)
    for shard in range(shards):
        mine = np.flatnonzero(shard_of == shard)
        begin[mine] = np.cumsum(count[mine]) - count[mine]
    table = spark.createDataFrame(
        [(s, int(shard_of[s]), int(begin[s])) for s in range(slots) if count[s]],
        "virtual_slot int, shard int, begin long")
    in_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (rows.withColumn("_at", F.row_number().over(in_slot))
            .join(F.broadcast(table), "virtual_slot")
            .select(F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("begin") + F.col("_at") - 1).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
