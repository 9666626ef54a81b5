"""Exact deduplication by a distributed content sort.

Texts are equal when identical after deleting ASCII white space.  A hashed sample
of rows gives splitters; the splitters range-partition the normalised texts, Spark's
external sort places equal texts next to each other, and each row is compared in full
with its predecessor.  The sort key is the first ``HEAD_CHARS`` characters of the
normalised text and its SHA-256, then the whole normalised text, so a splitter stays
small however long the texts are.

A text that fills several splitters (a huge group of copies) gets as many partitions;
its rows are spread over them by identifier and the few runs are joined up afterwards.

Only DataFrame functions are used.  Nulls count as empty text; all empty texts form
one group.  Of equal texts the row with most code points in the original stays, then
the smallest identifier; of rows that are alike in both, exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.llm.common import ASCII_SPACE, text_or_empty

#: Characters of the normalised text that lead the sort key.
HEAD_CHARS = 64
#: Sampled rows for each partition; the driver holds this many keys of at most
#: ``HEAD_CHARS`` characters and a digest for each shuffle partition.
SAMPLES_PER_PARTITION = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, ASCII_SPACE, "")


def sort_key(norm: Column, digest: Column) -> Column:
    return F.concat(F.substring(norm, 1, HEAD_CHARS), F.lit("\u0000"), digest)


def splitters(rows: DataFrame, partitions: int) -> list[str]:
    """Keys that cut the sampled bytes into ``partitions`` near-equal ranges, in order.

    A key may occur several times: its text alone fills that many ranges.
    """
    total = rows.count()
    one_in = max(1, total // (partitions * SAMPLES_PER_PARTITION))
    sampled = (rows.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(one_in)) == 0)
               .select("_key", F.octet_length("_text").alias("_bytes"))
               .collect())
    sampled.sort(key=lambda r: r["_key"])
    every = sum(r["_bytes"] + 64 for r in sampled) / partitions
    cuts, filled = [], 0.0
    for r in sampled:
        filled += r["_bytes"] + 64
        while filled >= every * (len(cuts) + 1) and len(cuts) < partitions - 1:
            cuts.append(r["_key"])
    return cuts


def _range_of(key: Column, identifier: Column, cuts: list[str]) -> Column:
    """Number of splitters at or below the key; a repeated splitter's rows are spread."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    # two levels: the block, then the place within it
    block = F.size(F.filter(heads, lambda h: h <= key))
    inside = F.element_at(F.array(*[F.array(*[F.lit(s) for s in b]) for b in blocks]), F.greatest(block, F.lit(1)))
    at = F.when(block == 0, 0).otherwise((block - 1) * width + F.size(F.filter(inside, lambda s: s <= key)))
    repeated = {c: cuts.count(c) for c in set(cuts) if cuts.count(c) > 1}
    if repeated:
        copies = F.create_map(*[F.lit(x) for pair in sorted(repeated.items()) for x in pair])
        spread = F.coalesce(F.try_element_at(copies, key), F.lit(1))
        at = at - F.pmod(F.xxhash64(identifier, F.lit("spread")), spread.cast("long")).cast("int")
    return at


def _compared(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...], partitions: int | None) -> DataFrame:
    """``_id``, ``_key``, ``_head`` (the row stays), ``_keep``, ``_size`` and the ``_carry`` columns."""
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"),
                     F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_carry") if carry else F.lit(0).alias("_carry"))
    digest = F.sha2(normalised(F.col("_text")), 256)
    keyed = rows.withColumn("_key", sort_key(normalised(F.col("_text")), digest))
    cuts = splitters(keyed, partitions)
    repeated = sorted({c for c in cuts if cuts.count(c) > 1})

    dealt = (keyed.withColumn("_part", _range_of(F.col("_key"), F.col("_id"), cuts))
             .repartitionById(len(cuts) + 1, F.col("_part"))
             .withColumn("_chars", F.char_length("_text"))
             .withColumn("_norm", normalised(F.col("_text"))))
    in_order = Window.partitionBy("_part").orderBy("_key", "_norm", F.desc("_chars"), "_id")
    before = F.lag("_norm").over(in_order)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (dealt.withColumn("_head", before.isNull() | (before != F.col("_norm")))
            .withColumn("_run", F.sum(F.col("_head").cast("long")).over(so_far))
            .select("_id", "_carry", "_key", "_part", "_run", "_head"))
    run = Window.partitionBy("_part", "_run")
    found = (runs.withColumn("_size", F.count(F.lit(1)).over(run))
             .withColumn("_keep", F.max(F.when(F.col("_head"), F.col("_id"))).over(run)))
    return _joined_up(found, keyed.where(F.col("_key").isin(repeated))) if repeated else found


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                partitions: int | None = None) -> DataFrame:
    """One row for each input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Only the two named columns are read, so others may have any name.  An empty table
    gives an empty result.
    """
    found = _compared(df, id_col, text_col, (), partitions)
    return found.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
                        F.col("_size").alias("group_size"), F.col("_head").alias("kept"),
                        F.substring_index("_key", "\u0000", -1).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                partitions: int | None = None) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = _compared(df, id_col, text_col, tuple(df.columns), partitions)
    return found.where("_head").select("_carry.*")


def _joined_up(found: DataFrame, hot: DataFrame) -> DataFrame:
    """The runs of each text that was spread over several ranges become one.

    ``hot`` has at most half as many texts as there are partitions, so what is
    broadcast is bounded by the partition count.
    """
    hot = hot.select("_key", "_id", F.char_length("_text").alias("_chars"))
    most = hot.groupBy("_key").agg(F.max("_chars").alias("_chars"), F.count(F.lit(1)).alias("_all"))
    whole = (hot.join(F.broadcast(most), ["_key", "_chars"])
             .groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_all").alias("_all")))
    same = F.col("_id").eqNullSafe(F.col("_first"))
    return (found.join(F.broadcast(whole), "_key", "left")
            .withColumn("_head", F.col("_head") & (F.col("_all").isNull() | same))
            .withColumn("_keep", F.when(F.col("_all").isNull(), F.col("_keep")).otherwise(F.col("_first")))
            .withColumn("_size", F.coalesce("_all", "_size")))
