"""Exact distinct counts from mergeable bitmaps.

``member_bitmaps`` numbers the distinct keys densely and keeps, for each group and each block of
``32768`` numbers, the bitmap of the keys that the group holds.  Bitmaps of one block can be
joined by OR, so one stored table gives exact distinct counts of the groups themselves and of any
union of groups, without the keys: ``distinct_counts`` has no exchange of keys, only of bitmaps.

Numbers are dealt inside buckets of a key's hash, each of which holds a bounded share of the keys,
so no step sorts or funnels all of them.  ``home`` names a column in which a key's rows mostly
agree (an order's store): keys of one home are numbered next to each other, which keeps the
bitmaps of its groups dense and few.  A key that lies in several homes is numbered in the least of
them and still counts once.  A null key does not count; null group values are groups like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one bitmap, fixed by ``bitmap_construct_agg``.
POSITIONS = 32768
#: Keys of one home that a bucket holds on average; what goes beyond ``POSITIONS`` starts a further block.
BUCKET = 8000
#: Partitions for each bucket, so that few buckets share one: a task's rows are bounded whatever the input.
SPREAD = 4

_BLOCK = ["_home", "_bucket", "_chunk"]


def bucket_count(df: DataFrame, key: str, home: str | None = None, bucket: int = BUCKET) -> int:
    """How many buckets keep the keys of the largest home within ``bucket`` each.  A sketch is enough: it
    decides how dense the bitmaps are, never what they count."""
    rough = df.groupBy(*([home] if home else [])).agg(F.approx_count_distinct(key).alias("n")).agg(F.max("n")).first()[0]
    return max(1, -(-(rough or 0) // bucket))


def member_bitmaps(df: DataFrame, groups: Sequence[str], key: str, home: str | None = None, buckets: int = 1) -> DataFrame:
    """``groups``, a block of numbers (``_home``, ``_bucket``, ``_chunk``) and the ``members`` bitmap of each."""
    groups = list(groups)
    cells = df.where(F.col(key).isNotNull()).select(
        *groups, F.col(key).alias("_key"), (F.col(home) if home else F.lit(0)).cast("string").alias("_home"),
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"))
    cells = cells.repartition(SPREAD * buckets, "_bucket").distinct()     # the one exchange of keys; all windows below keep to it
    same = Window.partitionBy("_bucket", "_key")
    order = Window.partitionBy("_bucket", "_home").orderBy("_key")
    numbered = (cells.withColumn("_home", F.min("_home").over(same)).withColumn("_number", F.dense_rank().over(order) - 1)
                .withColumn("_chunk", F.floor(F.col("_number") / POSITIONS).cast("int")))
    return numbered.groupBy(*groups, *_BLOCK).agg(
        F.bitmap_construct_agg((F.col("_number") % POSITIONS).cast("long")).alias("members"))


def distinct_counts(bitmaps: DataFrame, groups: Sequence[str], out: str = "distinct_keys") -> DataFrame:
    """Distinct keys of each group; ``groups`` may be any of the columns that the bitmaps are kept by, or none."""
    groups = list(groups)
    joined = bitmaps.groupBy(*groups, *_BLOCK).agg(F.bitmap_count(F.bitmap_or_agg("members")).alias("_n"))
    count = F.sum("_n").cast("bigint").alias(out)
    return joined.groupBy(*groups).agg(count) if groups else joined.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias(out))
