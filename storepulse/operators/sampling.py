"""Exact-size deterministic sampling without a global sort.

``exact_hash_select`` flags, in every stratum, exactly ``k`` rows: those with
the smallest ``md5(seed|tag|key)``.  A naive ``ORDER BY random LIMIT k`` (or
``row_number`` over a whole store) funnels a stratum into one task; here the
k-th smallest hash of each stratum is found by histograms:

1. counts by the first ``HEX`` hexadecimal digits of the hash (at most
   16^HEX rows per stratum, map-side combined); a running count over them
   finds the bucket that holds the k-th row and how many are needed there;
2. the same by the next ``HEX`` digits, within that bucket;
3. what is left, about n / 16^(2·HEX) rows per stratum, is ranked, which
   gives the cut-off hash.

One pass over the input then compares each row's hash with the cut-off of its
stratum.  A null stratum is a stratum like any other; with k ≥ n every row is
selected, with k ≤ 0 or null none.  The key identifies a row: rows that share
it are selected together or not at all.  The draw is a pure function of
(seed, key): a recomputed task after an executor loss selects the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storepulse.operators.ranking import join_null_safe

#: Hexadecimal digits of the hash that each histogram counts by.
HEX = 4


def hash_hex(seed, tag: str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(key).cast("string")))


def _narrowed(rows: DataFrame, need: DataFrame, strata: list[str], at: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the bucket that holds the last needed row, how many are needed there) per stratum.

    ``need`` has ``_need``, the number of rows to take of each stratum."""
    bucketed = rows.withColumn("_b", F.substring("_h", at, digits))
    counts = bucketed.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    counts = join_null_safe(counts.withColumn("_upto", F.sum("_n").over(running)), need, strata)
    last = (counts.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
            .select(*strata, "_b", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")))
    inside = join_null_safe(bucketed, last.drop("_need"), [*strata, "_b"], "left_semi")
    return inside.drop("_b"), last.drop("_b")


def exact_hash_select(df: DataFrame, key: str, k_of_total: Callable[[Column], Column], seed=42,
                      tag: str = "sample", strata: Sequence[str] = (), flag: str = "selected",
                      digits: int = HEX, stage=None) -> DataFrame:
    """Add boolean ``flag``: true for exactly ``k`` rows per stratum, where
    ``k = k_of_total(stratum_row_count)`` (may reference strata columns).

    ``stage(name, df) -> df`` may persist the two or three columns that are read
    for each histogram, and the strata's last hashes."""
    strata = list(strata)
    lean = df.select(*strata, hash_hex(seed, tag, key).alias("_h"))
    if stage is not None:
        lean = stage(f"hashes_{tag}", lean)
    total = F.count(F.lit(1)).alias("_total")
    sizes = (lean.groupBy(*strata).agg(total) if strata else lean.agg(total))
    sizes = sizes.withColumn("_need", F.coalesce(k_of_total(F.col("_total")).cast("bigint"), F.lit(0)))
    some = sizes.where((F.col("_need") > 0) & (F.col("_need") < F.col("_total"))).drop("_total")
    rest, need = _narrowed(lean, some, strata, 1, digits)
    rest, need = _narrowed(rest, need, strata, 1 + digits, digits)
    in_order = Window.partitionBy(*strata).orderBy("_h")
    cut = (join_null_safe(rest.withColumn("_row", F.row_number().over(in_order)), need, strata)
           .where("_row = _need").select(*strata, F.col("_h").alias("_cut")))
    # a hash has 32 digits, so "g" is above all of them and "" below
    sizes = sizes.withColumn("_all", F.when(F.col("_need") >= F.col("_total"), F.lit("g")).otherwise(F.lit("")))
    if strata:
        cuts = join_null_safe(sizes.select(*strata, "_all"), cut, strata, "left")
    else:
        cuts = sizes.select("_all").crossJoin(F.broadcast(cut.agg(F.max("_cut").alias("_cut"))))
    cuts = cuts.select(*strata, F.coalesce("_cut", "_all").alias("_cut"))
    if strata and stage is not None:
        cuts = stage(f"cuts_{tag}", cuts)        # its size is known then, so a few strata are joined without a shuffle of all rows
    return (join_null_safe(df.withColumn("_h", hash_hex(seed, tag, key)), cuts, strata, "left")
            .withColumn(flag, F.col("_h") <= F.col("_cut")).drop("_h", "_cut"))
