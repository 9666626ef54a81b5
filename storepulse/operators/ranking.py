"""Exact ranks over large data without a single-partition window.

``Window.orderBy(...)`` with no partition (or a partition that grows with
the data) moves every row of that partition into one task.  The operators here
compute the same numbers distributedly from ``cumulative_counts``, by one path
at every size:

1. collapse equal values: ``groupBy(partition, value).count()`` (partial
   aggregation: a value shared by a third of all rows is one row here);
2. deal the distinct values out by Spark's range partitioner and store them
   with the number of the range that they went to, so that everything after
   sees the same ranges, whatever is run again;
3. per range: total count → exclusive running total over the ranges (a window
   over at most as many rows per partition as there are ranges);
4. inside a range: running count of the values before it (window
   partitioned by partition × range).

Every distinct value then knows ``_before`` = number of rows strictly before
it.  ``exact_rank`` = 1 + ``_before``; ``exact_percentiles`` picks the values
whose row span covers the interpolation positions of each group (for whole
columns see ``operators.selection``).  A null partition value is a partition
like any other: every join is null-safe.  Nothing is collected.  The input is
read once for step 2, which runs when the function is called, and once where
ranks are joined back.  Values are numbers, dates or timestamps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storepulse.sources.tables import staged


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null equals null; without columns, ``right`` is one row that every row gets."""
    if not on:
        return left.crossJoin(F.broadcast(right))
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(right, cond, how).drop(*[f"_on_{c}" for c in on])


def cumulative_counts(df: DataFrame, value_col: str, partition_cols: Sequence[str] = (), desc: bool = False,
                      width: int | None = None) -> DataFrame:
    """Distinct non-null (partition, value) rows with ``_n`` (multiplicity),
    ``_before`` (rows of the partition strictly before the value in order) and
    ``_total`` (rows of the partition).  ``width`` is the number of ranges, by
    default that of shuffle partitions."""
    P = list(partition_cols)
    v = F.col(value_col)
    width = width or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vals = df.filter(v.isNotNull()).groupBy(*P, value_col).agg(F.count(F.lit(1)).alias("_n"))
    ranged = staged(vals.repartitionByRange(width, *P, value_col).withColumn("_range", F.spark_partition_id()), "ranges")
    per_range = ranged.groupBy(*P, "_range").agg(F.sum("_n").alias("_rows"))
    whole = Window.partitionBy(*P)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per_range.withColumn("_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
               .withColumn("_total", F.sum("_rows").over(whole)).drop("_rows"))
    inner = Window.partitionBy(*P, "_range").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_off") + F.coalesce(F.sum("_n").over(inner), F.lit(0))
    if desc:
        before = F.col("_total") - F.col("_n") - before
    return (join_null_safe(ranged, offsets, [*P, "_range"]).withColumn("_before", before.cast("bigint"))
            .drop("_off", "_range"))


def exact_rank(df: DataFrame, value_col: str, out: str = "rank", desc: bool = True, width: int | None = None,
               partition_cols: Sequence[str] = ()) -> DataFrame:
    """RANK() OVER (PARTITION BY partition_cols ORDER BY value [DESC] NULLS LAST).

    ``df`` is read twice; stage it first where it is costly to compute."""
    P = list(partition_cols)
    c = cumulative_counts(df, value_col, P, desc, width)
    ranked = c.select(*P, value_col, (F.col("_before") + 1).cast("bigint").alias(out))
    # nulls come after all values of their partition
    nulls = df.groupBy(*P).agg(F.count(value_col).alias("_n")) if P else df.agg(F.count(value_col).alias("_n"))
    nulls = nulls.select(*P, F.lit(None).cast(dict(df.dtypes)[value_col]).alias(value_col),
                         (F.col("_n") + 1).alias(out))
    return join_null_safe(df, ranked.unionByName(nulls), [*P, value_col], "left")


def exact_percentiles(df: DataFrame, value_col: str, qs: Sequence[float], partition_cols: Sequence[str] = (),
                      width: int | None = None, prefix: str = "p") -> DataFrame:
    """Exact linear-interpolation percentiles per partition, one column per q
    (named ``{prefix}{i}``) — the same numbers as ``percentile(value, q)``:
    position = q·(n−1); result = (hi−pos)·v[lo] + (pos−lo)·v[hi].  A partition
    without a value gets nulls, as does a whole table without one."""
    P = list(partition_cols)
    rows = df.select(*P, F.col(value_col).cast("double").alias("_x"))
    c = cumulative_counts(rows, "_x", P, False, width)
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("_total") - 1).cast("double") * float(q)
        lo, hi = F.floor(pos), F.ceil(pos)
        cover = lambda k: (F.col("_before") <= k) & (k < F.col("_before") + F.col("_n"))
        aggs += [F.max(F.when(cover(lo), F.col("_x"))).alias(f"_lo{i}"),
                 F.max(F.when(cover(hi), F.col("_x"))).alias(f"_hi{i}"),
                 F.max(pos).alias(f"_pos{i}")]
    g = c.groupBy(*P).agg(*aggs) if P else c.agg(*aggs)
    if P:
        g = join_null_safe(rows.select(*P).distinct(), g, P, "left")
    outs = []
    for i in range(len(qs)):
        pos, vlo, vhi = F.col(f"_pos{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}")
        lo, hi = F.floor(pos).cast("double"), F.ceil(pos).cast("double")
        outs.append(F.when((lo == hi) | (vlo == vhi), vlo)
                    .otherwise((hi - pos) * vlo + (pos - lo) * vhi).alias(f"{prefix}{i}"))
    return g.select(*P, *outs)
