"""Data profiling: nulls, duplicates, numeric summaries, shapes, key duplicates.

Each profile is one aggregation per table (all columns at once) followed by
an in-row unpivot (``inline`` of an array of structs) — never a loop of
per-column jobs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storepulse.functions.exprs import exact_mean, exact_round
from storepulse.operators.selection import column_percentiles
from storepulse.sources.fixtures import bounded
from storepulse.sources.tables import staged

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def profile_nulls(df: DataFrame, table: str) -> DataFrame:
    """D1: per column with nulls: null count, null % (2 dp) and type."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(c).isNull().cast("int")).cast("bigint").alias(f"_c{i}") for i, c in enumerate(cols)])
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("null_count"),
                              F.lit(types[c]).alias("dtype")) for i, c in enumerate(cols)])
    return (agg.select("_n", F.inline(rows)).filter(F.col("null_count") > 0)
            .select(F.lit(table).alias("table_name"), "column_name", "null_count",
                    exact_round(F.col("null_count").cast("double") / F.col("_n").cast("double") * 100, 2)
                    .alias("null_pct"), "dtype"))


def _row_digest(cols: list[str]) -> list:
    """Two 64-bit digests of a row; equal rows, nulls alike included, have equal ones."""
    nulls = F.array(*[F.col(c).isNull() for c in cols])       # a hash passes over a null itself
    return [F.xxhash64(nulls, *cols).alias("d1"), F.xxhash64(F.lit(0x5EED), nulls, *reversed(cols)).alias("d2")]


def profile_duplicates(df: DataFrame, table: str) -> DataFrame:
    """D2: fully duplicated rows beyond the first.

    Rows are counted by a 128-bit digest, so what is shuffled for them does not grow with their
    width.  A row whose digest is its own equals no other; those whose digest repeats are compared
    in full, so that a collision does not change the result.  The digests that repeat are stored
    before the plan is returned: up to a number of them no other row is shuffled."""
    rows = df.toDF(*[f"_{i}" for i in range(len(df.columns))])       # no name that clashes with those below
    digested = rows.select("*", *_row_digest(rows.columns))
    digests = digested.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    again = staged(digests.where("n > 1").select("d1", "d2"), f"repeated_{table}")
    # rows of a digest lie together where they were shuffled to meet it
    compared = (digested.join(bounded(again), ["d1", "d2"], "left_semi")
                .groupBy("d1", "d2", *rows.columns).agg(F.count(F.lit(1)).alias("n"))
                .groupBy("d1", "d2").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different"))
                .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", "different")]))
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(F.broadcast(compared)).select(
        F.lit(table).alias("table_name"), "rows", (F.col("rows") - F.col("n") + F.col("different")).alias("distinct_rows"),
        (F.col("n") - F.col("different")).alias("duplicate_rows"))


def _scale(dt) -> int:
    return dt.scale if isinstance(dt, T.DecimalType) else 0


QUARTILES = [0.25, 0.5, 0.75]


def describe_numeric(df: DataFrame, table: str, accuracy: int | None = None) -> DataFrame:
    """D3/G10: count, mean, std, min, quartiles (exact, linear), max of every
    numeric column, rounded to 2 dp, one row per column.

    Quartiles come from radix selection over all columns at once, before the plan is returned;
    all else is one aggregate.  ``accuracy`` opts into ``percentile_approx`` quartiles in that
    aggregate instead.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    exact = column_percentiles(df, {f.name: QUARTILES for f in fields}) if accuracy is None and fields else {}
    aggs, rows = [], []
    for i, f in enumerate(fields):
        c = F.col(f.name)
        x = c.cast("double")
        mean = exact_mean(c, _scale(f.dataType)) if not isinstance(f.dataType, (T.FloatType, T.DoubleType)) \
            else F.avg(x)
        aggs += [F.count(c).alias(f"_n{i}"), exact_round(mean, 2).alias(f"_m{i}"),
                 exact_round(F.stddev_samp(x), 2).alias(f"_s{i}"), F.min(x).alias(f"_lo{i}"),
                 F.max(x).alias(f"_hi{i}")]
        if accuracy is not None:
            aggs.append(F.percentile_approx(x, QUARTILES, accuracy).alias(f"_q{i}"))
        quartiles = [F.lit(v).cast("double") for v in exact[f.name]] if exact else [F.col(f"_q{i}")[k] for k in range(3)]
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"_n{i}").alias("count"), F.col(f"_m{i}").alias("mean"),
            F.col(f"_s{i}").alias("std"), exact_round(F.col(f"_lo{i}"), 2).alias("min"),
            *[exact_round(q, 2).alias(n) for q, n in zip(quartiles, ["p25", "p50", "p75"])],
            exact_round(F.col(f"_hi{i}"), 2).alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*rows))).select(
        F.lit(table).alias("table_name"), "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def table_shape(df: DataFrame, table: str) -> DataFrame:
    """D4: rows × columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(table).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))


def duplicate_key_count(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """D5: rows vs distinct keys (nulls count as one key, like a group-by)."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("distinct_keys")) \
        .select(F.lit(table).alias("table_name"), F.lit(",".join(key)).alias("key_columns"), "rows",
                "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("duplicate_keys"))


def profile_tables(tables: dict[str, DataFrame], fn, **kw) -> DataFrame:
    """One profile of several tables.  Jobs that a profile runs itself are submitted together."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return _union(list(pool.map(lambda t: fn(t[1], t[0], **kw), tables.items())))
