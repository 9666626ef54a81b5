"""Table IO: schema-first readers, writers, view registration, exports.

* ``read_table`` reads CSV (header, explicit schema — never inferred) or
  Parquet with the table's StructType.
* ``write_table`` writes Parquet (or CSV); fact tables are partitioned by
  order month so date filters prune files.
"""

from __future__ import annotations

import contextlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.session import store_dir
from storepulse.sources.schemas import AUDIT, RAW_SCHEMAS, clean_schema


def month_of(date_col: str = "order_date"):
    return F.date_format(date_col, "yyyy-MM")


def is_monthly(name: str, df: DataFrame) -> bool:
    """Fact tables are stored by order month."""
    return name.startswith("fact_") and "order_date" in df.columns


def by_month(df: DataFrame) -> DataFrame:
    """``df`` with ``order_month``, dealt out by it for a partitioned write.

    The rebalance hint lets Spark split a large month over several tasks and put small
    ones together, by size, at run time.  Files are sorted by store, so that a reader of
    some stores skips pages and row groups of others by their least and greatest value.
    A table that has its month already has been dealt out and sorted."""
    if "order_month" in df.columns:
        return df
    dealt = df.withColumn("order_month", month_of()).hint("rebalance", "order_month")
    return dealt.sortWithinPartitions("order_month", "store_id") if "store_id" in df.columns else dealt


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "csv", clean: bool = False,
               date_format: str = "yyyy-MM-dd", timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
               month: bool = False) -> DataFrame:
    """A table with its own schema.  ``month`` keeps the partition column of a stored fact table."""
    schema = AUDIT if name == "cleaning_audit" else clean_schema(name) if clean else RAW_SCHEMAS[name]
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("dateFormat", date_format)
                .option("timestampFormat", timestamp_format).option("mode", "FAILFAST").csv(path))
    names = [f.name for f in schema.fields]
    if month and name.startswith("fact_") and "order_date" in names:
        return spark.read.schema(schema.add("order_month", "string")).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*names)     # without a partition column


#: Rows of a compressed CSV file at most: it is read by one task.
CSV_ROWS = 1_000_000


def write_table(df: DataFrame, path: str, name: str, fmt: str = "parquet", mode: str = "overwrite",
                compression: str | None = None) -> None:
    """Facts as Parquet by order month, other tables as they are; CSV with a header.

    Parquet is compressed by zstd and CSV not at all unless ``compression`` says else."""
    if fmt == "csv":
        # values keep their outer blanks; cleaning trims them
        (df.drop("order_month").write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
         .option("compression", compression or "none").option("maxRecordsPerFile", CSV_ROWS if compression else 0)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    elif is_monthly(name, df):
        # a table that already has its month column has been dealt out by it
        out = df if "order_month" in df.columns else by_month(df)
        out.write.mode(mode).option("compression", compression or "zstd").partitionBy("order_month").parquet(path)
    else:
        df.write.mode(mode).option("compression", compression or "zstd").parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_CLEANING = {"depth": 0, "before": None}
_CLEANING_LOCK = threading.Lock()


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the actions inside are removed when each is done, and not at some collection of the driver's garbage.

    Where a plan of these is run once more, Spark makes the missing stages again.  The setting is put back at the end;
    of builds in several threads, by the last one."""
    with _CLEANING_LOCK:
        if not _CLEANING["depth"]:
            _CLEANING["before"] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _CLEANING["depth"] += 1
    try:
        yield
    finally:
        with _CLEANING_LOCK:
            _CLEANING["depth"] -= 1
            if not _CLEANING["depth"]:
                if _CLEANING["before"] is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, _CLEANING["before"])


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared store, read back; deleted when the application ends.

    For what several parts of a plan must see alike or should not compute again."""
    spark = df.sparkSession
    path = f"{store_dir(spark)}/storepulse/stage/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Expose a table set to ``spark.sql`` as temp views (IO4/IO5)."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def export_results(results: dict[str, DataFrame], out_dir: str) -> None:
    """IO6: write each result as a headed CSV folder.

    No ``coalesce(1)``: the picker table grows with the supplier table, so
    forcing one writer would funnel it through one task; AQE already
    collapses small results into few files.
    """
    for name, df in results.items():
        df.write.mode("overwrite").option("header", True).csv(f"{out_dir}/{name}")


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """IO8/U1: per-table row counts as one union, largest first."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.col("rows").desc(), "table_name")


def load_jdbc(tables: dict[str, DataFrame], url: str, properties: dict[str, str],
              batchsize: int = 10000, mode: str = "overwrite") -> None:
    """IO4: replace-load each table into a relational database in
    ``batchsize``-row insert batches (``df.write.jdbc``), one writer per
    partition.  Not exercised by the tests (no database is started here)."""
    for name, df in tables.items():
        df.write.option("batchsize", batchsize).option("truncate", "true").jdbc(
            url, name, mode=mode, properties=properties)
