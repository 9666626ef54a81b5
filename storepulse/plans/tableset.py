"""The table sets every named query runs on.

Pipeline, as in the reference: derive raw tables → clean → (load) → query.
The raw, cleaned and updated sets are *materialized once* per input
fingerprint as Parquet in the shared store (``session.store_dir``):

* the tables of the cleaned set are built one by one, when a query first reads
  them, with those that their cleaning needs (``cleaning.STEPS``); the audit
  closes the whole set;
* shuffle files of a build are removed as soon as each of its jobs is done, and
  the jobs of large inputs run one after another, so that the disk holds the
  shuffles of one of them;
* every report query then reads compact cleaned tables instead of
  re-deriving and re-cleaning the inputs (at 100 TB the cleaning job is the
  expensive part and must not run once per report);
* lineage is cut at the written tables, so a lost executor only recomputes
  from the Parquet files, never from the start;
* a builder writes a folder of its own and publishes it last, by a small
  pointer file that names it; readers follow the pointer, so they never see
  half a set, and nothing is renamed.  What a build stages is removed when it
  is done.

``STOREPULSE_MATERIALIZE=0`` (or ``materialize=False``) keeps everything as
one lazy plan — used to inspect end-to-end plans.
"""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor
import os
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from storepulse.operators.cleaning import STEPS, clean_all, clean_and_write, with_parents
from storepulse.operators.mutations import update_script
from storepulse.operators.profiling import NUMERIC
from storepulse.plans.summaries import BUILDERS, TableSet
from storepulse.session import store_dir
from storepulse.sources.fixtures import TPCH_TABLES, raw_tables
from storepulse.sources.schemas import AUDIT, RAW_SCHEMAS, TABLE_NAMES
from storepulse.sources import tables as IO
from storepulse.sources.tables import read_table, shuffles_removed, write_table

LAYOUT_VERSION = "v2"
_MEMO: dict[tuple[str, str], dict[str, DataFrame]] = {}


_CODE = ["sources/fixtures.py", "sources/schemas.py", "operators/cleaning.py", "operators/ranking.py", "operators/selection.py", "operators/sampling.py",
         "operators/mutations.py", "operators/distinct.py", "functions/exprs.py", "sources/tables.py", "plans/summaries.py", "plans/tableset.py"]


def _code_version() -> str:
    """Hash of the modules that decide the stored tables' content: any change
    to derivation or cleaning code writes a new set instead of reusing one."""
    import importlib
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1(LAYOUT_VERSION.encode())
    for rel in _CODE:
        try:
            with open(os.path.join(root, rel), "rb") as f:
                h.update(f.read())
        except OSError:   # shipped as a zip/egg: hash the compiled code instead
            mod = importlib.import_module("storepulse." + rel[:-3].replace("/", "."))
            for obj in vars(mod).values():
                code = getattr(obj, "__code__", None)
                if code is not None:
                    h.update(code.co_code)
    return h.hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _input_stamp(spark: SparkSession, path: str) -> str:
    """Size, number of files and modification time of an input, on any Hadoop
    file system: two calls, however many files it has."""
    fs, p = _fs(spark, path)
    held = fs.getContentSummary(p)
    return f"{held.getLength()}:{held.getFileCount()}:{fs.getFileStatus(p).getModificationTime()}"


_FINGERPRINTS: dict[tuple[str, str], str] = {}
_BYTES: dict[tuple[str, str], int] = {}
#: Bytes of input from which a job fills a cluster of some size by itself.
LARGE = 1 << 30


def _fingerprint(sf_dir: str, spark: SparkSession) -> str:
    """Stamp of inputs and code, taken once per session and path."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FINGERPRINTS:
        parts = [os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir, _code_version()]
        stamps = [_input_stamp(spark, f"{sf_dir}/{n}.parquet") for n in TPCH_TABLES]
        _BYTES[key] = sum(int(stamp.split(":")[0]) for stamp in stamps)
        parts += [f"{n}:{stamp}" for n, stamp in zip(TPCH_TABLES, stamps)]
        _FINGERPRINTS[key] = hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]
    return _FINGERPRINTS[key]


def submitted(spark: SparkSession, sf_dir: str, jobs: Iterable, run: Callable, at_once: int = 4) -> list:
    """``run`` of each of some independent jobs, together from driver threads; one after another where the input is large,
    as the disk then holds the shuffles of one alone."""
    _fingerprint(sf_dir, spark)
    with ThreadPoolExecutor(max_workers=1 if _BYTES[spark.sparkContext.applicationId, sf_dir] >= LARGE else at_once) as pool:
        return list(pool.map(run, jobs))


def _namespace() -> str:
    return os.environ.get("STOREPULSE_NAMESPACE", "shared")


def _published(spark: SparkSession, pointer: str) -> str | None:
    """The folder that the pointer file names, if there is one."""
    fs, p = _fs(spark, pointer)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip() or None
    finally:
        stream.close()


def _publish(spark: SparkSession, final: str, build) -> str:
    """Build a set in a folder of its own, then point ``{final}.current`` at it.

    Of concurrent builders the last one's pointer stays; every folder that a pointer has
    named is complete.  Returns the folder to read."""
    pointer = f"{final}.current"
    there = _published(spark, pointer)
    if there:
        return there
    base = f"{final}-{uuid.uuid4().hex[:12]}"
    with shuffles_removed(spark):
        build(base)
    _drop_stage(spark, base)
    _point(spark, pointer, base)
    return base


def _drop_stage(spark: SparkSession, base: str) -> None:
    fs, stage = _fs(spark, f"{base}/stage")
    fs.delete(stage, True)


def _point(spark: SparkSession, pointer: str, base: str) -> None:
    fs, p = _fs(spark, pointer)
    stream = fs.create(p, True)
    stream.write(bytearray(base.encode()))
    stream.close()


def _root(spark: SparkSession, sf_dir: str) -> str:
    return f"{store_dir(spark)}/storepulse/{_namespace()}/{_fingerprint(sf_dir, spark)}"


def published(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """The folder of a derived result of these inputs; ``build(folder)`` writes it the first time."""
    return _publish(spark, f"{_root(spark, sf_dir)}/{name}", build)


def staging(spark: SparkSession, base: str):
    """``stage(name, df)`` for the build of ``base``: ``df`` written beside it and read back, until the build is done."""
    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/stage/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/stage/{name}")
    return stage


def _shared_keys(spark: SparkSession, sf_dir: str):
    """``stage`` for ``raw_tables``: orders ⋈ customer, written once for all sets of these inputs."""
    def stage(name: str, df: DataFrame) -> DataFrame:
        path = published(spark, sf_dir, f"parts/{name}", lambda base: df.write.option("compression", "zstd").parquet(f"{base}/{name}"))
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")
    return stage


def _built(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, str]:
    """The folders of cleaned tables and of those that they need; the missing ones are derived, cleaned and written
    (no raw copy is)."""
    waves = with_parents(names)
    folders = {t: _published(spark, f"{_root(spark, sf_dir)}/parts/clean_{t}.current") for wave in waves for t in wave}
    missing = [t for t, folder in folders.items() if not folder]
    raw = raw_tables(spark, sf_dir, _shared_keys(spark, sf_dir), lines=True, names=missing) if missing else {}

    def make(t: str) -> str:
        def build(base: str) -> None:
            parents = [_clean_table(spark, folders[p], p) for p in STEPS[t][1]]
            rows = clean_and_write(t, raw[t], parents, lambda df: IO.write_table(df, f"{base}/{t}", t), staging(spark, base))
            # a few rows of counts observed during the write
            spark.createDataFrame(rows, AUDIT).coalesce(1).write.parquet(f"{base}/cleaning_audit")
        return published(spark, sf_dir, f"parts/clean_{t}", build)

    for wave in waves:      # the tables of one wave do not need each other
        new = [t for t in wave if not folders[t]]
        folders.update(zip(new, submitted(spark, sf_dir, new, make, at_once=3)))
    return folders


def _clean_table(spark: SparkSession, folder: str, name: str, month: bool = False) -> DataFrame:
    return read_table(spark, f"{folder}/{name}", name, "parquet", clean=True, month=month)


def _clean_audit(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the audit of all tables, which says that the whole set is there."""
    def build(base: str) -> None:
        folders = _built(spark, sf_dir, TABLE_NAMES)
        rows = [tuple(r) for t in STEPS for r in _clean_table(spark, folders[t], "cleaning_audit").collect()]
        spark.createDataFrame(rows, AUDIT).coalesce(1).write.parquet(f"{base}/cleaning_audit")
    return published(spark, sf_dir, "clean", build)


def _materialize_clean(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Cleaned tables, each derived, cleaned and written when a query first needs it, and the audit."""
    whole = {*names} >= {"cleaning_audit"} or {*names} >= {*TABLE_NAMES}
    audit = {"cleaning_audit": _clean_audit(spark, sf_dir)} if whole else {}
    folders = _built(spark, sf_dir, [t for t in names if t in STEPS]) | audit
    return {t: _clean_table(spark, folders[t], t, month=True) for t in names}


def _numeric(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)])


def _raw_folders(spark: SparkSession, sf_dir: str, kind: str, names) -> dict[str, str | None]:
    """Where raw tables are stored, each under its own pointer."""
    return {t: _published(spark, f"{_root(spark, sf_dir)}/{kind}_{t}.current") for t in names}


def _numeric_schema(name: str) -> StructType:
    return StructType([f for f in RAW_SCHEMAS[name].fields if isinstance(f.dataType, NUMERIC)])


def _materialize_raw(spark: SparkSession, sf_dir: str, names, numeric: bool = False) -> dict[str, DataFrame]:
    """Raw (pre-cleaning) tables, each written only when a query needs it; with ``numeric``, their numeric columns."""
    kind, root = "raw_numeric" if numeric else "raw", _root(spark, sf_dir)
    folders = _raw_folders(spark, sf_dir, kind, names)
    missing = [t for t in names if not folders[t]]
    if missing:
        base = f"{root}/{kind}-{uuid.uuid4().hex[:12]}"
        both = {"fact_orders", "fact_order_items"} <= set(missing)        # they share orders ⋈ customer
        raw = raw_tables(spark, sf_dir, _shared_keys(spark, sf_dir) if both else None, names=missing)

        def write(t: str) -> None:
            df = _numeric(raw[t]) if numeric else raw[t]
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/{t}")

        with shuffles_removed(spark):
            submitted(spark, sf_dir, missing, write)
        for t in missing:
            _point(spark, f"{root}/{kind}_{t}.current", base)
            folders[t] = base
    if numeric:
        return {t: spark.read.schema(_numeric_schema(t)).parquet(f"{folders[t]}/{t}") for t in names}
    return {t: read_table(spark, f"{folders[t]}/{t}", t, "parquet") for t in names}


def _materialize_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned orders as the update script leaves them."""
    def build(base: str) -> None:
        # no row changes its month, so the orders stay where the cleaned set has them: no shuffle deals them out anew
        updated = update_script(clean_set(spark, sf_dir)["fact_orders"], stage=staging(spark, base))
        write_table(updated.sortWithinPartitions("order_month", "store_id"), f"{base}/fact_orders", "fact_orders")

    return _clean_table(spark, published(spark, sf_dir, "updated", build), "fact_orders", month=True)


def _summaries(spark: SparkSession, sf_dir: str, kind: str, tables: Callable[[], dict[str, DataFrame]]):
    """The summaries of a stored set by name, each written when it is first asked for."""
    def stored(name: str) -> DataFrame:
        key = _memo_key(spark, sf_dir, f"{kind}_{name}")
        if key not in _MEMO:
            path = published(spark, sf_dir, f"{kind}_{name}", lambda base: BUILDERS[name](tables()).write.parquet(f"{base}/{name}"))
            _MEMO[key] = spark.read.parquet(f"{path}/{name}")
        return _MEMO[key]
    return stored


def _use_materialized(materialize: bool | None) -> bool:
    if materialize is not None:
        return materialize
    return os.environ.get("STOREPULSE_MATERIALIZE", "1") != "0"


def _memo_key(spark: SparkSession, sf_dir: str, kind: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, f"{_namespace()}/{_fingerprint(sf_dir, spark)}/{kind}"


def clean_set(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Cleaned eight tables (+ ``cleaning_audit``), each materialized when it is first read."""
    if not _use_materialized(None):
        return clean_tables(spark, sf_dir)
    names = [*TABLE_NAMES, "cleaning_audit"]

    def opened(wanted: Sequence[str]) -> dict[str, DataFrame]:
        keys = {t: _memo_key(spark, sf_dir, f"clean_{t}") for t in wanted}
        new = [t for t in wanted if keys[t] not in _MEMO]
        if new:
            _MEMO.update({keys[t]: df for t, df in _materialize_clean(spark, sf_dir, new).items()})
        return {t: _MEMO[key] for t, key in keys.items()}

    return TableSet({}, _summaries(spark, sf_dir, "clean", lambda: clean_set(spark, sf_dir)), names, opened)


def clean_tables(spark: SparkSession, sf_dir: str, materialize: bool | None = None) -> dict[str, DataFrame]:
    """Cleaned eight tables (+ ``cleaning_audit``), all of them there."""
    if not _use_materialized(materialize):
        clean, audit = clean_all(raw_tables(spark, sf_dir))
        clean["cleaning_audit"] = audit
        return clean
    return clean_set(spark, sf_dir).whole()


def raw_table_set(spark: SparkSession, sf_dir: str, materialize: bool | None = None, names=tuple(TABLE_NAMES),
                  numeric: bool = False) -> dict[str, DataFrame]:
    """The eight raw tables, or those of ``names`` (materialized on first use); ``numeric``: only their numeric columns."""
    if not _use_materialized(materialize):
        raw = raw_tables(spark, sf_dir, names=names)
        return {t: _numeric(raw[t]) if numeric else raw[t] for t in names}
    whole = {t: _memo_key(spark, sf_dir, f"raw_{t}") for t in names}
    if numeric and all(_raw_folders(spark, sf_dir, "raw", names).values()):
        return {t: _numeric(df) for t, df in raw_table_set(spark, sf_dir, True, names).items()}
    if numeric:
        return _materialize_raw(spark, sf_dir, names, numeric=True)
    if any(key not in _MEMO for key in whole.values()):
        for t, df in _materialize_raw(spark, sf_dir, names).items():
            _MEMO[whole[t]] = df
    return {t: _MEMO[key] for t, key in whole.items()}


def raw_read_once(spark: SparkSession, sf_dir: str, names=tuple(TABLE_NAMES), stage: bool = False) -> dict[str, DataFrame]:
    """Raw tables for a query that reads each of them once: the stored ones if all of them are there, else derived as they
    are read, so that what the query does not use is neither worked out nor written.  ``stage``: orders ⋈ customer is written once."""
    if _use_materialized(None) and all(_raw_folders(spark, sf_dir, "raw", names).values()):
        return raw_table_set(spark, sf_dir, names=names)
    return raw_tables(spark, sf_dir, _shared_keys(spark, sf_dir) if stage else None, names=names)


def updated_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The cleaned tables after the update script (materialized when they are first read)."""
    clean = clean_set(spark, sf_dir)

    def opened(wanted: Sequence[str]) -> dict[str, DataFrame]:
        key = _memo_key(spark, sf_dir, "updated_fact_orders")
        if "fact_orders" in wanted and key not in _MEMO:
            _MEMO[key] = _materialize_updated(spark, sf_dir)
        return {t: _MEMO[key] if t == "fact_orders" else clean[t] for t in wanted}

    return TableSet({}, _summaries(spark, sf_dir, "updated", lambda: updated_tables(spark, sf_dir)), [*clean], opened)


def table_sets(spark: SparkSession, sf_dir: str, materialize: bool | None = None):
    """(raw, clean) table dicts; clean also holds ``cleaning_audit``."""
    return raw_table_set(spark, sf_dir, materialize), clean_tables(spark, sf_dir, materialize)
