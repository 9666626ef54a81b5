"""Raw tables are stored one by one, and only for queries that read them more than once."""

import os

import pytest

import __spark_entry__ as E
from conftest import SMALL
from storepulse.operators import profiling as D
from storepulse.plans import operator_queries as Q
from storepulse.plans import tableset as S
from storepulse.sources.fixtures import raw_tables
from storepulse.sources.schemas import TABLE_NAMES


@pytest.fixture
def stored(spark, monkeypatch, request):
    """The pointers of a store of its own."""
    monkeypatch.setenv("STOREPULSE_NAMESPACE", f"test-{request.node.name}-{os.getpid()}")
    root = S._root(spark, SMALL)
    return lambda: sorted(n[:-8] for n in (os.listdir(root) if os.path.exists(root) else []) if n.endswith(".current"))


def rows(df):
    return sorted(map(str, df.collect()))


def test_dedup_keep_first_stores_the_raw_orders_alone(spark, stored):
    out = rows(E.queries()["dedup_keep_first"](spark, SMALL))
    assert stored() == ["raw_fact_orders"]
    assert out == rows(Q.dedup_keep_first(raw_tables(spark, SMALL)))


def test_key_joins_store_no_raw_table(spark, stored):
    out = {n: rows(E.queries()[n](spark, SMALL)) for n in ("anti_join_orphans", "semi_join_fk", "rows_before_after")}
    assert stored() == ["clean"]
    raw = S.raw_table_set(spark, SMALL)
    assert stored() == ["clean", *sorted(f"raw_{t}" for t in TABLE_NAMES)]
    clean = S.clean_tables(spark, SMALL)
    for n, got in out.items():
        assert got == rows(getattr(Q, n)(raw, clean)) == rows(E.queries()[n](spark, SMALL))


def test_csv_source_stores_no_parquet_copy(spark, stored):
    out = rows(E.queries()["csv_source"](spark, SMALL))
    assert stored() == ["csv_source"]
    raw = raw_tables(spark, SMALL)
    assert out == rows(Q._all([Q.checksums(raw[t], "csv", t) for t in TABLE_NAMES]))


def test_describe_numeric_stores_numeric_columns_alone(spark, stored):
    out = rows(E.queries()["describe_numeric"](spark, SMALL))
    assert stored() == sorted(f"raw_numeric_{t}" for t in TABLE_NAMES)
    raw = S.raw_table_set(spark, SMALL)
    assert out == rows(D.profile_tables(raw, D.describe_numeric)) == rows(E.queries()["describe_numeric"](spark, SMALL))


def test_updated_orders_stay_in_their_months(spark, stored, monkeypatch):
    seen, real = [], S.write_table
    monkeypatch.setattr(S, "write_table", lambda df, path, name, **k: (seen.append((name, df)), real(df, path, name, **k)))
    clean = S.clean_tables(spark, SMALL)
    seen.clear()
    updated = S.updated_tables(spark, SMALL)["fact_orders"]
    (name, written), = seen
    assert name == "fact_orders" and "order_month" in written.columns      # not dealt out by month again
    assert updated.where("not (order_month <=> date_format(order_date, 'yyyy-MM'))").count() == 0
    from storepulse.operators.mutations import update_script
    want = update_script(clean["fact_orders"].drop("order_month"))
    assert rows(updated.select(*want.columns)) == rows(want)
