"""DuckDB oracle SQL for every registered query (see ``oracle_sql()``)."""

from __future__ import annotations

from oracle import analytics, operators
from oracle.base import with_tables


def oracle_sql() -> dict[str, str]:
    bodies = {**analytics.SQL, **operators.SQL}
    # a report written as SQL text gives the rows of the DataFrame report
    from storepulse.plans.sql_reports import REPORTS
    bodies |= {k: bodies[k.removeprefix("sql_")] for k in REPORTS}
    return {k: with_tables(v) for k, v in bodies.items()}
