"""DuckDB oracle SQL for the registered queries (tests and the driver's check)."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from pairmine.oracles.mining import sql_mining

    out = dict(sql_mining())
    from pairmine.oracles import files, mt, prep, sweep

    for m in (sweep, mt, prep, files):
        out.update(m.sql())
    return out
