"""All registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations


def all_queries() -> dict:
    from pairmine.plans import mining_queries

    out = {}
    out.update(mining_queries.QUERIES)
    from pairmine.plans import io_queries, mt_queries, prep_queries, sweep_queries

    for m in (sweep_queries, mt_queries, prep_queries, io_queries):
        out.update(m.QUERIES)
    return out
