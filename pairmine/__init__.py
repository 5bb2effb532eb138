"""pairmine: a Spark-native engine that mines, scores, sweeps, evaluates and packs
parallel sentence corpora.

Layout
  sources/    readers, writers and stage tables (S*, K*), dense file-order index (W8)
  functions/  column expressions (F*, P1, F15)
  operators/  table-to-table operators: exact top-k join, scoring, quality, selection,
              run metrics, translation metrics, training-data preparation
  plans/      whole jobs composed from operators: mining, sweep, evaluation
  streaming/  incremental scoring of new candidate pairs (the resume path)
"""

from pairmine.session import get_spark, stage_root  # noqa: F401

__all__ = ["get_spark", "stage_root"]


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers need no install."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - an installed package works without it
        pass


_ship_by_value()
