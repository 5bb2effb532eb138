"""A registry that lives as long as the Python process.

Functions of this package reach the Python workers by value, so a module global is new in
every task. Workers are reused across tasks; what is costly to build (a model, a
tokenizer) is kept here under a string key and built once per worker process.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any

_NAME = "_pairmine_process_cache"


def process_cached(key: str, build: Callable[[], Any]) -> Any:
    store = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def process_latest(slot: str, key: str, build: Callable[[], Any]) -> Any:
    """Like ``process_cached``, but a slot holds the value of its latest key only: for values
    of which a long-lived worker meets many, one after the other (models fitted per run)."""
    store = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    held = store.get(slot)
    if held is None or held[0] != key:
        held = store[slot] = (key, build())
    return held[1]
