"""Objects kept by a Python worker from one task to the next."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def kept(key: object, make: Callable[[], object]) -> object:
    """``make()``, made once in this process for each ``key``; at most 64 keys are kept."""
    store = sys.modules.setdefault("_tickloom_kept", types.ModuleType("_tickloom_kept")).__dict__.setdefault("objects", {})
    if key not in store:
        if len(store) >= 64:
            store.clear()
        store[key] = make()
    return store[key]
