"""State that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import Any


def per_worker(key: str, make: Callable[[], Any]) -> Any:
    """The value under ``key`` in this process, made on first use. Only for what can be made again at any time."""
    kept = sys.modules.setdefault("orrery_worker_state", ModuleType("orrery_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
