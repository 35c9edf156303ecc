"""State that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types

_HOLDER = "leakguard_worker_state"


def worker_state() -> dict:
    """A dictionary of this process; it outlives a task and the pickled code of a stage."""
    return sys.modules.setdefault(_HOLDER, types.ModuleType(_HOLDER)).__dict__


def release() -> None:
    """Forget it: other work than encoding needs the memory more."""
    worker_state().clear()
