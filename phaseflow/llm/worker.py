"""State that Python workers keep from task to task.

Spark reuses a worker for whatever comes next, so what one operator keeps would take memory from the others. A worker
keeps the state of one operator: the first call of another clears it.
"""

from __future__ import annotations

from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}
_present = ""


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Names what frees the state of ``owner``."""
    _clear[owner] = clear


def enter(owner: str) -> None:
    """Says that ``owner`` runs now."""
    global _present
    if _present not in ("", owner) and _present in _clear:
        _clear[_present]()
    _present = owner
