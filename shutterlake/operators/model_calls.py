"""Calls of injected models: tried again after passing errors, then the next model."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any


class Unavailable(Exception):
    """A passing failure of a model: overload, a lost connection, a rate limit; ``after`` seconds are asked for where given."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message, after)
        self.after = after


def call(models: Sequence[Callable[[Any], Any]], argument: Any, waits: Sequence[float] = (2, 8, 32), sleep: Callable[[float], None] = time.sleep) -> tuple[Any, int]:
    """(result, number of the model that gave it).

    A model is called once and, after each :class:`Unavailable`, again when the
    next of ``waits`` is over, or what the failure asks for instead. Then the next
    model is called likewise; the last one's failure is raised. Any other error,
    such as a refused request, is raised at once, since no model would take it.
    """
    if not models:
        raise ValueError("no model is given")
    for number, model in enumerate(models):
        for turn in range(len(waits) + 1):
            try:
                return model(argument), number
            except Unavailable as failure:
                if turn < len(waits):
                    sleep(waits[turn] if failure.after is None else failure.after)
                elif number == len(models) - 1:
                    raise
    raise AssertionError("unreachable")
