"""Driver-side timers of a job's phases, with rates, as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager


class Timers:
    """Seconds and items of each phase of a job, in the order in which they ended."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock = clock
        self.phases: list[tuple[str, float, int]] = []

    @contextmanager
    def phase(self, name: str, items: int = 0) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.phases.append((name, self.clock() - began, items))

    def rows(self) -> list[tuple[str, float, int, float | None, float | None]]:
        """(phase, seconds, items, items a second, seconds an item) of each phase, and of all under "total"."""
        every = [*self.phases, ("total", sum(s for _, s, _ in self.phases), max((n for _, _, n in self.phases), default=0))]
        return [(name, s, n, n / s if s > 0 else None, s / n if n else None) for name, s, n in every]
