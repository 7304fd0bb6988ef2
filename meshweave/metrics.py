"""Phase timer and summaries of repeated runs."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from statistics import fmean, pstdev

from .sinks import timing_json


class Timer:
    """Collects named phases and counters."""

    def __init__(self) -> None:
        self.phases: list[tuple[str, float]] = []
        self.counters: dict[str, int] = {}

    @contextmanager
    def phase(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.phases.append((name, time.perf_counter() - began))

    def json(self) -> str:
        return timing_json(self.phases, self.counters)


def repeated(run: Callable[[], object], runs: int = 1, warmups: int = 2) -> dict[str, float]:
    """Mean, population deviation, least and greatest seconds of ``runs`` after ``warmups``."""
    for _ in range(max(0, warmups)):
        run()
    took = []
    for _ in range(max(1, runs)):
        began = time.perf_counter()
        run()
        took.append(time.perf_counter() - began)
    return {"mean": fmean(took), "std": pstdev(took), "min": min(took), "max": max(took)}
