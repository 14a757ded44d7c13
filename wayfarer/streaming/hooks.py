"""Hooks: what a host does with the events of a batch, by event type.

Prompt hooks answer: each has a time budget, and one that fails or takes longer is left out of the answers. Detached hooks run after them without a budget and without an answer.
No hook stops a batch. A hook gets the batch's rows of its type as a DataFrame, with visitors where these are given, and the batch's number; what it does with them is
Spark's work like any other.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, wait

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.base import with_visitors

BUDGET_SECONDS = 5.0
Hook = Callable[[DataFrame, int], object]
log = logging.getLogger(__name__)


class Hooks:
    """Registered hooks; deliver's handler, or a part of one."""

    def __init__(self, visitors: DataFrame | None = None, budget_seconds: float = BUDGET_SECONDS):
        self.visitors, self.budget = visitors, budget_seconds
        self.prompt: dict[str, list[Hook]] = defaultdict(list)
        self.detached: dict[str, list[Hook]] = defaultdict(list)

    def register(self, event_type: str, hook: Hook, detached: bool = False) -> None:
        (self.detached if detached else self.prompt)[event_type].append(hook)

    def __call__(self, batch: DataFrame, number: int) -> dict[str, list[object]]:
        """Run the hooks of the types that batch has; the answers of the prompt ones that came in time, by type."""
        wanted = sorted({*self.prompt, *self.detached})
        present = [r[0] for r in batch.where(F.col("event_type").isin(*wanted)).select("event_type").distinct().collect()] if wanted else []  # no more than are registered
        rows = {kind: self._rows(batch, kind) for kind in present}
        answers: dict[str, list[object]] = {}
        pool = ThreadPoolExecutor(max(1, sum(len(self.prompt[k]) + len(self.detached[k]) for k in present)))
        try:
            asked = [(k, pool.submit(hook, rows[k], number)) for k in sorted(present) for hook in self.prompt[k]]
            wait([f for _, f in asked], timeout=self.budget)
            for kind, future in asked:
                if not future.done():
                    log.warning("a hook of %s took longer than %s s", kind, self.budget)
                elif future.exception() is not None:
                    log.warning("a hook of %s failed: %s", kind, future.exception())
                else:
                    answers.setdefault(kind, []).append(future.result())
            loose = [(k, pool.submit(hook, rows[k], number)) for k in sorted(present) for hook in self.detached[k]]
            for kind, future in loose:
                if (error := future.exception()) is not None:
                    log.warning("a detached hook of %s failed: %s", kind, error)
        finally:
            pool.shutdown(wait=True)  # the batch ends when its hooks have
        return answers

    def _rows(self, batch: DataFrame, kind: str) -> DataFrame:
        rows = batch.where(F.col("event_type") == kind)
        return rows if self.visitors is None else with_visitors(rows, self.visitors)
