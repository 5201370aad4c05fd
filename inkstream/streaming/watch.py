"""Watching streams: which of them have been silent for too long."""

from __future__ import annotations

import time
from collections.abc import Callable
from threading import Lock

from pyspark.sql.streaming import StreamingQueryListener


class Silence(StreamingQueryListener):
    """Reports a running query once when no rows have come for `seconds`, and again after it has spoken and fallen silent.

    `report` gets the query's name or id and how long it has been silent.  Progress and idle events look at all queries;
    `look` may be called at any other time, as by a timer of the caller's."""

    def __init__(self, seconds: float, report: Callable[[str, float], None], clock: Callable[[], float] = time.monotonic):
        self.seconds, self.report, self.clock = seconds, report, clock
        self.spoke: dict[str, float] = {}
        self.names: dict[str, str] = {}
        self.told: set[str] = set()
        self.lock = Lock()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            run = str(event.runId)
            self.names[run], self.spoke[run] = event.name or str(event.id), self.clock()

    def onQueryProgress(self, event) -> None:
        if event.progress.numInputRows > 0:
            with self.lock:
                self.spoke[str(event.progress.runId)] = self.clock()
                self.told.discard(str(event.progress.runId))
        self.look()

    def onQueryIdle(self, event) -> None:
        self.look()

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            for held in (self.spoke, self.names):
                held.pop(str(event.runId), None)
            self.told.discard(str(event.runId))

    def look(self) -> None:
        now = self.clock()
        with self.lock:
            late = [(run, now - at) for run, at in self.spoke.items() if now - at > self.seconds and run not in self.told]
            self.told.update(run for run, _ in late)
            names = [(self.names.get(run, run), silent) for run, silent in late]
        for name, silent in names:
            self.report(name, silent)
